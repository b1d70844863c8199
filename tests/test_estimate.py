import numpy as np
import pytest
from pyspark.sql import functions as F

from trajekt.operators import align as A
from trajekt.operators import estimate as D
from trajekt.operators import evaluate as V
from trajekt.operators import rules as R
from trajekt.operators import sequences as S
from trajekt.plans import tables as T

K = np.array(T.intrinsics()).reshape(3, 3)
MATS = {c: np.array(m).reshape(3, 4) for c, m in T.CAMERAS.items()}


def seen(xyz, camera, shift=(0.0, 0.0)):
    h = MATS[camera] @ np.append(xyz, 1.0)
    return float(h[0] / h[2] + shift[0]), float(h[1] / h[2] + shift[1])


@pytest.fixture(scope="module")
def rigs(spark):
    cams = [(c, T.intrinsics(), m) for c, m in T.CAMERAS.items()]
    return spark.createDataFrame([(1, cams)], "session_id int, cams array<struct<camera_id: string, k: array<double>, p: array<double>>>")


def solve(spark, rigs, rows, **kw):
    df = spark.createDataFrame(rows, "session_id int, sample_idx long, joint_idx int, camera_id string, px double, py double, score double")
    packed = D.pack_views(df, ["session_id", "sample_idx", "joint_idx"], 0.3)
    out = D.triangulate(packed, rigs, "session_id", ["session_id", "sample_idx", "joint_idx"], **kw)
    return {(r.sample_idx, r.joint_idx): r for r in out.collect()}


def test_points_are_recovered_and_a_bad_camera_is_left_out(spark, rigs):
    rng = np.random.default_rng(2)
    world = rng.uniform(-0.8, 0.8, (30, 3))
    rows = []
    for i, p in enumerate(world):
        for c in MATS:
            bad = c == "c2" and i % 3 == 0
            rows.append((1, i, 0, c, *seen(p, c, (150.0, -90.0) if bad else (0.0, 0.0)), 0.9))
    got = solve(spark, rigs, rows)
    assert len(got) == 30
    for i, p in enumerate(world):
        r = got[(i, 0)]
        assert np.allclose([r.x, r.y, r.z], p, atol=1e-6)
        assert r.used_views == (["c0", "c1", "c3"] if i % 3 == 0 else ["c0", "c1", "c2", "c3"])


def test_the_only_clean_pairs_may_have_the_lowest_scores():
    rng = np.random.default_rng(9)
    angles = np.arange(9) * 0.6
    mats = []
    for a in angles:
        r = np.array([[np.cos(a), 0.0, np.sin(a)], [0.0, 1.0, 0.0], [-np.sin(a), 0.0, np.cos(a)]])
        mats.append(K @ np.hstack([r, [[0.1 * np.sin(a)], [0.0], [4.0]]]))
    mats = np.broadcast_to(np.array(mats), (20, 9, 3, 4))
    world = rng.uniform(-0.5, 0.5, (20, 3))
    h = np.einsum("bnij,bj->bni", mats, np.hstack([world, np.ones((20, 1))]))
    pixels = h[..., :2] / h[..., 2:]
    # four of nine cameras are far off, in different directions, and have the best scores: 26 pairs rank above the first clean one
    pixels[:, :4] += np.array([[300.0, 500.0], [-450.0, 260.0], [520.0, -410.0], [-280.0, -640.0]])
    scores = np.tile(np.r_[np.full(4, 0.99), np.full(5, 0.4)], (20, 1))
    ks = np.broadcast_to(K, (20, 9, 3, 3))
    xyz, _, mask, _ = D.solve_views(pixels, mats, ks, scores, 2, 25.0)
    assert np.allclose(xyz, world, atol=1e-6)
    assert not mask[:, :4].any() and mask[:, 4:].all()
    assert np.isnan(D.solve_views(pixels, mats, ks, scores, 2, 25.0, max_hypotheses=6)[0]).all()


def test_refinement_lowers_pixel_error(spark, rigs):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        p = rng.uniform(-0.5, 0.5, 3)
        rows += [(1, i, 0, c, *seen(p, c, rng.normal(0, 3, 2)), 0.9) for c in MATS]
    fine, rough = solve(spark, rigs, rows), solve(spark, rigs, rows, refine=False)
    both = [k for k in fine if k in rough]
    assert np.mean([fine[k].reproj_px for k in both]) <= np.mean([rough[k].reproj_px for k in both]) + 1e-6


def test_repeated_observations_count_once(spark, rigs):
    p = np.array([0.1, 0.2, 0.3])
    rows = [(1, 0, 0, "c0", *seen(p, "c0"), 0.9)] * 50 + [(1, 0, 0, "c1", *seen(p, "c1"), 0.8)]
    got = solve(spark, rigs, rows)
    assert got[(0, 0)].used_cameras == 2


def test_two_parallel_views_are_refused(spark, rigs):
    p = np.array([0.1, 0.2, 0.3])
    assert solve(spark, rigs, [(1, 0, 0, "c0", *seen(p, "c0"), 0.9)]) == {}


def test_rotation_average(spark):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [("a", *[float(v) for v in (q + rng.normal(0, 1e-3, (3, 3))).ravel()]) for _ in range(20)]
    names = [f"r{i}" for i in range(9)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names))
    r = D.average_rotations(df, ["k"], names).first()
    m = np.array([r[n] for n in names]).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m, q, atol=2e-3)


def matched(spark, pred, truth):
    rows = [("s", f, j, *map(float, pred[f, j]), *map(float, truth[f, j])) for f in range(pred.shape[0]) for j in range(pred.shape[1])]
    return spark.createDataFrame(rows, "session_id string, sample_idx long, joint_idx int, x double, y double, z double, gx double, gy double, gz double")


def test_translation_shows_only_in_the_global_error(spark):
    rng = np.random.default_rng(7)
    pred = rng.normal(size=(6, 17, 3))
    df = matched(spark, pred, pred + np.array([0.10, -0.20, 0.30]))
    assert df.agg(F.avg(V.point_error())).first()[0] * 1000 == pytest.approx(374.1657, abs=1e-4)
    rooted = V.root_relative(df, ["session_id", "sample_idx"], "joint_idx", 11, 12).agg(F.max("root_error")).first()[0]
    aligned = V.procrustes(df, ["session_id", "sample_idx"]).agg(F.max("aligned_error")).first()[0]
    assert rooted == pytest.approx(0.0, abs=1e-12) and aligned == pytest.approx(0.0, abs=1e-9)


def test_similarity_is_removed_but_mirroring_is_not(spark):
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    pred = rng.normal(size=(4, 17, 3))
    same = V.procrustes(matched(spark, pred, 1.7 * pred @ q + 3.0), ["session_id", "sample_idx"]).agg(F.max("aligned_error")).first()[0]
    flipped = V.procrustes(matched(spark, pred, pred * np.array([1, 1, -1])), ["session_id", "sample_idx"]).agg(F.avg("aligned_error")).first()[0]
    assert same < 1e-9 and flipped > 0.1


def test_bootstrap_interval_brackets_the_mean(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(50, 8, 400)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "session_id string, i long, v double")
    r = V.bootstrap_ci(df, "session_id", "i", "v", samples=400).first()
    half = 1.96 * v.std() / np.sqrt(len(v))
    assert r.ci_low == pytest.approx(v.mean() - half, abs=0.5 * half) and r.ci_high == pytest.approx(v.mean() + half, abs=0.5 * half)


@pytest.mark.parametrize("n,size", [(1000, 64), (64, 64), (65, 64), (3, 8), (513, 8)])
def test_block_draws_of_a_resample_sum_to_its_frames(n, size):
    blocks = -(-n // size)
    draws = np.stack([V.block_draws(7, "s", n, b, size, 500) for b in range(blocks)])
    assert (draws.sum(axis=0) == n).all() and (draws >= 0).all()
    share = draws.mean(axis=1) / n
    assert np.allclose(share, [min(size, n - b * size) / n for b in range(blocks)], atol=0.02)
    assert np.array_equal(draws[0], V.block_draws(7, "s", n, 0, size, 500))


def test_bootstrap_in_blocks_has_the_spread_of_the_mean(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(10, 2, 900)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("a", 1000 + i, None) for i in range(40)] + [("b", 0, 4.0)], "session_id string, i long, v double")
    rows = {r["session_id"]: r for r in V.bootstrap_ci(df, "session_id", "i", "v", samples=600, block=50).collect()}
    half = 1.96 * values.std() / 30
    assert abs(rows["a"]["ci_low"] - (values.mean() - half)) < 0.25 * half and abs(rows["a"]["ci_high"] - (values.mean() + half)) < 0.25 * half
    assert (rows["b"]["ci_low"], rows["b"]["ci_high"]) == (4.0, 4.0)


def test_greedy_match_equals_plain_loop(spark):
    rng = np.random.default_rng(12)
    rows, tol = [], 5
    for s in range(3):
        for c in "abc":
            for k, t in enumerate(sorted(rng.choice(400, 40, replace=False))):
                rows.append((s, c, int(t), f"{c}{k}"))
    df = spark.createDataFrame(rows, "s int, c string, t long, d string")
    got = {(r.s, r.reference, r.b, r.c) for r in A.greedy_match(df, "s", "c", "t", "d", "a", ["a", "b", "c"], tol, F.floor(F.col("t") / 50)).collect()}
    want = set()
    for s in range(3):
        pool = {c: [(t, d) for q, e, t, d in rows if q == s and e == c] for c in "abc"}
        for t, d in sorted(pool["a"]):
            pick = []
            for c in "bc":
                near = min(pool[c], key=lambda x: (abs(x[0] - t), x[0]), default=None)
                if near is None or abs(near[0] - t) > tol:
                    break
                pick.append(near)
            if len(pick) == 2:
                want.add((s, d, pick[0][1], pick[1][1]))
                for c, p in zip("bc", pick):
                    pool[c].remove(p)
    assert got == want


def brute_cost(costs, penalty):
    n, m = costs.shape
    best = {}

    def go(i, j):
        if i == 0 and j == 0:
            return 0.0
        if (i, j) in best:
            return best[(i, j)]
        out = np.inf
        if i > 0 and j > 0:
            out = costs[i - 1, j - 1] + min(go(i - 1, j - 1), go(i - 1, j), go(i, j - 1))
        if j > 0 and penalty is not None:
            out = min(out, go(i, j - 1) + penalty)
        best[(i, j)] = out
        return out

    return go(n, m)


@pytest.mark.parametrize("penalty", [None, 0.25])
def test_alignment_is_cheapest_and_monotone(penalty):
    rng = np.random.default_rng(13)
    for _ in range(30):
        costs = rng.random((rng.integers(1, 7), rng.integers(1, 6)))
        limit = None if penalty is None else int(S.whole(penalty))
        walk = S.Walk(S.first_row(costs.shape[1], limit), S.whole(costs), limit)
        pairs, skipped, out = walk.cells(costs.shape[1])
        skipped = [*range(out), *skipped]
        assert walk.last[-1] * S.UNIT == pytest.approx(brute_cost(costs, penalty))
        assert pairs == sorted(pairs)
        covered = {j for _, j in pairs} | set(skipped)
        assert covered == set(range(costs.shape[1])) and (penalty is not None or not skipped)


def test_anchor_spread_stays_ordered_and_inside(spark):
    df = spark.createDataFrame([(10, 40, ["a", "b", "c", "d"]), (5, 6, ["a", "b", "c"]), (7, 9, ["a"]), (1, 2, [])], "s long, e long, p array<string>")
    got = [[a.frame for a in r.x] for r in df.select(R.spread_anchors(F.col("p"), F.col("s"), F.col("e")).alias("x")).collect()]
    assert got == [[10, 20, 30, 40], [5, 6, 6], [7], []]


def test_interval_decisions(spark):
    rows = [("max", 0.0, 30.0, 33.0, 1.0, "confirmed_minor"), ("max", 0.0, 30.0, 28.0, 1.0, "within_range"), ("max", 0.0, 30.0, 30.5, 1.0, "boundary_uncertain"),
            ("range", 10.0, 20.0, 5.0, 1.0, "confirmed_minor"), ("range", 10.0, 20.0, 15.0, 1.0, "within_range"), ("range", 10.0, 20.0, None, 1.0, "not_measurable")]
    df = spark.createDataFrame(rows, "op string, lo double, hi double, v double, u double, want string")
    got = df.select("want", R.interval_status(F.col("op"), F.col("lo"), F.col("hi"), F.lit(0.5), F.col("v"), F.col("u"), F.lit(0.2)).alias("s")).collect()
    assert all(r.want == r.s for r in got)


def planted(kind, rng, frames=40):
    """Views of one camera that are wrong in a known way: (frame, joint, px, py, qx, qy)."""
    rows = []
    for f in range(frames):
        q = rng.uniform([300, 100], [900, 600], (17, 2))
        p = q + rng.normal(0, 0.5, q.shape)
        if kind == "shift":
            p = p + [60, -35]
        if kind == "swap":
            p = p[D.SWAP]
        if kind == "affine":
            p = p @ (1.05 * np.array([[np.cos(0.05), np.sin(0.05)], [-np.sin(0.05), np.cos(0.05)]])) + [40, 25]
            wrong = rng.random(17) < 0.35
            p[wrong] += rng.uniform(60, 200, (wrong.sum(), 2))
        rows += [("s", kind, f, j, *map(float, p[j]), *map(float, q[j])) for j in range(17)]
    return rows


def test_consensus_similarity_finds_planted_cameras(spark):
    rng = np.random.default_rng(17)
    kinds = ("healthy", "shift", "swap", "affine")
    rows = [r for kind in kinds for r in planted(kind, rng)] + [("s", "few", 0, 0, 1.0, 1.0, 2.0, 2.0), ("s", "null", 0, 0, None, 1.0, 2.0, 2.0)]
    views = spark.createDataFrame(rows, "session_id string, camera_id string, sample_idx long, joint_idx int, px double, py double, qx double, qy double")
    fits = {r["camera_id"]: r for r in D.consensus_similarity(views, ["session_id", "camera_id"]).collect()}
    assert "few" not in fits and "null" not in fits
    near = lambda r, a, b, x, y: np.allclose([r["fa"], r["fb"]], [a, b], atol=2e-3) and np.allclose([r["ftx"], r["fty"]], [x, y], atol=2.0)
    assert near(fits["healthy"], 1, 0, 0, 0) and near(fits["shift"], 1, 0, 60, -35)
    assert near(fits["affine"], 1.05 * np.cos(0.05), 1.05 * np.sin(0.05), 40, 25)
    found = D.camera_hypotheses(views.where("camera_id not in ('few', 'null')"), "session_id", "sample_idx").withColumns(
        {"target_count": F.when(F.col("camera_id") == "healthy", 0).otherwise(20), "bad_joints": F.when(F.col("camera_id") == "healthy", 0).otherwise(12), "bad_arm_joints": F.lit(0), "best_shift": F.lit(0), "best_shift_error": F.lit(1.0), "zero_shift_error": F.lit(1.0)}
    )
    got = {r["camera_id"]: r["c"] for r in found.select("camera_id", D.classify_camera().alias("c")).collect()}
    assert got == {"healthy": "healthy", "shift": "calibration_alignment_bias", "swap": "left_right_identity_mismatch", "affine": "calibration_alignment_bias"}


def test_consensus_similarity_reads_the_pairs_once_a_round_and_votes_without_lambdas(spark, monkeypatch):
    """A lambda over the proposals was interpreted 48 times for every pair, and each round of the refit read all pairs twice."""
    rng, sc, plans, fits = np.random.default_rng(5), spark.sparkContext, [], []
    rows = [r for kind in ("shift", "affine") for r in planted(kind, rng, 60)]
    views = spark.createDataFrame(rows, "session_id string, camera_id string, sample_idx long, joint_idx int, px double, py double, qx double, qy double")
    keep, fit = D.materialise, D.similarity_fit
    monkeypatch.setattr(D, "materialise", lambda df, label: (plans.append((label, df._jdf.queryExecution().toString())), keep(df, label))[1])
    monkeypatch.setattr(D, "similarity_fit", lambda *a: (fits.append(1), fit(*a))[1])

    def records():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = records()
    assert D.consensus_similarity(views, ["session_id", "camera_id"]).count() == 2
    # proposals, votes, one pass for each fit and the last, which finds the same inliers
    assert records() - before < len(rows) * (len(fits) + 3.5)
    assert len(fits) >= 1 and not any("lambdafunction" in plan for label, plan in plans if label == "consensus")
