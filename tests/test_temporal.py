import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajekt.operators import temporal as E
from trajekt.operators.blocks import runs
from trajekt.streaming import causal as C


def points(spark, xyz, valid=None):
    n = len(xyz)
    valid = np.ones(n, bool) if valid is None else valid
    rows = [("s", i, *(map(float, xyz[i]) if valid[i] else (None,) * 3)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, x double, y double, z double")


def columns(df, names):
    return {r["i"]: tuple(r[n] for n in names) for r in df.collect()}


def test_polynomial_fit_keeps_quadratics_at_edges(spark):
    t = np.arange(30.0)
    xyz = np.stack([t**2, 3 - t, 0.5 * t**2 + t], axis=1)
    valid = np.ones(30, bool)
    valid[[11, 20]] = False
    df = runs(points(spark, xyz, valid), ["k"], "i", F.col("x").isNotNull())
    got = columns(E.savgol_fit(df, ["k"], "i", "xyz", 7, 2), ["x_fit", "y_fit", "z_fit"])
    for i in range(30):
        assert got[i] == pytest.approx(tuple(xyz[i]), abs=1e-8) if valid[i] else got[i] == (None, None, None)


def test_robust_smoothing_removes_a_spike_and_keeps_gaps(spark):
    rng = np.random.default_rng(5)
    t = np.arange(60.0)
    xyz = np.stack([0.02 * t, 0.01 * t, np.ones(60)], axis=1) + rng.normal(0, 0.002, (60, 3))
    xyz[31] += 0.6
    valid = np.ones(60, bool)
    valid[45:48] = False
    out = columns(E.robust_savgol(points(spark, xyz, valid), ["k"], "i", "xyz", F.lit(True)), ["x_sm", "y_sm", "z_sm"])
    assert out[46] == (None, None, None)
    assert abs(out[31][0] - 0.62) < 0.25 < abs(xyz[31][0] - 0.62)


def test_short_gaps_only(spark):
    xyz = np.arange(36.0).reshape(12, 3)
    valid = np.array([1, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0], bool)
    out = E.fill_short_gaps(points(spark, xyz, valid), ["k"], "i", "xyz", F.lit(True), 2)
    got = {r.i: (r.x, r.provenance) for r in out.collect()}
    assert got[1] == (3.0, 2) and got[2] == (6.0, 2)
    assert got[6] == (None, 0) and got[11] == (None, 0) and got[0] == (0.0, 1)


def test_speed_of_constant_motion(spark):
    xyz = np.outer(np.arange(20.0), [0.3, 0.0, 0.4])
    got = columns(E.speed(points(spark, xyz), ["k"], "i", "xyz", 10.0), ["speed"])
    assert got[0] == (None,)
    assert all(got[i][0] == pytest.approx(5.0) for i in range(3, 17))


def test_smoothing_window_policy():
    assert E.smoothing_window(7, 1) == 7 and E.smoothing_window(7, 3) == 1 and E.smoothing_window(7, 3, 5) == 5
    with pytest.raises(ValueError):
        E.smoothing_window(4, 1)


def wide_frames(spark, n=40, cameras=2):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(cameras):
        base = rng.uniform(100, 500, (17, 2))
        for i in range(n):
            xy = base + 3 * i + rng.normal(0, 1.0, (17, 2))
            if i == 20:
                xy[9] += 900
            scores = rng.uniform(0.3, 1.0, 17)
            valid = rng.random(17) > 0.1
            rows.append((1, f"c{c}", i, int(i >= 28), xy[:, 0].tolist(), xy[:, 1].tolist(), scores.tolist(), valid.tolist()))
    return spark.createDataFrame(rows, C.FRAME)


def arrays(df):
    return {(r.camera_id, r.sample_idx): (tuple(r.xs), tuple(r.valid)) for r in df.collect()}


def test_batch_filter_equals_one_step_at_a_time(spark):
    frames = wide_frames(spark)
    got = arrays(C.causal_filter(frames))
    states = {}
    for r in frames.orderBy("camera_id", "sample_idx").collect():
        states[r.camera_id] = C.filter_step(states.get(r.camera_id), r.sample_idx, r.person_id, *C._frame_arrays(r), C.FilterSettings())
        want = C._output(r, states[r.camera_id])
        assert got[(r.camera_id, r.sample_idx)] == (tuple(want[4]), tuple(want[7]))


def test_streaming_filter_equals_batch_in_any_order_of_files(spark, tmp_path):
    frames = wide_frames(spark)
    source, sink, last = str(tmp_path / "in"), str(tmp_path / "out"), frames.agg(F.max("sample_idx")).first()[0]
    for k in (2, 0, 3, 1):
        frames.where(F.floor(F.col("sample_idx") / 10) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for turn in range(2):
        query = C.causal_filter_stream(stream, delay="3 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
        query.trigger(availableNow=True).start(sink).awaitTermination()
        if turn == 0:
            spark.createDataFrame([(-1, "end", last + 300, 0, [], [], [], [])], C.FRAME).write.mode("append").parquet(source)
    assert arrays(spark.read.schema(C.FRAME).parquet(sink)) == arrays(C.causal_filter(frames))


def test_reordering_stream_equals_batch_and_gives_late_frames_apart(spark, tmp_path):
    """Frames within the delay are applied in order; one that comes after its turn leaves as it was, marked late, and the rest is the batch result without it."""
    frames = wide_frames(spark)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    turn = F.floor(F.col("sample_idx") / 10) + F.when(F.col("sample_idx") % 4 == 1, 1).otherwise(0)
    lost = F.col("sample_idx") == 5
    dealt = frames.withColumn("turn", F.when(lost, 99).otherwise(turn))
    turns = sorted(r[0] for r in dealt.select("turn").distinct().collect())
    for k in turns:
        dealt.where(F.col("turn") == k).drop("turn").coalesce(1).write.mode("append").parquet(source)
    ends = [(s, c, 10_000, 0, [], [], [], []) for s, c in {(r.session_id, r.camera_id) for r in frames.select("session_id", "camera_id").collect()}]
    spark.createDataFrame(ends, C.FRAME).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(source)
    job = C.causal_filter_reordered(stream, delay_frames=20).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
    job.trigger(availableNow=True).start(sink).awaitTermination()
    found = spark.read.schema(C.REORDERED).parquet(sink)
    assert arrays(found.where("not late").drop("late")) == arrays(C.causal_filter(frames.where(~lost)))
    assert arrays(found.where("late").drop("late")) == arrays(frames.where(lost))


def test_side_repair_leaves_the_face_alone():
    xy = np.stack([np.arange(17) * 40.0, np.full(17, 100.0)], axis=1)
    cfg = C.FilterSettings(repair_sides=True)
    first = C.filter_step(None, 0, 0, xy, np.ones(17), np.ones(17, bool), cfg)
    swapped = xy.copy()
    for a, b in ((1, 2), (3, 4), (9, 10)):
        swapped[[a, b]] = swapped[[b, a]]
    out = C.filter_step(first, 1, 0, swapped, np.ones(17), np.ones(17, bool), cfg)["xy"]
    assert np.allclose(out[[9, 10]], xy[[9, 10]])
    assert not np.allclose(out[[1, 2]], xy[[1, 2]]) and not np.allclose(out[[3, 4]], xy[[3, 4]])


def tracked(tracks, boxes, conf, ids):
    tracks.grow(1)
    dets = np.column_stack([np.array(boxes, float), conf, ids])[None]
    usable = tracks.usable(dets)
    shown, found = tracks.step(np.array([0]), dets, usable, C.best_detections(dets, usable, tracks.cfg.target_confidence))
    return (int(tracks.id[0]), bool(found[0])) if shown[0] else None


def test_tracker_keeps_identity_and_reacquires():
    tracks = C.Tracks(C.TrackSettings(reacquire_after=3, lost_buffer=2))
    me, decoy = [100, 100, 200, 300], [600, 100, 900, 500]
    assert tracked(tracks, [me, decoy], [0.9, 0.7], [1, 2]) == (1, True)
    assert tracked(tracks, [decoy, me], [0.99, 0.3], [2, 1])[0] == 1
    seen = [tracked(tracks, [decoy], [0.9], [2]) for _ in range(4)]
    assert seen == [(1, False), (1, False), (2, True), (2, True)]


def test_box_updates_are_bounded():
    box = np.array([[100.0, 100.0, 200.0, 300.0]])
    moved = C.followed(box, box + np.array([900, 0, 900, 0]), np.array([1]), (1280, 720))[0]
    assert 0 < moved[0] - 100 < 0.35 * 0.31 * np.hypot(100, 200)
    assert np.allclose(C.steadied(box, box, 0.35, 0.12), box)


def test_series_step_together_as_they_do_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(1, f"c{c}", i * (1 + c % 2), *(float(v) for v in corner), *(float(v) for v in corner + rng.uniform(20, 300, 2))) for c in range(5) for i in range(30) for corner in [rng.uniform(0, 400, 2)]]
    boxes = spark.createDataFrame(rows, "session_id int, camera_id string, sample_idx bigint, x0 double, y0 double, x1 double, y1 double")
    got = {(r.camera_id, r.sample_idx): (r.x0, r.y0, r.x1, r.y1) for r in C.track_boxes(boxes.repartition(3)).collect()}
    for c in range(5):
        held, last = None, 0
        for r in sorted((r for r in rows if r[1] == f"c{c}"), key=lambda r: r[2]):
            seen = np.array([r[3:]])
            held, last = seen if held is None else C.followed(held, seen, np.array([r[2] - last]), (1280, 720)), r[2]
            assert np.allclose(got[(r[1], r[2])], held[0])
    assert len(got) == len(rows)


def test_long_recordings_arrive_in_few_steps_and_equal_the_batch_form(spark, tmp_path):
    """Many turns make a step, so triggers don't grow with the recording; late frames cross the ends of steps, and none is lost."""
    from trajekt.plans import streaming_queries as S

    assert S.turns_in_step(0) == 1 and S.turns_in_step(60_000) == 84 and S.turns_in_step(10**9) == S.MOST_TURNS
    frames, source = S.view_frames(spark, "/root/testdata/sf0.001"), str(tmp_path / "in")
    S.arriving(spark, "/root/testdata/sf0.001", source, delay=2)
    came = spark.read.schema(C.FRAME).parquet(source).select("_metadata.file_modification_time").distinct().count()
    assert frames.agg(F.max("sample_idx")).first()[0] // 2 + 2 > S.STEPS and came <= S.STEP_FILES * (S.STEPS // 2 + 2) + 1
    found = S.filtered_stream(spark, "/root/testdata/sf0.001", delay=2)
    rows = lambda df: {(r.session_id, r.camera_id, r.sample_idx): (tuple(r.xs), tuple(r.ys), tuple(r.scores), tuple(r.valid)) for r in df.collect()}
    assert found.where("late").isEmpty() and rows(found) == rows(C.causal_filter(frames))


def test_short_runs_need_no_quantiles_by_bucket_and_long_ones_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xyz, valid = rng.normal(0, 0.02, (60, 3)).cumsum(axis=0), np.ones(60, bool)
    xyz[[12, 40]] += 1.5
    valid[[20, 21, 33]] = False
    smoothed = lambda: columns(E.robust_savgol(points(spark, xyz, valid), ["k"], "i", "xyz", F.lit(True)), ["x_sm", "y_sm", "z_sm"])
    with monkeypatch.context() as m:
        m.setattr(E, "exact_quantiles", None)
        short = smoothed()
    monkeypatch.setattr(E, "BLOCK_ROWS", 14)
    assert short == smoothed()
    assert abs(short[40][0] - xyz[40][0]) > 0.5 and short[20] == (None, None, None)


def test_stability_fits_raw_and_smoothed_points_in_one_pass(spark, monkeypatch):
    """Before, the runs and the windows of every series were built twice, once for each kind."""
    from trajekt.plans import quality_queries as Q

    rng, fits, fit = np.random.default_rng(3), [], E.savgol_fit
    raw = rng.normal(0, 1, (2, 40, 2)).cumsum(axis=1)
    smooth = raw + rng.normal(0, 0.1, raw.shape)
    rows = [("s", j, i, *(None if i == 20 else float(v) for v in (*raw[j, i], *smooth[j, i]))) for j in range(2) for i in range(40)]
    points = spark.createDataFrame(rows, "session_id string, joint_idx int, sample_idx long, x double, y double, x_sm double, y_sm double")
    monkeypatch.setattr(Q.E, "savgol_fit", lambda *a, **k: (fits.append(1), fit(*a, **k))[1])
    row = Q.stability(points, ["session_id", "joint_idx"], "session_id", "sample_idx", ["x", "y"], ["x_sm", "y_sm"]).first()
    assert len(fits) == 1

    box = np.sqrt(((raw.max(axis=0) - raw.min(axis=0)) ** 2).sum(axis=1))

    def ratio(values):
        out = []
        for j in range(2):
            for start, stop in ((0, 20), (21, 40)):
                part, hat = values[j, start:stop], E.polynomial_hat(11, 2)
                for p in range(stop - start):
                    a = min(max(p - 5, 0), stop - start - 11)
                    out.append(np.linalg.norm(part[p] - hat[p - a] @ part[a:a + 11]) / box[start + p])
        return np.median(out)

    assert row["comparable_samples"] == 78
    assert np.allclose([row["raw_ratio"], row["stable_ratio"]], [ratio(raw), ratio(smooth)], rtol=1e-9)
