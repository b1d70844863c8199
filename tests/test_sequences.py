"""Block-wise sequence alignment against a plain cell-by-cell table, with missing costs, ties, many blocks and several scan levels."""

import numpy as np
import pytest

from trajekt.operators import sequences as S

INF = float("inf")


def plain(costs, penalty):
    """The whole table at once, cell by cell: (pairs, skipped, total)."""
    n, m = costs.shape
    acc = {(0, 0): 0.0} | {(0, j): INF if penalty is None else penalty * j for j in range(1, m + 1)} | {(i, 0): INF for i in range(1, n + 1)}
    skips = {(0, j) for j in range(1, m + 1) if penalty is not None}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            match = costs[i - 1, j - 1] + min(acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
            passed = INF if penalty is None else acc[i, j - 1] + penalty
            acc[i, j] = min(match, passed)
            if passed < match:
                skips.add((i, j))
    pairs, skipped, i, j = [], [], n, m
    while j > 0 and (i > 0 or penalty is not None):
        if (i, j) in skips:
            skipped.append(j - 1)
            j -= 1
            continue
        pairs.append((i - 1, j - 1))
        around = [(acc[i - 1, j - 1], i - 1, j - 1), (acc[i - 1, j], i - 1, j), (acc[i, j - 1], i, j - 1)]
        least = min(a for a, _, _ in around)
        _, i, j = next(a for a in around if a[0] == least)
    return sorted(pairs), sorted(skipped), acc[n, m]


def tables():
    rng = np.random.default_rng(12)
    out = []
    for k in range(24):
        n, m = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        # few different values, so ties abound
        costs = rng.integers(0, 5, (n, m)) / 4 if k % 2 else rng.random((n, m)).round(3)
        if k % 3 == 0:
            costs[rng.random((n, m)) < 0.2] = INF
        out.append(costs.astype(float))
    out.append(np.full((7, 3), INF))
    return out


@pytest.mark.parametrize("penalty", [None, 0.25])
def test_blocks_and_scan_equal_the_whole_table(spark, penalty):
    given = tables()
    rows = [(f"s{k}", i, [None if v == INF else float(v) for v in row], penalty) for k, t in enumerate(given) for i, row in enumerate(t)]
    frame = spark.createDataFrame(rows, "session string, seg long, costs array<double>, pen double")
    for block, fan in ((3, 2), (1000, 128)):
        found = S.align_segments(frame, "session", "seg", "pen" if penalty else None, block, fan).collect()
        for k, t in enumerate(given):
            own = [r for r in found if r["session"] == f"s{k}"]
            pairs, skipped, total = plain(t, penalty)
            assert sorted((r["segment"], r["movement"]) for r in own if r["segment"] is not None) == pairs, (block, k)
            assert sorted(r["movement"] for r in own if r["segment"] is None) == skipped
            assert all(abs(r["total_cost"] - total) < 1e-6 or r["total_cost"] == total for r in own)
            assert all((r["cost"] is None) == (t[r["segment"], r["movement"]] == INF) for r in own if r["segment"] is not None)


def test_no_segments(spark):
    frame = spark.createDataFrame([], "session string, seg long, costs array<double>")
    assert S.align_segments(frame, "session", "seg").count() == 0


def test_matrices_combine_in_any_grouping():
    rng = np.random.default_rng(3)
    costs = S.whole(rng.random((9, 5)))
    whole, first, second, third = (S.transfer(costs[a:b], 40_000_000) for a, b in ((0, 9), (0, 2), (2, 6), (6, 9)))
    assert np.array_equal(S.through(S.through(first, second), third), whole)
    assert np.array_equal(S.through(first, S.through(second, third)), whole)
    row = S.first_row(5, 40_000_000)
    assert np.array_equal(S.through(row, whole), list(S.table_rows(row, costs, 40_000_000))[-1])
