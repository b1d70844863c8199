"""Block-wise windows against plain pandas, with blocks small enough that every edge is crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajekt.operators import blocks as B


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 120), ("a", 40), ("b", 7)):
        t = np.cumsum(rng.integers(1, 5, n))
        for i in range(n):
            rows.append((key, int(t[i]), i, None if rng.random() < 0.3 else float(rng.normal()), bool(rng.random() < 0.6)))
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v", "on"])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, t long, i long, v double, on boolean"), pdf


def by_row(df, column):
    return {(r["k"], r["i"]): r[column] for r in df.select("k", "i", column).collect()}


def test_ordinal_numbers_every_series_densely(series):
    df, pdf = series
    got = by_row(B.ordinal(df, ["k"], ["t"], B.index_block("t", 10), "pos"), "pos")
    assert got == {(r.k, r.i): r.i for r in pdf.itertuples()}


def test_halo_equals_plain_window(series):
    df, pdf = series
    out = B.with_halo(df, ["k"], "i", 2, 3, lambda w: {"m": F.avg("v").over(w.rangeBetween(-2, 3)), "p": F.lag("v", 2).over(w)}, rows=8)
    assert out.count() == len(pdf)
    for key, part in pdf.groupby("k"):
        v = part["v"].to_numpy(float)
        got = by_row(out.where(F.col("k") == key), "m")
        lag = by_row(out.where(F.col("k") == key), "p")
        for i in range(len(v)):
            near = v[max(0, i - 2): i + 4]
            near = near[~np.isnan(near)]
            want = near.mean() if len(near) else None
            assert got[(key, i)] == pytest.approx(want) if want is not None else got[(key, i)] is None
            back = v[i - 2] if i >= 2 and not np.isnan(v[i - 2]) else None
            assert lag[(key, i)] == back


def test_carry_crosses_blocks_without_values(series):
    df, pdf = series
    sparse = F.when((F.col("i") % 29 == 3), F.col("t"))
    out = B.carry(df, ["k"], ["i"], B.index_block("i", 5), last={"p": sparse}, first={"n": sparse})
    before, after = by_row(out, "p"), by_row(out, "n")
    for key, part in pdf.groupby("k"):
        known = [(r.i, r.t) for r in part.itertuples() if r.i % 29 == 3]
        for r in part.itertuples():
            assert before[(key, r.i)] == next((t for i, t in reversed(known) if i <= r.i), None)
            assert after[(key, r.i)] == next((t for i, t in known if i >= r.i), None)


def test_running_total(series):
    df, pdf = series
    got = by_row(B.running_total(df, ["k"], ["i"], B.index_block("i", 6), F.col("t"), "s"), "s")
    for key, part in pdf.groupby("k"):
        for i, s in zip(part["i"], part["t"].cumsum()):
            assert got[(key, i)] == s


def test_runs_follow_flags_and_identity(series):
    df, pdf = series
    out = B.runs(df, ["k"], "i", F.col("on"), F.floor(F.col("i") / 11))
    start, end = by_row(out, "run_start"), by_row(out, "run_end")
    for key, part in pdf.groupby("k"):
        on = part["on"].tolist()
        for i in range(len(on)):
            if not on[i]:
                assert start[(key, i)] is None and end[(key, i)] is None
                continue
            a = i
            while a > 0 and on[a - 1] and (a - 1) // 11 == i // 11:
                a -= 1
            z = i
            while z + 1 < len(on) and on[z + 1] and (z + 1) // 11 == i // 11:
                z += 1
            assert (start[(key, i)], end[(key, i)]) == (a, z)


def test_expand_range_is_whole(spark):
    df = spark.createDataFrame([("a", 3, 30), ("b", 5, 4), ("c", 0, 0)], "k string, a long, z long")
    out = B.expand_range(df, ["k"], F.col("a"), F.col("z"), "f", rows=7)
    assert sorted((r.k, r.f) for r in out.collect()) == sorted([("a", i) for i in range(3, 31)] + [("c", 0)])
