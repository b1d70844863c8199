import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajekt.operators.quantiles import _parts, exact_quantiles, median_mad, value_bucket, weighted_median

PROBS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(11)
    groups = {
        "wide": rng.normal(0, 1e6, 501), "tiny": rng.normal(0, 1e-9, 200), "ties": np.repeat([1.5, -2.0, 0.0, 7.0], 25), "one": np.array([4.25]),
        "constant": np.full(40, -3.0), "mixed": np.concatenate([rng.exponential(1, 300), -rng.exponential(50, 300), np.zeros(50)]),
    }
    return groups


def test_matches_linear_interpolation(spark, values):
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in values.items()])
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], F.col("v"), PROBS).collect()}
    assert set(got) == set(values)
    for key, v in values.items():
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12, abs=1e-18)


def test_nulls_are_skipped_and_empty_groups_absent(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    assert [(r.k, r.m) for r in exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}).collect()] == [("a", 2.0)]


def test_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    v = np.unique(np.concatenate([rng.normal(0, 10.0**e, 200) for e in range(-12, 13, 3)] + [[0.0, -1e-320, 1e300]]))
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))


def test_median_mad_and_weighted_median(spark, values):
    v = values["mixed"]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v, "w": (np.arange(len(v)) % 5).astype(float)}))
    row = median_mad(df, ["k"], F.col("v")).first()
    assert row["median"] == pytest.approx(np.median(v))
    assert row["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))))
    w = (np.arange(len(v)) % 5).astype(float)
    order = np.argsort(v[w > 0], kind="stable")
    cum = np.cumsum(w[w > 0][order])
    want = v[w > 0][order][np.searchsorted(cum, 0.5 * cum[-1])]
    assert weighted_median(df, ["k"], F.col("v"), F.col("w")).first()["weighted_median"] == want


def test_infinities_and_nan_count_as_missing(spark):
    rows = [("n", v) for v in (1.0, float("nan"), 3.0, 5.0)] + [("i", v) for v in (1.0, float("inf"), 3.0, float("-inf"))] + [("x", float("nan"))]
    got = {r.k: r.m for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), {"m": 0.5}).collect()}
    assert got == {"n": 3.0, "i": 2.0}


def test_values_crowded_in_one_bucket_are_exact_and_split(spark):
    n = 200_000
    df = spark.range(n).select((1003.0 + F.pmod(F.col("id") * 7919, F.lit(n)) / (n / 5.0)).alias("v"))
    got = exact_quantiles(df, [], F.col("v"), PROBS).first()
    want = 1003.0 + np.arange(n) / (n / 5.0)
    assert df.select(value_bucket(F.col("v"))).distinct().count() == 1
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.percentile(want, 100 * p), rel=1e-12)
    counts = df.select(F.col("v").alias("__v"), value_bucket(F.col("v")).alias("__b"), F.lit(1).alias("__m"))
    bounds = counts.groupBy("__b").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    assert _parts(counts, bounds, []).groupBy("__p").count().agg(F.max("count")).first()[0] < n / 2000


def test_distinct_values_are_not_all_counted(spark):
    """Only the values near a wanted rank are shuffled, however many distinct ones there are, so a task's memory doesn't grow with them."""
    n, sc = 200_000, spark.sparkContext
    df = spark.range(0, n, 1, 4).select(F.lit("k").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(n)) * 0.001 + 1.0).alias("v"))

    def records():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    row = exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "p": 0.95}).first()
    want = np.percentile(np.arange(n) * 0.001 + 1.0, [50, 95])
    assert [row["m"], row["p"]] == pytest.approx(want, rel=1e-12)
    assert records() - before < n / 5
