"""Trackers cut into time slices give, bit for bit, what one run over the whole series gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajekt.streaming import causal as C


def walk(rng, n):
    at = np.cumsum(rng.normal(0, 6, (n, 2)), axis=0) + 500
    size = np.abs(rng.normal(120, 30, (n, 2))) + 5
    return np.hstack([at - size / 2, at + size / 2])


@pytest.fixture(scope="module")
def boxes(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s, n in ((1, 400), (2, 90), (3, 1)):
        for i, b in enumerate(walk(rng, n)):
            # frames are missing here and there, once for more than a slice
            if i % 11 != 3 and not (s == 1 and 150 <= i < 230):
                rows.append((s, "c", i, *map(float, b)))
    return spark.createDataFrame(rows, "session_id int, camera_id string, sample_idx long, x0 double, y0 double, x1 double, y1 double").repartition(5)


def same(a, b, columns):
    key = lambda r: (r["session_id"], r["camera_id"], r["sample_idx"])
    left, right = ({key(r): tuple(r[c] for c in columns) for r in d.collect()} for d in (a, b))
    assert left == right and left
    return left


@pytest.mark.parametrize("span", [7, 64])
def test_followed_boxes(boxes, span):
    same(C.track_boxes(boxes, slice_frames=span), C.track_boxes(boxes), ("x0", "y0", "x1", "y1"))


@pytest.mark.parametrize("span", [7, 50])
def test_selected_identities(spark, boxes, span):
    n = F.col("sample_idx")
    det = lambda dx, conf, track: F.struct((F.col("x0") + dx).alias("x0"), "y0", (F.col("x1") + dx).alias("x1"), "y1", conf.alias("conf"), F.lit(track).alias("track_id"))
    both = F.array_compact(F.array(F.when((n % 60 < 40) & (n % 9 != 0), det(0.0, F.lit(0.7) + (n % 7) * 0.04, 1)), F.when(n % 5 != 2, det(80.0, F.lit(0.6) + (n % 4) * 0.1, 2))))
    frames = boxes.select("session_id", "camera_id", "sample_idx", both.alias("dets"))
    found = same(C.select_identity(frames, slice_frames=span), C.select_identity(frames), ("track_id", "confidence", "detected", "x0", "y0", "x1", "y1"))
    assert {v[0] for v in found.values()} == {1, 2} and {v[2] for v in found.values()} == {True, False}


def test_no_rows(boxes):
    assert C.track_boxes(boxes.limit(0)).count() == 0
