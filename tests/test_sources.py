"""Document store and camera settings."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from trajekt.sources import scans, store


def test_store_keeps_documents_and_its_index_reads_no_content(spark, tmp_path):
    docs = [("a", "text é\nline"), ("b", ""), ("c", None), ("d", "x" * 100_000)]
    path = str(tmp_path / "store")
    store.store_documents(spark.createDataFrame(docs, "doc string, body string"), path, "doc", "body", 2)
    assert {r["name"]: r["content"] for r in store.stored(spark, path).collect()} == {n: t or "" for n, t in docs}
    index = store.index(spark, path)
    want = {n: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for n, t in docs}
    assert {r["name"]: (r["size"], r["sha256"]) for r in index.collect()} == want
    assert 1 <= index.select("container").distinct().count() <= 2
    assert "content" not in index._jdf.queryExecution().executedPlan().toString()
    damaged = store.stored(spark, path).withColumn("content", F.when(F.col("name") == "a", "other").when(F.col("name") == "d", F.repeat(F.lit("y"), 100_000)).otherwise(F.col("content")))
    assert {r["name"]: r["d"] for r in damaged.select("name", store.damage().alias("d")).collect()} == {"a": "size", "b": "none", "c": "none", "d": "sha256"}


def test_setting_cameras_have_projections(spark, tmp_path):
    def camera(name, rotation, translation):
        return {"name": name, "size": [1920, 1080], "matrix": [[1000, 0, 960], [0, 1000, 540], [0, 0, 1]], "distortions": [0, 0, 0, 0, 0], "rotation": rotation, "translation": translation}

    place = tmp_path / "setting=s1"
    place.mkdir()
    quarter = [0.0, np.pi / 2, 0.0]
    (place / "cameras.json").write_text(json.dumps([camera("c0", [0, 0, 0], [1, 2, 3]), camera("c1", quarter, [0, 0, 4]), camera("c2", [0.1, 0], [0, 0, 4])]))
    settings = scans.setting_cameras(spark, str(tmp_path))
    got = {r["camera_id"]: r for r in settings.collect()}
    k = np.array([[1000, 0, 960], [0, 1000, 540], [0, 0, 1.0]])
    turned = np.array([[0, 0, 1], [0, 1, 0], [-1, 0, 0.0]])
    assert np.allclose(np.array(got["c0"]["p"]).reshape(3, 4), k @ np.hstack([np.eye(3), [[1], [2], [3]]]))
    assert np.allclose(np.array(got["c1"]["p"]).reshape(3, 4), k @ np.hstack([turned, [[0], [0], [4]]]), atol=1e-9)
    assert got["c2"]["p"] is None and got["c1"]["width"] == 1920
    wanted = spark.createDataFrame([("s1", "c0"), ("s1", "c9"), ("s2", "c0")], "setting string, camera_id string")
    assert {(r["setting"], r["camera_id"]): r["verdict"] for r in scans.selected_cameras(settings, wanted).collect()} == {("s1", "c0"): "found", ("s1", "c9"): "camera_missing", ("s2", "c0"): "setting_missing"}
