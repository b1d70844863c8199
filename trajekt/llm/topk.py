"""Exact top-k search: tiles of query and candidate blocks as matrix products, partial selection in each, and a tree of merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm.common import table
from trajekt.session import materialise

SCALE = 64
BLOCK = 4096
QUERIES = 2048
ROWS_AT_ONCE = 128
FAN_IN = 8
LEAST = np.iinfo(np.int64).min


def as_integers(vector: str, scale: int = SCALE):
    """floor(scale * x) of each component as double; null for vectors that are null or hold null or non-finite components."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col(vector).isNotNull() & fit, whole)


def _pack(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            vectors = rows["v"].combine_chunks()
            lengths = np.diff(vectors.offsets.to_numpy())
            # rows of unequal length are padded with zeros, which add nothing to a product
            width = int(lengths.max(initial=0))
            dense = np.zeros((len(lengths), width), np.int64)
            dense[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy()
            ids = rows["vec_id"].to_numpy()
            block = int(ids.view(np.uint64).sum(dtype=np.uint64) >> np.uint64(1)) ^ len(ids)
            item = next(t for t in (np.int8, np.int16, np.int32, np.int64) if t is np.int64 or np.abs(dense.astype(float)).max(initial=0) <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict({"kind": [kind], "block": pa.array([block], pa.int64()), "width": pa.array([width], pa.int32()), "item": pa.array([np.dtype(item).itemsize], pa.int32()), "ids": [ids.tobytes()], "vectors": [dense.astype(item).tobytes()]})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, size))
                held, n = rows.slice(size).to_batches(), n - size
        if n:
            yield out(pa.Table.from_batches(held))

    return run


BLOCKS = "kind string, block long, width int, item int, ids binary, vectors binary"


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k highest scores, ties to the smaller id; ids are ascending, and barred entries hold LEAST."""
    n = scores.shape[1]
    take = min(k, n)
    if np.abs(np.where(scores == LEAST, 0, scores)).max(initial=0) < (1 << 62) // max(n, 1):
        key = np.where(scores == LEAST, LEAST, scores * n + (n - 1 - np.arange(n)))
        top = np.argpartition(key, n - take, axis=1)[:, n - take :] if take < n else np.tile(np.arange(n), (len(scores), 1))
        order = np.argsort(-np.take_along_axis(key, top, 1), axis=1, kind="stable") if take else top
        top = np.take_along_axis(top, order, 1)
    else:
        top = np.stack([np.lexsort((np.arange(n), -row.astype(object)))[:take] for row in scores])
    return ids[top], np.take_along_axis(scores, top, 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can reach 2^53, else in whole numbers, held to the range of a long."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * width
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T if width else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.vectors, f"i{row.item}").astype(np.int64).reshape(len(ids), row.width)


def _lists(query: int, part: int, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict:
    return {"query_block": query, "part": part, "queries": q.tobytes(), "k": ids.shape[1], "ids": np.ascontiguousarray(ids).tobytes(), "scores": np.ascontiguousarray(scores).tobytes()}


LISTS = "query_block long, part long, queries binary, k int, ids binary, scores binary"


def _tile(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        candidates = [_matrix(r) for r in rows[rows["kind"] == "c"].itertuples()]
        for r in rows[rows["kind"] == "q"].itertuples():
            q_ids, q = _matrix(r)
            for part, (c_ids, c) in enumerate(candidates):
                order = np.argsort(c_ids, kind="stable")
                c_ids = c_ids[order]
                c, kept = c[order], []
                for at in range(0, len(q), ROWS_AT_ONCE):
                    scores = products(q[at : at + ROWS_AT_ONCE], c)
                    scores[q_ids[at : at + ROWS_AT_ONCE, None] == c_ids[None, :]] = LEAST
                    kept.append(best(c_ids, scores, k))
                out.append(_lists(r.block, int(rows["shard"].iloc[0]) * 1024 + part, q_ids, *(np.concatenate(x) for x in zip(*kept))))
        return pd.DataFrame(out, columns=LISTS.replace(",", "").split()[::2])

    return run


def _merge(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = list(rows.itertuples())
        q = np.frombuffer(parts[0].queries, np.int64)
        ids = np.concatenate([np.frombuffer(p.ids, np.int64).reshape(len(q), p.k) for p in parts], axis=1)
        scores = np.concatenate([np.frombuffer(p.scores, np.int64).reshape(len(q), p.k) for p in parts], axis=1)
        # lexsort by row: score first, then id
        order = np.lexsort((ids, -np.maximum(scores, LEAST + 1)), axis=1)[:, :k]
        return pd.DataFrame([_lists(parts[0].query_block, int(parts[0].part), q, np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1))])

    return run


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            q = np.frombuffer(r.queries, np.int64)
            ids, scores = (np.frombuffer(x, np.int64).reshape(len(q), r.k) for x in (r.ids, r.scores))
            at, rank = np.nonzero(scores != LEAST)
            yield pd.DataFrame({"query_id": q[at], "rank": (rank + 1).astype(np.int32), "vec_id": ids[at, rank], "score": scores[at, rank]})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all candidates but its own id.

    Both sides are (vec_id, vector). Ties go to the smaller vec_id; fewer candidates than k give them all. Null ids, and vectors that
    are null or hold null or non-finite components, take no part. Shorter vectors count as padded with zeros. Repeated query rows are
    answered each. Candidate rows lie in blocks, every query block meets every candidate block once; a tile keeps k for each query,
    and FAN_IN lists are merged at a time, so no task holds more than a few blocks.
    """
    def blocks(rows: DataFrame, kind: str, size: int) -> DataFrame:
        if kind == "q":
            rows = rows.repartition(max(1, -(-rows.count() // size)), "vec_id")
        fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers("vector").alias("v")).where("vec_id is not null and v is not null")
        return materialise(fit.mapInArrow(_pack(kind, size), BLOCKS), f"{kind}blocks")

    q, c = blocks(queries, "q", query_block), blocks(candidates, "c", block)
    # a shard is about one block; each query block goes to every shard that holds one
    shards = max(1, c.count())
    c = c.withColumn("shard", F.pmod(F.xxhash64("block", "ids"), F.lit(shards)))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    columns = ["kind", "block", "width", "item", "ids", "vectors", "shard"]
    # a tile is one query block and one shard
    q = q.select(*columns, F.col("block").alias("of"), F.xxhash64("ids").alias("of2"))
    tiles = q.select("of", "of2", "shard").distinct()
    c = c.select(*columns).join(tiles, "shard").select(*columns, "of", "of2")
    lists = q.unionByName(c).groupBy("of", "of2", "shard").applyInPandas(_tile(k), LISTS).withColumn("part", F.xxhash64("part").bitwiseAND(F.lit(0x7FFFFFFF)))
    left = shards
    lists = materialise(lists, "lists")
    while left > 1:
        left = -(-left // FAN_IN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(left))).groupBy("query_block", F.xxhash64("queries"), "part").applyInPandas(_merge(k), LISTS)
    return lists.mapInPandas(_rows, "query_id long, rank int, vec_id long, score long")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
