"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.session import materialise

#: Fixed: the white space of every contract here, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of (id, flag) that may be broadcast: about 16 MB in a hash relation. Beyond it the same join shuffles.
SMALL_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable) -> Callable:
    """`run`, a function for mapInArrow, whose freed memory goes back to the system when its task ends: workers live on, and what
    they still hold would count against the next stage."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, whatever the optimiser merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_or_shuffled(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`side`, to be read from a stored table, as a broadcast if it is counted to be small, else to be hashed in each partition."""
    return F.broadcast(side) if side.count() <= rows else side.hint("shuffle_hash")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links as (node, root), root the smallest node.

    Alternates large and small stars, with minima instead of neighbour lists, so that a hub is never gathered in one task.
    Each round is a written table. Links that hold a null or join a node to itself count for nothing.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = materialise(edges, "edges"), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        stars = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        hung = stars.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
