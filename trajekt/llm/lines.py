"""Line dedup: levelled sorted runs of line hashes, against which each batch is anti-joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm.common import SPACES, table
from trajekt.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased and other letters as they are."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (h1, h2, n): in how many documents of the batches so far each line occurred.

    A run is a table in the shared folder, sorted by hash within partitions. A new batch goes to level 0 without the lines that a
    run already holds as settled (n >= min_docs): those can't change any more. A level of `fanout` runs is summed into one run
    of the next level, so that a hash lies in few runs and every hash is rewritten once a level.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [run.where(F.col("n") >= self.min_docs).select(*HASH) for run in self.runs()])

    def append(self, lines: DataFrame) -> None:
        """lines: (h1, h2), one row for each document that has the line."""
        batch = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
        if self.runs():
            batch = batch.join(self.settled(), HASH, "left_anti")
        self._add(0, batch)

    def _add(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(materialise(rows.sortWithinPartitions(*HASH), f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._summed(self.levels[level]), []
            self._add(level + 1, merged)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """A table of its own, so that a join with it deals out both sides and Spark can split a line that a third of all documents hold."""
        return materialise(self._summed(self.runs()).where(F.col("n") >= self.min_docs).select(*HASH), "frequent")


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept (text): lines whose key is in at least `min_docs` documents go everywhere.

    A null or empty text is one empty line. Lines of white space have no key and stay. Each row of `docs` counts as a document,
    repeated rows and rows with a null id too. Other columns pass through, but for any
    named like a result; an empty table gives an empty one.
    The hashes have 128 bits; the text itself moves once, to meet its dropped positions.
    """
    spark = docs.sparkSession
    row = [F.col("doc_id"), F.xxhash64("text").alias("__th")]
    keys = F.transform(F.transform(split_lines(F.col("text")), line_key), lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    hashed = docs.select(*row, keys.alias("keys")).withColumn("batch", F.pmod("__th", F.lit(batches)))
    hashed = materialise(hashed, "lines")
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        own = hashed.where(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").select("k.*")
        runs.append(own)
    at = hashed.select("doc_id", "__th", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("doc_id", "__th", "pos", "k.*")
    gone = at.join(runs.frequent(), HASH, "left_semi").groupBy("doc_id", "__th").agg(F.collect_set("pos").alias("__gone"))
    gone = materialise(gone, "gone").withColumnRenamed("doc_id", "__id").withColumnRenamed("__th", "__of")
    text = docs.withColumn("__th", F.xxhash64("text"))
    met = text.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__of")), "left")
    lines = split_lines(F.col("text"))
    kept = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    own = [docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return met.select(*own, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
