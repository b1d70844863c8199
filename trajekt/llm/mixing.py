"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajekt.llm.common import WORD, table
from trajekt.session import materialise

#: Fixed by the contract: weights of the sources in order of their names, repeating; the share of all words; most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of the id: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with target, budget, epochs and rest: one row for each source, so one small window.

    Shares by weight, none above MOST_EPOCHS times the source's size, excess reshared until none is above. The fixed point is
    a common level times the weight for all sources below their limit: sources in order of limit / weight fill up first.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST_EPOCHS).withColumn("fill", F.col("most") / F.col("weight"))
    filled = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(filled), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0))))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"])
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double"))
    rows = rows.withColumn("target", target).withColumn("budget", F.least(F.round("target").cast("long"), F.col("most")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).select("source", "source_size", "target", "epochs", "rest")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken) for each row of `docs` (doc_id, text, source).

    A source's documents are ordered by a random key, ties by id and size. Whole epochs take every document; the last one takes
    documents until the source's budget, where the document on the cut gives its first `part` words. taken = epochs * size +
    part, so a source's taken words are its target to the nearest word. The order is cut into slices of the key range: the
    keys are uniform, so slices are even however large a source is; only slice totals meet in a window over a source.
    Null or blank texts have size 0 and are taken 0 times; a null source is a source; rows with equal ids are documents each
    (rows alike in key, id and size may change places, which changes no result but for the row). An empty table gives none.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    sized = materialise(sized, "sized")
    rows = sized.count()
    bits = max(10, (rows // 50_000).bit_length())
    sliced = sized.withColumn("slice", F.shiftright("key", KEY_BITS - bits))
    totals = materialise(sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = source_targets(totals.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    starts = starts.join(targets.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).select(F.col("source").alias("__source"), F.col("slice").alias("__slice"), "start", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sliced.withColumn("through", F.sum("size").over(within))
    met = run.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("slice") == F.col("__slice")))
    part = F.least(F.greatest(F.col("rest") - (F.col("start") + F.col("through") - F.col("size")), F.lit(0)), F.col("size"))
    met = met.withColumn("part", part)
    return met.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, the one on a source's cut shortened to its part.

    Rows alike in id, source and size that lie on a cut are all cut alike.
    """
    plan = mix(docs, seed).where("taken > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.max("epochs").alias("__epochs"), F.max("part").alias("__part"))
    met = docs.withColumn("__n", word_count(F.col("text"))).join(plan.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size")))
    whole = F.array_repeat(F.col("text"), F.col("__epochs").cast("int"))
    tail = F.when(F.col("__part") == F.col("__n"), F.array(F.col("text"))).when(F.col("__part") > 0, F.array(first_words(F.col("text"), F.col("__part")))).otherwise(F.array().cast("array<string>"))
    return met.withColumn("text", F.explode(F.concat(whole, tail))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2 * source_size AS most, 2 * source_size / weight AS fill FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER ahead, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM filled WINDOW ahead AS (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, most, coalesce(least(most::DOUBLE, weight * (SELECT arg_min(level, fill) FROM levels WHERE level <= fill)), most::DOUBLE) AS target FROM levels),
budgets AS (
  SELECT *, least(round(target)::BIGINT, most) AS budget, CASE WHEN source_size > 0 THEN floor(least(round(target)::BIGINT, most) / source_size) ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM sized)
SELECT r.doc_id, r.size::BIGINT AS size, b.source_size::BIGINT AS source_size, b.target,
  (b.epochs * r.size + least(greatest(b.budget - b.epochs * b.source_size - r.before, 0), r.size))::BIGINT AS taken
FROM run r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""
