"""From raw documents to packed training sequences: five stages, each over all rows that the one before kept.

Every stage but the last returns the columns of `documents`. A stage's result is a table in the shared folder that the next one
reads, so a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm import jaccard, lines, mixing, packing, toxicity
from trajekt.llm.common import small_or_shuffled, table
from trajekt.session import materialise


#: Parts of texts that a worker keeps encoded while packing.
CACHED = 150_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose id is not in `gone` (a column __id); rows without an id stay."""
    return docs.join(small_or_shuffled(materialise(gone, "gone")), F.col("doc_id") == F.col("__id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic, as they are."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1").select(F.col("doc_id").alias("__id")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents share; n_chars counts what is left. One of only such lines stays, empty.

    A row travels as one struct beside its id and text, so columns of any name come through as they were.
    """
    kept = lines.dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")))
    changed = F.col("n_dropped") > 0
    named = {"text": F.when(changed, F.col("kept")).otherwise(F.col("__row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[named[c].alias(c) if named.get(c) is not None else F.col("__row").getField(c).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document of the smallest id."""
    classes = jaccard.jaccard_join(docs)
    return _without(docs, classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__id")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's cut is shortened and n_chars follows. Other columns are as they were."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))
    mixed = mixing.mixed(rows)
    mixed = mixed.select(*[(F.col("text") if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns])
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens. The cache of encoded words is small and ends with its task: workers hold
    other stages' memory, and stages run again in the same workers."""
    return packing.pack(packing.pieces(docs, cached=CACHED, kept_on=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Model scores, tokenizer ids and a local search have no SQL; tests cover the operators that the stages call, but not yet the stages or run() themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
