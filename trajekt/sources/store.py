"""A document store: many small documents in few container files, with an index that is read without their content.

A directory or file for each document costs a listing entry, an open and a task's attention each. Here a container is a Parquet file of
rows (name, size, sha256, content): the first three columns are the index, which column pruning reads alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "name string, size long, sha256 string, content string"


def store_documents(docs: DataFrame, path: str, name: str = "name", content: str = "content", containers: int | None = None) -> None:
    """Writes documents (name, text) as containers, sorted by name so that a look-up by name skips files and row groups."""
    text = F.coalesce(F.col(content), F.lit(""))
    rows = docs.select(F.col(name).cast("string").alias("name"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), text.alias("content"))
    spread = rows.repartitionByRange(containers, "name") if containers else rows.repartitionByRange("name")
    spread.sortWithinPartitions("name").write.parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256, container) of every document; contents are not read."""
    return stored(spark, path).select("name", "size", "sha256", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("container"))


def damage() -> Column:
    """Whether a stored row's content still has its size and digest."""
    return F.when(F.octet_length("content") != F.col("size"), "size").when(F.sha2("content", 256) != F.col("sha256"), "sha256").otherwise("none")
