"""Secret scans: an incremental ledger of blobs, each scanned once for each version of each rule."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm.common import let, table
from trajekt.session import materialise

#: Mark the ends of a match in a text; in texts that hold them they are replaced by another control character, as long.
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` is shorter than `least` fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three kinds are the contract's. A run of hex digits is matched whole, so its length may stand in the pattern.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
SPAN = "array<struct<start:int,ord:int,end:int,rule:string>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, ord, end, rule) of the rule's matches, in code points, end exclusive."""
    marked = F.split(F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    none = F.array().cast(SPAN)

    def found(parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            match = F.substring_index(part, CLOSE, 1)
            size, tested = F.length(match), (F.length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else F.length(match))
            span = F.struct(state["at"].alias("start"), F.lit(order).alias("ord"), (state["at"] + size).alias("end"), F.lit(rule.id).alias("rule"))
            own = F.when(tested >= rule.least, F.array(span)).otherwise(none).cast(SPAN)
            return F.struct((state["at"] + F.length(part) - 1).alias("at"), F.concat(state["spans"], own).alias("spans"))

        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("spans"))
        return F.when(F.size(parts) < 2, none).otherwise(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["spans"])

    return let(marked, found)


class BlobLedger:
    """What has been scanned: rows (blob, rules, found) in a folder that all executors share; blob is the SHA-256 of a content.

    `scan` reads only contents whose blob the ledger lacks for some rule version, once however many paths hold it, adds what
    it finds, and returns the findings for every path. Nothing in the ledger is ever changed, so a lost run is repeated safely.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.folder, self.parts = folder, []
        if folder:
            self.parts.append(spark.read.schema(f"blob binary, rules array<string>, found {SPAN}").parquet(folder))

    def _rows(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None

    def scan(self, docs: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
        """(path, blob, found) for each row of docs. A null content is an empty one; null paths and repeated rows stay."""
        body = F.coalesce(F.col(content), F.lit(""))
        docs = docs.select(F.col(path).alias("path"), body.alias("body"))
        docs = docs.withColumn("blob", F.unhex(F.sha2("body", 256)))
        paths = materialise(docs.select("path", "blob"), "paths")
        every = F.array(*[F.lit(r.id) for r in self.rules])
        blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
        ledger = self._rows()
        if ledger is None:
            todo = blobs.withColumn("todo", every)
        else:
            known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
            todo = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("done")
        todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
        unseen = docs.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")))
        marks = F.col("body").contains(OPEN) | F.col("body").contains(CLOSE)
        unseen = unseen.select("blob", "todo", F.when(marks, F.translate("body", OPEN + CLOSE, OTHER + OTHER)).otherwise(F.col("body")).alias("body"))
        columns = [F.when(F.array_contains("todo", r.id), spans(F.col("body"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(self.rules)]
        new = unseen.select("blob", F.col("todo").alias("rules"), F.concat(*columns).alias("found"))
        if self.folder:
            new.write.mode("append").parquet(self.folder)
            self.parts = [self.spark.read.schema(f"blob binary, rules array<string>, found {SPAN}").parquet(self.folder)]
        else:
            self.parts.append(materialise(new, "ledger"))
        current = F.filter(F.array_distinct(F.flatten(F.collect_list("found"))), lambda x: F.array_contains(every, x["rule"]))
        findings = self._rows().where(F.size("found") > 0).groupBy("blob").agg(F.array_sort(current).alias("found"))
        findings = materialise(findings, "findings")  # so that Spark can split a blob that many paths hold
        return paths.join(findings, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.substring_index(x["rule"], "@", 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are paths, their texts the contents; the ledger begins empty and lies in the shared folder."""
    ledger = BlobLedger(spark)
    rows = ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r for r in RULES if r.base]
    number = lambda r: F.size(F.filter("found", lambda x: x["rule"] == r.id)).cast("long").alias(f"n_{r.kind}")
    bases = F.filter("found", lambda x: F.array_contains(F.array(*[F.lit(r.id) for r in base]), x["rule"]))
    return rows.select("doc_id", *map(number, base), F.sha2(listed(bases), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
