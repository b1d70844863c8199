"""Filter interaction audit: what each order of the filters removes where, and each filter's Shapley share by potentials."""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajekt.llm.common import WORD, let, small_or_shuffled, table
from trajekt.session import materialise

#: Fixed by the contract: least words, least share of distinct words and most share of capitals in percent, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
#: The filter that asks for a smaller id's text; the others look at a text alone.
COPY = "E"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure condition of each filter on a text that is not null: A short, B repetitive, C capitals, D signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": counted["n"] < LEAST_WORDS,
        "B": 100 * counted["d"] < LEAST_DISTINCT * counted["n"],
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic, digest) of each row: bit i of mask is set if the text fails the i-th filter of A to D."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("__text")).values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("__text")).select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("__text", 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    stored = materialise(rows, "failures")
    met = stored.where("doc_id is not null").join(small_or_shuffled(materialise(marks, "marks")), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    # a null id has no label, so such rows need not meet in one task of the join
    alone = stored.where("doc_id is null").select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    return met.unionByName(alone).fillna(0, ["good", "toxic"])


def coalition_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bits in the order ABCDE.

    Of the rows of one text those with the smallest id don't fail E: they alone are sought, by a rank of which every task passes on the first place
    only, and counted out of all rows, which are counted without meeting. So no group of copies comes together.
    """
    rows = materialise(failures(docs, labels), "failed")
    known = rows.where("doc_id is not null")
    copy, by_text = 1 << len(text_failures(F.col("text"))), Window.partitionBy("digest").orderBy("doc_id")
    first = known.withColumn("__place", F.rank().over(by_text)).where("__place = 1")
    counted = [F.sum(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]

    def count(d: DataFrame, extra: int, sign: int) -> DataFrame:
        own = d.groupBy("part", (F.col("mask") + extra).alias("mask")).agg(*counted)
        return own.select("part", "mask", *[(F.col(c) * sign).cast("long").alias(c) for c in ("n", "good", "toxic")])

    firsts = materialise(first.groupBy("part", "mask").agg(*counted), "firsts")
    minus = firsts.select("part", (F.col("mask") + copy).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    parts = [count(known, copy, 1), minus, firsts, count(rows.where("doc_id is null"), 0, 1)]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]).where("n > 0")


def removed_by_coalition(counts: DataFrame, filters: int) -> DataFrame:
    """(part, total, v, good, toxic): arrays over all coalitions of how many documents any of its filters removes."""
    met = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))

    def hit(what: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit((1 << filters) - 1)),
            lambda s: F.aggregate("c", F.lit(0).cast("long"), lambda a, m: a + F.when(m["mask"].bitwiseAND(s) != 0, m[what]).otherwise(0)),
        )

    return met.select("part", "total", hit("n").alias("v"), hit("good").alias("good"), hit("toxic").alias("toxic"))


def potentials(v: Column, filters: int) -> Column:
    """Hart-Mas-Colell potentials of the game v over all coalitions, times lcm(1..filters) so that they are whole.

    P(S) = (v(S) + sum of P(S without i) over its members i) / |S|. Coalitions come in order of their bits, so each finds the
    smaller ones in what is there already.
    """
    unit = lcm(*range(1, filters + 1))

    def grown(p: Column, s: Column) -> Column:
        members = [s.bitwiseAND(F.lit(1 << i)) != 0 for i in range(filters)]
        smaller = sum((F.when(m, F.get(p, s - (1 << i))).otherwise(0) for i, m in enumerate(members)), F.lit(0).cast("long"))
        # a whole number: the potential is a sum of dividends over sizes up to `filters`
        value = F.get(v, s) * unit + smaller
        return F.concat(p, F.array(F.call_function("div", value, F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grown)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter order and step, with the step's counts and its filter's Shapley share.

    docs (doc_id, text, source), labels (doc_id, quality, toxic). A document is one of 2^5 failure sets, so after one count of sets the audit is
    arithmetic on 32 coalitions a part: a step's counts are differences of coalitions along the order, and a filter's share is the potential
    of all filters minus that without it, times 5! for the sum over all orders.

    Null texts are empty, a null source is the part ''. A row with a null id has no smaller id and no label, so it never fails E. Rows of one text that
    share its smallest id don't fail E either; repeated rows count each. Of several labels of one id a 1 wins; other
    values and missing labels count as 0. Further columns of any name are ignored; an empty table gives no rows.
    """
    letters = [*text_failures(F.col("text")), COPY]
    filters, full = len(letters), (1 << len(letters)) - 1
    orders = list(permutations(range(filters)))
    steps = [(o, k) for o in orders for k in range(filters)]
    before = [sum(1 << i for i in o[:k]) for o, k in steps]
    fixed = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    games = removed_by_coalition(coalition_counts(docs, labels), filters)
    games = materialise(games.withColumn("p", potentials(F.col("v"), filters)), "games")
    rows = games.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = rows.select(
        "*",
        F.get(fixed(["".join(letters[i] for i in o) for o in orders], "string"), F.floor(F.col("__i") / filters).cast("int")).alias("filter_order"),
        (F.col("__i") % filters + 1).cast("int").alias("step"), F.get(fixed(before, "int"), F.col("__i")).alias("__b"), F.get(fixed([o[k] for o, k in steps], "int"), F.col("__i")).alias("__f"),
    )
    own = F.call_function("shiftleft", F.lit(1), F.col("__f"))
    rows = rows.withColumn("__own", own).withColumn("__a", F.col("__b") + F.col("__own"))
    step = lambda c: F.get(c, F.col("__a")) - F.get(c, F.col("__b"))
    share = (F.get("p", F.lit(full)) - F.get("p", F.lit(full) - F.col("__own"))) * (factorial(filters) // lcm(*range(1, filters + 1)))
    return rows.select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
        (F.col("total") - F.get("v", F.col("__a"))).alias("kept"), step("v").alias("removed"), (F.get("v", F.col("__own")) - step("v")).alias("redundant"),
        (F.get("v", F.lit(full)) - F.get("v", F.lit(full) - F.col("__own"))).alias("unique_fails"), step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


OP12_SQL = r"""
WITH d0 AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d0),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT d1.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS dd, coalesce(d1.doc_id > min(d1.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d1 LEFT JOIN lab USING (doc_id)),
kinds AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN dd THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS prior FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
met AS (SELECT k.part, o, s, f, n, good, toxic, fails, contains(fails, f) AS hit,
    prior <> '' AND regexp_matches(fails, '[' || prior || 'x]') AS gone FROM kinds k, steps),
r AS (SELECT part, o AS filter_order, s AS step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
