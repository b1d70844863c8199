"""Document fingerprints by winnowing, as one expression for each text, and the likeness of a text to its edit and its neighbour."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajekt.llm.common import let, table
from trajekt.session import materialise

#: Words in a gram, grams in a window: a run of GRAM + WINDOW - 1 = 6 words that two texts share gives a shared fingerprint.
#: The first and last gram of a text are always kept, so GRAM words in common at both starts or both ends do too.
GRAM, WINDOW = 3, 4
#: A word longer than this counts as several, so that text without spaces has grams too.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Of the 63 bits by which grams are ordered, so many hold the position: texts up to 67 million words have rightmost ties.
PLACE_BITS = 26
LAST = (1 << PLACE_BITS) - 1
HASH_MASK = (1 << (63 - PLACE_BITS)) - 1


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW, ends: bool = False) -> Column:
    """Array of (hash, at): of each window of gram hashes the least, the rightmost of equal ones, with its position.

    A text of fewer than `gram` words is one gram of them all; without words it has none. Fewer grams than a window are one
    window. With `ends`, windows that reach over the first or last gram count as well. Values are packed as order bits of the hash above the place from the end, so that the least number is the rightmost
    least hash; minima of windows come from minima of half as many, so the work is linear in the text and log in the window.
    """
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def grams(h: Column) -> Column:
        full = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (gram - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, gram)]))
        return F.when(F.size(h) >= gram, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def chosen(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(HASH_MASK)), PLACE_BITS).bitwiseOR((F.lit(LAST) - F.least(i, F.lit(LAST))).cast("long")))

        def minima(p: Column, done: int) -> Column:
            if done >= window:
                if ends:
                    return F.array_distinct(F.filter(p, lambda v: v.isNotNull()))
                return F.array_distinct(F.slice(p, F.lit(1), F.greatest(F.size(p) - (window - 1), F.lit(1))))
            step = min(done, window - done)
            # least() skips what lies beyond the last gram, so a text of fewer grams than a window is one window
            return let(F.transform(p, lambda x, i: F.least(x, F.get(p, i + step))), lambda q: minima(q, done + step))

        if ends:
            packed = F.concat(F.array_repeat(F.lit(None).cast("long"), window - 1), packed)
        least = let(packed, lambda p: minima(p, 1))
        return F.transform(least, lambda v: let(F.lit(LAST) - v.bitwiseAND(F.lit(LAST)), lambda at: F.struct(F.get(g, at.cast("int")).alias("hash"), at.cast("int").alias("at"))))

    return let(hashes, lambda h: let(grams(h), chosen))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; two without any are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def whole_array(values: list) -> Column:
    """Whole numbers as one constant array, however many there are: a text that the optimiser splits once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def by_range(value: Column, splits: list, width: int) -> Column:
    """Number of sorted `splits` below the value, found in two steps of about `width` and its complement; -1 for null."""
    if not splits:
        return F.when(value.isNull(), -1).otherwise(0)
    coarse = F.size(F.filter(whole_array([splits[min(i + width, len(splits)) - 1] for i in range(0, len(splits), width)]), lambda s: s < value))
    fine = F.slice(whole_array(splits), coarse * width + 1, F.lit(width))
    return F.when(value.isNull(), -1).otherwise(coarse * width + F.size(F.filter(fine, lambda s: s < value)))


def with_next(docs: DataFrame, key: str, carried: list[str], rows_per_slice: int = 64, most_slices: int = 1 << 18, derive=lambda d: d) -> DataFrame:
    """Rows of `docs` with next_<c> of each carried column: the row after it by descending key, after the last the first.

    Rows are cut into slices of the key's range at approximate quantiles, as many as keep a slice at about rows_per_slice up to 262,144 (16
    million rows; at ten billion a slice has 40,000); each slice also gets the first row of the slice below, so a window over a slice sees every
    neighbour and rows move once. Null keys come last, equal keys in order of a hash of the first carried column. `derive` adds carried columns
    after rows have moved, so they never travel. A row alone is its own neighbour.
    """
    rows = docs.count()
    number = max(1, min(most_slices, rows // rows_per_slice))
    splits: list = []
    if number > 1:
        quantiles = docs.select(F.percentile_approx(key, [i / number for i in range(1, number)], max(100_000, 2 * number))).first()[0]
        splits = sorted(set(quantiles or []))
    cut = docs.withColumn("__slice", by_range(F.col(key), splits, max(1, isqrt(number)))).withColumn("__tie", F.xxhash64(carried[0])).withColumn("__halo", F.lit(0))
    order = F.struct(F.col(key).isNull().alias("n"), (-F.col(key)).alias("k"), F.col("__tie").alias("t"))
    heads = materialise(cut.groupBy("__slice").agg(F.min(order).alias("__head")), "heads")
    down = Window.orderBy(F.col("__slice").desc())
    above = F.coalesce(F.lag("__slice").over(down), F.min("__slice").over(Window.partitionBy()))
    heads = heads.select(F.col("__slice").alias("__from"), above.alias("__to"), (-F.col("__head.k")).alias("__key"), F.col("__head.t").alias("__t"))
    first = cut.join(F.broadcast(heads), (F.col("__slice") == F.col("__from")) & F.col(key).eqNullSafe(F.col("__key")) & (F.col("__tie") == F.col("__t")))
    first = first.dropDuplicates(["__from"]).withColumn("__slice", F.col("__to")).withColumn("__halo", F.lit(1)).select(*cut.columns)
    ahead = Window.partitionBy("__slice").orderBy("__halo", F.col(key).desc_nulls_last(), "__tie")
    # the window finds the rows where this exchange put them
    both = derive(cut.unionByName(first).repartition("__slice"))
    return both.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in carried]).where("__halo = 0").drop("__slice", "__tie", "__halo")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fp, edited_fp, near_edited, near_next for each row of docs (doc_id, text); a null text is empty.

    The edited text has the last third of its code points replaced by the first as many of the next document's.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = with_next(docs, "doc_id", ["text", "fp"], derive=lambda d: d.withColumn("fp", winnow(F.col("text"), ends=True)))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    met = met.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next_fp.hash").alias("next_hash"))
    met = met.withColumn("edited_fp", winnow(F.col("edited"), ends=True))
    return met.select(
        "doc_id", "n_chars", "edited", "fp", "edited_fp",
        likeness(F.col("fp.hash"), F.col("edited_fp.hash")).alias("near_edited"), likeness(F.col("fp.hash"), F.col("next_hash")).alias("near_next"),
    )


def printed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda f: F.concat_ws("@", F.lower(F.hex(f["hash"])), f["at"].cast("string"))), ",")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
