"""Substring dedup: rolling hashes of all windows of 50 words, counted across documents, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm import words as W
from trajekt.llm.common import small_or_shuffled, table
from trajekt.session import materialise

WINDOW = 50
#: Words of a seed. Of each WINDOW - SEED + 1 seeds in a row the least is chosen, so that equal windows share a chosen seed.
SEED = 20


def _seeds(window: int, seed: int):
    """For each document: n_words, a hash of its word sequence, and chosen seeds as (hashes, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in W.chunks(batch["text"]):
                h = w.hashes()
                n = np.diff(w.first)
                up, down = W.powers(W.SECOND_BASE, len(h) + 1)
                sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[: len(h)])))
                whole = W.mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]] + n.astype(np.uint64))
                plain = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(h + np.uint64(1)) * W.powers(W.WORD_BASE, len(h) + 1)[0][: len(h)])))
                other = W.mix((plain[w.first[1:]] - plain[w.first[:-1]]) * W.powers(W.WORD_BASE, len(h) + 1)[1][w.first[:-1]])
                g = W.rolled(h, seed)
                span = window - seed + 1
                starts, counts = W.inside(w.first, window)
                hashes, places, sizes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(to - at, np.int64)
                if len(starts):
                    # a seed is the least of a window around it if it equals the greatest of the minima of all windows around it
                    least = np.zeros(len(g) + span - 1, np.uint64)
                    least[starts + span - 1] = W.sliding_min(g, span)[starts]
                    chosen = np.flatnonzero(W.sliding_max(least, span) == g[: len(least) - span + 1])
                    doc = np.searchsorted(w.first, chosen, side="right") - 1
                    hashes, places = W.signed(g[chosen]), (chosen - w.first[doc]).astype(np.int32)
                    sizes = np.bincount(doc, minlength=to - at)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(at, to - at), "n_words": pa.array(n, pa.int64()), "t1": pa.array(W.signed(whole)), "t2": pa.array(W.signed(other)),
                    "hashes": pa.ListArray.from_arrays(ends, pa.array(hashes)), "places": pa.ListArray.from_arrays(ends, pa.array(places)),
                })

    return run


def _windows(window: int, seed: int):
    """Hashes of the windows around shared seeds: (doc_id, start, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["places"]
            for at, to, w in W.chunks(batch["text"]):
                h = w.hashes()
                g, g2 = W.rolled(h, window), W.rolled(h, window, W.SECOND_BASE)
                starts, counts = W.inside(w.first, window)
                if not len(starts):
                    continue
                own = places.slice(at, to - at)
                doc = np.repeat(np.arange(to - at), own.value_lengths().fill_null(0).to_numpy())
                seeds = np.minimum(own.flatten().to_numpy() + w.first[doc], w.first[doc + 1])
                # a window that begins at s holds the seeds that begin in s .. s + window - seed
                marks = np.bincount(np.maximum(seeds - (window - seed), w.first[doc]), minlength=len(h) + 2) - np.bincount(seeds + 1, minlength=len(h) + 2)
                starts = starts[np.cumsum(marks)[starts] > 0]
                doc = np.searchsorted(w.first, starts, side="right") - 1
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(at, to - at).take(pa.array(doc)), "start": pa.array((starts - w.first[doc]).astype(np.int32)), "h1": pa.array(W.signed(g[starts])), "h2": pa.array(W.signed(g2[starts]).astype(np.int32))})

    return run


def kept_words(text: str | None, begins, ends) -> tuple[str, int, int]:
    """The text's words outside the intervals, joined by a space, with the number of words and of those removed."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for b, e in zip(begins if begins is not None else (), ends if ends is not None else ()):
        kept += words[at:b]
        at = e
    kept += words[at:]
    return b" ".join(kept).decode(), len(words), len(words) - len(kept)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [kept_words(*x) for x in zip(batch["text"].to_pylist(), batch["begins"].to_pylist(), batch["ends"].to_pylist())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "kept": pa.array([x[0] for x in done], pa.string()), "n_words": pa.array([x[1] for x in done], pa.int64()), "n_removed": pa.array([x[2] for x in done], pa.int64())})


def intervals(starts, window: int):
    """Begins and ends of the maximal intervals that windows at the sorted `starts` cover."""
    begins = F.filter(starts, lambda x, i: (i == 0) | (x - F.get(starts, i - 1) > window))
    ends = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - x > window))
    return begins.alias("begins"), F.transform(ends, lambda x: x + window).alias("ends")


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n_words, copy), and (doc_id, starts) of windows that also start in a document of smaller id.

    Every window is hashed; what is counted in Spark are the windows that hold a seed found in two documents. Each stretch of
    WINDOW words has a least seed, chosen in every document with that stretch, so no repeated window lacks one. Documents of the
    same words meet as one: `copy` marks all but that of the smallest id, whose every window starts there too.
    """
    # places among rows of one id can't be told apart, so the seeds of repeated rows are those of one row
    first = materialise(docs.select("doc_id", "text").mapInArrow(_seeds(window, seed), "doc_id long, n_words long, t1 long, t2 long, hashes array<long>, places array<int>"), "seeds")
    least = materialise(first.where("doc_id is not null").groupBy("t1", "t2", "n_words").agg(F.min("doc_id").alias("of")), "texts")
    met = materialise(first.join(least, ["t1", "t2", "n_words"], "left").select("doc_id", "n_words", "of", "hashes", "places"), "marked")
    own = met.where("doc_id = of and size(hashes) > 0").select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("doc_id", F.col("s.hashes").alias("h"), F.col("s.places").alias("place"))
    shared = materialise(own.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "shared")
    places = own.join(shared, "h").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    places = materialise(places, "places").withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(small_or_shuffled(places.select("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    texts = texts.join(places.hint("shuffle_hash"), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "places")
    windows = materialise(texts.mapInArrow(_windows(window, seed), "doc_id long, start int, h1 long, h2 int"), "windows")
    counted = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a")
    counted = materialise(counted, "counted")
    later = windows.join(counted, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    later = later.select("doc_id", *intervals(F.col("starts"), window))
    return met.select("doc_id", "n_words", (F.col("doc_id") > F.col("of")).alias("copy")), later


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of docs (doc_id, text): no word stays that lies in a repeated window.

    Null texts have no words. Rows of a null id are compared with none and stay whole. Rows of one id count as one document, so
    they never remove each other's words. Fewer than `window` words are no window. An empty table gives an empty one.
    """
    facts, later = repeated_windows(docs, window, seed)
    full = facts.where(f"copy and n_words >= {window}").groupBy("doc_id").agg(F.max("n_words").cast("int").alias("n"))
    full = full.select("doc_id", F.array(F.lit(0)).alias("begins"), F.array("n").alias("ends"))
    cut = later.unionByName(full).groupBy("doc_id").agg(F.first("begins").alias("begins"), F.first("ends").alias("ends"))
    cut = materialise(cut, "cut").withColumnRenamed("doc_id", "__id")
    met = docs.select("doc_id", "text").join(small_or_shuffled(cut), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "begins", "ends")
    return met.mapInArrow(_removed, "doc_id long, kept string, n_words long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
spot AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS s FROM w WHERE len(words) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h FROM spot),
least AS (SELECT h, min(doc_id) AS a, max(doc_id) AS b FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT win.doc_id, unnest(generate_series(s, s + 49)) AS pos FROM win JOIN least USING (h) WHERE win.doc_id > a),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (
  SELECT word.doc_id, count(*) FILTER (gone.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL) AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
