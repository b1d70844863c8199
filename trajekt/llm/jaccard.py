"""N-gram Jaccard join: MinHash values compared step by step, pairs dropped by their posterior, the rest verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm import words as W
from trajekt.llm.common import components, released, small_or_shuffled, table
from trajekt.session import materialise

GRAM = 5
THRESHOLD = 0.8
#: 20 bands of 4 values: a pair at the threshold shares a band with probability 1 - 3e-5, and a family all the more.
BANDS, ROWS = 20, 4
STEP = 16
#: A pair is dropped if its chance of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Documents in a block; pairs of blocks are the tasks of a large family.
BLOCK = 512


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For each number of compared values, the fewest equal ones with which a pair stays.

    With a uniform prior and m of n values equal the similarity is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in steps:
        tail = [sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) for m in range(n + 1)]
        out.append(next(m for m in range(n + 1) if tail[m] >= tolerance or m == n))
    return out


def shingles(w: W.Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the ends. Fewer words than `gram` are one shingle."""
    h = w.hashes()
    starts, counts = W.inside(w.first, gram)
    g = W.rolled(h, gram)[starts] if len(starts) else np.zeros(0, np.uint64)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < gram))
    owner = np.repeat(np.arange(len(n)), counts)
    if len(short):
        extra = np.array([np.bitwise_xor.reduce(W.mix(h[w.first[t] : w.first[t + 1]] + np.arange(1, n[t] + 1, dtype=np.uint64) * np.uint64(W.WORD_BASE))) for t in short.tolist()], np.uint64)
        g, owner = np.concatenate([g, extra]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[fresh], np.cumsum(np.bincount(owner[fresh], minlength=len(n)))


def signatures(g: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """size least 32-bit values of each text's shingles under as many hash functions; texts without shingles get the largest."""
    out = np.full((len(ends), size), 0xFFFFFFFF, np.uint32)
    begins = np.concatenate(([0], ends[:-1]))
    some = np.flatnonzero(ends > begins)
    if len(some):
        rng = np.random.default_rng(20)
        factors = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for i, f in enumerate(factors):
            out[some, i] = np.minimum.reduceat(((g ^ (g >> np.uint64(29))) * f) >> np.uint64(32), begins[some]).astype(np.uint32)
    return out


def _sketches(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in W.chunks(batch["text"]):
                g, ends = shingles(w, gram)
                begins = np.concatenate(([0], ends[:-1]))
                total = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(g + np.uint64(5)))))
                other = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(g ^ np.uint64(W.SECOND_BASE)))))
                sig = signatures(g, ends, BANDS * ROWS).astype(np.uint64).reshape(-1, BANDS, ROWS)
                bands = np.zeros(sig.shape[:2], np.uint64)
                for r in range(ROWS):
                    bands = W.mix(bands + sig[:, :, r] + np.uint64(W.WORD_BASE))
                bands = bands + np.arange(BANDS, dtype=np.uint64)
                full = np.where(ends > begins, BANDS, 0)
                offsets = pa.array(np.concatenate(([0], np.cumsum(full))), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(at, to - at), "n": pa.array(ends - begins, pa.int64()),
                    "s1": pa.array(W.signed(total[ends] - total[begins])), "s2": pa.array(W.signed(other[ends] - other[begins])),
                    "bands": pa.ListArray.from_arrays(offsets, pa.array(W.signed(np.ascontiguousarray(bands[full > 0]).reshape(-1)))),
                })

    return run


def _members(gram: int):
    """The signature and the shingles of each text, with the columns of its family."""
    others = ["family", "rep", "weight", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in W.chunks(batch["text"]):
                g, ends = shingles(w, gram)
                sig = signatures(g, ends, BANDS * ROWS)
                begins = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_pydict({c: batch[c].slice(at, to - at) for c in others} | {"sig": pa.array([s.tobytes() for s in sig], pa.binary()), "grams": pa.array([g[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())})

    return run


def candidates(sig: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> np.ndarray:
    """Pairs (i < j) of rows that stay when their values are compared `step` at a time and unlikely pairs are dropped."""
    steps = list(range(step, sig.shape[1] + 1, step))
    least = least_matches(threshold, tolerance, steps)
    i, j = np.triu_indices(len(sig), 1)
    equal = np.zeros(len(i), np.int32)
    for n, m in zip(steps, least):
        for a in range(0, len(i), 1 << 17):
            equal[a : a + (1 << 17)] += (sig[i[a : a + (1 << 17)], n - step : n] == sig[j[a : a + (1 << 17)], n - step : n]).sum(1, dtype=np.int32)
        stay = equal >= m
        i, j, equal = i[stay], j[stay], equal[stay]
    return np.stack([i, j], 1)


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs' sets, from products of 0/1 matrices over slices of the shared shingles."""
    used = np.unique(pairs)
    if len(pairs) < 64 or len(pairs) < len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    values = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    owner, column = owner[counts[column] > 1], column[counts[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    product = np.zeros((len(used), len(used)), np.float64)
    width = 8192
    for c in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [c, c + width])
        dense = np.zeros((len(used), width), np.float32)
        dense[owner[a:b], column[a:b] - c] = 1
        product += dense @ dense.T
    at = np.searchsorted(used, pairs)
    return product[at[:, 0], at[:, 1]].astype(np.int64)


LINKS = "rep long, hub long, links long, text_links long"


def _links(threshold: float):
    """Links of one pair of blocks: for each representative how many documents and texts it links to, and a hub of its component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep"]).sort_values("rep", ignore_index=True)
        if len(rows) < 2:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rep", "hub", "links", "text_links")})
        sig = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
        sets = [np.frombuffer(s, np.uint64) for s in rows["grams"]]
        reps, weight, block = (rows[c].to_numpy(np.int64) for c in ("rep", "weight", "block"))
        pairs = candidates(sig, threshold)
        if rows["bi"].iloc[0] != rows["bj"].iloc[0]:
            pairs = pairs[block[pairs[:, 0]] != block[pairs[:, 1]]]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets, pairs)
        pairs = pairs[both >= threshold * (size[pairs].sum(1) - both) - 1e-9]
        links, texts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(links, pairs[:, a], weight[pairs[:, b]])
            np.add.at(texts, pairs[:, a], 1)
        hub = np.arange(len(rows))
        while len(pairs):
            low = np.minimum(hub[pairs[:, 0]], hub[pairs[:, 1]])
            new = hub.copy()
            np.minimum.at(new, pairs[:, 0], low)
            np.minimum.at(new, pairs[:, 1], low)
            new = new[new]
            if (new == hub).all():
                break
            hub = new
        own = np.flatnonzero(texts)
        return pd.DataFrame({"rep": reps[own], "hub": reps[hub[own]], "links": links[own], "text_links": texts[own]})

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links for each row of docs (doc_id, text).

    Documents with the same set of `gram`-word shingles are copies and meet as one, the smallest id (`copy_of`); `n_copies` counts them.
    Two sets are linked if their Jaccard similarity reaches `threshold`; `n_links` counts the other documents linked to a row, its
    copies too, and class_id is the smallest id that links lead to.

    Representatives that share a band of MinHash values form families (connected, so no bucket is ever paired out). A family is cut into
    blocks by hash; each pair of blocks is one group, in which pairs are pruned by the posterior and the rest verified by exact
    products. A group returns counts and a hub for each representative, not pairs, so a group of near copies gives rows in
    proportion to its size, and no partner is left out.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; fewer than `gram` words are one shingle. Null, empty and blank texts have the empty set and
    are copies of each other. A row without an id has no class and no links. Rows of one id are one document.
    """
    sketch = materialise(docs.select("doc_id", "text").mapInArrow(released(_sketches(gram)), "doc_id long, n long, s1 long, s2 long, bands array<long>"), "sketch")
    known = sketch.where("doc_id is not null")
    reps = known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("weight"))
    reps = materialise(reps, "reps")
    own = known.join(reps.select(F.col("rep").alias("doc_id"), F.col("s1").alias("t1"), F.col("s2").alias("t2")), "doc_id").where("s1 = t1 and s2 = t2").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    own = materialise(own.distinct(), "bands")
    hubs = materialise(own.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "hubs")
    edges = own.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    family = materialise(components(edges), "families")
    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    family = family.join(sizes, "root").join(reps.select(F.col("rep").alias("node"), "weight"), "node")
    family = family.select(F.col("root").alias("family"), F.col("node").alias("rep"), "weight", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    family = materialise(family, "members")
    texts = docs.select("doc_id", "text").join(small_or_shuffled(family.select(F.col("rep").alias("__id"))), F.col("doc_id") == F.col("__id"), "left_semi")
    texts = texts.join(family.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("family", "rep", "weight", "blocks", "text")
    members = texts.mapInArrow(released(_members(gram)), "family long, rep long, weight long, blocks int, sig binary, grams binary")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_blocks = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = with_blocks.select("family", "rep", "weight", "sig", "grams", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    found = materialise(paired.groupBy("family", "bi", "bj").applyInPandas(_links(threshold), LINKS), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = reps.join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("s1", "s2", "n", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    facts = materialise(facts, "classes")
    met = sketch.select("doc_id", "s1", "s2", "n").join(facts, ["s1", "s2", "n"], "left")
    known = F.col("doc_id").isNotNull()
    return met.select("doc_id", F.when(known, F.col("root")).alias("class_id"), F.when(known, F.col("rep")).alias("copy_of"), F.when(known, F.col("weight")).otherwise(0).alias("n_copies"), F.when(known, F.col("links") + F.col("weight") - 1).otherwise(0).alias("n_links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5
    THEN list_transform(generate_series(1, len(words) - 4), lambda s: array_to_string(words[s:s + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS grams FROM w),
reps AS (SELECT grams, min(doc_id) AS rep, count(*) AS weight, len(grams) AS n FROM g GROUP BY grams),
each AS (SELECT rep, unnest(grams) AS gram FROM reps),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM each a JOIN each b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
linked AS (
  SELECT a, b, y.weight AS weight FROM pairs JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach AS (SELECT rep AS node, rep AS root FROM reps UNION SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
links AS (SELECT a, sum(weight) AS links FROM linked GROUP BY a)
SELECT g.doc_id, roots.root AS class_id, reps.rep AS copy_of, reps.weight AS n_copies, (coalesce(links.links, 0) + reps.weight - 1)::BIGINT AS n_links
FROM g JOIN reps ON g.grams = reps.grams JOIN roots ON roots.node = reps.rep LEFT JOIN links ON links.a = reps.rep
"""
