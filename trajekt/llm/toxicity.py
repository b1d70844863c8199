"""Toxicity: class-conditional Kneser-Ney models of byte 6-grams with shared backoff, compared by length-normalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajekt.llm import words as W
from trajekt.llm.common import released, small_or_shuffled, table
from trajekt.session import materialise

ORDER = 6
DISCOUNT = 0.75
#: Entries in a slice of the scoring table, about 40 MB with their index: more grams make more slices, not larger ones.
SLICE = 1 << 21
#: Slices that a worker keeps in memory. Those of a longer table are read one after the other for each run of texts.
HELD = 6
#: Added to a text's length, so that a few bytes are no evidence.
PRIOR_LENGTH = 64
THRESHOLD = 0.7
#: The model of both permitted folds, beside 0 and 2 of one each.
BOTH = 9
PRECISION, LEAST_CHANCE = 0.95, 0.35
BINS = 4000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """0 and 2: the models and the calibration learn from a labelled row, 1: it is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def grams(w: W.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte grams of all texts in a run, one after the other, as numbers, and how many each text has.

    A-Z are lower-cased and a run of white space is one space.
    """
    data = _FOLD[w.data]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    edges = np.concatenate(([0], np.cumsum(keep)))[w.edges]
    data = data[keep]
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(w.edges) - 1, np.int64)
    wide, keys = data.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(order):
        keys <<= np.uint64(8)
        keys |= wide[j : j + n]
    starts, counts = W.inside(edges, order)
    return keys[starts], counts


def _counted(order: int, most: int = 1 << 20):
    """(g, c0, c1, c2, c3): grams of the texts of kind 0 to 3, summed within a task until there are `most` of them."""

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.stack([np.bincount(inverse, np.concatenate([n[c] for _, n in held]), len(keys)).astype(np.int64) for c in range(4)])

    def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": pa.array(W.signed(keys))} | {f"c{c}": pa.array(counts[c]) for c in range(4)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            kind = batch["kind"].to_numpy(zero_copy_only=False).astype(np.int64)
            for at, to, w in W.chunks(batch["text"]):
                keys, counts = grams(w, order)
                own = np.repeat(kind[at:to], counts)
                held.append(out([(keys, np.stack([own == c for c in range(4)]).astype(np.int64))]))
            if sum(len(k) for k, _ in held) > most:
                held = [out(held)]
                if len(held[0][0]) > most:
                    yield batch_of(*held[0])
                    held = []
        if held:
            yield batch_of(*out(held))

    return released(run)


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(m, g, c0, c1) of texts (text, toxic, fold): counts by class of the models 0 and 2, of that fold alone, and BOTH."""
    kinds = texts.select("text", (F.col("toxic") + F.col("fold")).alias("kind"))
    sums = kinds.mapInArrow(_counted(order), "g long, c0 long, c1 long, c2 long, c3 long").groupBy("g").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(4)])
    by_model = [(0, F.col("c0"), F.col("c1")), (2, F.col("c2"), F.col("c3")), (BOTH, F.col("c0") + F.col("c2"), F.col("c1") + F.col("c3"))]
    rows = F.array(*[F.struct(F.lit(m).alias("m"), F.col("g"), a.alias("c0"), b.alias("c1")) for m, a, b in by_model])
    return sums.select(F.inline(rows)).where("c0 + c1 > 0")


def language_models(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(m, key, value) of each model m of `counts` (m, g, c0, c1): what a text's grams need to be scored, seen or not.

    Orders from the highest to 2 are of the class: text counts, then continuation counts (in how many places of the order above a
    gram ends). What discounts leave goes to the order below, and last to the continuation counts of both classes together,
    so an expression that neither class has is about as likely in both. The value of a gram of 2 to `order` bytes is
    log P(last byte | the bytes before, toxic) - log of the same for the other class; that of a context of 1 to `order` - 1 bytes is the
    same difference of the shares that it leaves to the order below. `gram_key` and `context_key` tell keys apart.
    """
    tables = [counts.select("m", "g", F.col("c0").alias("n0"), F.col("c1").alias("n1"))]
    for k in range(order - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        ends = [F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"n{c}") for c in (0, 1)]
        tables.append(materialise(tables[-1].groupBy("m", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(*ends), "grams"))
    # a model has 256 rows of order 1 at most
    total = F.sum(F.col("n0") + F.col("n1")).over(Window.partitionBy("m"))
    base = (F.col("n0") + F.col("n1") + 0.5) / (total + 128.0)
    lower = tables[-1].select(F.col("m").alias("lm"), F.col("g").alias("low"), base.alias("p0"), base.alias("p1"))
    out = []
    for k in range(2, order + 1):
        mask = (1 << (8 * (k - 1))) - 1
        own = tables[order - k].withColumn("context", F.shiftright("g", 8))
        sums = [x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"s{c}"), F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"d{c}"))]
        contexts = own.groupBy("m", "context").agg(*sums)
        left = [F.when(F.col(f"s{c}") > 0, DISCOUNT * F.col(f"d{c}") / F.col(f"s{c}")).otherwise(1.0) for c in (0, 1)]
        contexts = materialise(contexts.select("m", "context", "s0", "s1", left[0].alias("l0"), left[1].alias("l1")), "contexts")
        own = own.join(contexts, ["m", "context"]).join(lower, (F.col("m") == F.col("lm")) & (F.col("g").bitwiseAND(F.lit(mask)) == F.col("low")))
        p = [F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{c}")).otherwise(0.0) + F.col(f"l{c}") * F.col(f"p{c}") for c in (0, 1)]
        lower = materialise(own.select(F.col("m").alias("lm"), F.col("g").alias("low"), p[0].alias("p0"), p[1].alias("p1")), "shared")
        out.append(lower.select(F.col("lm").alias("m"), gram_key(F.col("low"), k).alias("key"), F.log(F.col("p1") / F.col("p0")).alias("value")))
        out.append(contexts.select("m", context_key(F.col("context"), k - 1).alias("key"), F.log(F.col("l1") / F.col("l0")).alias("value")))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


def gram_key(g, length: int):
    """A gram of at most 6 bytes below its length, so that grams of several lengths are told apart; a column or an array."""
    return g.bitwiseOR(F.lit(length << 48)) if isinstance(g, Column) else g | np.uint64(length << 48)


def context_key(g, length: int):
    return gram_key(g, 8 + length)


def built(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice: entries by hash, and where those of each bucket start. There are about as many buckets as entries."""
    mixed = W.mix(keys)
    bits = max(1, len(keys).bit_length())
    order = np.argsort(mixed)
    starts = np.zeros((1 << bits) + 1, np.uint32)
    np.cumsum(np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), out=starts[1:])
    return starts, keys[order], values[order].astype(np.float32)


def found(part: tuple, keys: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key, 0 for those that the slice doesn't have, and which it has. Whole keys are compared."""
    starts, own, values = part
    home = (mixed >> np.uint64(64 - (len(starts).bit_length() - 1))).astype(np.int64)
    at, ends = starts[home].astype(np.int64), starts[home + 1].astype(np.int64)
    out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    left = np.flatnonzero(at < ends)
    while len(left):
        place = at[left]
        same = own[place] == keys[left]
        out[left[same]], hit[left[same]] = values[place[same]], True
        at[left] += 1
        left = left[~same & (place + 1 < ends[left])]
    return out, hit


@dataclass
class Scorer:
    """parts are broadcast slices of the scoring table; every entry of the model is in one of them."""

    parts: list
    order: int = ORDER

    @property
    def most_bytes(self) -> int:
        """Texts scored together: many where slices are read again for each run of texts."""
        return 1 << 20 if len(self.parts) <= HELD else 1 << 24

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = W.mix(keys)
        if len(self.parts) == 1:
            return found(self.parts[0].value, keys, mixed)
        out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        own = (mixed % np.uint64(len(self.parts))).astype(np.int32)
        by_slice = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[by_slice], np.arange(len(self.parts) + 1))
        for i, part in enumerate(self.parts):
            at = by_slice[edges[i] : edges[i + 1]]
            if len(at):
                out[at], hit[at] = found(part.value, keys[at], mixed[at])
                if len(self.parts) > HELD:
                    part.__dict__.pop("_value", None)
        return out, hit

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each gram of `order` bytes: its own, or the shares of its contexts down to the longest end that was seen."""
        keys, places = np.unique(keys, return_inverse=True)
        out, hit = self.entries(gram_key(keys, self.order))
        new = np.flatnonzero(~hit)
        if len(new):
            # all that a new gram can fall back to is looked up at once, so that slices are read twice
            ends = {k: keys[new] & np.uint64((1 << (8 * k)) - 1) for k in range(1, self.order + 1)}
            wanted = [context_key(ends[k] >> np.uint64(8), k - 1) for k in range(self.order, 1, -1)] + [gram_key(ends[k], k) for k in range(self.order - 1, 1, -1)]
            asked, back = np.unique(np.concatenate(wanted), return_inverse=True)
            got, seen = self.entries(asked)
            got, seen = (x[back].reshape(len(wanted), len(new)) for x in (got, seen))
            sums, open_ = got[0].copy(), np.ones(len(new), bool)
            for i in range(1, self.order - 1):
                gram = self.order - 2 + i
                sums += np.where(open_, np.where(seen[gram], got[gram], got[i]), 0)
                open_ &= ~seen[gram]
            out[new] = sums
        return out[places]

    def ratios(self, w: W.Words) -> np.ndarray:
        keys, counts = grams(w, self.order)
        sums = np.concatenate(([0.0], np.cumsum(self.values(keys), dtype=np.float64)))
        ends = np.cumsum(counts)
        return (sums[ends] - sums[ends - counts]) / (counts + PRIOR_LENGTH)


def _cut(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = W.mix(batch["key"].to_numpy().view(np.uint64)) % np.uint64(slices)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(own.astype(np.int32)), "key": batch["key"], "value": batch["value"].cast(pa.float32())})

    return run


def scoring_table(models: DataFrame, most: int = SLICE) -> list:
    """Broadcast slices by hash that hold every row of the models (key, value). The driver sees one slice at a time, of about `most` rows."""
    models = models.select("key", "value")
    slices = max(1, -(-models.count() // most))
    rows = models.mapInArrow(_cut(slices), "slice int, key long, value float")
    if slices > 1:
        rows = materialise(rows.sortWithinPartitions("slice"), "slices")
    parts = []
    for i in range(slices):
        own = rows.where(F.col("slice") == i).select("key", "value").toArrow()
        parts.append(models.sparkSession.sparkContext.broadcast(built(own["key"].to_numpy().view(np.uint64), own["value"].to_numpy())))
    return parts


def _ratios(parts: list, order: int, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(parts, order)
        for batch in batches:
            ratio = [scorer.ratios(w) for _, _, w in W.chunks(batch["text"], scorer.most_bytes)]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in others} | {"ratio": pa.array(np.concatenate(ratio) if ratio else np.zeros(0))})

    return released(run)


def calibration(binned: DataFrame) -> tuple[float, float]:
    """Intercept and slope of a logistic fit of `toxic` to the ratio, over counts by bin: a bin is 1 / BINS wide, so their number is bounded.

    The intercept is then moved so that THRESHOLD lies at the lowest chance, LEAST_CHANCE or more, above which the fit expects PRECISION.
    """
    rows = [(r["bin"] / BINS, r["toxic"], r["n"]) for r in binned.collect()]
    if len({y for _, y, _ in rows}) < 2:
        return 0.0, 0.0
    x, y, n = (np.array(v, float) for v in zip(*rows))
    scale = max(float(np.sqrt((n * x * x).sum() / n.sum())), 1e-6)
    basis = np.stack([np.ones_like(x), x / scale])
    at = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ basis, -30, 30)))
        # a weak pull to zero keeps the slope finite where the classes part cleanly
        slope = basis @ (n * (y - p)) - 0.05 * at
        step = np.linalg.solve((basis * (n * p * (1 - p))) @ basis.T + 0.05 * np.eye(2), slope)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(at @ basis, -30, 30)))
    order = np.argsort(-p, kind="stable")
    caught, flagged = np.cumsum((n * p)[order]), np.cumsum(n[order])
    sure = (caught / flagged >= PRECISION) & (p[order] >= LEAST_CHANCE)
    cut = float(p[order][np.flatnonzero(sure)[-1]]) if sure.any() else THRESHOLD
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut))
    return float(at[0] + shift), float(at[1] / scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, order: int = ORDER, most: int = SLICE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); the score is a function of the text alone.

    Rows of `labels` (doc_id, toxic) whose crc32(doc_id as text) mod 3 is 0 or 2 teach the language models, all of them. The
    calibration learns from the same rows, each scored by models of the other remainder; an id with several labels counts as toxic if one says so, null labels count for nothing. Null and empty texts
    have ratio 0. Labels of fewer than two classes give 0.5 everywhere. Text moves only to meet labels, and only where these
    are too many to broadcast.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialise(known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 1").withColumnRenamed("doc_id", "__id"), "labels")

    labelled = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 1).join(small_or_shuffled(known), F.col("doc_id") == F.col("__id")).select("text", "toxic", "fold")
    counts = materialise(gram_counts(labelled, order), "counts")
    models = materialise(language_models(counts, order), "models")
    tables = {m: scoring_table(models.where(F.col("m") == m), most) for m in (0, 2, BOTH)}
    crossed = [labelled.where(F.col("fold") == m).mapInArrow(_ratios(tables[2 - m], order, ["toxic"]), "toxic int, ratio double") for m in (0, 2)]
    binned = crossed[0].unionByName(crossed[1]).groupBy(F.floor(F.col("ratio") * BINS).cast("int").alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n"))
    a, b = calibration(binned)
    shared = tables[BOTH]
    scored = docs.select("doc_id", "text").mapInArrow(_ratios(shared, order, ["doc_id"]), f"doc_id {dict(docs.dtypes)['doc_id']}, ratio double")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col("ratio"))))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
