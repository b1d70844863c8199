"""Target-distribution importance resampling: hashed n-gram counts of corpus and target, weights, and a draw by perturbed scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajekt.llm.common import table
from trajekt.session import materialise

#: Fixed by the contract: buckets of features, longest run of words, least words of a drawn document, share drawn in percent, seed.
BUCKETS, LONGEST, LEAST_WORDS, DRAWN, SEED = 10_000, 3, 20, 5, 42
#: Words are ASCII digits and letters and all characters beyond ASCII; a byte 0 stands between texts, as a token of its own.
TOKEN = re.compile(rb"\x00|[0-9a-z\x80-\xff]+")
BATCH_BYTES = 1 << 20
CRC_POLYNOMIAL = 0xEDB88320


def _crc_steps() -> np.ndarray:
    """The 256 values by which a CRC-32 moves over one byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC_POLYNOMIAL), step >> 1)
    return step


class Crc:
    """CRC-32 of joined byte strings from the parts' own, for whole arrays: crc(a + b) is crc(a) moved over len(b) zero bytes, xor crc(b).

    Moving is linear, so it is four look-ups by byte. There is a table for each length below NEAR and, beyond, for each power of two.
    """

    NEAR = 64

    def __init__(self):
        step = _crc_steps()

        def over(values: np.ndarray) -> np.ndarray:
            return step[values & 0xFF] ^ (values >> np.uint32(8))

        own = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        near = [own]
        for _ in range(self.NEAR):
            near.append(over(near[-1]))
        self.near, self.powers = np.stack(near), [near[1]]
        for _ in range(40):
            last = self.powers[-1]
            self.powers.append(self._through(last, last))
        self.space = np.uint32(zlib.crc32(b" "))

    @staticmethod
    def _through(moved: np.ndarray, values: np.ndarray) -> np.ndarray:
        return moved[0][values & 0xFF] ^ moved[1][(values >> 8) & 0xFF] ^ moved[2][(values >> 16) & 0xFF] ^ moved[3][values >> 24]

    def moved(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        flat, at = self.near.reshape(-1), np.minimum(length, self.NEAR) * 1024
        out = flat[at + (crc & 0xFF)] ^ flat[at + 256 + ((crc >> 8) & 0xFF)] ^ flat[at + 512 + ((crc >> 16) & 0xFF)] ^ flat[at + 768 + (crc >> 24)]
        far = np.flatnonzero(length > self.NEAR)
        if len(far):
            rest = length[far] - self.NEAR
            for bit, power in enumerate(self.powers):
                on = np.flatnonzero((rest >> bit) & 1)
                if len(on):
                    out[far[on]] = self._through(power, out[far[on]])
        return out

    def spaced(self, crc: np.ndarray) -> np.ndarray:
        """CRC after one more byte, a space."""
        return self._through(self.near[1], crc) ^ self.space


def features(texts: list[str | None], crc: Crc, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts, and the texts' numbers of words.

    The texts are joined with sentinels, one pass of the pattern finds all words, and a run of words counts only if its first and last
    word lie in one text by the sentinels' places.
    """
    joined = b"\x00".join([(t or "").encode().replace(b"\x00", b" ") for t in texts] + [b""]).lower()
    found = TOKEN.findall(joined)
    n = len(found)
    own = np.fromiter(map(zlib.crc32, found), np.uint32, n)
    length = np.fromiter(map(len, found), np.int64, n)
    borders = np.flatnonzero((length == 1) & (own == zlib.crc32(b"\x00")))
    owner = np.searchsorted(borders, np.arange(n), "left")
    word = np.ones(n, bool)
    word[borders] = False
    texts_of, bucket_of, run = [], [], own
    for size in range(1, longest + 1):
        if size > 1:
            if n < size:
                break
            run = crc.moved(crc.spaced(run[: n - size + 1]), length[size - 1 :]) ^ own[size - 1 :]
        first, last = slice(0, n - size + 1), slice(size - 1, n)
        inside = word[first] & word[last] & (owner[first] == owner[last])
        texts_of.append(owner[first][inside])
        bucket_of.append((run[inside] % np.uint32(buckets)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate(texts_of or [empty]), np.concatenate(bucket_of or [empty]), np.bincount(owner[word], minlength=len(texts))


def _runs(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Consecutive texts of about BATCH_BYTES together; a longer one comes alone."""
    own, size, start = [], 0, 0
    for i, text in enumerate(texts.to_pylist()):
        own.append(text)
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield start, own
            own, size, start = [], 0, i + 1
    if own:
        yield start, own


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = Crc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _runs(batch["text"]):
                total += np.bincount(features(texts, crc, buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of `rows` (text): each task adds up its own, so at most `buckets` rows a task are shuffled."""
    return rows.select("text").mapInArrow(_counted(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the two tables of bucket counts: 1000 times the log ratio with one added to each bucket, floored."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = materialise(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(sums["all_s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(sums["all_t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for batch in batches:
            for at, texts in _runs(batch["text"]):
                owner, bucket, words = features(texts, crc, len(gain), longest)
                # sums of whole numbers far below 2^53 are exact
                weight = np.bincount(owner, gain[bucket].astype(np.float64), len(texts)).astype(np.int64)
                count = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(at, len(texts)), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(count, pa.int64()), "weight": pa.array(weight, pa.int64())})

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel value from a digest of the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with __rank, from 1, in the given order: a range sort, places within each part, and the parts' sizes summed up.

    The sorted rows are stored, so the places are those of one sort; the sizes are one row for each part. Rows equal in the order
    follow each other in any order.
    """
    placed = materialise(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    met = placed.join(F.broadcast(starts), part == F.col("__part"))
    return met.withColumn("__rank", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__start")


def resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text) against the texts of `target` (text).

    Two scans of the texts: one adds up bucket counts, one weighs each text by the table of gains, whose size is the number of buckets.
    Documents of at least `least_words` words are sorted by score, ties by smaller id (null ids last), and the first `drawn` percent of
    them, rounded down, are ranked; all other rows have a null rank.

    Null and blank texts have no features and weight 0. A null id hashes as the empty text; rows with equal ids are documents each, rows equal in
    score and id are ranked in any order. An empty target weighs by rarity alone, an empty table gives no rows. Further columns of any name
    are ignored. A text of any length is one run of its own in a task.
    """
    counts = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    gain = np.zeros(buckets, np.int64)
    for row in counts.toLocalIterator():
        gain[row["bucket"]] = row["gain"]
    kind = dict(docs.dtypes)["doc_id"]
    weighed = docs.select("doc_id", "text").mapInArrow(_weighed(gain, longest), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    most = able.count() * drawn // 100
    ranked = numbered(able, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = ranked.select(*scored.columns, F.when(F.col("__rank") <= most, F.col("__rank")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
