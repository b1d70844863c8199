"""Best-fit packing of tokenised documents into sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm.common import released, table
from trajekt.llm.wordpiece import byte_codes
from trajekt.session import materialise

LENGTH = 2048
END = 0
#: Pieces in a group, within which bins are filled and improved; then those of underfull bins form groups anew.
GROUP = 4096
#: A bin below this share is taken apart when groups are formed anew.
FULL = 0.98
SPECIAL = "<|endoftext|>"
MOST_CACHED, LONGEST_CACHED = 500_000, 48
#: ASCII signs that are neither letters, digits nor white space: at a word's end they are a pre-token of their own.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space at which texts are not cut.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Tokens(dict):
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer merges within pre-tokens only, and a pre-token never spans the end of a word before white space. So a text cut
    before single spaces and line breaks has the ids of its parts, and a part is encoded once while the cache holds it. The cache
    keeps two generations of `most` parts, about 250 bytes each; a worker keeps it from task to task. Texts with other white space or special tokens are encoded whole.
    """

    def __init__(self, path: str, most: int = MOST_CACHED):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.encoder, self.old, self.ends = Tokenizer.from_file(path), {}, {}
        self.merges, self.codes = self.encoder.model, {b: c for c, b in byte_codes().items()}

    def encoded(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, word: str) -> bytes:
        """Ids of a single pre-token, straight from the tokenizer's merges."""
        coded = word.encode().decode("latin-1").translate(self.codes)
        return array("I", [t.id for t in self.merges.tokenize(coded)]).tobytes()

    def signs(self, end: str) -> bytes:
        ids = self.ends.get(end)
        if ids is None:
            if len(self.ends) > 10_000:
                self.ends.clear()
            ids = self.ends[end] = self.merged(end)
        return ids

    def fresh(self, part: str) -> bytes:
        core = part.rstrip(SIGNS)
        if not core.isalpha():
            return self.encoded(part if part[:1] == "\n" else " " + part)
        return self.merged(" " + part) if core == part else self[core] + self.signs(part[len(core) :])

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.fresh(part)
        if len(part) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = text.replace("\n", " \n").split(" ")
        # without other white space the numbers are equal only if every space and line break stands alone between words
        if len(text.split()) != len(parts) or SPECIAL in text or any(c in text for c in OTHER_SPACE):
            return self.encoded(text)
        first = parts[0]
        head = self[first] if first[:1] == "\n" else self.encoded(first)
        return head + b"".join(map(self.__getitem__, parts[1:]))


_tokens: dict[tuple[str, int], Tokens] = {}


def _pieces(path: str | None, length: int, end: int, with_ids: bool, cached: int, kept_on: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            if not kept_on:
                _tokens.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path("byte_bpe_50k.json")
        if (place, cached) not in _tokens:
            _tokens[place, cached] = Tokens(place, cached)
        tokens = _tokens[place, cached]
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            owner, piece, start, size, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = tokens.ids(text) + last
                n = len(ids) // 4
                cut = n % length if n > length else n
                edges = [0, *range(cut or length, n, length), n]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    own = ids[4 * a : 4 * b]
                    owner.append(row)
                    piece.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(np.frombuffer(own, "<u4").astype(np.int32))
            out = {"doc_id": batch["doc_id"].take(pa.array(owner, pa.int32())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {}))

    return run if kept_on else released(run)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, cached: int = MOST_CACHED, kept_on: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each row of docs (doc_id, text).

    A null text is empty: its only id is `end`. Documents of more than `length` ids are cut from the end, so the first piece
    may be shorter. `path` is a tokenizer file that exists on every worker; None is the public byte-level one.
    `cached` is the number of parts of texts that a worker keeps encoded, its time against its memory; without `kept_on` it forgets
    them, and the tokenizer, at the end of each task.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, length, end, with_ids, cached, kept_on), schema)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each size: largest first, each into the fullest bin that still holds it."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            own, room, count = count, length, count + 1
        bins[i] = own
        room -= size
        if room:
            open_bins[room].append(own)
            rooms |= 1 << room
    return bins


def _taken(sizes: list[int], room: int) -> int:
    """Bit t for each total t that a bin of these sizes takes with a rise: for nothing or one of its pieces, within its room."""
    span, out = (1 << room) - 1, 0
    for size in {0, *sizes}:
        out |= span << (size + 1)
    return out


def _given(sizes: list[int]) -> int:
    """Bit t for each total t of one piece or two."""
    ones = both = 0
    for size in sizes:
        both |= ones << size
        ones |= 1 << size
    return ones | both


def _bits(number: int, width: int) -> np.ndarray:
    return np.frombuffer((number & ((1 << (64 * width)) - 1)).to_bytes(8 * width, "little"), "<u8")


def improve(sizes: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """Local search: take from the emptiest bin by moves, one-for-one and two-for-one exchanges with fuller bins, until none helps.

    An exchange raises the other bin's fill without passing its room, and of all exchanges that with the largest rise is made, so
    the sum of squared fills grows at each step and the search ends. A bin that can give nothing is left until one of the two bins
    of a later exchange, at least as full as it, takes one of its totals; all other bins are as they were when it was tried.
    """
    if not len(sizes):
        return bins.copy()
    own: list[list[int]] = [[] for _ in range(int(bins.max()) + 1)]
    for i, b in enumerate(bins.tolist()):
        own[b].append(i)
    size = sizes.astype(np.int64).tolist()
    bins, sizes = bins.copy(), sizes.astype(np.int64)
    fill = np.bincount(bins, sizes).astype(np.int64)
    width = length // 64 + 1
    given = np.stack([_bits(_given([size[i] for i in o]), width) for o in own])
    stuck = (fill >= length) | (fill == 0)
    none = length + 1
    while not stuck.all():
        donor = int(np.argmin(np.where(stuck, none, fill)))
        totals = np.flatnonzero(np.unpackbits(given[donor].view(np.uint8), bitorder="little"))
        fit = (fill < length) & (fill >= fill[donor])
        fit[donor] = False
        others = np.flatnonzero(fit[bins])
        # least[t]: the smallest piece, or none at all, for which some bin takes t
        least = np.full(length + 1, none)
        at = np.minimum(sizes[others] + length - fill[bins[others]], length)
        np.minimum.at(least, at, sizes[others])
        if fit.any():
            least[length - fill[fit].min()] = 0
        least = np.minimum.accumulate(least[::-1])[::-1]
        rise = totals - least[totals]
        best = int(rise.max(initial=0))
        if best <= 0:
            stuck[donor] = True
            continue
        total = int(totals[np.argmax(rise)])
        back = total - best
        mine = {size[i]: i for i in own[donor]}
        if total in mine:
            give = [mine[total]]
        else:
            seen: dict[int, int] = {}
            for i in own[donor]:
                if total - size[i] in seen:
                    give = [seen[total - size[i]], i]
                    break
                seen[size[i]] = i
        # of the bins that take it, the fullest
        if back:
            can = others[(sizes[others] == back) & (length - fill[bins[others]] >= best)]
            got = int(can[np.argmax(fill[bins[can]])])
            other = int(bins[got])
            own[other].remove(got)
            own[donor].append(got)
            bins[got] = donor
        else:
            can = np.flatnonzero(fit & (length - fill >= total))
            other = int(can[np.argmax(fill[can])])
        for i in give:
            own[donor].remove(i)
            own[other].append(i)
            bins[i] = other
        fill[other] += best
        fill[donor] -= best
        stuck[[donor, other]] = False
        for b in (donor, other):
            given[b] = _bits(_given([size[i] for i in own[b]]), width)
        for b in (donor, other):
            if 0 < fill[b] < length:
                waiting = np.flatnonzero(stuck & (fill <= fill[b]) & (fill > 0))
                takes = _bits(_taken([size[i] for i in own[b]], length - int(fill[b])), width)
                stuck[waiting[(given[waiting] & takes).any(axis=1)]] = False
        stuck |= (fill == 0) | (fill >= length)
    return np.unique(bins, return_inverse=True)[1]


def _packed(length: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        small = np.flatnonzero(sizes < length)
        bins = np.empty(len(sizes), np.int64)
        bins[small] = improve(sizes[small], best_fit(sizes[small], length), length)
        full = np.flatnonzero(sizes >= length)
        bins[full] = np.arange(len(full)) + (bins[small].max(initial=-1) + 1)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        own = bins[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(fresh, before, 0))
        fill = np.bincount(bins, sizes, minlength=1).astype(np.int64)
        group = int(rows["grp"].iloc[0])
        return rows.drop(columns=["grp"]).assign(sequence_id=(level << 56) | (group << 28) | bins, offset=offset, fill=fill[bins])

    return run


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP, full: float = FULL) -> DataFrame:
    """Rows of `parts` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, gapless in each sequence.

    Groups are dealt by hash, so a long document's pieces spread. After each round the pieces of underfull bins form fewer groups, until
    one is left or groups stop getting fewer; a group is never larger than about `group` pieces, and every piece ends in a sequence.
    """
    kind = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in parts.columns) + ", sequence_id long, offset long"
    open_parts, closed, level, groups = materialise(parts, "pieces"), [], 0, None
    while True:
        n = open_parts.count()
        wanted = max(1, -(-n // group))
        last = wanted == 1 or (groups is not None and wanted * 2 > groups) or level >= 60
        groups = wanted
        dealt = open_parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(groups)))
        rows = dealt.groupBy("grp").applyInPandas(_packed(length, level), schema + ", fill long")
        rows = materialise(rows, "packed")
        if last:
            closed.append(rows.drop("fill"))
            break
        closed.append(rows.where(F.col("fill") >= full * length).drop("fill"))
        open_parts = rows.where(F.col("fill") < full * length).select(*parts.columns)
        level += 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; a sequence holds 2048 ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(pieces(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
