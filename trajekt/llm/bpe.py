"""BPE encoding and decoding: texts as positions in tables of distinct words, each distinct word encoded once, ids back by position."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm.common import table
from trajekt.llm.wordpiece import byte_codes

#: Fixed: the characters of Unicode's property White_Space, which is what the tokenizer's pattern takes as white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of one kind of ASCII character may end only before white space or an ASCII character of another kind, apostrophes aside.
GOES_ON = "(?!['\\x80-\\U0010ffff])"
WORD = re.compile(f"[{WHITE}]*(?:[A-Za-z]++{GOES_ON}|[0-9]++{GOES_ON}|[!-&(-/:-@\\[-`{{-~]++{GOES_ON}|[^{WHITE}]+)|[{WHITE}]+")
#: A chunk of texts, with one table of its distinct words, ends at so many bytes; its positions go in rows of about so many words.
CHUNK_BYTES, ROW_WORDS = 32 << 20, 1 << 18
#: Texts taken from an Arrow batch at a time.
SLICE = 512


def words_of(text: str, special: re.Pattern | None) -> list[str]:
    """Words of a text, in order and without loss, such that the ids of the text are those of its words one after another.

    The tokenizer merges bytes within pre-tokens only. No pre-token spans the end of a word before white space, or the place between
    ASCII letters, digits and signs; a sign or space stays with what follows it where that may be one pre-token with it (an
    apostrophe, letters beyond ASCII). Special tokens are words of their own, and the texts between them stand alone, as in the tokenizer.
    """
    if special is None or not special.search(text):
        return WORD.findall(text)
    out: list[str] = []
    for part in special.split(text):
        out += [part] if special.fullmatch(part) else WORD.findall(part)
    return out


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def special_tokens(path: str) -> re.Pattern | None:
    """Pattern of the special tokens of a tokenizer file, as one group. Ones that take white space with them are not supported."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("special tokens that depend on what stands beside them can't be encoded word by word")
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id, at its place; ids that the file doesn't name are empty."""
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    codes = byte_codes()
    names = loaded["model"]["vocab"] | {t["content"]: t["id"] for t in loaded["added_tokens"]}
    out = [b""] * (max(names.values(), default=-1) + 1)
    for name, i in names.items():
        out[i] = bytes(codes[c] for c in name) if all(c in codes for c in name) else name.encode()
    return out


def packed(*numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their low bytes first, then the next, and so on, which packs better than number by number."""
    flat = np.concatenate(numbers).astype("<u4")
    return pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u4")
    flat = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view("<u4").ravel()


def gathered(edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs edges[i]..edges[i + 1] for each i of `at`, one run after another, and the runs' lengths."""
    lengths = edges[at + 1] - edges[at]
    ends = np.cumsum(lengths)
    return np.repeat(edges[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0), lengths


class Chunk:
    """Words of a run of texts, and each text's positions in their table."""

    def __init__(self, name: str):
        self.name, self.known, self.at, self.rows, self.size, self.crc, self.bytes = name, {}, [], [], [], 0, 0

    def add(self, row, words: list[str], text: str) -> None:
        known = self.known
        self.at.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
        self.rows.append(row)
        self.size.append(len(words))
        raw = text.encode()
        self.crc, self.bytes = zlib.crc32(raw, self.crc), self.bytes + len(raw)

    def key(self) -> int:
        """The same for the same texts at the same place; other texts there have no table under this key."""
        name = f"{self.name}-{len(self.rows)}-{self.crc:08x}"
        return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little", signed=True)

    def ranks(self) -> np.ndarray:
        """Place of each word in the table: the more frequent first, then as they came."""
        count = np.bincount(np.concatenate([*self.at, np.zeros(0, np.uint32)]), minlength=len(self.known))
        out = np.empty(len(count), np.uint32)
        out[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
        return out


def _chunks(special: re.Pattern | None) -> Iterator[Chunk]:
    """Generator that is sent (row, text) and yields each chunk as it is full; None ends it."""
    number, part = 0, TaskContext.get().partitionId()
    chunk, full = Chunk(f"{part}-{number}"), None
    while True:
        sent = yield full
        full = None
        if sent is None:
            yield chunk if chunk.rows else None
            return
        row, text = sent
        chunk.add(row, words_of(text, special), text)
        if chunk.bytes >= CHUNK_BYTES:
            number += 1
            full, chunk = chunk, Chunk(f"{part}-{number}")


def _each_chunk(batches: Iterator[pa.RecordBatch], special: re.Pattern | None) -> Iterator[Chunk]:
    feed = _chunks(special)
    next(feed)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            own = batch.slice(start, SLICE)
            for row, text in zip(own["doc_id"].to_pylist(), own["text"].to_pylist()):
                full = feed.send((row, text or ""))
                if full is not None:
                    yield full
                    del full
                    pa.default_memory_pool().release_unused()
    last = feed.send(None)
    if last is not None:
        yield last


def _word_rows(special: re.Pattern | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _each_chunk(batches, special):
            key, at, words = chunk.key(), chunk.ranks().astype(np.int32), list(chunk.known)
            for i in range(0, len(words), 20_000):
                own = words[i : i + 20_000]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(own), key)), "at": pa.array(at[i : i + 20_000]), "word": pa.array(own, pa.string())})

    return run


def _position_rows(special: re.Pattern | None, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _each_chunk(batches, special):
            key, rank, ends = chunk.key(), chunk.ranks(), np.cumsum(chunk.size)
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROW_WORDS, "right")))
                at = rank[np.concatenate(chunk.at[a:b])]
                out = {
                    "chunk": pa.array([key], pa.int64()), "doc_ids": pa.array([chunk.rows[a:b]], pa.list_(id_type)), "sizes": pa.array([chunk.size[a:b]], pa.list_(pa.int32())),
                    "packed": pa.array([packed(at)], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(out)
                a = b

    return run


_encoders: dict[str, object] = {}


def _encoder(path: str | None):
    """The tokenizer, loaded once in a worker. It encodes in the task's own thread: threads of its own would keep memory of their own."""
    place = tokenizer_path(path)
    if place not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[place] = Tokenizer.from_file(place)
        _encoders[place].no_truncation()
        _encoders[place].no_padding()
    return _encoders[place]


def _encoded_words(path: str | None):
    """Ids of words that come in order, so that a word's rows stand together and it is encoded once; rows of one chunk in a batch become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        last, ids = None, np.zeros(0, "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch["word"].dictionary_encode()
            names = words.dictionary.to_pylist()
            fresh = names[1:] if names[0] == last else names
            own = [ids] if len(fresh) < len(names) else []
            for i in range(0, len(fresh), SLICE):
                own += [np.array(e.ids, "<u4") for e in encoder.encode_batch(fresh[i : i + SLICE], add_special_tokens=False)]
            last, ids = batch["word"][-1].as_py(), own[words.indices[-1].as_py()]
            edges, flat = np.concatenate(([0], np.cumsum([len(x) for x in own]))), np.concatenate(own)
            chunk, at, word = batch["chunk"].to_numpy(), batch["at"].to_numpy(), words.indices.to_numpy()
            order = np.lexsort((at, chunk))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk[order])) + 1, [len(order)]))
            rows = [(order[a:b], *gathered(edges, word[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
            out = {
                "chunk": pa.array(chunk[order[cuts[:-1]]]), "words": pa.array([len(r) for r, _, _ in rows], pa.int32()), "ids": pa.array([len(p) for _, p, _ in rows], pa.int32()),
                "packed": pa.array([packed(at[r], n, flat[p]) for r, p, n in rows], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def _joined(id_type: pa.DataType):
    """Texts' ids from the positions of one chunk and the ids of its words."""

    def run(places: pa.Table, words: pa.Table) -> pa.Table:
        parts = [(unpacked(raw, 2 * n + m), n) for raw, n, m in zip(words["packed"].to_pylist(), words["words"].to_pylist(), words["ids"].to_pylist())]
        empty = [np.zeros(0, "<u4")]
        at, lengths, ids = (np.concatenate(x) for x in ([p[:n] for p, n in parts] or empty, [p[n : 2 * n] for p, n in parts] or empty, [p[2 * n :] for p, n in parts] or empty))
        order = np.argsort(at)
        if not np.array_equal(at[order], np.arange(len(order))) or (not len(order) and any(map(any, places["sizes"].to_pylist()))):
            raise RuntimeError("positions and words of a chunk differ: the input gave other rows when it was read again; store it first")
        # the table of words in its own order: word i has flat[edges[i]:edges[i + 1]]
        came = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        place, size = gathered(came, order)
        flat, edges = ids[place], np.concatenate(([0], np.cumsum(size)))
        owner, count, digest, lists = [], [], [], []
        for doc_ids, sizes, raw in zip(places["doc_ids"].combine_chunks() if places.num_rows else [], places["sizes"].to_pylist(), places["packed"].to_pylist()):
            place, size = gathered(edges, unpacked(raw, sum(sizes)).astype(np.int64))
            own = flat[place]
            cuts = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(sizes)))]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                digest.append(hashlib.sha256(own[a:b].tobytes()).hexdigest())
                count.append(b - a)
            lists.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(own.astype(np.int32))))
            owner.append(doc_ids.values)
        found = pa.chunked_array(lists, pa.list_(pa.int32()))
        return pa.table({"doc_id": pa.chunked_array(owner, id_type), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "ids": found})

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, ids (array<int>) of each row of docs (doc_id, text), as the tokenizer itself gives them.

    Each task splits its texts into words and keeps, for chunks of about CHUNK_BYTES, a table of distinct words and the texts'
    positions in it. The tables' rows are dealt by word and sorted, so each distinct word is encoded once, wherever it occurs; its ids
    go back to (chunk, place in the table), packed by chunk, and meet the positions there. What moves is a row for each distinct word of a
    chunk and the packed positions, not the texts. A group is a chunk, so it is bounded by CHUNK_BYTES or one text.

    Null and empty texts have no ids. Rows with equal or null ids and repeated rows are encoded each for itself; other columns of any name are
    ignored; an empty table gives none. A very long text is a chunk, a very long word a row. Ids are unsigned 32-bit
    little-endian in the digest. `docs` is read twice and must give the same rows in the same order each time (stored tables do);
    otherwise the join raises. `path` is a tokenizer file that exists on every worker; None is the public byte-level one.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    special = special_tokens(tokenizer_path(path))
    places = rows.mapInArrow(_position_rows(special, id_type), f"chunk long, doc_ids array<{kind}>, sizes array<int>, packed binary")
    words = rows.mapInArrow(_word_rows(special), "chunk long, at int, word string")
    words = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded_words(path), "chunk long, words int, ids int, packed binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, ids array<int>"
    return places.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_joined(id_type), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of `encoded` with `decoded`, the text of their `ids` (array<int>): every id meets its piece in the id-to-piece table.

    The table has an entry for each token of the vocabulary and goes with the plan as one array of pieces in hexadecimal, so the join is a
    look-up by place where the row is: ids keep their order, rows do not move, and no Python worker is needed. Bytes that are no UTF-8 become
    U+FFFD. Null or empty ids give an empty text, unknown or null ids nothing; special tokens appear as they are. A column `decoded` of the
    input is replaced. `path` is read on the driver only.
    """
    pieces = F.split(F.lit(",".join(p.hex() for p in piece_bytes(tokenizer_path(path)))), ",")
    joined = F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), "")
    return encoded.withColumn("decoded", F.coalesce(F.make_valid_utf8(F.unhex(joined).cast("string")), F.lit("")))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
