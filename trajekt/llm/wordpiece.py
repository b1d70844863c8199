"""Token counts: greedy longest-match word pieces counted by an automaton with failure links, without building the pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajekt.llm import words as W
from trajekt.llm.common import table

#: Fixed: the mark that the public vocabulary's tokens begin with where they begin a word, and its code for each byte.
WORD_MARK = "Ġ"


def byte_codes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word, without their mark, and pieces that go on, of a byte-level vocabulary file."""
    codes = byte_codes()
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    tokens = [bytes(codes[c] for c in t) for t in names if all(c in codes for c in t)]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "]


class Automaton:
    """Trie of two roots (0 for the start of a word, 1 for its rest) with failure links and popped-token counts.

    At a node without the next byte, the tokens of the longest match are popped and the walk goes on at the node of what is left of
    the node's string: pops[v] tokens leave, link[v] stays. Each byte moves forward once and each pop shortens the string, so the
    walk is linear. A byte that no piece begins with counts as one token of its own.
    """

    def __init__(self, first: list[bytes], rest: list[bytes]):
        step: dict[tuple[int, int], int] = {}
        parent, byte, token = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((0, first), (1, [*rest, *(bytes([b]) for b in range(256))])):
            for piece in pieces:
                at = root
                for b in piece:
                    to = step.get((at, b))
                    if to is None:
                        to = step[at, b] = len(parent)
                        parent.append(at)
                        byte.append(b)
                        token.append(False)
                    at = to
                token[at] = True
        # a word whose first byte begins no initial piece has that byte as a token
        for b in range(256):
            if (0, b) not in step:
                step[0, b] = len(parent)
                parent.append(0)
                byte.append(b)
                token.append(True)
            token[step[0, b]] = True
        n = len(parent)
        link, pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if token[v]:
                link[v], pops[v] = 1, 1
                continue
            at, popped = link[parent[v]], pops[parent[v]]
            while (at, byte[v]) not in step:
                popped += pops[at]
                at = link[at]
            link[v], pops[v] = step[at, byte[v]], popped
        ends = [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            # what a word that ends at v still gives; link[v] is nearer to the root
            ends[v] = pops[v] + ends[link[v]]
        keys = np.array([a * 256 + b for a, b in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(step.values()), np.int32)[order]
        self.link, self.pops, self.ends = (np.array(x, np.int32) for x in (link, pops, ends))
        # the moves of both roots and of shallow nodes are most of all: a table over node * 256 + byte in hashed slots
        bits = max(16, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left = np.arange(len(self.keys))
        probe = 0
        while len(left):
            slot = self._slots(self.keys[left], probe)
            free = self.slot_key[slot] == -1
            _, chosen = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            take = chosen[free[chosen]]
            self.slot_key[slot[take]], self.slot_to[slot[take]] = self.keys[left[take]], self.to[left[take]]
            left = np.delete(left, take)
            probe += 1
        self.probes = probe

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys.astype(np.uint64) + np.uint64(probe * 0x51ED27)) * np.uint64(W.BYTE_BASE)) >> self.shift).astype(np.int64)

    def moves(self, keys: np.ndarray) -> np.ndarray:
        """Node after node * 256 + byte, -1 if there is none."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slots(keys[left], probe)
            there = self.slot_key[slot]
            hit = there == keys[left]
            out[left[hit]] = self.slot_to[slot[hit]]
            left = left[~hit & (there != -1)]
            if not len(left):
                break
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[starts:ends], all words one byte further at a time."""
        total = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int32)
        order = np.argsort(starts - ends, kind="stable")
        lengths = (ends - starts)[order]
        done = 0
        while done < (lengths[0] if len(lengths) else 0):
            live = order[: np.searchsorted(-lengths, -done, side="left")]
            # searchsorted on descending lengths: words longer than `done`
            byte = data[starts[live] + done].astype(np.int64)
            wait = live
            while len(wait):
                to = self.moves(state[wait].astype(np.int64) * 256 + byte)
                ok = to >= 0
                state[wait[ok]] = to[ok]
                wait, byte = wait[~ok], byte[~ok]
                total[wait] += self.pops[state[wait]]
                state[wait] = self.link[state[wait]]
            done += 1
        return total + self.ends[state]


_automata: dict[str, Automaton] = {}


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for at, to, w in W.chunks(batch["text"]):
                h = w.hashes()
                # a word is walked once in a run of texts, however often it occurs there
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                own = automaton.counts(w.data, w.starts[first], w.ends[first])[inverse]
                sums = np.concatenate(([0], np.cumsum(own)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(at, to - at), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_tokens": pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64())})

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs (doc_id, text): greedy longest pieces of each word `[^\\x20\\x09-\\x0D]+`.

    The first piece of a word is the longest initial piece of the vocabulary, each further one the longest other piece; bytes that
    no piece has count one each. Null and blank texts have no words. `path` is read on the driver only; the automaton, whose
    size is the vocabulary's, is broadcast. Rows are scanned once and not shuffled.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _automata:
        _automata[path] = Automaton(*vocabulary(path))
    shared = docs.sparkSession.sparkContext.broadcast(_automata[path])
    return docs.select("doc_id", "text").mapInArrow(_counted(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
