"""Words of Arrow text columns as numpy arrays: positions, hashes and rolling hashes, without a Python object for each word.

Words are `[^\\x20\\x09-\\x0D]+`. Those characters are single bytes in UTF-8, so bytes are enough. Hashes are polynomials modulo
2^64 (Rabin-Karp), made from prefix sums, and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
SECOND_BASE = 0xAF251AF3B0F025B5
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 1 << 23:
            return both[0], both[1]
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@dataclass
class Words:
    """Words of a run of texts. Word i is data[starts[i]:ends[i]]; text t is data[edges[t]:edges[t + 1]] and has the words first[t] to first[t + 1] - 1."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    edges: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = powers(BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def rolled(hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of each run of k hashes, also of those that cross texts."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of k words within one text, and the number of them in each text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    ends = np.cumsum(counts)
    return np.repeat(first[:-1] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0), counts


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~x, w)


def chunks(texts: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive texts of about most_bytes together. A null text is empty; a longer text comes alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        data = raw[offsets[at] : offsets[to]]
        edges = offsets[at : to + 1] - offsets[at]
        full = ~BLANK[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = full[:-1], full[1:]
        inner = edges[:-1][edges[:-1] < len(data)]
        before[inner] = False
        inner = edges[1:][edges[1:] > 0]
        after[inner - 1] = False
        starts = np.flatnonzero(full & ~before)
        yield at, to, Words(data, starts, np.flatnonzero(full & ~after) + 1, np.searchsorted(starts, edges), edges)
        at = to
