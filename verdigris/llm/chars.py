"""Vectorised word splitting and hashing over batches of texts.

Texts are laid out as one array of code points; words are maximal runs outside
``[\\x20\\x09-\\x0D]``.  A word's hash is the polynomial ``sum((c_i + 1) * BASE**i) mod 2**64``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse mod 2**64; under 2**62, so that SQL engines with 128-bit integers can follow.
BASE = 0x2545F4914F6CDD1D
CHUNK_CHARS = 1 << 17
#: Rows whose texts a worker holds as strings at a time.
ROWS = 1024
_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        seed = np.full(max(n, CHUNK_CHARS + (CHUNK_CHARS >> 2)), _U(base & (2**64 - 1)))
        seed[0] = 1
        have = _tables[name] = np.multiply.accumulate(seed)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, which share the batches' memory; when they end, freed memory is given back."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    batch = None
    give_back()


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text has a range of its own."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Words of a list of texts: ``start``/``end`` into ``cp``, ``doc`` (index of the text), ``hash``."""

    def __init__(self, texts: list[str], fold: bool = False):
        raw = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(raw, np.uint32)
        if fold:
            cp = cp + (((cp - np.uint32(65)) < 26) * np.uint32(32)).astype(np.uint32)
        self.cp = cp
        self.n_docs = len(texts)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_start = np.concatenate([[0], np.cumsum(length)])
        word = ~((cp == 32) | ((cp - np.uint32(9)) <= 4))
        edge = np.flatnonzero(np.diff(word, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)  # index of each text's first word
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        sums = np.zeros(len(cp) + 1, _U)
        np.cumsum((cp.astype(_U) + _U(1)) * _powers("p", BASE, len(cp)), out=sums[1:])
        self.sums = sums
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers("q", pow(BASE, -1, 2**64), len(self.cp) + 1)
        return (self.sums[end] - self.sums[start]) * inverse[start]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and index of the first word of every n-word window inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        h = mix(self.hash)
        out = h[:m].copy()
        for k in range(1, n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + m])
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return out[at], at


def sum_by(doc: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, weights, n)[:n]
