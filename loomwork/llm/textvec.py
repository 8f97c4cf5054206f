"""Splits and hashes the words of Arrow string columns with numpy, many texts at a time.

Hashes are 64-bit: polynomials modulo 2**64 over random values of the bytes (of the words' hashes for windows), mixed at
the end.  Slices of a batch keep memory bounded however many rows a batch has; a very long text is hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(n, 1 << 12)
        a = np.full(size, base, np.uint64)
        a[0] = 1
        kept = np.multiply.accumulate(a)
        if size <= 2 * _BLOCK:
            _powers[base] = kept
    return kept[:n]


@dataclass
class Words:
    data: np.ndarray  # the bytes of the texts, one after the other
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # which text of the slice each word is in
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(column)
    ends = np.cumsum(sizes)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at, n = 0, len(start)
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, side="right")))
        lo, hi = start[at], end[to - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix64((sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """The words ([^\\x20\\x09-\\x0D]+) of the texts; with ``lower`` A-Z count as a-z."""
    data, offsets = utf8(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, start, end, doc, _hash_spans(data, start, end), first)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Of k consecutive values, for each start; windows may cross texts."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    for lo in range(0, n - k + 1, _BLOCK):
        hi = min(n, lo + _BLOCK + k - 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(h[lo:hi] * _power(_BASE, hi - lo), out=sums[1:])
        m = hi - lo - k + 1
        out[lo : lo + m] = mix64((sums[k:] - sums[:-k]) * _power(_INVERSE, hi - lo)[:m] + _U(k))
    return out


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's windows of k words, and where each text's begin; a shorter text is one shingle."""
    n = w.counts()
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - w.first[:-1], m)
    out = np.empty(len(at), np.uint64)
    long = np.repeat(n >= k, m)
    out[long] = window_hash(w.hash, k)[at[long]]
    for size in range(1, k):
        short = np.repeat(n == size, m)
        if short.any():
            out[short] = window_hash(w.hash, size)[at[short]]
    return out, begin


def counted(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text with their counts: (text, value, count)."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], values[at], np.diff(np.append(at, len(values)))
