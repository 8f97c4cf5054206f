"""Character n-grams of the distinct words of a slice of texts, as hashed features.

Features of a text are sums over its words, so each distinct word of a slice is looked at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textvec import mix64, split_words

_U = np.uint64
_PRIME = _U(0x100000001B3)
_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Distinct:
    """The words of some texts: ``doc`` and ``word`` (an index of the distinct words) of each occurrence, and the
    distinct words' letters, lower-cased, with 0 for anything else and between words."""

    doc: np.ndarray
    word: np.ndarray
    n_docs: int
    n_words: int
    char: np.ndarray
    owner: np.ndarray  # the word of each char

    def letters(self) -> np.ndarray:
        """Letters of each distinct word."""
        return np.bincount(self.owner[self.char > 0], minlength=self.n_words)


def distinct_words(column: pa.Array) -> Distinct:
    w = split_words(column)
    _, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    joined = b"\n".join([raw[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
    text = ("\n" + joined.decode("utf-8", "replace") + "\n").lower()
    char = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    owner = np.maximum(np.cumsum(char == 10) - 1, 0)
    return Distinct(w.doc, word, len(column), len(first), np.where(_letters()[char], char, 0), np.minimum(owner, max(len(first) - 1, 0)))


def grams(d: Distinct, sizes: tuple[int, ...], bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of letters; a word's edges count as a character.  With ``whole`` also of whole words."""
    words, buckets = [], []
    char = d.char.astype(np.uint64)
    blank = d.char == 0
    for n in sizes:
        if len(char) < n:
            continue
        m = len(char) - n + 1
        h = np.full(m, n, np.uint64)
        ok = np.ones(m, bool)
        for i in range(n):
            h = h * _PRIME + char[i : i + m]
            if 0 < i < n - 1:
                ok &= ~blank[i : i + m]
        if n <= 2:
            ok &= ~(blank[:m] & blank[n - 1 :])
        at = np.flatnonzero(ok)
        owner = d.owner[np.where(blank[at], at + 1, at)] if n > 1 else d.owner[at]
        words.append(owner)
        buckets.append(mix64(h[at]) & _U((1 << bits) - 1))
    if whole and len(char):
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        # sums of letters times powers of an odd number; a difference of two sums, shifted back, belongs to the word alone
        sums = np.concatenate([[_U(0)], np.cumsum(char * _powers(_PRIME, len(char)), dtype=np.uint64)])
        h = (sums[end] - sums[start]) * _powers(_INVERSE, len(char))[start]
        words.append(d.owner[start])
        buckets.append(mix64(h + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) & _U((1 << bits) - 1))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(buckets).astype(np.int64)
