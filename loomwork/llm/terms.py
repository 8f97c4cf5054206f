"""Terms of Arrow string columns as dictionary codes: bytes are classified by a table, equal terms meet in Arrow's hash table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textvec import _LOWER, utf8

#: Bytes of a term.  A byte from 0x80 on is part of a character beyond ASCII, all of which belong to terms.
_BYTES = np.arange(256)
LETTERS = (_BYTES >= 0x80) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LETTERS_DIGITS = LETTERS | ((_BYTES >= 0x30) & (_BYTES <= 0x39))


@dataclass
class Terms:
    distinct: pa.Array  # of large binary: the terms, in order of appearance
    code: np.ndarray  # of each occurrence, in text order
    doc: np.ndarray  # the row of each occurrence


def terms_of(column: pa.Array, member: np.ndarray) -> Terms:
    """The maximal runs of member bytes in each text, A-Z as a-z; null has none."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    n = len(data)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)])
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    coded = values.dictionary_encode()
    first = np.searchsorted(start, offsets)
    return Terms(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), np.diff(first)))
