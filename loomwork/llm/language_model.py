"""An interpolated modified Kneser-Ney trigram model, counted in Spark and read by workers from memory-mapped arrays.

Counting goes in passes over ranges of the words' hashes, so that the shuffle of a pass, which is removed after it, stays a part
of the input.  In a pass, tasks split whole texts into words (one end token for each text), count the trigrams whose
middle word is in the range with numpy, and leave the sums to Spark: trigrams are dealt to shards by their middle word, so a
shard has all of a bigram's followers and all words before it.  Trigrams of common middle words are dealt by their first two
words instead, and those of common first two words by all three; what such shards know of a bigram or a word is a part,
and parts are added up in a second, small shuffle.  The number of shards grows with the tokens, so a shard has a bounded
size.
Storing: a task sums its shard and writes it as sorted arrays to the shared folder: of a hash 32 bits stand in the array and the
upper ones in an index over it, counts take a byte, and those from 255 on stand apart.
Discounts follow from the counts of counts of all texts; a few numbers for each shard are all that reaches the driver.
Scoring: workers map the arrays and look up a batch's distinct trigrams, bigrams and words shard by shard, in order, so
pages are touched once.  A folder that isn't a local path is read shard by shard into memory, nothing is copied to disk.

P(w|uv) = max(c(uvw) - D3(c), 0) / c(uv.) + g(uv) P(w|v), where D3 is one of three discounts and g(uv) the mass discounted;
P(w|v) is the same for the numbers n(.vw) of different words before vw, and P(w) for those before w, with V + 1 equal
chances below it (one for an unknown word), so unseen words have a probability above 0.  A text begins after two end tokens;
as nothing stands before these, n(.vw) is the count c(vw) where v is one of them.

Defined cases: a null text is empty, and its only token is the end; with no training text all tokens are equally likely
(V = 0: probability 1); a very long text is split and scored in one piece, some 100 bytes for each of its words; other
columns, whatever their names, are not looked at; rows with a null id are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_path, forget, new_path, remainder, settle, table, text_of
from .textvec import as_long, mix64, slices, split_words

_U = np.uint64
#: Hash of the token at the end of a text.
END = _U(0x5851F42D4C957F2D)
_SLICE = 4 << 20
#: Words and bigrams found to be common in a sample of so many texts are dealt to more shards; this changes no result.
SAMPLE_TEXTS = 2000
#: A shard's tokens, the least number of passes, and a pass's tokens at most for each shuffle partition.
SHARD_TOKENS, LEAST_PASSES, PASS_TOKENS = 1_500_000, 3, 60_000_000
#: Counts are stored in a byte; those from this one on in a table of their own.
LARGE = 255
#: A row is a run: some columns of numbers that a task has for a shard, in order, as bytes.
_RUNS = "shard int, kind int, run binary"
_FIELDS = ["shard", "kind", "run"]
#: What is stored of a word: as a context, how often it occurs, and the number of words before it.
OF_WORDS = "total", "ones", "twos", "more", "often", "before"
# kinds of runs: trigrams, a bigram as context, a bigram by the words before it, a word as context, a word by those before it, sums
TRIPLE, CONTEXT, SUFFIX, HEAD, TAIL, TOTALS = range(6)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the two hashes before each, and where each text begins."""
    words = split_words(column, lower=True)
    n = words.counts() + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    w = np.empty(begin[-1], np.uint64)
    last = begin[1:] - 1
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner], w[last] = words.hash, END
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:] = w[:-1]
    v[begin[:-1]] = END
    u[1:] = v[:-1]
    u[begin[:-1]] = END
    return u, v, w, begin


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(u * _U(0x9E3779B97F4A7C15) + v)


def triple_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(pair_hash(u, v) * _U(0xD6E8FEB86659FD93) + w)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix64(h + _U(1)) >> _U(20)) % _U(shards)).astype(np.int64)


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def dealt(u: np.ndarray, v: np.ndarray, w: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard of each trigram, and whether its middle word and its first two are common."""
    common, pair = among(v, model["common"]), pair_hash(u, v)
    twice = common & among(pair, model["common_pairs"])
    h = np.where(common, pair, v)
    h[twice] = triple_hash(u[twice], v[twice], w[twice])
    return shard_of(h, model["shards"]), common, twice


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of the first of each, and the sums of the values."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), *values
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[at], order[at], *(np.add.reduceat(x[order], at) for x in values)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes: each as its distinct values and their numbers, or plainly where that is shorter.

    Numbers and counts are cut to the bytes that they need, so a run is shuffled in about half its size.
    """
    out = [np.array([len(columns[0]), len(columns)], np.int64).tobytes()]
    for x in columns:
        x = np.asarray(x)
        own, at = np.unique(x, return_inverse=True)
        at = at.astype(np.min_scalar_type(max(len(own) - 1, 0)))
        coded = len(own) * 8 + at.nbytes < len(x) * 8
        own, at = (own.astype(x.dtype), at) if coded else (x, at[:0])
        if x.dtype != np.uint64 and len(own):
            own = own.astype(np.min_scalar_type(int(own.max())))  # counts, which are not negative
        out += [np.array([len(own), own.itemsize, at.itemsize if coded else 0], np.int64).tobytes(), own.tobytes(), at.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of a run, as unsigned 64-bit numbers."""
    at = 16
    n, columns = np.frombuffer(data, np.int64, 2)
    found = []
    for _ in range(columns):
        own, size, code = np.frombuffer(data, np.int64, 3, at)
        values = np.frombuffer(data, f"u{size}", own, at + 24).astype(np.uint64)
        at += 24 + own * size
        found.append(values[np.frombuffer(data, f"u{code}", n, at)] if code else values)
        at += n * code
    return found


def _runs(shard: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard; the columns' order within a shard is kept."""
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(shard) else []
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        run = pack(*[x[order[at:to]] for x in columns])
        yield pa.RecordBatch.from_arrays([pa.array([int(ordered[at])], pa.int32()), pa.array([kind], pa.int32()), pa.array([run], pa.binary())], _FIELDS)


def _count(batches: Iterator[pa.RecordBatch], model: dict, turn: int) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, ...]] = []

    def merged() -> Iterator[pa.RecordBatch]:
        u, v, w, shard = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        _, first, c = _summed(triple_hash(u, v, w), np.ones(len(w), np.int64))
        return _runs(shard[first], TRIPLE, u[first], v[first], w[first], c)

    for b in batches:
        for lo, to in slices(b.column(0), _SLICE):
            u, v, w, _ = tokens(b.column(0)[lo:to])
            shard = dealt(u, v, w, model)[0]
            own = np.flatnonzero(shard % model["passes"] == turn)  # shards belong to passes in turn
            kept.append((u[own], v[own], w[own], shard[own].astype(np.int32)))
            if sum(len(x[0]) for x in kept) > 2_000_000:
                yield from merged()
    if kept:
        yield from merged()


def _file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under a name of this attempt and then moves it to its own, so that a task may run twice."""
    where, path = _file_system(folder)
    where.create_dir(path, recursive=True)
    trial = f"{path}/.{name}-{np.random.SeedSequence().entropy:x}"
    with where.open_output_stream(trial) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
    if where.get_file_info(f"{path}/{name}").type != arrow_fs.FileType.NotFound:
        where.delete_file(f"{path}/{name}")
    where.move(trial, f"{path}/{name}")


def _get(folder: str, name: str, kind: type) -> np.ndarray:
    """A stored array: mapped where the folder is a local path, else read."""
    where, path = _file_system(folder)
    info = where.get_file_info(f"{path}/{name}")
    if info.type == arrow_fs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    mapped = isinstance(where, arrow_fs.LocalFileSystem)
    with pa.memory_map(f"{path}/{name}") if mapped else where.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read_buffer(), kind)  # the mapping outlives the file's handle


class Rows:
    """Sorted hashes with a count each: an index over their upper bits for some 16 rows an entry, the next 32 bits of each, a byte.

    A hash that isn't stored is taken for one that is with a chance of 4e-9.
    """

    def __init__(self, folder: str, name: str):
        self.low, self.count = _get(folder, f"{name}-low", np.uint32), _get(folder, f"{name}-count", np.uint8)
        self.index = _get(folder, f"{name}-index", np.uint32)
        self.large, self.large_count = _get(folder, f"{name}-large", np.uint64), _get(folder, f"{name}-largecount", np.int64)

    @staticmethod
    def put(folder: str, name: str, h: np.ndarray, count: np.ndarray) -> None:
        """Of distinct hashes in order; nothing is written for none."""
        if len(h):
            bits = max(0, (len(h) // 16).bit_length())
            key = h >> _U(32 - bits)
            _put(folder, f"{name}-low", key.astype(np.uint32))
            _put(folder, f"{name}-index", np.searchsorted(key >> _U(32), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32))
            _put(folder, f"{name}-count", np.minimum(count, LARGE).astype(np.uint8))
            if (count >= LARGE).any():
                _put(folder, f"{name}-large", h[count >= LARGE])
                _put(folder, f"{name}-largecount", count[count >= LARGE].astype(np.int64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash the place, -1 for none, and the count."""
        count = np.zeros(len(h), np.int64)
        if not len(self.low) or not len(h):
            return np.full(len(h), -1), count
        key = h >> _U(32 - (len(self.index) - 1).bit_length() + 1)
        asked, entry = key.astype(np.uint32), (key >> _U(32)).astype(np.int64)
        at, end = self.index[entry].astype(np.int64), self.index[entry + 1].astype(np.int64)
        last = len(self.low) - 1
        for step in (1 << i for i in reversed(range(int((end - at).max()).bit_length()))):  # binary search in all entries at once
            further = at + step
            at = np.where((further <= end) & (self.low[np.minimum(further - 1, last)] < asked), further, at)
        place = np.where((at < end) & (self.low[np.minimum(at, last)] == asked), at, -1)
        hit = np.flatnonzero(place >= 0)
        count[hit] = self.count[place[hit]]
        many = np.flatnonzero(count == LARGE)
        if len(many):
            count[many] = self.large_count[np.minimum(np.searchsorted(self.large, h[many]), len(self.large) - 1)]
        return place, count


def _totals(kind: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of counts: how many are 1, 2, 3 and 4; how many there are; their sum."""
    few = np.array([kind, *[int(np.sum(counts == i)) for i in (1, 2, 3, 4)], len(counts), int(counts.sum())])
    yield from _runs(np.zeros(1, np.int64), TOTALS, *few[:, None])


def _put_contexts(folder: str, s: int, h: np.ndarray, total: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray) -> None:
    """Contexts seen once say all by their count; of the others the numbers of followers stand in the order of their hashes."""
    Rows.put(folder, f"contexts-{s:06d}", h, total)
    several = total > 1
    if several.any():
        Rows.put(folder, f"contextsseveral-{s:06d}", h[several], np.zeros(int(several.sum()), np.int64))
        for n, x in (("ones", ones), ("twos", twos), ("more", more)):
            _put(folder, f"contexts{n}-{s:06d}", x[several].astype(np.uint32))


def _of_suffixes(folder: str, s: int, v: np.ndarray, w: np.ndarray, n: np.ndarray, often: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Stores bigrams by the number of words before them; yields what they say of their words.

    A word stands in the middle of as many trigrams as it occurs (the end for the beginning of its text).
    """
    h = pair_hash(v, w)
    order = np.argsort(h)
    Rows.put(folder, f"suffixes-{s:06d}", h[order], n[order])
    word, _, *sums = _summed(v, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64), often)
    yield from _runs(shard_of(word, shards), HEAD, word, *sums)
    word, _, before = _summed(w, np.ones(len(w), np.int64))
    yield from _runs(shard_of(word, shards), TAIL, word, before)
    yield from _totals(1, n)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[np.ndarray]]]]:
    """A task's shards, of bounded size each: the columns of each kind of runs."""
    held: dict[int, dict[int, list[bytes]]] = {}
    for b in batches:
        for s, kind, run in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(s, {}).setdefault(kind, []).append(run)
    for s in sorted(held):
        yield s, {kind: [np.concatenate(x) for x in zip(*map(unpack, runs), strict=True)] for kind, runs in held.pop(s).items()}


def _store(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Writes shards of trigrams and of the bigrams that they know wholly; yields parts of the others and of words."""
    folder, shards = model["folder"], model["shards"]
    for s, found in _by_shard(batches):
        u, v, w, c = found.pop(TRIPLE)
        h, first, c = _summed(triple_hash(u, v, w), c.astype(np.int64))
        u, v, w = u[first], v[first], w[first]
        Rows.put(folder, f"triples-{s:06d}", h, c)
        yield from _totals(0, c)
        _, common, twice = dealt(u, v, w, model)
        pair, at, *sums = _summed(pair_hash(u, v), c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))
        part = twice[at]
        _put_contexts(folder, s, pair[~part], *[x[~part] for x in sums])
        yield from _runs(shard_of(pair[part], shards), CONTEXT, pair[part], *[x[part] for x in sums])
        _, at, n, often = _summed(pair_hash(v, w), np.ones(len(v), np.int64), c)
        v, w, part = v[at], w[at], common[at]
        n = np.where(v == END, often, n)  # nothing stands before a text
        yield from _of_suffixes(folder, s, v[~part], w[~part], n[~part], often[~part], shards)
        yield from _runs(shard_of(pair_hash(v[part], w[part]), shards), SUFFIX, v[part], w[part], n[part], often[part])


def _store_parts(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Adds up and writes what several shards know of common bigrams; passes on what these say of their words."""
    folder, shards = model["folder"], model["shards"]
    for s, found in _by_shard(batches):
        if CONTEXT in found:
            pair, *sums = found.pop(CONTEXT)
            pair, _, *sums = _summed(pair, *[x.astype(np.int64) for x in sums])
            _put_contexts(folder, shards + s, pair, *sums)
        if SUFFIX in found:
            v, w, n, often = found.pop(SUFFIX)
            _, at, n, often = _summed(pair_hash(v, w), n.astype(np.int64), often.astype(np.int64))
            yield from _of_suffixes(folder, shards + s, v[at], w[at], n, often, shards)


def _store_words(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Writes shards of words; yields their counts of counts.  Words that occur once say all by that."""
    folder = model["folder"]
    for s, found in _by_shard(batches):
        head, tail = found.pop(HEAD, [np.zeros(0, np.uint64)] * 6), found.pop(TAIL, [np.zeros(0, np.uint64)] * 2)
        n, m = len(head[0]), len(tail[0])
        columns = [np.concatenate([x, np.zeros(m, np.uint64)]) for x in head[1:]] + [np.concatenate([np.zeros(n, np.uint64), tail[1]])]
        word, _, *sums = _summed(np.concatenate([head[0], tail[0]]), *[x.astype(np.int64) for x in columns])
        often, before = sums[4], sums[5]
        Rows.put(folder, f"words-{s:06d}", word, often)
        several = often > 1
        if several.any():
            Rows.put(folder, f"wordsseveral-{s:06d}", word[several], np.zeros(int(several.sum()), np.int64))
            for name, x in zip(OF_WORDS, sums, strict=True):
                _put(folder, f"{name}-{s:06d}", x[several])
        yield from _totals(2, before)
        yield from _totals(3, often)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more; where counts of counts are missing, the usual three quarters, bounded by the count."""
    if not n1 or not n2 or not n3:
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


class Contexts:
    """What is stored of contexts: how often they occur, and how many followers they have once, twice and more often."""

    def __init__(self, folder: str, s: int):
        self.all, self.several = Rows(folder, f"contexts-{s:06d}"), Rows(folder, f"contextsseveral-{s:06d}")
        self.sums = [_get(folder, f"contexts{n}-{s:06d}", np.uint32) for n in ("ones", "twos", "more")]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        total = self.all.find(h)[1]
        out = [(total == 1).astype(np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)]
        asked = np.flatnonzero(total > 1)
        place = self.several.find(h[asked])[0]
        for o, x in zip(out, self.sums, strict=True):
            o[asked] = x[place]
        return total, *out


class Words:
    """What is stored of words."""

    def __init__(self, folder: str, s: int):
        self.all, self.several = Rows(folder, f"words-{s:06d}"), Rows(folder, f"wordsseveral-{s:06d}")
        self.sums = [_get(folder, f"{n}-{s:06d}", np.int64) for n in OF_WORDS]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        often = self.all.find(h)[1]
        once = (often == 1).astype(np.int64)
        out = [once.copy(), once.copy(), np.zeros_like(once), np.zeros_like(once), once.copy(), once.copy()]
        asked = np.flatnonzero(often > 1)
        place = self.several.find(h[asked])[0]
        for o, x in zip(out, self.sums, strict=True):
            o[asked] = x[place]
        return tuple(out)


@lru_cache(maxsize=4096)
def _mapped(kind: type, folder: str, *name) -> Rows | Contexts | Words:
    return kind(folder, *name)


def _opened(kind: type, folder: str, *name) -> Rows | Contexts | Words:
    """An opened shard; those of local paths, which are only mapped, are kept."""
    return _mapped(kind, folder, *name) if isinstance(_file_system(folder)[0], arrow_fs.LocalFileSystem) else kind(folder, *name)


def _find(h: np.ndarray, shard: np.ndarray, n: int, open_: callable) -> tuple[np.ndarray, ...]:
    """``n`` values of each hash, shard by shard, the hashes of each in order."""
    out = [np.zeros(len(h), np.int64) for _ in range(n)]
    order = np.lexsort((h, shard))
    ordered = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(h) else []
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        own = order[at:to]
        for o, x in zip(out, open_(int(ordered[at]), h[own]), strict=True):
            o[own] = x
    return tuple(out)


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    folder, shards, common, pairs = model["folder"], model["shards"], model["common"], model["common_pairs"]
    d3, d2, d1 = (np.array([0.0, *model[x]]) for x in ("triple_discounts", "pair_discounts", "word_discounts"))
    n, v1 = model["tokens"], model["words"] + 1
    mass = lambda d, ones, twos, more, total: np.where(total > 0, (d[1] * ones + d[2] * twos + d[3] * more) / np.maximum(total, 1), 1.0)
    less = lambda c, d, total: np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)
    for b in batches:
        for lo, to in slices(b.column(1), _SLICE):
            u, v, w, begin = tokens(b.column(1)[lo:to])
            word, at = np.unique(w, return_inverse=True)
            total, ones, twos, more, often, before = _find(word, shard_of(word, shards), 6, lambda s, h: _opened(Words, folder, s).find(h))
            place = np.searchsorted(word, v)  # every word before another is one of the text's own, or the end
            p = less(before, d1, model["kinds"]) + (model["word_mass"] if model["kinds"] else 1.0) / v1
            base = np.log10((often + 0.1) / (n + 0.1 * v1))
            # bigrams v w; those before each word are the same ones, and the beginning
            pair = np.append(pair_hash(v, w), pair_hash(np.array([END]), np.array([END])))
            h, first, back = np.unique(pair, return_index=True, return_inverse=True)
            fv, fw = np.append(v, END)[first], np.append(w, END)[first]
            mid = among(fv, common)
            shard = np.where(mid, shards + shard_of(h, shards), shard_of(fv, shards))
            (c,) = _find(h, shard, 1, lambda s, x: _opened(Rows, folder, f"suffixes-{s:06d}").find(x)[1:])
            own = first < len(w)
            fp, fw_at = np.append(place, 0)[first], np.append(at, 0)[first]
            p2 = np.where(own, less(c, d2, total[fp]) + mass(d2, ones[fp], twos[fp], more[fp], total[fp]) * p[fw_at], 1.0)[back[:-1]]
            mid = among(fw, common)
            shard = np.where(mid & among(h, pairs), shards + shard_of(h, shards), shard_of(np.where(mid, h, fw), shards))
            context = _find(h, shard, 4, lambda s, x: _opened(Contexts, folder, s).find(x))
            before_at = np.empty(len(w), np.int64)
            before_at[1:], before_at[begin[:-1]] = back[:-2], back[-1]
            gamma, seen = mass(d3, *context[1:], context[0])[before_at], context[0][before_at]
            # trigrams, where the context is known
            known = np.flatnonzero(seen > 0)
            c3 = np.zeros(len(w), np.int64)
            h, first, back = np.unique(triple_hash(u[known], v[known], w[known]), return_index=True, return_inverse=True)
            first = known[first]
            (c,) = _find(h, dealt(u[first], v[first], w[first], model)[0], 1, lambda s, x: _opened(Rows, folder, f"triples-{s:06d}").find(x)[1:])
            c3[known] = c[back]
            p3 = less(c3, d3, seen) + gamma * p2
            add = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731, B023
            is_known = (often > 0).astype(np.int64)[at]
            arrays = [b.column(0)[lo:to], pa.array(np.diff(begin)), pa.array(add(is_known)), pa.array(add(base[at])), pa.array(add(np.log10(p3)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of bigrams (kind 1)."""
    for b in batches:
        for lo, to in slices(b.column(0), _SLICE):
            _, v, w, _ = tokens(b.column(0)[lo:to])
            for kind, h in ((0, w), (1, pair_hash(v, w))):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(as_long(h)), pa.array(n)], ["kind", "h", "n"])


def _common(texts: DataFrame, n_texts: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and bigrams with more than an eighth of a shard in a sample, the most common 1024 at most of each."""
    share = min(1.0, SAMPLE_TEXTS / max(1, n_texts))
    some = texts.where(F.pmod(F.xxhash64(F.lit("common"), "text"), F.lit(1 << 20)) < share * (1 << 20)).mapInArrow(_sample, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    some = settle(some, "sample")
    total = {r["kind"]: r["n"] for r in some.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    found = []
    for kind in (0, 1):
        often = some.where((F.col("kind") == kind) & (F.col("n") > total.get(kind, 0) / (8 * shards))).orderBy(F.desc("n"), "h").limit(1024).collect()
        found.append(np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64)))
    forget(texts.sparkSession, some)
    start = pair_hash(np.array([END]), np.array([END]))
    return np.union1d(found[0], [END]), np.union1d(found[1], start)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's totals of each kind."""
    totals = np.zeros((4, 6), np.int64)
    for b in batches:
        for run in b.column(2).to_pylist():
            kind, *sums = (int(x[0]) for x in unpack(run))
            totals[kind] += sums
    yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(totals.tolist(), pa.list_(pa.int64()))], ["kind", "sums"])


def train(texts: DataFrame, shards: int | None = None, passes: int | None = None) -> dict:
    """Counts and stores a model of the column ``text``; returns where it is and its few global numbers."""
    spark = texts.sparkSession
    texts = texts.select(text_of().alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    about = size["n"] + size["bytes"] // 6  # tokens, roughly: only the numbers of shards and passes depend on it
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), about // SHARD_TOKENS)
    passes = passes or min(shards, max(LEAST_PASSES, about // (PASS_TOKENS * shards)))
    common, common_pairs = _common(texts, size["n"], shards)
    model = {"folder": new_path(spark, "model"), "shards": shards, "passes": passes, "common": common, "common_pairs": common_pairs}
    found = []
    for turn in range(passes):
        counted = texts.mapInArrow(lambda it, turn=turn: _count(it, model, turn), _RUNS)
        # the shards of a pass are those that leave its number when divided by the number of passes
        counted = counted.repartitionById(-(-shards // passes), F.expr(f"CAST(shard div {passes} AS INT)"))
        found.append(settle(counted.mapInArrow(lambda it: _store(it, model), _RUNS), f"parts{turn}"))
        del counted
    parts = reduce(DataFrame.unionByName, found)
    of_bigrams = parts.where(F.col("kind").isin(CONTEXT, SUFFIX)).repartitionById(shards, F.col("shard"))
    found.append(settle(of_bigrams.mapInArrow(lambda it: _store_parts(it, model), _RUNS), "bigramparts"))
    parts = reduce(DataFrame.unionByName, found)
    of_words = parts.where(F.col("kind").isin(HEAD, TAIL)).repartitionById(shards, F.col("shard"))
    found.append(settle(of_words.mapInArrow(lambda it: _store_words(it, model), _RUNS), "wordparts"))
    totals = np.zeros((4, 6), np.int64)
    sums = reduce(DataFrame.unionByName, found).where(F.col("kind") == TOTALS).mapInArrow(_added, "kind int, sums array<long>")
    for r in sums.groupBy("kind").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(6)]).alias("sums")).collect():
        totals[r["kind"]] = r["sums"]
    forget(spark, *found)
    three, two, one = (discounts(*map(int, totals[kind][:4])) for kind in range(3))
    w1, w2, _, _, words, kinds = map(int, totals[2])
    mass = (one[0] * w1 + one[1] * w2 + one[2] * (words - w1 - w2)) / kinds if kinds else 1.0
    n_words, n_tokens = map(int, totals[3][4:])
    return model | {"tokens": n_tokens, "words": n_words, "kinds": kinds, "triple_discounts": three, "pair_discounts": two, "word_discounts": one, "word_mass": mass}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row: log10 probabilities of the whole text."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lambda it: _score(it, model), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double")


def drop_model(spark: SparkSession, model: dict) -> None:
    """Deletes the stored arrays; scores must have been written before."""
    delete_path(spark, model["folder"])


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(remainder(10) != 0))
    out = settle(score(docs, model), "scores")
    drop_model(spark, model)
    return out.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
