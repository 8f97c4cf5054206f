"""MinHash near-dedup with ProbMinHash signatures.

A text is the multiset of its five-word shingles, weighted by their counts.  Each shingle runs a Poisson process of that
rate; arrivals go to random components, each component keeps its earliest arrival, and a shingle stops as soon as
its next arrival is later than all components' (early termination).  Two texts agree in a component with the
probability Jaccard similarity J_P of the weighted sets, which is the plain Jaccard similarity where counts are equal.

128 components in 32 bands of 4 make candidates (a pair at 0.8 is missed with a chance of 5e-8).  A candidate link is
verified by the exact J_P of the whole texts, at 0.8 or more; classes are the connected components of the links.
Equal texts are collapsed first.

Links are sought only where they can join two classes.  First each text is tried with the candidate that it shares most
bands with.  Where a bucket still holds several classes, its texts are dealt anew by their rarest shingles: two texts
with J_P >= t share at least the weight t of either text, so with shingles in any common order (here by frequency)
they share one among the first 1 - t of the weight of each.  This loses nothing, and texts that share a common
passage but little else no longer meet.  Pairs of different classes in these finer buckets
are verified: after two rounds in which the texts of a large bucket meet one pivot, pairs are listed for buckets of
a bounded size, and larger ones are split into blocks; a task gets two blocks and multiplies their shingle
matrices, which bounds J_P for all their pairs at once (with a and b the shared parts of either text's weight,
J_P <= 1 / (1/a + 1/b - 1)), and verifies what is left.  No bucket is capped, and no list of all pairs is made.

Defined cases: a text under five words is a single shingle; texts without words (null among them) are in one class only with
equal texts, null being empty; a row with a null doc_id takes the class of its text, null if no other row has it; different
texts of one doc_id are told apart (a class is named by its smallest doc_id, so such an id may name two, and the column
``node`` tells which); a very long text is a row of its own to every step; other columns, whatever their names, are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import forget, settle, table, text_of
from .textvec import as_long, counted, mix64, shingles, slices, split_words

K, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 4
#: Rounds in which the texts of large buckets meet one pivot; buckets up to LARGE rows are listed pair by pair, and larger
#: ones compared block by block.
PIVOTS, LARGE, BLOCK = 2, 48, 512
#: Slots in which shingles are counted for their order; the order decides the cost, never the result.
RANK_BITS = 18
_SLICE = 1 << 20
_U = np.uint64


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, uint32) of n weighted sets; elements as (set, hash, weight)."""
    best = np.full(n * m, ~_U(0))
    t = np.zeros(len(doc))
    identity = mix64(value + _U(11)) & _U(0xFFFFFFFF)
    latest = np.full(n, 0xFFFFFFFF, np.uint64)
    turn = 0
    while len(doc):
        turn += 1
        r = mix64(value + _U((turn * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        t = t - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0**-53)) / weight
        time = t.astype(np.float32).view(np.uint32).astype(np.uint64)
        at = doc * m + (mix64(r) % _U(m)).astype(np.int64)
        np.minimum.at(best, at, (time << _U(32)) | identity)
        live = np.unique(doc)
        latest[live] = best.reshape(n, m)[live].max(1) >> _U(32)
        keep = time < latest[doc]
        doc, value, weight, t, identity = doc[keep], value[keep], weight[keep], t[keep], identity[keep]
    return (best.reshape(n, m) & _U(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    n, m = signatures.shape
    parts = signatures.reshape(n, bands, m // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
    for i in range(m // bands):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _banded(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(2), _SLICE):
            values, begin = shingles(split_words(b.column(2)[lo:to]), k)
            doc, value, count = counted(values, begin)
            keys = band_keys(prob_minhash(doc, value, count.astype(np.float64), to - lo, bands * rows), bands)
            filled = np.diff(begin) > 0
            ends = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(keys[filled].ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:to], b.column(1)[lo:to], lists], ["doc_id", "digest", "bands"])


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets given as sorted distinct hashes and weights, in n log n steps."""
    if not len(a) or not len(b):
        return float(not len(a) and not len(b))
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    u, v = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    ratio = u / v
    only_a, only_b = wa.sum() - u.sum(), wb.sum() - v.sum()
    below = np.concatenate([[0], np.cumsum(v)])
    above = np.concatenate([[0], np.cumsum(u)])
    i = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(u / (only_a + u.sum() - above[i] + ratio * (only_b + below[i]))))


def _verified(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    last, seen = None, None
    for b in batches:
        ids = b.column(0).to_pylist()
        keep = []
        for lo, to in slices(b.column(3), _SLICE):
            doc, value, count = counted(*shingles(split_words(b.column(3)[lo:to]), k))
            cut = np.searchsorted(doc, np.arange(to - lo + 1))
            for i in range(lo, to):
                if ids[i] != last:  # rows of one text come one after the other
                    _, va, ca = counted(*shingles(split_words(b.column(2)[i : i + 1]), k))
                    last, seen = ids[i], (va, ca)
                s = slice(cut[i - lo], cut[i - lo + 1])
                if probability_jaccard(*seen, value[s], count[s]) >= threshold:
                    keep.append(i)
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _ranks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """How many texts have a shingle of each hash slot."""
    n = np.zeros(1 << RANK_BITS, np.int64)
    for b in batches:
        for lo, to in slices(b.column(0), _SLICE):
            _, value, _ = counted(*shingles(split_words(b.column(0)[lo:to]), k))
            n += np.bincount((value >> _U(64 - RANK_BITS)).astype(np.int64), minlength=1 << RANK_BITS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], k: int, threshold: float, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each text's shingles in order of rank, as far as the weight before them is at most 1 - threshold of all."""
    for b in batches:
        for lo, to in slices(b.column(1), _SLICE):
            doc, value, count = counted(*shingles(split_words(b.column(1)[lo:to]), k))
            order = np.lexsort((value, rank[(value >> _U(64 - RANK_BITS)).astype(np.int64)], doc))
            doc, value, count = doc[order], value[order], count[order]
            total = np.bincount(doc, count, to - lo)
            before = np.cumsum(count) - count
            before = before - np.concatenate([[0], np.cumsum(total)])[doc]
            keep = before <= (1 - threshold) * total[doc] + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(as_long(value[keep])), b.column(0).take(pa.array(doc[keep] + lo))], ["key", "rep"])


def _block_links(t: pa.Table, k: int, threshold: float) -> pa.Table:
    """Links between the texts of two blocks, one for each pair of classes at most."""
    ids, label, own = (t.column(x).to_numpy() for x in ("rep", "label", "own"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    doc, value, count = counted(*shingles(split_words(t.column("text").combine_chunks()), k))
    first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
    total = np.maximum(np.bincount(doc, count, len(ids)), 1)
    code = np.unique(value, return_inverse=True)[1]
    of_first, of_second = np.zeros((len(first), len(second)), np.float32), np.zeros((len(first), len(second)), np.float32)
    place = np.full(len(ids), -1)
    step = max(1, (32 << 20) // max(len(first) + len(second), 1))
    for lo in range(0, int(code.max(initial=-1)) + 1, step):
        m = (code >= lo) & (code < lo + step)
        sides = []
        for side in (first, second):
            place[:] = -1
            place[side] = np.arange(len(side))
            at = m & (place[doc] >= 0)
            dense = np.zeros((len(side), min(step, int(code.max()) + 1 - lo)), np.float32)
            dense[place[doc[at]], code[at] - lo] = count[at]
            sides.append(dense)
        of_first += sides[0] @ (sides[1] > 0).T.astype(np.float32)
        of_second += (sides[0] > 0).astype(np.float32) @ sides[1].T
    with np.errstate(divide="ignore"):
        most = 1 / (total[first][:, None] / of_first + total[second][None, :] / of_second - 1)
    most[(of_first == 0) | (of_second == 0)] = 0
    x, y = np.nonzero((most >= threshold - 1e-6) & (label[first][:, None] != label[second][None, :]))
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    seen, out = set(), []
    for p, q in zip(first[x].tolist(), second[y].tolist(), strict=True):
        pair = (min(label[p], label[q]), max(label[p], label[q]))
        if pair not in seen:
            s, r = slice(cut[p], cut[p + 1]), slice(cut[q], cut[q + 1])
            if probability_jaccard(value[s], count[s], value[r], count[r]) >= threshold:
                seen.add(pair)
                out.append(sorted((int(ids[p]), int(ids[q]))))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def roots(links: DataFrame) -> DataFrame:
    """(id, label) of links (a, b) with a < b, each b in one link: the smallest id of each tree, by pointer doubling."""
    labels = links.select(F.col("b").alias("id"), F.col("a").alias("label"))
    while True:
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = settle(labels.join(up, "label", "left").select("id", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "roots")
        if labels.where("moved").isEmpty():
            return labels.drop("moved")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links between classes."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    found = components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
    return settle(moved.select("id", F.coalesce("to", "label").alias("label")).union(found.where("id <> label")), "labels")


def near_groups(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, digest), and (digest, doc_id, node, label) of each distinct text that has an id.

    A text's node is its smallest doc_id, or a number of its own where another text has the same; equal labels (the node
    of one of the texts) make a class.
    """
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(settle(df, name))
        return made[-1]

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of().cast("binary")).alias("digest"), text_of().alias("text"))
    signed = settle(base.mapInArrow(lambda it: _banded(it, k, bands, rows), "doc_id long, digest string, bands array<long>"), "signed")
    groups = kept(signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands")).where("doc_id IS NOT NULL"), "groups")
    twice = groups.groupBy("doc_id").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1").select("doc_id", "first")
    own = F.least(F.lit(-1).cast("long"), -F.abs(F.xxhash64("digest")))
    groups = groups.join(twice, "doc_id", "left").withColumn("rep", F.when(F.col("digest") != F.col("first"), own).otherwise(F.col("doc_id"))).drop("first")
    groups = kept(groups, "nodes")
    banded = groups.select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    pivots = banded.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").drop("hi")
    buckets = kept(banded.join(pivots, "key"), "buckets")
    in_doubt = groups.join(buckets.select("rep").distinct(), "rep").select("doc_id", "digest", "rep")
    texts = base.join(in_doubt, ["doc_id", "digest"]).select(F.col("rep").alias("doc_id"), "text")
    texts = kept(texts.dropDuplicates(["doc_id"]), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        with_b = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        with_a = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return with_a.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verified(it, k, threshold), "a long, b long")

    best = buckets.where("a < rep").groupBy(F.col("rep").alias("b")).agg(F.mode("a", True).alias("a"))
    labels = roots(kept(verify(best), "links"))
    made.append(labels)
    named = buckets.select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    named = kept(named, "named")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = named.join(several, "key").select(F.col("rep").alias("doc_id")).distinct()
    open_ = kept(texts.join(open_, "doc_id"), "open")
    slots = open_.select("text").mapInArrow(lambda it: _ranks(it, k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    rank = np.zeros(1 << RANK_BITS, np.int32)
    rank[slots.column("slot").to_numpy()] = np.minimum(slots.column("n").to_numpy(), 2**31 - 1)
    shared = spark.sparkContext.broadcast(rank)
    rarest = kept(open_.mapInArrow(lambda it: _rarest(it, k, threshold, shared.value), "key long, rep long"), "rarest")

    def open_rows(rows: DataFrame) -> DataFrame:
        """(key, rep, label, n) of the buckets that still hold several classes."""
        named = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        of_key = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
        return named.join(of_key, "key")

    for _ in range(PIVOTS):  # most texts of a large group are linked to its class in linear steps
        rows = kept(open_rows(rarest), "openrows")
        pivot = rows.where(F.col("n") > LARGE).groupBy("key").agg(F.min_by(F.struct("rep", "label"), F.xxhash64("rep")).alias("p"))
        found = rows.join(pivot, "key").where("label <> p.label").select(F.least("p.rep", "rep").alias("a"), F.greatest("p.rep", "rep").alias("b"))
        more = kept(verify(found.distinct()), "links")
        if more.isEmpty():
            break
        labels = merged(labels, more)
        made.append(labels)
        rarest = rows.select("key", "rep")
    rows = kept(open_rows(rarest.select("key", "rep")), "openrows")
    x, y = rows.where(F.col("n") <= LARGE).alias("x"), rows.where(F.col("n") <= LARGE).alias("y")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")))
    found = verify(found.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    large = rows.where(F.col("n") > LARGE).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    n_blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64(F.lit("block"), "rep"), n_blocks)
    large = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    large = large.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "text")
    within = large.groupBy("key", "i", "j").applyInArrow(lambda t: _block_links(t, k, threshold), "a long, b long")
    more = kept(found.union(within), "links")
    if not more.isEmpty():
        labels = merged(labels, more)
        made.append(labels)
    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "doc_id", F.col("rep").alias("node"), F.coalesce("label", "rep").alias("label"))
    out = settle(named, "classes")
    forget(spark, *made)
    return signed.select("doc_id", "digest"), out


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, node): the class of each row, named by its smallest doc_id."""
    rows, groups = near_groups(docs, **options)
    least = groups.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = groups.join(least, "label").select("digest", "class_id", F.col("label").alias("node"))
    return rows.join(named, "digest", "left").select("doc_id", "class_id", "node")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, a text of its smallest doc_id, with all columns; rows without an id or class all stay.

    Of rows that agree in that id and text one stays.
    """
    _, groups = near_groups(docs, **options)
    least = groups.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.digest").alias("_digest"))
    named = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(named.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.md5(text_of().cast("binary")).alias("_digest"))
    first = rows.join(least, ["_id", "_digest"], "left_semi")
    often = first.groupBy("_id", "_digest").agg(F.count("*").alias("_n"))
    several = often.where("_n > 1").select("_id", "_digest")
    once = first.join(several, ["_id", "_digest"], "left_anti").select("_row")
    one = first.join(several, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select("_row")
    return once.unionByName(one).unionByName(rows.where("_id IS NULL").select("_row")).select("_row.*")


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
