"""Ranked lexical search with frequent-pattern trees of documents.

For a batch of items, each document becomes the vector of its counts of the items' terms, the most frequent term first.  A task
sorts the vectors of its documents, so those that begin alike lie side by side: the sorted block is a trie whose nodes
are intervals, their shared beginnings being the paths (unary paths are one step).  The tree is searched depth-first for all items
together.  A node's largest count of each term and least m bound what any document below it can score for an item, as the score
grows with tf and falls with m; an item whose bound is below its k-th best score so far leaves the search there, and a node that
no item is left for is not entered.  What remains at nodes of up to ``LEAF`` documents is scored exactly, in integers below
2**53, as one matrix product.

The k-th best scores of a bounded sample of documents are where all tasks begin; they are scores of real documents,
so nothing is lost.  Tasks return k documents for each item at most, which Spark ranks.  Texts are read once for a batch of
items; only the vectors are kept.

Defined cases: a null text has no terms, like one without any, and is never found; an item without terms finds nothing; repeated rows
are ranked each by itself; a null doc_id comes behind others of its score; items that share an item_id are searched each
by itself; a very long text is a slice of its own; other columns, whatever their names, are not looked at; empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, numbered, settle, table
from .terms import LETTERS_DIGITS, terms_of
from .textvec import slices

#: Documents returned for an item.
TOP = 50
#: Items and distinct terms of a batch, documents of the sample, documents of a leaf, entries of a tree.
ITEMS, TERMS, SAMPLE, LEAF, ENTRIES = 256, 1 << 14, 8192, 64, 1 << 22
SCALE = 1_000_000_000
_SLICE = 4 << 20
_NONE = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(1), _SLICE):
            t = terms_of(b.column(1)[lo:to], LETTERS_DIGITS)
            width = max(len(t.distinct), 1)
            once = np.unique(t.doc * width + t.code)
            terms = t.distinct.take(pa.array(once % width)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(once // width + lo)), terms], ["item", "term"])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array([t.encode() for t in vocabulary], pa.large_binary())
    width = max(len(vocabulary), 1)
    for b in batches:
        for lo, to in slices(b.column(1), _SLICE):
            t = terms_of(b.column(1)[lo:to], LETTERS_DIGITS)
            code = pc.fill_null(pc.index_in(t.distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[t.code]
            n = np.bincount(t.doc, minlength=to - lo)
            there = code >= 0
            key, tf = np.unique(t.doc[there] * width + code[there], return_counts=True)
            size = np.bincount(key // width, minlength=to - lo)
            some = n > 0
            ends = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % width).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:to].filter(pa.array(some)), pa.array(n[some]), *lists], ["doc_id", "n", "code", "tf"])


def _document_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n = np.zeros(width, np.int64)
    for b in batches:
        n += np.bincount(b.column(0).flatten().to_numpy(), minlength=width)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["code", "df"])


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms each, exact however large the counts."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        n = n.astype(object)
    return (100 - 50 + (50 * n * documents) // terms).astype(np.int64)


@dataclass
class Asked:
    """A batch of items: which of them has which term with which weight, and what is known of the collection."""

    weight: np.ndarray  # items x ranks
    rank: np.ndarray  # of each code, the most frequent first
    documents: int
    terms: int
    top: int
    least: np.ndarray  # a score of each item that its k-th best is known to reach


class _Best:
    """The best documents of each item so far."""

    def __init__(self, asked: Asked) -> None:
        self.asked, self.least, self.new = asked, asked.least.copy(), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((item, score, doc))
        self.new += len(item)
        if self.new > 20 * self.asked.top:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts, strict=True) if self.parts else ((), (), ())))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        at = place == self.asked.top - 1
        self.least[item[at]] = np.maximum(self.least[item[at]], score[at])
        keep = place < self.asked.top
        self.parts, self.new = [(item[keep], score[keep], doc[keep])], 0
        return self.parts[0]


class Tree:
    """The trie of a block of documents: their vectors in the order of ranks, sorted."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, ends: np.ndarray, code: np.ndarray, tf: np.ndarray, asked: Asked) -> None:
        of = np.repeat(np.arange(len(doc)), np.diff(ends))
        rank = asked.rank[code]
        order = np.lexsort((rank, of))
        rank, tf = rank[order], tf[order]
        data = rank.astype(">u4").tobytes()
        at = (ends * 4).tolist()
        keys = [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        by_path = np.array(sorted(range(len(doc)), key=keys.__getitem__), np.int64)
        size = np.diff(ends)[by_path]
        self.start = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(self.start[-1]) + np.repeat(ends[:-1][by_path] - self.start[:-1], size)
        self.rank, self.tf = rank[take], tf[take]
        self.doc, self.m = doc[by_path], length_norm(n, asked.documents, asked.terms)[by_path]
        self.size, self.asked = size, asked

    def shared(self, lo: int, hi: int, depth: int) -> int:
        """Steps that all documents of an interval share: as they are sorted, those of the first and the last."""
        most = min(self.size[lo], self.size[hi - 1])
        a, b = self.start[lo], self.start[hi - 1]
        differ = np.flatnonzero(self.rank[a + depth : a + most] != self.rank[b + depth : b + most])
        return depth + int(differ[0]) if len(differ) else int(most)

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        """The intervals of the next terms; small neighbours are one."""
        at = self.start[lo:hi] + depth
        step = np.where(self.size[lo:hi] > depth, self.rank[np.minimum(at, len(self.rank) - 1)], -1)
        cuts = [lo, *(np.flatnonzero(np.diff(step)) + 1 + lo).tolist(), hi]
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if out and y - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def search(self, best: _Best) -> None:
        weight = self.asked.weight
        todo = [(0, len(self.doc), 0, np.arange(len(weight)))] if len(self.doc) else []
        while todo:
            lo, hi, depth, active = todo.pop()
            a, b = self.start[lo], self.start[hi]
            rank, tf = self.rank[a:b], self.tf[a:b]
            most = np.zeros(weight.shape[1], np.int64)
            np.maximum.at(most, rank, tf)
            some = np.flatnonzero(most)
            bound = weight[np.ix_(active, some)] @ impact(most[some], self.m[lo:hi].min()).astype(np.float64)
            active = active[(bound >= best.least[active]) & (bound > 0)]
            if not len(active):
                continue
            deeper = self.shared(lo, hi, depth) if hi - lo > LEAF else depth
            if hi - lo > LEAF and (deeper < self.size[lo] or deeper < self.size[hi - 1]):
                todo += [(x, y, deeper, active) for x, y in reversed(self.children(lo, hi, deeper))]
                continue
            for x in range(lo, hi, LEAF):  # one leaf, or many documents with one path
                y = min(hi, x + LEAF)
                s = slice(self.start[x], self.start[y])
                value = np.zeros((len(some), y - x))
                of = np.repeat(np.arange(y - x), self.size[x:y])
                value[np.searchsorted(some, self.rank[s]), of] = impact(self.tf[s], np.repeat(self.m[x:y], self.size[x:y]))
                score = weight[np.ix_(active, some)] @ value
                item, doc = np.nonzero(score >= np.maximum(best.least[active], 1)[:, None])
                best.add(active[item], score[item, doc].astype(np.int64), self.doc[x + doc])


def _searched(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    asked: Asked = shared.value
    best = _Best(asked)
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("code")).to_numpy(zero_copy_only=False))]).astype(np.int64)
        doc = pc.fill_null(b.column("doc_id"), _NONE).to_numpy(zero_copy_only=False)
        n, code, tf = b.column("n").to_numpy(), b.column("code").flatten().to_numpy(), b.column("tf").flatten().to_numpy()
        lo = 0
        while lo < b.num_rows:
            to = max(lo + 1, int(np.searchsorted(ends, ends[lo] + ENTRIES, side="right")) - 1)
            Tree(doc[lo:to], n[lo:to], ends[lo : to + 1] - ends[lo], code[ends[lo] : ends[to]], tf[ends[lo] : ends[to]], asked).search(best)
            lo = to
    item, score, doc = best.cut()
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=doc == _NONE)], ["item", "score", "doc_id"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _batches(sizes: DataFrame, items: int, terms: int) -> list[tuple[int, int]]:
    """Ranges of item numbers whose numbers of items and terms are bounded."""
    out, n, left = [], 0, 0
    for x in sizes.orderBy("item").toLocalIterator():
        if not out or n == items or x["n"] > left:
            out.append((x["item"], x["item"]))
            n, left = 0, terms
        out[-1] = (out[-1][0], x["item"])
        n, left = n + 1, left - x["n"]
    return out


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP, batch_items: int = ITEMS, batch_terms: int = TERMS, sample: int = SAMPLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = settle(numbered(items.select("item_id", F.col("text").cast("string").alias("text")), [F.col("item_id"), F.xxhash64("text")], "item"), "items")
    terms = settle(asked.select(F.col("item").cast("long").alias("item"), "text").mapInArrow(_item_terms, "item long, term string"), "terms")
    out = []
    for lo, hi in _batches(terms.groupBy("item").agg(F.count("*").alias("n")), batch_items, batch_terms):
        own = terms.where(F.col("item").between(lo, hi)).collect()  # bounded by the batch
        vocabulary = sorted({r["term"] for r in own})
        vectors = settle(texts.mapInArrow(lambda it, v=vocabulary: _vectors(it, v), "doc_id long, n long, code array<int>, tf array<long>"), "vectors")
        documents, total = vectors.agg(F.count("*"), F.sum("n")).collect()[0]
        if not documents:
            forget(spark, vectors)
            continue
        width = len(vocabulary)
        counted = vectors.select("code").mapInArrow(lambda it, w=width: _document_counts(it, w), "code long, df long")
        df = np.zeros(width, np.int64)
        for r in counted.groupBy("code").agg(F.sum("df").alias("df")).collect():
            df[r["code"]] = r["df"]
        rank = np.empty(width, np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(width)
        code = {t: i for i, t in enumerate(vocabulary)}
        weight = np.zeros((hi - lo + 1, width))
        for r in own:
            c = code[r["term"]]
            weight[r["item"] - lo, rank[c]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df[c]) + 1)))

        def search(rows: DataFrame, least: np.ndarray, a=(weight, rank, documents, total), lo=lo) -> DataFrame:
            shared = spark.sparkContext.broadcast(Asked(*a, top, least))
            found = rows.mapInArrow(lambda it: _searched(it, shared), "item long, score long, doc_id long")
            return _ranked(found, top).withColumn("item", F.col("item") + lo)

        least = np.zeros(hi - lo + 1, np.int64)
        if documents > 2 * sample:
            some = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(documents // sample)) == 0).limit(2 * sample)
            for r in search(some, least).where(F.col("rank") == top).collect():
                least[r["item"] - lo] = r["score"]
        out.append(settle(search(vectors, least), "found"))
        forget(spark, vectors)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
o AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM o, s GROUP BY term),
m AS (SELECT k, doc_id, 100 - 50 + (50 * len(t) * docs) // terms AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT item, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN o USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}"""
