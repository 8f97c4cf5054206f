"""How the sources of a language differ in their words, by a vocabulary held as minimal acyclic transducers.

1.  Document frequencies of (lang, term) are counted, and the terms of at least ``LEAST_DOCS`` documents are kept.
2.  The kept terms, sorted by language and bytes, are numbered without gaps and cut into runs of a bounded number of terms; each run
    becomes a minimal acyclic transducer whose outputs are the terms' ordinals.
3.  All texts stream through the transducers and are counted anew by (lang, source, ordinal).  Transducers go to the executors in parts
    of at most ``PART_BYTES`` in all, one pass over the texts for each part (one pass up to some millions of kept terms).
4.  Smoothed shares are compared in integers: pairs of sources block by block of ordinals, terms against the whole language.
    Equal values go by ordinal, which is the terms' order.

Counts are combined in the task and by Spark before each shuffle; sources are compared as matrices of one block of ordinals and
at most 2 * ``TILE`` sources, from which one partial sum for each pair comes out.  The pairs of a language's sources are
the result, so it grows with their square, whatever the number of documents.

Defined cases: null text, lang and source count as ''; texts without terms add a group without counts; a language without kept terms
has pairs of value 0 and no terms; repeated rows count again; ties have their order; other columns, whatever their
names, are not looked at; a very long text is one slice of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, numbered, settle, table
from .terms import LETTERS, terms_of
from .textvec import slices
from .transducer import Transducer, build

#: A term is kept for a language that holds it in so many documents; pseudo-count of each term; terms listed for a group.
LEAST_DOCS, ADDED, TOP = 30, 5, 50
SCALE = 1_000_000_000
#: Terms of a transducer, bytes of transducers that an executor holds at a time, ordinals of a block, sources of a tile.
RUN_TERMS, PART_BYTES, BLOCK, TILE = 1 << 18, 64 << 20, 512, 128
_SLICE, _HELD = 2 << 20, 1 << 20


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, pa.Array]]:
    """(lang, sources, texts) of the rows of each language in slices of bounded bytes."""
    langs = batch.column(0).dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        at = pa.array(np.flatnonzero(of == i))
        sources, texts = batch.column(1).take(at), batch.column(2).take(at)
        for lo, to in slices(texts, _SLICE):
            yield lang, sources[lo:to], texts[lo:to]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, _, texts in _by_lang(batch):
            t = terms_of(texts, LETTERS)
            width = max(len(t.distinct), 1)
            once = np.unique(t.doc * width + t.code) % width
            n = np.bincount(once, minlength=len(t.distinct))
            terms = t.distinct.cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, pa.array(n, pa.int64())], ["lang", "term", "n"])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal): the kept terms of each language, numbered from 0 in the order of language and term."""
    counted = _read(docs).mapInArrow(_document_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = settle(counted.where(F.col("n") >= least).select("lang", "term"), "kept")
    out = settle(numbered(kept, [F.col("lang"), F.col("term")], "number").select("lang", "term", (F.col("number") - 1).cast("long").alias("ordinal")), "ordinals")
    forget(docs.sparkSession, kept)
    return out


def _built(run: pa.Table) -> pa.Table:
    run = run.sort_by("ordinal")
    data = build(t.encode() for t in run.column("term").to_pylist()).to_bytes()
    return pa.table({"lang": run.column("lang")[:1], "first": run.column("ordinal")[:1], "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})


def transducers(kept: DataFrame, run_terms: int = RUN_TERMS) -> DataFrame:
    """(lang, first, size, data): a transducer for each run of terms; a term's ordinal is its place and ``first``."""
    runs = kept.withColumn("run", F.floor(F.col("ordinal") / run_terms))
    return settle(runs.groupBy("lang", "run").applyInArrow(_built, "lang string, first long, size long, data binary"), "transducers")


class _Held:
    """Counts by key, merged when there are many; at most 2 * _HELD keys and what one slice adds."""

    def __init__(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, lang: str, sources: pa.Array, source: np.ndarray, ordinal: np.ndarray) -> None:
        """Occurrences: the row of ``sources`` and the ordinal of each."""
        coded = sources.dictionary_encode()
        ids = np.array([self.names.setdefault((lang, s), len(self.names)) for s in coded.dictionary.to_pylist()], np.int64)
        of = ids[coded.indices.to_numpy(zero_copy_only=False)]
        key, count = np.unique((of[source] << 40) | ordinal, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.n += len(key)
        if self.n > 2 * _HELD:
            self.merge()

    def merge(self) -> None:
        key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)]
        self.keys, self.n = [key], len(key)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self.merge()
            key, names = self.keys[0], list(self.names)
            of = pa.array(key >> 40)
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(of) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array(key & ((1 << 40) - 1)), pa.array(self.counts[0])], ["lang", "source", "ordinal", "n"])
        self.__init__()


def _recounted(batches: Iterator[pa.RecordBatch], part) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, list[tuple[int, Transducer]]] = {}
    for lang, first, data in part.value:
        by_lang.setdefault(lang, []).append((first, Transducer.from_bytes(data)))
    held = _Held()
    for batch in batches:
        for lang, sources, texts in _by_lang(batch):
            if lang not in by_lang:
                continue
            t = terms_of(texts, LETTERS)
            ordinal = np.full(len(t.distinct), -1, np.int64)
            for first, transducer in by_lang[lang]:
                place = transducer.places(t.distinct)
                ordinal = np.where(place >= 0, place + first, ordinal)
            of = ordinal[t.code]
            there = of >= 0
            held.add(lang, sources, t.doc[there], of[there])
            if held.n > _HELD:
                held.merge()
                if held.n > _HELD:
                    yield from held.rows()
    yield from held.rows()


def counts_by_source(docs: DataFrame, made: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the terms of the transducers ``made`` in each source."""
    spark, rows, parts, left = docs.sparkSession, _read(docs), [], part_bytes
    # a part is what the executors hold at a time; only sizes and places of the transducers are listed here
    for x in made.select("lang", "first", "size").orderBy("first").toLocalIterator():
        if not parts or x["size"] > left:
            parts.append([x["first"], x["first"]])
            left = part_bytes
        parts[-1][1] = x["first"]
        left -= x["size"]
    out = []
    for lo, hi in parts:
        part = spark.sparkContext.broadcast([(x["lang"], x["first"], bytes(x["data"])) for x in made.where(F.col("first").between(lo, hi)).collect()])
        found = rows.mapInArrow(lambda it, part=part: _recounted(it, part), "lang string, source string, ordinal long, n long")
        out.append(settle(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts"))
        part.destroy()
    if not out:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def share(n: Column, total: Column, terms: Column, added: int = ADDED) -> Column:
    """1 + floor(SCALE * (n + added) / (total + added * terms)), in decimals, which don't overflow."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + added).cast("decimal(19,0)")
    return F.call_function("div", above, (total + added * terms).cast("decimal(19,0)")) + 1


def _block_sums(rows: pa.Table) -> pa.Table:
    """Sums of |p - q| over the ordinals of one block, for pairs of the sources of two tiles; ordinal -1 has a source's share of 0."""
    first, second = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    source = rows.column("source").combine_chunks().dictionary_encode()
    names, of = source.dictionary, source.indices.to_numpy(zero_copy_only=False)
    ordinal, p, tile = (rows.column(c).to_numpy() for c in ("ordinal", "p", "tile"))
    base = ordinal < 0
    width = np.unique(ordinal[~base])
    share = np.zeros((len(names), len(width)), np.int64)
    share[of[base]] = p[base][:, None]
    share[of[~base], np.searchsorted(width, ordinal[~base])] = p[~base]
    own = np.zeros(len(names), np.int64)
    own[of] = tile
    a, b, total = [], [], []
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    for x in left:
        others = right[right > x] if first == second else right
        a.append(np.full(len(others), x))
        b.append(others)
        total.append(np.abs(share[others] - share[x]).sum(1))
    a, b, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, total))
    lang = rows.column("lang")[:1].to_pylist() * len(a)
    return pa.table({"lang": pa.array(lang, pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(total, pa.int64())})


def _pairs(counts: DataFrame, groups: DataFrame, spans: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    own = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    block = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))).alias("block")
    base = own.join(spans.select("lang", "lo", "hi"), "lang").select("lang", "source", "tile", "tiles", block, F.lit(-1).cast("long").alias("ordinal"), share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p"))
    full = counts.join(own, ["lang", "source"]).select("lang", "source", "tile", "tiles", F.floor(F.col("ordinal") / BLOCK).alias("block"), "ordinal", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    rows = base.union(full).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "source", "tile", "ordinal", "p")
    sums = rows.groupBy("lang", "block", "i", "j").applyInArrow(_block_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    x, y = (groups.select("lang", F.col("source").alias(c)) for c in ("source", "item"))
    both = x.join(y, "lang").where("source <> item").withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
    return both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, run_terms: int = RUN_TERMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources by the distance of their shares, and each source's terms that stand
    out most from its language."""
    spark = docs.sparkSession
    kept = kept_terms(docs, least)
    made = transducers(kept, run_terms)
    counts = counts_by_source(docs, made, part_bytes)
    spans = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = _read(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(spans.select("lang", "terms"), "lang", "left")
    groups = settle(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")), "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.first("terms").alias("terms"))
    q = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "ordinal", share(F.col("n"), F.col("whole"), F.col("terms")).alias("q"))
    p = counts.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = p.join(q, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(kept, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(counts, groups, spans).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = settle(named.unionByName(pairs), "divergence")
    forget(spark, kept, made, counts, groups)
    return out


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT lang, source, n, unnest(t) AS item FROM d),
kept AS (SELECT lang, item FROM o GROUP BY lang, item HAVING count(DISTINCT n) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, item, count(*) AS c FROM o JOIN kept USING (lang, item) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.item, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + {ADDED})::HUGEINT) // (coalesce(n.n, 0) + {ADDED} * v.v) AS p
    FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
q AS (SELECT lang, item, 1 + ({SCALE} * (sum(c) + {ADDED})::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + {ADDED} * count(*) OVER (PARTITION BY lang)) AS q FROM p GROUP BY lang, item),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', item, p - q FROM p JOIN q USING (lang, item) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}"""
