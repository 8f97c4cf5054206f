"""Substring dedup with a log-structured fingerprint index.

Every 50-word window has an anchor: the ten-word window in it with the smallest hash, a choice that depends on the words of
the window alone.  Equal windows therefore share their anchor, and the index needs the anchors only (a window hash of
about every twentieth word) instead of all windows.

The index is a list of immutable runs, tables bucketed and sorted by hash.  A batch becomes a run of its own; each older
run is merge-joined with it, bucket by bucket and without shuffling the history.  Shared anchors name candidate texts,
old and new; in these the 50-word windows of the shared anchors are hashed (128 bits with the anchor's) and compared,
which verifies the candidates, and the smallest document that a window starts in is found.

Runs stand in levels.  A batch's run goes to the lowest one; a level with ``FANOUT`` runs is merged into one run of the next, so a
row is rewritten once for each level and not at each batch.  The folder of an index holds its runs and, for each state, a
manifest that is written last; an index is opened by its folder in any session, and dropped on request.

A window that very many texts share is a hot key of the last join; such keys, at most ``HOT`` of them, are joined by broadcast.

Whole copies are found by a digest of the text, also held in runs: only the first of equal texts is indexed, which
changes no result, as all windows of a later copy start in the first one.

Defined cases: a null text has no words; a row with a null doc_id is kept whole and never removes words elsewhere; rows that
repeat one doc_id don't remove each other's words; texts under 50 words are kept whole; a very long text is a slice of its own,
whose anchors are found block by block; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_path, forget, new_path, settle, table, text_of
from .textvec import as_long, mix64, slices, split_words, window_hash

WINDOW, ANCHOR = 50, 10
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Windows with more than this share of all candidate rows are joined by broadcast: fewer than so many keys can be.
HOT = 4096
#: Windows whose anchors are looked for at a time.
_BLOCK = 1 << 16
_MANIFEST = "kind string, level int, name string"


def anchored(hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, their anchors' places, and the hashes of all anchor-sized windows."""
    short = window_hash(hashes, anchor)
    starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, short
    width = window - anchor + 1
    views = np.lib.stride_tricks.sliding_window_view(short, width)
    least = [views[starts[i : i + _BLOCK]].argmin(1) for i in range(0, len(starts), _BLOCK)]
    return starts, starts + np.concatenate(least), short


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(2)):
            w = split_words(b.column(2)[lo:to])
            _, places, short = anchored(w.hash, w.doc, window, anchor)
            places = np.unique(places)
            at = pa.array(w.doc[places] + lo)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(short[places])), b.column(0).take(at), b.column(1).take(at)], ["h", "doc_id", "rid"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows whose anchors are in the column ``shared`` of their text."""
    for b in batches:
        shared = b.column(4)
        for lo, to in slices(b.column(3)):
            w = split_words(b.column(3)[lo:to])
            starts, places, short = anchored(w.hash, w.doc, window, anchor)
            lists = shared[lo:to]
            doc_of = np.repeat(np.arange(to - lo), np.diff(lists.offsets.to_numpy()))
            asked = lists.flatten().to_numpy().view(np.uint64)
            # anchors are looked up together with their text
            have = np.sort(mix64(asked + mix64(doc_of.astype(np.uint64))))
            own = mix64(short[places] + mix64(w.doc[starts].astype(np.uint64)))
            found = np.searchsorted(have, own)
            hit = np.flatnonzero((found < len(have)) & (have[np.minimum(found, max(len(have) - 1, 0))] == own)) if len(have) else np.zeros(0, np.int64)
            starts, places = starts[hit], places[hit]
            full = window_hash(w.hash, window)[starts]
            at = pa.array(w.doc[starts] + lo)
            cols = [pa.array(as_long(short[places])), pa.array(as_long(full)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array((starts - w.first[w.doc[starts]]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "w", "doc_id", "rid", "fresh", "start"])


class WindowIndex:
    """The runs of one index in a folder; ``ingest`` takes a batch and returns the windows of it to remove.

    ``levels`` has the runs of anchors (kind "h") and of text digests (kind "digest") by level, each a table bucketed and sorted
    by its key.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT, buckets: int | None = None, folder: str | None = None):
        self.spark, self.window, self.anchor, self.fanout = spark, window, anchor, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or new_path(spark, "index")
        self.levels: dict[str, list[list[str]]] = {"h": [], "digest": []}
        self.state = 0

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT) -> WindowIndex:
        """The index of a folder as its last manifest has it; its runs become tables of this session."""
        rows = spark.read.schema(f"{_MANIFEST}, state int, buckets int").parquet(f"{folder}/manifest").collect()  # a few rows for each ingest
        last = max(r["state"] for r in rows)
        index = cls(spark, window, anchor, fanout, rows[0]["buckets"], folder)
        index.state = last
        for r in sorted((r for r in rows if r["state"] == last and r["name"]), key=lambda r: (r["level"], r["name"])):
            columns = "h BIGINT, doc_id BIGINT, rid BIGINT" if r["kind"] == "h" else "digest STRING, first BIGINT"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} ({columns}) USING parquet CLUSTERED BY ({r['kind']}) SORTED BY ({r['kind']}) INTO {r['buckets']} BUCKETS LOCATION '{folder}/{r['name']}'")
            index._add(r["kind"], r["level"], r["name"])
        return index

    def runs(self, kind: str) -> list[str]:
        return [r for level in self.levels[kind] for r in level]

    def _add(self, kind: str, level: int, name: str) -> None:
        while len(self.levels[kind]) <= level:
            self.levels[kind].append([])
        self.levels[kind][level].append(name)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"loomwork_run_{uuid.uuid4().hex}"
        sorted_ = df.repartition(self.buckets, kind).sortWithinPartitions(kind)
        sorted_.write.bucketBy(self.buckets, kind).sortBy(kind).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop_run(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, f"{self.folder}/{name}")

    def _commit(self, kind: str, name: str) -> list[str]:
        """Adds a run and merges levels that are full, from below; returns the runs that are in no level any more."""
        self._add(kind, 0, name)
        gone, level = [], 0
        while len(self.levels[kind][level]) >= self.fanout:
            full = self.levels[kind][level]
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(r) for r in full]), kind)
            gone += full
            self.levels[kind][level] = []
            self._add(kind, level + 1, merged)
            level += 1
        return gone

    def _manifest(self) -> None:
        """A new state: what a session that opens the folder from now on sees."""
        self.state += 1
        rows = [(kind, n, r, self.state, self.buckets) for kind, levels in self.levels.items() for n, level in enumerate(levels) for r in level]
        self.spark.createDataFrame(rows, f"{_MANIFEST}, state int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def drop(self) -> None:
        """Drops the tables of the runs and deletes the folder."""
        for kind in self.levels:
            for r in self.runs(kind):
                self.spark.sql(f"DROP TABLE IF EXISTS {r}")
        delete_path(self.spark, self.folder)

    def ingest(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Indexes ``batch`` and returns (doc_id, rid, starts): windows of it that also start in a smaller document.

        Both frames have doc_id, rid (a hash of the row), digest and text; ``history`` holds the rows ingested before,
        which must have smaller ids.  ``starts`` is [-1] for a copy of a whole text.
        """
        spark, window, anchor = self.spark, self.window, self.anchor
        own = settle(batch.groupBy("digest").agg(F.min("doc_id").alias("first")), "digests")
        known = reduce(DataFrame.unionByName, [spark.table(r).join(own.select("digest"), "digest") for r in self.runs("digest")]) if self.runs("digest") else None
        firsts = own if known is None else own.join(known.groupBy("digest").agg(F.min("first").alias("old")), "digest", "left").select("digest", F.least("first", "old").alias("first"))
        of_copy = settle(batch.select("doc_id", "rid", "digest").join(firsts, "digest").where("doc_id > first").select("doc_id", "rid").distinct(), "copies")
        fresh = batch.join(of_copy, ["doc_id", "rid"], "left_anti").dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", "text")
        rows = fresh.mapInArrow(lambda it: _anchors(it, window, anchor), "h long, doc_id long, rid long")
        run = self._write(rows, "h")
        new = spark.table(run)
        keys = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        old = [spark.table(r).join(keys, "h").select("h", "doc_id", "rid") for r in self.runs("h")]
        met = settle(reduce(DataFrame.unionByName, old), "met") if old else None
        within = keys.where("lo < hi").select("h")
        shared = within if met is None else within.union(met.select("h")).distinct()
        asked = new.join(shared, "h", "left_semi").select("h", "doc_id", "rid", F.lit(True).alias("fresh"))
        if met is not None:
            asked = asked.unionByName(met.withColumn("fresh", F.lit(False)))
        asked = settle(asked.groupBy("doc_id", "rid").agg(F.first("fresh").alias("fresh"), F.collect_set("h").alias("shared")), "asked")
        texts = batch.select("doc_id", "rid", "text")
        texts = texts if met is None else texts.unionByName(history.select("doc_id", "rid", "text"))
        texts = texts.join(asked, ["doc_id", "rid"]).select("doc_id", "rid", "fresh", "text", "shared")
        found = settle(texts.mapInArrow(lambda it: _windows(it, window, anchor), "h long, w long, doc_id long, rid long, fresh boolean, start int"), "windows")
        hits = self._later(found)
        marks = hits.groupBy("doc_id", "rid").agg(F.collect_set("start").alias("starts"))
        out = settle(marks.unionByName(of_copy.withColumn("starts", F.array(F.lit(-1)))), "marks")
        gone = [*self._commit("digest", self._write(own, "digest")), *self._commit("h", run)]
        self._manifest()
        for r in gone:
            self._drop_run(r)
        forget(spark, own, *[x for x in (met, asked, found, of_copy) if x is not None])
        return out

    def _later(self, found: DataFrame) -> DataFrame:
        """Windows of the batch that also start in a smaller document."""
        n = found.count()
        first = found.groupBy("h", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
        first = settle(first, "firsts")
        hot = F.broadcast(first.where(F.col("n") * HOT > n).select("h", "w", "first"))  # fewer than HOT rows
        usual = found.where("fresh").join(hot.select("h", "w"), ["h", "w"], "left_anti").join(first.where(F.col("n") * HOT <= n).select("h", "w", "first"), ["h", "w"])
        return usual.unionByName(found.where("fresh").join(hot, ["h", "w"])).where("doc_id > first")


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts in zip(b.column(1), b.column(2)):
            words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space only
            starts = starts.as_py() or []
            n = len(words)
            if starts and starts[0] < 0:
                gone = np.full(n, n >= window)
            else:
                step = np.zeros(n + 1, np.int32)
                at = np.unique(np.array(starts, np.int64))
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:n]) > 0
            left = [w for w, g in zip(words, gone) if not g] if gone.any() else words
            n_words.append(n)
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that repeat a window of a smaller document.

    Documents are ingested in ``batches`` of ascending ids, each against the index of those before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text_of()).alias("rid"), F.md5(text_of().cast("binary")).alias("digest"), text_of().alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    index = WindowIndex(spark, window, anchor)
    low, marks = None, []
    for cut in [*sorted(set(cuts or [])), None]:
        batch = rows.where(F.col("doc_id").isNotNull())
        history = batch.where(F.col("doc_id") <= low) if low is not None else batch.where(F.lit(False))
        batch = batch.where(F.col("doc_id") > low) if low is not None else batch
        batch = batch.where(F.col("doc_id") <= cut) if cut is not None else batch
        marks.append(index.ingest(batch, history))
        low = cut
    index.drop()
    marked = reduce(DataFrame.unionByName, marks)
    joined = rows.select("doc_id", "rid", "text").join(marked, ["doc_id", "rid"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(lambda it: _removed(it, window), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents."""
    docs = table(spark, sf_dir, "documents")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by plain SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS f FROM k GROUP BY h),
g AS (SELECT doc_id, list_sort(list(p)) AS g FROM k JOIN f USING (h) WHERE doc_id > f GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(g, lambda x: generate_series(x, x + 49)))) AS c FROM g),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, unnest(c) AS i, true AS gone FROM c),
r AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept, count(*) FILTER (WHERE gone) AS n_removed
      FROM e LEFT JOIN x USING (doc_id, i) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
