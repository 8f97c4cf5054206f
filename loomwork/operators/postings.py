"""A stored inverted index: positions of terms in retrieval units, kept in segments that are written once.

    <path>/postings/segment=N/bucket=B   one row for each term of each unit, with its positions, sorted by term: a query reads the
                                         buckets of its terms, and within them the row groups whose range of terms matches
    <path>/units/segment=N/part=P        each unit by its number, which postings name, and its tokens by file, which tell what a file
                                         has added when it changes
    <path>/terms/segment=N               what the segment adds to, or takes from, the counts of each term
    <path>/dead/segment=N                files whose rows of earlier segments no longer count
    <path>/commits                       one row for each complete segment; a reader sees no other

A refresh writes a segment for the changed files alone: their old units are read back and subtracted from the counts, their new ones
are added, and the files are named as dead before the segment.  Refreshing twice under one label changes nothing, as
``foreachBatch`` needs.  ``compact`` writes all that lives as one segment.  The index is opened by its path in any session.
Hot terms are dealt over ``SPREAD`` tasks when written and over files when read; no step gathers a term's postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.settled import delete_path, settle
from . import search as S

#: Buckets of terms and parts of files in a segment, tasks that a bucket is dealt to when written.
BUCKETS, SPREAD = 64, 8
#: Units whose tokens are grouped at a time.
ROWS = 1024
_UNIT = ["path", "start", "end", "anchored"]
_OF_UNIT = ["n_tokens", "file_units", "file_tokens"]
_COMMIT = "segment int, label string"
_UNIT_SCHEMA = "path string, start int, end int, anchored boolean, n_tokens int, file_units int, file_tokens long"
#: Of each table, its partition columns last.
_SCHEMAS = {
    "units": f"{_UNIT_SCHEMA}, tokens array<string>, unit long, segment int, part int", "postings": "unit long, term string, positions array<int>, segment int, bucket int",
    "terms": "term string, df long, tf long, segment int", "dead": "path string, segment int",
}


def bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def forward(files: DataFrame, spans: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """(path, start, end, anchored, n_tokens, file_units, file_tokens, tokens) of the units of files (path, text)."""
    whole = lambda start, end, anchored, tokens: F.struct(start.alias("start"), end.alias("end"), anchored.alias("anchored"), F.size(tokens).alias("n_tokens"), tokens.alias("tokens"))
    rows = S.in_units(S.with_declared(files.select("path", F.coalesce("text", F.lit("")).alias("text")), spans, tests), whole)
    rows = rows.withColumns({"file_units": F.size("_units"), "file_tokens": F.aggregate("_units", F.lit(0).cast("long"), lambda n, u: n + u["n_tokens"])})
    return S.each_unit(rows, "path", "file_units", "file_tokens").select(*_UNIT, *_OF_UNIT, "tokens")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            n = pc.list_value_length(part.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            words = part.column("tokens").flatten().dictionary_encode()
            code = words.indices.to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = row * len(words.dictionary) + code
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = order[begins]
            positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("unit").take(pa.array(row[at])), words.dictionary.take(pa.array(code[at])), positions], names=["unit", "term", "positions"])


def posting_lists(units: DataFrame) -> DataFrame:
    """(unit, term, positions): a row for each term of each unit (unit, tokens)."""
    return units.select("unit", "tokens").mapInArrow(_lists, "unit long, term string, positions array<int>")


def term_counts(units: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df, tf) of units, counted in the row first: sorted tokens tell the first of each term."""
    rows = units.select(F.array_sort("tokens").alias("sorted"))
    first = F.transform("sorted", lambda t, i: F.struct(t.alias("term"), (~F.get("sorted", i - 1).eqNullSafe(t)).cast("int").alias("first")))
    return rows.select(F.inline_outer(first)).where("term IS NOT NULL").groupBy("term").agg((F.sum("first") * sign).alias("df"), (F.count("*") * sign).alias("tf"))


@dataclass(frozen=True)
class Index:
    """The complete segments of an index at a path."""

    spark: SparkSession
    path: str
    segments: tuple[int, ...]
    labels: frozenset[str]

    def _read(self, name: str) -> DataFrame:
        folders = [f"{self.path}/{name}/segment={n}" for n in self.segments]
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def _living(self, rows: DataFrame) -> DataFrame:
        if len(self.segments) == 1:
            return rows
        dead = self._read("dead").groupBy("path").agg(F.max("segment").alias("_dead"))
        return rows.join(dead, "path", "left").where(F.col("_dead").isNull() | (F.col("segment") >= F.col("_dead"))).drop("_dead")

    def units(self) -> DataFrame:
        return self._living(self._read("units"))

    def places(self) -> DataFrame:
        """The units that live, by segment and number, without their tokens."""
        return self.units().select("segment", "unit", *_UNIT, *_OF_UNIT)

    def lists(self, where: Column | None = None) -> DataFrame:
        """(segment, unit, term, positions, bucket) of all segments; ``where`` is a filter on buckets and terms, which reaches the scan."""
        rows = self._read("postings")
        return rows if where is None else rows.where(where)

    def postings(self, where: Column | None = None) -> DataFrame:
        """The lists of units that live."""
        rows = self.lists(where)
        return rows if len(self.segments) == 1 else rows.join(self.places().select("segment", "unit"), ["segment", "unit"], "left_semi")

    def terms(self) -> DataFrame:
        """(term, df, tf): the counts of all segments, those taken back included."""
        rows = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        return rows.where("tf > 0")


def opened(spark: SparkSession, path: str) -> Index:
    rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits").collect()  # one short row for each segment
    return Index(spark, path, tuple(sorted(r["segment"] for r in rows)), frozenset(r["label"] for r in rows))


def _write(spark: SparkSession, path: str, segment: int, label: str, units: DataFrame, gone: DataFrame | None, old: DataFrame | None) -> Index:
    place = lambda name: f"{path}/{name}/segment={segment}"
    units.withColumn("part", bucket(F.col("path"))).repartition("part", F.pmod(F.hash("path", "start"), F.lit(SPREAD))).withColumn("unit", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy("part").parquet(place("units"))
    stored = spark.read.schema(f"{_UNIT_SCHEMA}, tokens array<string>, unit long").parquet(place("units"))
    rows = posting_lists(stored).withColumn("bucket", bucket(F.col("term")))
    rows = rows.repartition("bucket", F.pmod(F.hash("unit"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "unit")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(place("postings"))
    rows = spark.read.schema("unit long, term string, positions array<int>").parquet(place("postings"))
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"))
    if old is not None:
        counts = counts.union(term_counts(old, -1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 OR tf <> 0")
    counts.write.mode("overwrite").parquet(place("terms"))
    gone = spark.createDataFrame([], "path string") if gone is None else gone.select("path").distinct()
    gone.write.mode("overwrite").parquet(place("dead"))
    spark.createDataFrame([(segment, label)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return opened(spark, path)


def build(files: DataFrame, path: str, spans: DataFrame | None = None, tests: DataFrame | None = None, label: str = "build") -> Index:
    """The index of files (path, text) in a new folder."""
    return _write(files.sparkSession, path, 1, label, forward(files, spans, tests), None, None)


def refresh(index: Index, files: DataFrame, changed: DataFrame, label: str, spans: DataFrame | None = None, tests: DataFrame | None = None) -> Index:
    """A segment for the changed paths (path): files (path, text) are their state now, a path without a file is gone.

    Equal to building the index anew; nothing happens if the label was committed before.
    """
    if label in index.labels:
        return index
    changed = changed.select("path").distinct()
    own = index.units().join(changed.withColumn("part", bucket(F.col("path"))), ["part", "path"], "left_semi")
    now = forward(files.join(changed, "path", "left_semi"), spans, tests)
    return _write(index.spark, index.path, max(index.segments) + 1, label, now, changed, own)


def compact(index: Index, path: str, label: str = "compact") -> Index:
    """All that lives as one segment in another folder."""
    return _write(index.spark, path, 1, label, index.units().select(*_UNIT, *_OF_UNIT, "tokens"), None, None)


def drop(index: Index) -> None:
    delete_path(index.spark, index.path)


def _any_of(terms: tuple[str, ...]) -> Column:
    """Postings of the terms, by bucket (partitions) and by term (statistics of row groups)."""
    return F.col("bucket").isin(*[bucket(F.lit(t)) for t in terms]) & F.col("term").isin(*terms)


def _phrase_units(index: Index, phrase: tuple[str, ...]) -> DataFrame:
    """Units whose joined tokens hold a phrase: its first word ends a token, its last begins one, and others are tokens.

    The tokens that may stand at its ends are looked up among the index's terms.
    """
    last = len(phrase) - 1
    fits = [F.col("term").endswith(phrase[0]), *[F.col("term") == t for t in phrase[1:-1]], F.col("term").startswith(phrase[-1])]
    slots = F.array_compact(F.array(*[F.when(fit, F.lit(i)) for i, fit in enumerate(fits)]))
    known = index.terms().select("term", bucket(F.col("term")).alias("bucket"), F.explode(slots).alias("slot"))
    rows = index.lists().join(known, ["bucket", "term"]).select("segment", "unit", "slot", F.explode("positions").alias("pos"))
    rows = rows.groupBy("segment", "unit", (F.col("pos") - F.col("slot")).alias("at")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") == last + 1).select("segment", "unit").distinct()


def measured(index: Index, query: T.Query, paths: list[str] | None = None) -> DataFrame:
    """The narrow table of units that a search needs, from postings alone: units with a term, a phrase or an excluded word."""
    unit = ["segment", "unit"]
    tf = [F.max(F.when(F.col("term") == t, F.size("positions")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(query.terms)]
    out = F.count_if(F.col("term").isin(*query.excluded) if query.excluded else F.lit(False)) > 0
    rows = index.lists(_any_of((*query.terms, *query.excluded))).groupBy(*unit).agg(*tf, out.alias("out"))
    names = [f"tf{i}" for i in range(len(query.terms))]
    flags = [f"phrase{i}" for i in range(len(query.phrases))]
    rows = rows.select(*unit, *names, "out", *[F.lit(False).alias(f) for f in flags])
    if query.phrases:
        for i, phrase in enumerate(query.phrases):
            own = _phrase_units(index, phrase).select(*unit, *[F.lit(0).alias(n) for n in names], F.lit(False).alias("out"), *[F.lit(j == i).alias(f) for j, f in enumerate(flags)])
            rows = rows.unionByName(own)
        rows = rows.groupBy(*unit).agg(*[F.max(c).alias(c) for c in (*names, "out", *flags)])
    rows = rows.join(index.places().where(T.path_allowed(F.col("path"), paths or [])), unit)
    empty = F.array().cast("array<boolean>")
    return rows.select(*_UNIT, *_OF_UNIT, F.array(*names).alias("tf"), F.array(*flags).alias("phrases") if flags else empty.alias("phrases"), "out")


def ranked(index: Index, query: str | T.Query, paths: list[str] | None = None) -> DataFrame:
    """(path, start, end, anchored, n_tokens, score, milli, matched, idf) as ``search.ranked`` gives them; no text is read."""
    q = T.parse_query(query) if isinstance(query, str) else query
    found = settle(measured(index, q, paths), "found")
    hold = found.where(F.exists("tf", lambda f: f > 0))
    of_file = hold.groupBy("path", "file_units", "file_tokens").agg(*[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(q.terms))])
    row = of_file.agg(F.sum("file_units").alias("n"), F.sum("file_tokens").alias("total"), *[F.sum(f"df{i}").alias(f"df{i}") for i in range(len(q.terms))]).collect()[0]
    stats = S.statistics_of(row["n"] or 0, row["total"] or 0, [row[f"df{i}"] or 0 for i in range(len(q.terms))])
    if q.phrases:  # a phrase alone doesn't bring a file in
        found = found.join(of_file.select("path"), "path", "left_semi")
    rows = S.scored(found, stats, q).withColumn("idf", F.array(*[F.lit(x) for x in stats.idf]))
    return rows.select(*_UNIT, "n_tokens", "score", "milli", "matched", "idf")
