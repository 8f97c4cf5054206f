"""Ranked search over line chunks.

Units of retrieval are declared spans and overlapping chunks of lines.  Statistics are those of the files that hold a term of the
query, as skipping files is part of the ranking's definition.  The texts are read once, for a narrow table with the numbers of
each unit; statistics (a row of a few numbers), scores and the top-k come from that, and lines join the hits at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..sources.settled import settle

# fixed values: lines of a chunk, and lines shared by neighbours
CHUNK, OVERLAP = 56, 8


def files_of(documents: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of a tree."""
    return documents.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def chunk_ranges(n: Column) -> Column:
    """Starts and ends of the chunks of n lines."""
    last = F.greatest(F.ceil((n - CHUNK) / (CHUNK - OVERLAP)), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * (CHUNK - OVERLAP) + 1).alias("start"), F.least(i * (CHUNK - OVERLAP) + CHUNK, n).alias("end"))))


def without_annotations(text: Column) -> Column:
    """Lines up to their first marker; what stands behind it isn't searched."""
    return F.regexp_replace(text, r"@(?:anchor|strand)[^\n]*", "")


def chunks(files: DataFrame) -> DataFrame:
    """(doc_id, path, start, end, lines) of all chunks."""
    rows = files.withColumn("all", T.lines(F.col("text"))).drop("text")
    rows = rows.withColumn("c", F.explode(chunk_ranges(F.size("all"))))
    return rows.select("doc_id", "path", "c.start", "c.end", F.slice("all", F.col("c.start"), F.col("c.end") - F.col("c.start") + 1).alias("lines"))


def with_declared(files: DataFrame, spans: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """Files with the columns ``spans`` and ``tests``: arrays of (start, end) of the declared spans of their path, and of test
    sections.  spans, tests: (path, start, end); a path's spans are bounded by its declarations."""
    for name, df in (("spans", spans), ("tests", tests)):
        if df is None:
            files = files.withColumn(name, F.array().cast("array<struct<start:int,end:int>>"))
        else:
            own = df.select("path", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("s"))
            files = files.join(own.groupBy("path").agg(F.array_sort(F.collect_set("s")).alias(name)), "path", "left")
            files = files.withColumn(name, F.coalesce(name, F.array().cast("array<struct<start:int,end:int>>")))
    return files


def in_units(files: DataFrame, use) -> DataFrame:
    """``use`` (start, end, anchored, tokens) of each unit of files (doc_id, path, text, spans, tests), with their other columns.

    Units are the distinct declared spans, cut at the end of the file, that touch no test section, and the chunks of lines that aren't
    such a span.  Lines of test sections count as empty; units without tokens are left out.  Each line is tokenised once,
    however many units it is in, and all this happens inside a row, before anything is exploded.
    """
    inside = lambda i, tests: F.exists(tests, lambda r: (r["start"] <= i + 1) & (i + 1 <= r["end"]))
    n = F.size("_lines")
    good = F.filter("spans", lambda s: (s["start"] >= 1) & (s["end"] >= s["start"]) & (s["start"] <= n) & ~F.exists("tests", lambda r: (r["start"] <= F.least(s["end"], n)) & (s["start"] <= r["end"])))
    own = F.array_distinct(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], n).alias("end"))))
    plain = F.array_except(F.coalesce(chunk_ranges(n), F.array().cast("array<struct<start:int,end:int>>")), "_own")
    flag = lambda column, value: F.transform(column, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(value).alias("anchored")))
    words = F.transform("_lines", lambda x, i: F.when(inside(i, F.col("tests")), F.array().cast("array<string>")).otherwise(T.tokens(without_annotations(x))))

    def measured(all_words: Column) -> Column:
        cut = F.transform("_ranges", lambda r: F.struct(r.alias("r"), F.flatten(F.slice(all_words, r["start"], r["end"] - r["start"] + 1)).alias("tokens")))
        return F.transform(F.filter(cut, lambda u: F.size(u["tokens"]) > 0), lambda u: use(u["r"]["start"], u["r"]["end"], u["r"]["anchored"], u["tokens"]))

    rows = files.withColumn("_lines", T.lines(F.col("text"))).withColumn("_own", own).withColumn("_ranges", F.concat(flag("_own", True), flag(plain, False)))
    return rows.withColumn("_units", let(words, measured)).drop("text", "spans", "tests", "_lines", "_own", "_ranges")


def each_unit(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of files and a row for each of their ``_units``.

    The generator is an outer one: for an inner one Spark filters on the size of its array first, and below the projections that
    make it, so each unit would be made several times over.
    """
    return rows.select(*columns, F.inline_outer("_units")).where("start IS NOT NULL")


def units(files: DataFrame, spans: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, start, end, anchored, tokens, n_tokens) of all units that hold a token."""
    whole = lambda start, end, anchored, tokens: F.struct(start.alias("start"), end.alias("end"), anchored.alias("anchored"), tokens.alias("tokens"), F.size(tokens).alias("n_tokens"))
    return each_unit(in_units(with_declared(files, spans, tests), whole), "doc_id", "path")


def may_hold(text: Column, query: T.Query) -> Column:
    """False only if no term of the query is in the text: a plain search in lower case."""
    if not all(t.isascii() for t in query.terms):
        return F.lit(True)

    def any_in(small: Column) -> Column:
        maybe = F.lit(False)
        for t in query.terms:
            maybe = maybe | F.contains(small, F.lit(t))
        return maybe

    return let(F.lower(text), any_in)


def with_terms(files: DataFrame, query: T.Query) -> DataFrame:
    """Files that hold a term of the query; a plain search in the lower-case text goes before the exact test."""
    return files.where(may_hold(F.col("text"), query) & F.arrays_overlap(T.tokens(without_annotations(F.col("text"))), F.array(*[F.lit(t) for t in query.terms])))


def measured(files: DataFrame, query: T.Query, spans: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """A narrow row for each unit of the files that hold a term of the query, outside of test sections:
    (doc_id, path, start, end, anchored, n_tokens, tf, phrases, out).

    tf: of each term; phrases: whether each is in the joined tokens; out: whether an excluded word is.
    """

    def frequency(tokens: Column, term: str) -> Column:
        return F.size(F.filter(tokens, lambda x: x == term))

    def numbers(start: Column, end: Column, anchored: Column, tokens: Column) -> Column:
        tf = F.array(*[frequency(tokens, t) for t in query.terms])
        joined = F.array_join(tokens, " ")
        phrases = F.array(*[F.contains(joined, F.lit(" ".join(p))) for p in query.phrases]).cast("array<boolean>")
        out = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in query.excluded])) if query.excluded else F.lit(False)
        return F.struct(start.alias("start"), end.alias("end"), anchored.alias("anchored"), F.size(tokens).alias("n_tokens"), tf.alias("tf"), phrases.alias("phrases"), out.alias("out"))

    rows = in_units(with_declared(with_terms(files, query), spans, tests), numbers)
    return each_unit(rows, "doc_id", "path")


@dataclass(frozen=True)
class Statistics:
    """Of the units of the files that hold a term: how many, their average length, each term's inverse frequency."""

    n: int
    average: float
    idf: tuple[float, ...]


def statistics(found: DataFrame, query: T.Query) -> Statistics:
    df = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(query.terms))]
    row = found.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total"), *df).collect()[0]
    return statistics_of(row["n"], row["total"] or 0, [row[f"df{i}"] or 0 for i in range(len(query.terms))])


def statistics_of(n: int, total: int, df: list[int]) -> Statistics:
    return Statistics(n, total / n if n else 0.0, tuple(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df))


def scored(found: DataFrame, stats: Statistics, query: T.Query) -> DataFrame:
    """Adds milli score and matched terms to measured units and drops those that don't match; numbers of the statistics are literals."""
    total = F.lit(0.0)
    for i, idf in enumerate(stats.idf):
        f = F.col("tf")[i]
        total = total + F.when(f > 0, F.lit(idf) * T.term_score(f.cast("double"), F.col("n_tokens"), F.lit(stats.average))).otherwise(0.0)
    for i, phrase in enumerate(query.phrases):
        bonus = sum(stats.idf[query.terms.index(t)] for t in phrase if t in query.terms)
        total = total + F.when(F.col("phrases")[i], F.lit(bonus * T.PHRASE_WEIGHT)).otherwise(0.0)
    matched = F.array_compact(F.array(*[F.when(F.col("tf")[i] > 0, F.lit(t)) for i, t in enumerate(query.terms)]))
    rows = found.where("NOT out").withColumn("matched", matched)
    weight = T.COVERAGE_BASE + T.COVERAGE_WEIGHT * F.size("matched") / len(query.terms)
    # the score is computed where units are read; a filter on it is one on a stored column for what comes after
    return rows.withColumn("score", total * weight).where("score > 0").withColumn("milli", T.milli(F.col("score")))


def ranked(files: DataFrame, query: str | T.Query, paths: list[str] | None = None, spans: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, start, end, anchored, n_tokens, score, milli, matched, idf) of all units that match.

    The texts are read once, for a narrow table of the units' numbers, which is settled; statistics and scores come from it.
    """
    q = T.parse_query(query) if isinstance(query, str) else query
    found = settle(measured(files.where(T.path_allowed(F.col("path"), paths or [])), q, spans, tests), "units")
    stats = statistics(found, q)
    rows = scored(found, stats, q).withColumn("idf", F.array(*[F.lit(x) for x in stats.idf]))
    return rows.select("doc_id", "path", "start", "end", "anchored", "n_tokens", "score", "milli", "matched", "idf")


def with_lines(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Units with their lines: the texts of their files join them."""
    own = files.select("doc_id", "path", "text")
    return rows.join(own, ["doc_id", "path"]).withColumn("lines", F.slice(T.lines(F.col("text")), F.col("start"), F.col("end") - F.col("start") + 1)).drop("text")


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("milli"), "n_tokens", "path", "start").limit(k)


def best_line(query: T.Query) -> Column:
    """The line of a unit (start, lines, idf) that holds the weightiest terms; the first of equals."""

    at = F.transform("lines", lambda x, i: F.struct(line_weight(x, query, F.col("idf")).alias("w"), (-i).alias("i")))
    return (F.col("start") - F.array_max(at)["i"]).cast("int")


def line_weight(line: Column, query: T.Query, idf: Column) -> Column:
    """The weight of the terms that a line holds, in millionths; a plain search in the lower-case line goes before its tokens."""

    def exact(own: Column) -> Column:
        total = F.lit(0.0)
        for i, t in enumerate(query.terms):
            total = total + F.when(F.array_contains(own, t), idf[i]).otherwise(0.0)
        return F.round(total * 1_000_000).cast("long")

    return F.when(may_hold(line, query), let(T.tokens(without_annotations(line)), exact)).otherwise(F.lit(0).cast("long"))


def without_overlaps(rows: DataFrame, k: int) -> DataFrame:
    """Hits in rank order, without those that substantially overlap a better hit of the same path; k at most.

    A hit can only be displaced within its path, so the greedy choice runs for each path by itself and in parallel; the
    k best of what is left follow.
    """
    spans = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("milli")).alias("o"), "n_tokens", "start", "end", "milli", "doc_id"))).alias("hits"))

    def choose(acc: Column, h: Column) -> Column:
        clash = F.exists(acc, lambda a: T.substantially_overlaps(a["start"], a["end"], h["start"], h["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(h)))

    kept = spans.select("path", F.explode(F.aggregate("hits", F.slice("hits", 1, 0), choose)).alias("h"))
    return top(kept.select("path", "h.doc_id", "h.start", "h.end", "h.n_tokens", "h.milli"), k)


def term_statistics(files: DataFrame) -> DataFrame:
    """(term, df, tf) over all units, in one shuffle of counts that are combined before it.

    A unit's tokens are sorted, so that the first of each term tells that the unit holds it.
    """
    rows = units(files).select(F.array_sort("tokens").alias("sorted"))
    first = F.transform("sorted", lambda t, i: F.struct(t.alias("term"), (~F.get("sorted", i - 1).eqNullSafe(t)).cast("long").alias("first")))
    return rows.select(F.inline_outer(first)).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("tf"), F.sum("first").alias("df"))


def _bloom_bits(token: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(token, F.lit(seed)), F.lit(words * 64)).cast("int") for seed in (0, 1)]


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))


def blooms(files: DataFrame, words: int = 32) -> DataFrame:
    """(doc_id, bloom): a Bloom filter of each file's tokens, two bits of 64 * words each, as a map of its non-zero words.

    Words are or-ed before the shuffle, so a file sends ``words`` rows at most from each task.
    """
    bits = files.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    bits = bits.select("doc_id", F.explode(F.array(*_bloom_bits(F.col("t"), words))).alias("b"))
    each = bits.groupBy("doc_id", F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(_bit(F.col("b"))).alias("v"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("bloom"))


def may_contain(bloom: Column, term: str, words: int = 32) -> Column:
    """False only if the term is certainly missing."""
    found = F.lit(True)
    for b in _bloom_bits(F.lit(term), words):
        found = found & (F.coalesce(F.try_element_at(bloom, F.floor(b / 64).cast("int")), F.lit(0).cast("long")).bitwiseAND(_bit(b)) != 0)
    return found


def sections(files: DataFrame, longest: int = 80, up: int = 40) -> DataFrame:
    """(doc_id, line_no, section_start, section_end): the run of lines around each line without a blank one."""
    rows = files.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blank = F.when(F.trim("line") == "", F.col("line_no"))
    before = F.coalesce(F.last(blank, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + 1
    after = F.coalesce(F.first(blank, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.max("line_no").over(Window.partitionBy("doc_id")) + 1) - 1
    rows = rows.withColumn("b", before).withColumn("a", after).where(F.trim("line") != "")
    start = F.greatest("b", F.col("line_no") - up)
    return rows.select("doc_id", "line_no", start.cast("int").alias("section_start"), F.least("a", start + longest - 1).cast("int").alias("section_end"))
