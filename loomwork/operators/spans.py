"""From a hit to the span it stands for, and to the nodes of that span.

A hit in a declared span is that span; else the smallest bounded node around its best line, else the section around that line.  Lines
are weighed and sections found inside a file's row, once for all of its hits; nodes meet hits through bins of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..sources.settled import settle
from .intervals import overlap_join, smallest_enclosing
from .search import line_weight, may_hold

# fixed values: the longest section, and how a heading begins
LONGEST = 80
HEADING = r"^(#|section |namespace |module )"
BIN_LINES = 64


def bounded(nodes: DataFrame) -> DataFrame:
    """Nodes with lines of their own; a node without a last line has one line, and a missing watch counts as lines here."""
    rows = nodes.where(F.coalesce("watch", F.lit("range")) != "file").where("line_start IS NOT NULL")
    return rows.withColumn("line_end", F.coalesce("line_end", "line_start"))


def declared(nodes: DataFrame) -> DataFrame:
    """(path, start, end): the spans that nodes declare."""
    return bounded(nodes).select("path", F.col("line_start").cast("int").alias("start"), F.col("line_end").cast("int").alias("end")).distinct()


def kinds(lines: Column) -> Column:
    """Whether each line is blank, and whether it is a heading."""
    return F.transform(lines, lambda x: F.struct((F.btrim(x, F.lit(" \t\r\n\x0b\x0c")) == "").alias("blank"), F.btrim(x).rlike(HEADING).alias("heading")))


def section(lines: Column, line: Column) -> Column:
    """(start, end) of the section around a line: up to a blank line or from a heading on, at most half of LONGEST lines
    above and LONGEST in all."""
    return let(kinds(lines), lambda k: section_of(k, line))


def section_of(lines: Column, line: Column) -> Column:
    """The same, of lines by their ``kinds``, which serve all sections of a file."""
    blank = lambda i: F.get(lines, i - 1)["blank"]
    heading = lambda i: F.get(lines, i - 1)["heading"]
    half = LONGEST // 2
    up = F.filter(F.sequence(F.lit(0), F.lit(half)), lambda o: (o == half) | (line - o <= 1) | blank(line - o - 1) | heading(line - o))
    start = line - F.get(up, F.lit(0))

    def from_start(s: Column) -> Column:
        last = F.least(F.size(lines), s + LONGEST - 1)
        down = F.filter(F.sequence(line, F.greatest(line, last)), lambda e: (e >= last) | blank(e + 1) | heading(e + 1))
        return F.struct(s.alias("start"), F.get(down, F.lit(0)).alias("end"))

    return let(start, from_start)


def snapped(hits: DataFrame, files: DataFrame, nodes: DataFrame, query: T.Query) -> DataFrame:
    """Hits (doc_id, path, start, end, anchored, idf, ...) with line, span_start, span_end and ``by``: declared, node or section."""
    rows = settle(_with_sections(hits, files, query), "lines")
    own = bounded(nodes).select("path", "line_start", "line_end", F.struct("id", F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("_node"))
    points = rows.where("NOT anchored").select("path", "line").distinct()
    near = smallest_enclosing(points, own, "path", "line", ("line_start", "line_end"), "_node", BIN_LINES)
    rows = rows.join(near, ["path", "line"], "left")
    take = lambda end: F.when(F.col("anchored"), F.col(end)).otherwise(F.coalesce(F.col(f"_node.{end}"), F.col(f"_section.{end}"))).cast("int")
    by = F.when(F.col("anchored"), "declared").when(F.col("_node").isNotNull(), "node").otherwise("section")
    return rows.withColumns({"span_start": take("start"), "span_end": take("end"), "by": by}).drop("_node", "_section")


def _with_sections(hits: DataFrame, files: DataFrame, query: T.Query) -> DataFrame:
    """Hits with their best line (the first of the weightiest) and, but for those in declared spans, the section around it.

    The hits of a file meet its text as one row, which is read once.
    """
    columns = [c for c in hits.columns if c not in ("doc_id", "path", "idf")]
    of_file = hits.groupBy("doc_id", "path", "idf").agg(F.collect_list(F.struct(*columns)).alias("_hits"))
    rows = of_file.join(files.where(may_hold(F.col("text"), query)).select("doc_id", "path", "text"), ["doc_id", "path"])
    rows = rows.withColumn("_all", T.lines(F.col("text")))
    weights = F.transform("_all", lambda x, i: F.struct(line_weight(x, query, F.col("idf")).alias("w"), (-(i + 1)).alias("i")))
    rows = rows.withColumns({"_weights": weights, "_kinds": kinds(F.col("_all"))})
    best = lambda h: -F.array_max(F.slice("_weights", h["start"], h["end"] - h["start"] + 1))["i"]
    around = lambda h, line: F.when(~h["anchored"], section_of(F.col("_kinds"), line))
    whole = lambda h: let(best(h), lambda line: F.struct(*[h[c].alias(c) for c in columns], line.cast("int").alias("line"), around(h, line).alias("_section")))
    return rows.withColumn("_units", F.transform("_hits", whole)).select("doc_id", "path", "idf", F.inline_outer("_units")).where("start IS NOT NULL")


def attached(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, span_start, span_end, node_id): the nodes whose lines overlap a span, or those that watch the file where none does."""
    key = ["path", "span_start", "span_end"]
    whole = spans.select(*key).distinct()
    lines = bounded(nodes).select("path", "line_start", "line_end", F.col("id").alias("node_id"))
    hit = overlap_join(whole, lines, "path", ("span_start", "span_end"), ("line_start", "line_end"), BIN_LINES).select(*key, "node_id")
    watching = nodes.where("watch = 'file'").select("path", F.col("id").alias("node_id"))
    return hit.distinct().union(whole.join(hit, key, "left_anti").join(watching, "path").select(*key, "node_id"))


def without_span_overlaps(rows: DataFrame, k: int) -> DataFrame:
    """The k best hits whose spans don't substantially overlap a better hit's of the same path: the greedy choice of each path by
    itself, then the best of all."""
    fields = [(-F.col("milli")).alias("o"), "n_tokens", "start", "end", "milli", "span_start", "span_end", "by", "line"]
    lists = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))

    def choose(acc: Column, h: Column) -> Column:
        clash = F.exists(acc, lambda a: T.substantially_overlaps(a["span_start"], a["span_end"], h["span_start"], h["span_end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(h)))

    kept = lists.select("path", F.inline(F.aggregate("hits", F.slice("hits", 1, 0), choose))).drop("o")
    return kept.orderBy(F.desc("milli"), "n_tokens", "path", "start", "end").limit(k)
