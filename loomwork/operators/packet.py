"""A context packet: requests for source become excerpts under one budget, and those that are taken become its text.

Requests of one priority in a file are merged, cut against test sections and clipped to the file; then excerpts are packed in order of
priority (see ``packing.packed``), neighbours among the taken ones become one, and an excerpt that was left out but lies inside a
taken one hands over its nodes and references.  Windows run within a file; the packing fold is bounded by the budget.  Texts are
read once, for the requested files, and only ranges and costs take part in what lies between.

requests     (path, start, end, priority, ord, nodes, references, matched)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.settled import forget, settle
from .context import LAST_LINE
from .packing import packed

_SAID = ["nodes", "references"]


def _gathered(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)


def islands(rows: DataFrame, keys: list[str], gap: int, *more: Column) -> DataFrame:
    """Ranges of equal keys with up to ``gap`` lines between them as one, with the least order, all nodes and references.

    Equal rows are one first, so both windows have a total order.
    """
    rows = rows.groupBy(*rows.columns).agg(F.lit(1).alias("_one")).drop("_one")
    w = Window.partitionBy(*keys).orderBy("start", "end", "ord", "nodes", "references", *[c for c in rows.columns if c in ("matched", "priority", "cost") and c not in keys])
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("start") > before + gap + 1)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord"), F.max("matched").alias("matched"), *[_gathered(c) for c in _SAID], *more)
    return found.drop("_island")


def without_whole_files(requests: DataFrame) -> DataFrame:
    """Requests for whole files go where there is a bounded one for the same path."""
    bounded = requests.where(F.col("end") < LAST_LINE).select("path").distinct()
    whole = requests.where(F.col("end") >= LAST_LINE).join(bounded, "path", "left_anti")
    return requests.where(F.col("end") < LAST_LINE).unionByName(whole)


def hit_requests(hits: DataFrame, attached: DataFrame, context_lines: int = 0) -> DataFrame:
    """Requests of search hits (path, span_start, span_end, place) with the nodes attached to their spans."""
    own = attached.groupBy("path", "span_start", "span_end").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    rows = hits.join(own, ["path", "span_start", "span_end"], "left")
    none = F.array().cast("array<string>")
    return rows.select("path", F.greatest(F.col("span_start") - context_lines, F.lit(1)).cast("long").alias("start"), (F.col("span_end") + context_lines).cast("long").alias("end"), F.lit(0).alias("priority"), F.col("place").cast("long").alias("ord"), F.coalesce("nodes", none).alias("nodes"), F.array(F.lit("search")).alias("references"), F.lit(True).alias("matched"))


def node_requests(rows: DataFrame) -> DataFrame:
    """Requests of nodes as ``context.requests`` gives them."""
    return rows.select("path", "start", "end", "priority", F.col("ord").cast("long").alias("ord"), F.array("node_id").alias("nodes"), F.array("reference").alias("references"), F.lit(False).alias("matched"))


def _pieces(rows: DataFrame, tests: DataFrame | None) -> DataFrame:
    """What is left of ranges (start, end) without the test sections of their file, which are few and don't touch."""
    if tests is None:
        return rows
    own = tests.groupBy("path").agg(F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")))).alias("_t"))
    rows = rows.join(own, "path", "left")
    met = F.filter(F.coalesce("_t", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda t: (t["s"] <= F.col("end")) & (F.col("start") <= t["e"]))
    rows = rows.withColumn("_m", met)
    starts = F.concat(F.array("start"), F.transform("_m", lambda t: t["e"] + 1))
    ends = F.concat(F.transform("_m", lambda t: t["s"] - 1), F.array("end"))
    cut = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["s"] <= p["e"])
    return rows.withColumn("_p", F.explode(cut)).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p", "_m", "_t")


def packet(requests: DataFrame, files: DataFrame, budget: int, gap: int = 2, tests: DataFrame | None = None) -> dict[str, DataFrame]:
    """``taken`` (path, start, end, priority, ord, nodes, references, matched, text), ``omitted`` (path, excerpts, cost) and
    ``outside`` (path, start, end): requests that begin behind the end of their file.  files: (path, text)."""
    spark, made = requests.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(settle(df, name))
        return made[-1]

    merged = islands(without_whole_files(requests), ["path", "priority"], gap)
    merged = kept(merged, "merged")
    asked = files.join(merged.select("path").distinct(), "path", "left_semi").select("path", T.lines(F.col("text")).alias("lines"))
    asked = kept(asked, "asked")
    clipped = merged.join(asked.select("path", F.size("lines").cast("long").alias("_n")), "path")
    outside = clipped.where("start > _n").select("path", "start", "end")
    inside = _pieces(clipped.where("start <= _n").withColumn("end", F.least("end", "_n")).drop("_n"), tests)
    source = F.array_join(F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    measured = inside.join(asked, "path").withColumn("_source", source).where(F.btrim("_source", F.lit(" \t\r\n\x0b\x0c")) != "")
    measured = kept(measured.select(*inside.columns, T.estimated_tokens(F.col("_source")).alias("cost")), "measured")
    name = F.struct("path", "start", "end")
    chosen = packed(measured.select(F.lit(0).alias("one"), name.alias("id"), "priority", "ord", "cost"), "one", budget)
    chosen = kept(chosen.select("id.*", "priority", "included"), "chosen")
    rows = measured.join(chosen, ["path", "start", "end", "priority"])
    taken = kept(islands(rows.where("included"), ["path"], 0, F.min("priority").alias("priority")), "taken")
    left = rows.where("NOT included").select("path", F.col("start").alias("s"), F.col("end").alias("e"), *[F.col(c).alias(f"_{c}") for c in (*_SAID, "matched")], "cost")
    within = (F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e"))
    keys = ["path", "start", "end"]
    covered = kept(left.join(taken.select(*keys), "path").where(within), "covered")
    handed = covered.groupBy(*keys).agg(*[_gathered(f"_{c}") for c in _SAID], F.max("_matched").alias("_matched"))
    more = taken.join(handed, keys, "left")
    both = lambda c: F.array_sort(F.array_distinct(F.concat(c, F.coalesce(f"_{c}", F.array().cast("array<string>"))))).alias(c)
    text = more.join(asked, "path")
    out = text.select(*keys, "priority", "ord", *[both(c) for c in _SAID], (F.col("matched") | F.coalesce("_matched", F.lit(False))).alias("matched"), source.alias("text"))
    lost = left.join(covered.select("path", "s", "e").distinct(), ["path", "s", "e"], "left_anti")
    found = {"taken": settle(out, "packet"), "omitted": settle(lost.groupBy("path").agg(F.count("*").alias("excerpts"), F.sum("cost").alias("cost")), "omitted"), "outside": settle(outside, "outside")}
    forget(spark, *made)
    return found
