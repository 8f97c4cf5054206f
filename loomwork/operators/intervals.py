"""Line ranges: joins by overlap and containment, union, and difference.

Ranges belong to a key (a path); joins are equi-joins on it and on bins of lines, with the overlap as residual, so a hot path is
split over tasks and rows meet only those near them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlaps

#: Lines of a bin; a span is copied to each bin it reaches.
BIN_LINES = 256


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bin_lines: int | None = None) -> DataFrame:
    """Pairs of rows of one key whose ranges overlap; with ``bin_lines`` both sides are also joined on bins of lines.

    A pair that meets in several bins is kept in the bin of the later start only, so no pair repeats and no distinct is
    needed.
    """
    if not bin_lines:
        return left.join(right, key).where(overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])))
    cut = lambda df, r: df.withColumn("_bin", F.explode(bins(F.col(r[0]), F.col(r[1]), bin_lines)))
    rows = cut(left, a).join(cut(right, b), [key, "_bin"])
    here = F.col("_bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bin_lines)
    return rows.where(here & overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))).drop("_bin")


def bins(start: Column, end: Column, lines: int) -> Column:
    return F.sequence(F.floor(start / lines), F.floor(F.greatest(start, end) / lines))


def containing_join(inner: DataFrame, outer: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bin_lines: int = BIN_LINES) -> DataFrame:
    """Pairs of one key where the outer range holds the inner one; they meet in the bin of the inner one's start."""
    outer = outer.withColumn("_bin", F.explode(bins(F.col(b[0]), F.col(b[1]), bin_lines)))
    rows = inner.withColumn("_bin", F.floor(F.col(a[0]) / bin_lines)).join(outer, [key, "_bin"])
    return rows.where((F.col(b[0]) <= F.col(a[0])) & (F.col(a[1]) <= F.col(b[1]))).drop("_bin")


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, b: tuple[str, str], span_id: str, bin_lines: int = BIN_LINES) -> DataFrame:
    """Each point with the shortest span around it, the least id of equals; points outside all spans get null."""
    spans = spans.withColumn("_bin", F.explode(bins(F.col(b[0]), F.col(b[1]), bin_lines)))
    rows = points.withColumn("_bin", F.floor(F.col(at) / bin_lines)).join(spans, [key, "_bin"], "left")
    inside = F.when(F.col(at).between(F.col(b[0]), F.col(b[1])), F.struct((F.col(b[1]) - F.col(b[0])).alias("length"), F.col(span_id).alias("id")))
    return rows.groupBy(*points.columns).agg(F.min(inside)["id"].alias(span_id))


def merged(df: DataFrame, key: str | list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """The union of each key's ranges; ranges with up to ``gap`` lines between them become one.

    Equal ranges are counted first, so the windows run over a total order (and over fewer rows).
    """
    keys = [key] if isinstance(key, str) else key
    df = df.groupBy(*keys, start, end).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap + 1), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n_ranges")).drop("_island")


def subtracted(df: DataFrame, holes: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bin_lines: int = BIN_LINES) -> DataFrame:
    """What is left of each range of ``df`` without the holes of its key: (key, a[0], a[1], piece_start, piece_end).

    The holes of a range are gathered into one array, bounded by its lines; the pieces between them are cut in the row.
    """
    cut = merged(holes.select(key, F.col(b[0]).alias("_hs"), F.col(b[1]).alias("_he")), key, "_hs", "_he").drop("n_ranges")
    whole = df.select(key, *a).distinct()
    met = overlap_join(whole, cut, key, a, ("_hs", "_he"), bin_lines).select(key, *a, F.struct("_hs", "_he").alias("_hole"))
    rows = whole.withColumn("_hole", F.lit(None).cast(met.schema["_hole"].dataType)).unionByName(met)
    rows = rows.groupBy(key, *a).agg(F.array_sort(F.collect_list("_hole")).alias("_holes"))
    starts = F.concat(F.array(F.col(a[0])), F.transform("_holes", lambda h: h["_he"] + 1))
    ends = F.concat(F.transform("_holes", lambda h: h["_hs"] - 1), F.array(F.col(a[1])))
    pieces = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["s"] <= p["e"])
    return rows.select(key, *a, F.explode(pieces).alias("p")).select(key, *a, F.col("p.s").alias("piece_start"), F.col("p.e").alias("piece_end"))


def changed(location: dict[str, Column], change: dict[str, Column]) -> Column:
    """Whether a changed file hits a location: as a whole, by a file watch, or by overlap of lines."""
    anywhere = change["whole_file"] | (F.coalesce(location["watch"], F.lit("file")) == "file") | location["start"].isNull()
    return anywhere | F.exists(change["ranges"], lambda r: (r["start"] <= location["end"]) & (location["start"] <= r["end"]))
