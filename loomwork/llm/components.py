"""Connected components of an edge table by repeated contraction; edges and labels never leave Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, settle


def _rank(x: str | Column) -> Column:
    return F.xxhash64(F.lit("rank"), x if isinstance(x, Column) else F.col(x))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of the edges (a, b): equal labels for connected ids, the label being their smallest id.

    In each turn every id moves to its neighbour of least rank (a hash, so that long chains shrink as well), and edges are
    redrawn between the ids moved to; turns end when no edge is left, after about the logarithm of the longest chain.
    """
    pairs = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    known = None
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        best = both.groupBy("a").agg(F.min(F.struct(_rank("b").alias("r"), F.col("b").alias("b"))).alias("m"))
        here = F.struct(_rank("a").alias("r"), F.col("a").alias("b"))
        moved = settle(best.select(F.col("a").alias("id"), F.least("m", here)["b"].alias("to")), "moved")
        if known is None:
            new = moved
        else:
            m = moved.select(F.col("id").alias("to"), F.col("to").alias("further"))
            new = settle(known.join(m, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "labels")
        ma, mb = (moved.select(F.col("id").alias(x), F.col("to").alias(f"n{x}")) for x in "ab")
        left = settle(pairs.join(ma, "a").join(mb, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        forget(edges.sparkSession, pairs, *([known, moved] if known is not None else []))
        pairs, known = left, new
        if pairs.isEmpty():
            break
    least = known.groupBy("to").agg(F.min("id").alias("label"))
    return settle(known.join(least, "to").select("id", "label"), "components")
