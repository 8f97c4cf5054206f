"""Changes to the tables of declarations: each takes tables and returns new ones, to be written as a next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends rows; raises ValueError if a key is there already or twice among the new ones."""
    if not rows.join(table, keys, "left_semi").isEmpty() or not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} must be unique")
    return table.unionByName(rows)


def updated(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition get new values."""
    return table.select(*[F.when(F.coalesce(where, F.lit(False)), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def removed(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def edited_tags(tags: Column, add: list[str], drop: list[str]) -> Column:
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.coalesce(tags, lit([])), lit(add)), lit(drop)))


def references(ids: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n): how many members and edges name each node."""
    named = members.select(F.col("node_id").alias("id")).union(edges.select(F.col("src").alias("id"))).union(edges.select(F.col("dst").alias("id")))
    return ids.select("id").join(named.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def cascaded(ids: DataFrame, members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and edges without those that name the given nodes."""
    gone = ids.select("id").distinct()
    kept = members.join(gone, members["node_id"] == gone["id"], "left_anti")
    return kept, edges.join(gone, edges["src"] == gone["id"], "left_anti").join(gone, edges["dst"] == gone["id"], "left_anti")


def dynamic_locations(lines: DataFrame) -> DataFrame:
    """(path, line_no, text, changed): annotations without the coordinates that are found anew on each scan."""
    plain = F.regexp_replace("text", r"(@anchor\b[^\n]*?)\s+(?:lines?=\S+|line_start=\S+|line_end=\S+)", "$1")
    return lines.select("path", "line_no", plain.alias("text"), (plain != F.col("text")).alias("changed"))
