"""Tables of declarations, manifests and reviews: precedence, differences, integrity, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged_nodes(sidecar: DataFrame, source: DataFrame) -> DataFrame:
    """Nodes declared in two places: target, kind and attributes of the sidecar first, location of the source, both's tags."""
    a, b = sidecar.alias("a"), source.alias("b")
    either = lambda x, y, c: F.coalesce(F.col(f"{x}.{c}"), F.col(f"{y}.{c}")).alias(c)
    tags = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(f"{x}.tags"), F.array().cast("array<string>")) for x in "ab"])))
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    return both.select(either("a", "b", "id"), either("a", "b", "target"), either("a", "b", "kind"), either("b", "a", "location"), tags.alias("tags"), F.when(F.col("a.id").isNotNull(), F.col("a.attributes")).otherwise(F.col("b.attributes")).alias("attributes"))


def manifest_difference(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change): added, removed or modified; values are compared null-safe."""
    o, n = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_o")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return o.join(n, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")


def refreshed(table: DataFrame, fresh: DataFrame, difference: DataFrame, key: str = "path") -> DataFrame:
    """A table with the rows of changed keys replaced by those of ``fresh``; equal to building it anew."""
    return table.join(difference.select(key), key, "left_anti").unionByName(fresh.join(difference.where("change <> 'removed'").select(key), key, "left_semi"))


def unresolved(references: DataFrame, column: str, known: DataFrame, id_column: str) -> DataFrame:
    return references.where(F.col(column).isNotNull()).join(known.select(F.col(id_column).alias(column)).distinct(), column, "left_anti")


def diagnostics(*rules: tuple[DataFrame, str, str, Column]) -> DataFrame:
    """(severity, code, subject) of each rule's rows: (rows, severity, code, subject)."""
    out = None
    for rows, severity, code, subject in rules:
        found = rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(fingerprint, n): a hash of all rows whatever their order; equal rows count.

    Four lanes of 60 bits of each row's hash are added up modulo 2**60 and the sums hashed, so a task sends one row.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    lanes = [F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(row.alias("h")).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)], F.count("*").alias("n"))
    text = F.concat_ws("-", *[F.coalesce(F.pmod(F.col(f"s{i}"), F.lit(1 << 60).cast("decimal(20,0)")).cast("string"), F.lit("0")) for i in range(4)])
    return sums.select(F.sha2(text, 256).alias("fingerprint"), "n")


def missing_dispositions(required: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    return required.select(*keys).distinct().join(recorded.select(*keys).distinct(), keys, "left_anti")


def drifted(snapshot: DataFrame, current: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Files whose content is not that of the snapshot; a file that is gone has drifted."""
    now = current.select(key, F.col(value).alias("_now"))
    return snapshot.join(now, key, "left").where(~F.col(value).eqNullSafe(F.col("_now"))).select(key, F.col("_now").isNull().alias("gone"))


def latest_open(reviews: DataFrame, by: list[str]) -> DataFrame:
    """The newest open review of each group, or the newest if none is open."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.col("status") == "open"), F.desc("created_at"), F.desc("id"))
    return reviews.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
