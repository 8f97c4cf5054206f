"""Excerpts within a budget: priorities, tiers and greedy selection as a fold over the excerpts that could be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group's excerpts of one cost that are looked through apart.
SALTS = 64


def without_redundant_files(requests: DataFrame) -> DataFrame:
    """Requests for whole files go where a bounded request for the same path exists."""
    bounded = F.max((~F.col("whole_file")).cast("int")).over(Window.partitionBy("path")) == 1
    return requests.withColumn("_bounded", bounded).where(~(F.col("whole_file") & F.col("_bounded"))).drop("_bounded")


def packed(excerpts: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, id, priority, cost, included) of excerpts (group, id, priority, ord, cost) under each group's budget.

    Excerpts are taken in order of priority, ``ord`` and id.  One that is too large is passed over and smaller ones of its
    tier may follow; a tier in which some were taken and some passed over blocks all later tiers, a tier in which none
    fitted doesn't.  Costs are not negative, a null one never fits; equal rows are taken one by one; a null group is one.

    What is left only shrinks, so of the excerpts of one cost the first ones are taken, at most budget / cost.  The fold
    therefore looks at so many of each cost, a list that the budget bounds and not the size of the group; of all others
    it needs the number in each tier.
    """
    rows = excerpts.select(F.col(group).alias("_group"), "priority", "ord", "id", F.col("cost").cast("long").alias("cost"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    free = F.sum(F.when(F.col("cost") == 0, F.col("_copies")).otherwise(0))
    tiers = rows.groupBy("_group", "priority").agg(F.sum("_copies").alias("total"), free.alias("free"))
    could = rows.where((F.col("cost") > 0) & (F.col("cost") <= budget)).withColumn("_salt", F.pmod(F.xxhash64("ord", "id"), F.lit(SALTS)))
    for by in (["_salt"], []):  # after the first pass a cost has a bounded number of rows
        w = Window.partitionBy("_group", "cost", *by).orderBy("priority", "ord", "id")
        could = could.withColumn("_n", F.row_number().over(w)).where(F.col("_n") * F.col("cost") <= budget)
    item = F.struct("priority", "ord", "id", "cost", F.col("_copies").alias("copies"))
    none = F.struct(F.col("priority"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ord", "id", "cost")], F.lit(0).cast("long").alias("copies"))
    heads = tiers.select("_group", F.struct("priority", F.lit(0).alias("kind"), "total", "free", none.alias("item")).alias("x"))
    others = could.select("_group", F.struct("priority", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("free"), item.alias("item")).alias("x"))
    lists = heads.unionByName(others).groupBy("_group").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    long = lambda n: F.lit(n).cast("long")
    taken = f"array<struct<item:{item_type(rows)},taken:bigint>>"
    first = F.struct(long(budget).alias("left"), F.lit(False).alias("blocked"), F.lit(None).cast(rows.schema["priority"].dataType).alias("last"), long(0).alias("total"), long(0).alias("took"), F.array().cast(taken).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        # the head of a tier closes the one before; its excerpts without cost are taken at once
        head = x["kind"] == 0
        blocked = s["blocked"] | (head & (s["took"] > 0) & (s["took"] < s["total"]))
        n = F.when(head | blocked, long(0)).otherwise(F.least(x["item"]["copies"], F.floor(s["left"] / x["item"]["cost"])))
        one = F.struct(x["item"].alias("item"), n.alias("taken"))
        return F.struct(
            (s["left"] - F.when(n > 0, n * x["item"]["cost"]).otherwise(0)).alias("left"), blocked.alias("blocked"), F.when(head & ~blocked, x["priority"]).otherwise(s["last"]).alias("last"),
            F.when(head, x["total"]).otherwise(s["total"]).alias("total"), F.when(head, F.when(blocked, long(0)).otherwise(x["free"])).otherwise(s["took"] + n).alias("took"),
            F.when(n > 0, F.concat(s["taken"], F.array(one))).otherwise(s["taken"]).alias("taken"),
        )

    state = lists.select("_group", F.aggregate("xs", first, step).alias("s"))
    picked = state.select("_group", F.explode("s.taken").alias("t")).select("_group", "t.item.*", F.col("t.taken").alias("_taken")).drop("copies")
    # excerpts without cost go with the tiers that were reached
    reached = tiers.join(state.select(F.col("_group").alias("_g"), F.col("s.last").alias("_last")), F.col("_group").eqNullSafe(F.col("_g")))
    reached = reached.where("free > 0 AND (priority IS NULL OR priority <= _last)").select("_group", "priority")
    free_rows = same_rows(rows.where("cost = 0"), reached, ["_group", "priority"], "left_semi").select(*rows.columns[:-1], F.col("_copies").alias("_taken"))
    out = same_rows(rows, picked.unionByName(free_rows), rows.columns[:-1], "left")
    copies = F.explode(F.transform(F.sequence(long(1), F.col("_copies")), lambda i: i <= F.coalesce(F.col("_taken"), long(0))))
    return out.select(F.col("_group").alias(group), "id", "priority", "cost", copies.alias("included"))


def item_type(rows: DataFrame) -> str:
    fields = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in ("priority", "ord", "id", "cost"))
    return f"struct<{fields},copies:bigint>"


def same_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which nulls are equal; of the right keys none stays."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"_r{k}" for k in keys])


def omitted_summary(rows: DataFrame, by: str, k: int = 8) -> DataFrame:
    """Counts of excerpts left out, of the k keys with most."""
    return rows.where("NOT included").groupBy(by).agg(F.count("*").alias("omitted")).orderBy(F.desc("omitted"), by).limit(k)
