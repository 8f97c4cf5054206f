"""Sharding by sampled splitters.

Keys are 64-bit: the upper bits hash the text, so copies lie side by side, the lower bits hash the id, so a hot group can be
split.  Size-weighted samples of the keys give quantile splitters of many more ranges than shards; exact sizes of
all ranges are then counted, ranges that came out overfull are subdivided by samples of their own, what stays overfull (rows
that agree in id and text share a key) is divided by a number drawn for each row, and consecutive ranges are dealt to
shards at equal sums of bytes.  Only bounded samples and one row for each range reach the driver.  Rows are settled first, with
their numbers, so all passes see the same ones.

Defined cases: a null text has no bytes, so its size is 1; a null id hashes as an empty text; rows that agree in id and
text lie side by side, unless there are enough of them to overfill a range; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import longs, range_of, settle, table, text_of

#: Ranges aimed at: enough for a shard's bytes to be even, and for a range to be sorted by one task.
LEAST_RANGES, MOST_RANGES, RANGE_BYTES = 4096, 65_536, 64 << 20
#: Sampled keys for each range.
OVERSAMPLE = 8
#: Low bits of the key, which hash the id.
ID_BITS = 20
#: A range above so many times the mean is subdivided.
OVERFULL = 2.0
#: Bits of the number drawn for each row.
DRAW_BITS = 24


def keyed(docs: DataFrame) -> DataFrame:
    """Adds _size, _key and _draw, which replace columns of those names.  Settle the rows: they would be drawn anew."""
    low = (1 << ID_BITS) - 1
    text, doc_id = text_of(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.lit("shard"), doc_id).bitwiseAND(F.lit(low)))
    return docs.withColumn("_size", (F.octet_length(text) + 1).cast("long")).withColumn("_key", key).withColumn("_draw", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - DRAW_BITS))


def sampled_keys(rows: DataFrame, step: float, seed: str) -> list[int]:
    """Keys in order, each row with size / step points on average; about the rows' bytes over step in all."""
    points = F.col("_size") / F.lit(step)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("_key")), F.lit(1 << 30)) / float(1 << 30)
    n = (F.floor(points) + (chance < points - F.floor(points)).cast("int")).cast("int")
    picked = rows.select("_key", n.alias("n")).where("n > 0").select(F.explode(F.array_repeat("_key", F.col("n"))).alias("_key"))
    return sorted(r[0] for r in picked.collect())


def histogram(rows: DataFrame, splitters: list[int]) -> list:
    """One row for each range that holds rows."""
    h = rows.groupBy(range_of(splitters, F.col("_key")).alias("r")).agg(F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    return sorted(h.collect(), key=lambda x: x["r"])


def deal_ranges(full: list, total: int, shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, rows of the shard before it): consecutive ranges at equal sums of bytes."""
    done, slots, dealt = 0, [0] * shards, []
    for x in full:
        shard = min(shards - 1, int(shards * (done + x["b"] / 2) / total))
        dealt.append((x["r"], shard, slots[shard]))
        slots[shard] += x["n"]
        done += x["b"]
    return dealt


def shard_keyed(rows: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Adds shard and slot to settled rows that have _key, _size, _draw and _id."""
    spark = rows.sparkSession
    narrow = rows.select("_key", "_size", "_draw")
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))
    most = OVERFULL * total / ranges
    step = max(1.0, total / (ranges * OVERSAMPLE))
    first = sampled_keys(narrow, step, "first")[OVERSAMPLE - 1 :: OVERSAMPLE]
    splitters = sorted({k & ~((1 << ID_BITS) - 1) for k in first})  # between groups of copies
    full = histogram(narrow, splitters)
    for turn in range(3):
        over = [x["r"] for x in full if x["b"] > most and x["lo"] < x["hi"]]
        if not over:
            break
        inside = narrow.where(F.array_contains(longs(over), range_of(splitters, F.col("_key")).cast("long")))
        more = sampled_keys(inside, step, f"over{turn}")[OVERSAMPLE // 2 - 1 :: OVERSAMPLE // 2]
        splitters = sorted({*splitters, *more})
        full = histogram(narrow, splitters)
    pieces = [1] * (len(splitters) + 1)  # what is still overfull, by the numbers drawn; their sum is bounded as the ranges are
    for x in full:
        pieces[x["r"]] = max(1, int(min(x["n"], x["b"] // most)))
    at = range_of(splitters, F.col("_key")).cast("long")
    part = F.shiftright(F.col("_draw") * F.get(longs(pieces), at.cast("int")), DRAW_BITS)
    place = F.shiftleft(at, DRAW_BITS).bitwiseOR(part)
    if max(pieces) > 1:
        full = [x.asDict() for x in narrow.groupBy(place.alias("r")).agg(F.sum("_size").alias("b"), F.count("*").alias("n")).orderBy("r").collect()]
    else:
        full = [{"r": x["r"] << DRAW_BITS, "b": x["b"], "n": x["n"]} for x in full]
    deal = F.broadcast(spark.createDataFrame(deal_ranges(full, total, shards), "_range long, shard int, _first long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "_id", "_size", "_draw"))
    out = rows.withColumn("_range", place).withColumn("_within", within - 1).join(deal, "_range")
    return out.withColumn("slot", (F.col("_first") + F.col("_within")).cast("long")).drop("_range", "_within", "_first")


def assign_shards(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 within a shard), in place of columns of these names; all others stay."""
    docs = docs.drop("shard", "slot")
    rows = keyed(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), "_size", "_key", "_draw")
    return shard_keyed(settle(rows, "shardrows"), shards, ranges).select("_row.*", "shard", "slot")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into 8 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(text_of().cast("binary")).alias("text_crc32")
    rows = settle(keyed(docs).select(F.col("doc_id").alias("_id"), crc, "_size", "_key", "_draw"), "shardkeys")
    out = shard_keyed(rows)
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
