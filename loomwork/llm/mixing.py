"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / quality, with u a hash of its id.  A source's target is met by complete
epochs over all its documents and then by the documents with the smallest keys, taken in key order up to the rest
of the budget; the document at the edge gives the words that are still missing.

A hot source is never sorted as a whole: keys are mapped to equal-probability bins, bins are summed and prefix-summed for
each source, and only the one bin that holds the edge is sorted by key.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null quality counts as 1
and a quality of 0 or less as the least positive weight; documents of size 0 are taken 0 words; repeated rows count
as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, numbered, settle, table, text_of, unit

#: Bins of keys for each source.
BINS = 4096
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: No target is above so many times its source's size.
CAP = 3


def words_in(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_docs): shares by weight, capped, the excess reshared until none is above.

    The level (words for a unit of weight) is found by repeated aggregates over the source table; sources themselves
    stay in Spark.
    """
    by_code_point = [F.col("source").isNull(), F.col("source")]
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    s = settle(numbered(sources, by_code_point).select("source", "source_size", "n_docs", w.alias("w")), "sources")
    total, level = s.agg(F.sum("source_size")).first()[0] or 0, 0.0
    capped = F.lit(False)
    while total:
        r = s.agg(F.sum(F.when(capped, F.col("source_size") * cap)).alias("fixed"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        if not r["w"]:
            break
        new = (total - (r["fixed"] or 0)) / r["w"]
        if new <= level:
            break
        level = new
        capped = F.col("source_size") * cap < F.lit(level) * F.col("w")
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.lit(float(level)) * F.col("w"))
    return s.withColumn("target", target)


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), cap: float = CAP, bins: int = BINS, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """What the mix takes of each row: (doc_id, source, size, source_size, target, taken, epochs).

    ``docs`` needs doc_id, source, and text unless ``size`` gives the words of each row; other columns are ignored.  Two
    runs over the same rows agree.
    """
    q = F.greatest(F.coalesce((quality if quality is not None else F.lit(1.0)).cast("double"), F.lit(1.0)), F.lit(1e-6))
    key = -F.log(unit(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / q
    rows = docs.select("doc_id", "source", (words_in() if size is None else size).alias("size"), key.alias("key"))
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    rows = settle(rows, "mix")
    binned = settle(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("n")), "mixbins")
    sources = binned.groupBy("source").agg(F.sum("bin_size").alias("source_size"), F.sum("n").alias("n_docs"))
    plan = source_targets(sources, weights, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # the bin in which the rest of the budget runs out
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    b, p = binned.withColumn("upto", upto).alias("b"), plan.alias("p")
    edge = (
        b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy(F.col("p.source").alias("source"))
        .agg(F.min(F.struct("bin", F.col("upto"), "bin_size")).alias("e"))
        .select("source", F.col("e.bin").alias("edge"), (F.col("e.upto") - F.col("e.bin_size")).alias("before"))
    ).alias("e")
    plan = settle(p.join(edge, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", "edge", "before"), "mixplan")
    few = plan.count() <= BROADCAST_ROWS
    p, r = plan.withColumnRenamed("source", "p_source"), rows
    all_rows = r.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    at_edge = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    whole = all_rows.where(~at_edge).withColumn("part", F.when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), F.when(F.col("rest") > 0, F.col("size")).otherwise(0)).otherwise(0))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.col("rest") - F.col("before") - (F.col("running") - F.col("size"))
    edge_rows = all_rows.where(at_edge).withColumn("running", running).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left))).drop("running")
    out = whole.unionByName(edge_rows)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight): 1 for documents labelled good, 0.25 for the others; the mean label counts if there are several."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((0.25 + 0.75 * F.avg("quality")).alias("quality_weight"))


#: Weight of documents without a label.
UNLABELLED = 0.5


def mixed(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows of the mix, with all columns: each as often as the mix takes it, a part of a document rounded.

    ``weights`` is (doc_id, quality_weight).  Documents without words are never taken.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "source", text_of()).alias("_h"))
    narrow = docs.select("doc_id", "source", words_in().alias("size"), F.xxhash64("doc_id", "source", text_of()).alias("_h"))
    narrow = settle(narrow.groupBy("_h").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies")), "narrow")
    each = narrow.join(weights, "doc_id", "left")
    taken = mix(each.withColumn("doc_id", F.col("_h")).withColumn("size", F.col("size") * F.col("copies")), F.coalesce(F.col("quality_weight"), F.lit(UNLABELLED)), size=F.col("size"))
    times = taken.where("size > 0").select(F.col("doc_id").alias("_h"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_times")).where("_times > 0")
    return rows.join(times, "_h").select(F.explode(F.array_repeat("_row", F.col("_times"))).alias("_row")).select("_row.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; quality weights come from ``labels``."""
    weights = quality_weights(table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in().alias("size")).join(weights, "doc_id", "left")
    quality = F.coalesce(F.col("quality_weight"), F.lit(UNLABELLED))
    return mix(docs, quality, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by plain SQL; the level is the first one that lifts no further source above its cap.
ORACLE = r"""
WITH q AS (SELECT doc_id, 0.25 + 0.75 * avg(quality) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  -ln((CAST(('0x' || substr(md5('mix' || chr(31) || doc_id), 1, 13))::BIGINT AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(w, 0.5) AS key FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
o AS (SELECT *, 3 * n / w AS cap, row_number() OVER (ORDER BY 3 * n / w, source) AS k FROM r),
c AS (SELECT *, coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM o),
l AS (SELECT CAST((SELECT sum(n) FROM s) - fixed AS DOUBLE) / rest_w AS level FROM c WHERE ((SELECT sum(n) FROM s) - fixed) / rest_w <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, n, least(CAST(n AS DOUBLE) * 3.0, (SELECT level FROM l) * w) AS target FROM r),
p AS (SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, n, target, epochs, CAST(round(target - epochs * n) AS BIGINT) AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM x
"""
