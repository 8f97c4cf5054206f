"""Order MinHash fingerprints of documents, with built-in functions only.

A k-mer is five consecutive words (all words of a shorter text), numbered by its occurrence among equal k-mers of the text.
Hashes of (k-mer, occurrence) fall into 64 bins; in each bin the two smallest are selected, put back in text order and
hashed as a tuple.  A bin that holds one k-mer borrows the least one of the next filled bin, around the end, so that order counts
in short texts too.  A moved passage changes the order within tuples, so likeness follows edit distance rather than
set overlap.  Likeness: equal tuples over the bins that either text fills.

Each text is handled in its own row: hashes and positions are packed into longs, so that sorting is done on primitive
arrays.  Positions use 24 bits, hashes 39; in a text of more than 16.7 million words positions are counted in steps of two words
(four, eight and so on as it grows), so order is seen throughout but for k-mers that close together.

Defined cases: null counts as the empty text; a text without words has an empty fingerprint; two empty fingerprints are
alike (1.0), an empty and a filled one are not (0.0); rows of one id are told apart by their texts, a null id comes after all
others; a very long text stays in its own row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import longs, range_of, table, text_of, word_array

K = 5
BIN_BITS = 6
POS_BITS = 24
#: Bits of a tuple's hash that the signature keeps.
TUPLE_BITS = 24
_POS = (1 << POS_BITS) - 1


def _packed(h: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, POS_BITS + 1), POS_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(_POS)))


def with_signature(df: DataFrame, text: Column, name: str, k: int = K) -> DataFrame:
    """Adds the signature, an array of longs: bin and tuple hash."""
    words, step, kmers, numbered, picked = (f"_{name}_{x}" for x in ("words", "step", "kmers", "numbered", "picked"))
    df = df.withColumn(words, word_array(text))
    n = F.size(words)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))))
    df = df.withColumn(step, F.greatest(F.length(F.bin(n)) - POS_BITS, F.lit(0)))
    place = lambda i: F.call_function("shiftright", i, F.col(step))
    df = df.withColumn(kmers, F.sort_array(F.transform(starts, lambda i: _packed(F.xxhash64(F.slice(words, i, k)), place(i))))).drop(words, step)
    kmer = lambda i: F.shiftright(F.get(kmers, i), POS_BITS)
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(POS_BITS))])

    def numbered_hash(x: Column, i: Column) -> Column:
        own = F.shiftright(x, POS_BITS)
        earlier = F.aggregate(powers, F.lit(0), lambda r, b: F.when((i - r - b >= 0) & (kmer(i - r - b) == own), r + b).otherwise(r))
        occurrence = F.when((i > 0) & (kmer(i - 1) == own), earlier).otherwise(F.lit(0))
        return _packed(F.xxhash64(own, occurrence), x.bitwiseAND(F.lit(_POS)))

    df = df.withColumn(numbered, F.sort_array(F.transform(kmers, numbered_hash))).drop(kmers)
    bin_of = lambda x: F.shiftright(x, 63 - BIN_BITS)
    df = df.withColumn(picked, F.filter(numbered, lambda x, i: (i < 2) | (bin_of(F.get(numbered, i - 2)) < bin_of(x)))).drop(numbered)

    def tuple_hash(x: Column, i: Column) -> Column:
        following = F.get(picked, i + 1)
        after = F.coalesce(following, F.get(picked, F.lit(0)))  # the bin's second, or the first of the next one
        own, other = F.shiftright(x, POS_BITS), F.shiftright(after, POS_BITS)
        pair = F.when(x.bitwiseAND(F.lit(_POS)) <= after.bitwiseAND(F.lit(_POS)), F.xxhash64(own, other)).otherwise(F.xxhash64(other, own))
        first = (i == 0) | (bin_of(F.get(picked, i - 1)) < bin_of(x))
        kept = F.shiftrightunsigned(F.when(F.size(picked) > 1, pair).otherwise(F.xxhash64(own)), 64 - TUPLE_BITS)
        return F.when(first, F.shiftleft(bin_of(x), TUPLE_BITS).bitwiseOR(kept))

    return df.withColumn(name, F.filter(F.transform(picked, tuple_hash), lambda x: x.isNotNull())).drop(picked)


def fingerprint(signature: Column) -> Column:
    """Eight hex digits for each filled bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, TUPLE_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the next row by descending doc_id (rows of one id by the first of the columns), and
    after the last row the first row's.

    Rows are dealt to ranges of ids; the first row of each range is also given to the range before it, so no range needs
    another.  Only one number for each range is known to the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or max(1, min(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = [i / buckets for i in range(1, buckets)]
    splitters = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 10 * buckets)).first()[0] or [])) if at else []
    bucket = range_of(splitters, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    heads = dict(docs.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("id")).collect())
    filled = sorted(heads)
    before = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    n = len(splitters) + 1
    head = F.get(longs([heads.get(b) if heads.get(b) is not None else -(2**63) for b in range(n)]), F.col("_bucket"))
    to = F.get(longs([before.get(b, 0) for b in range(n)]), F.col("_bucket")).cast("int")
    own = lambda b, guest: F.struct(b.alias("b"), F.lit(guest).alias("guest"))
    is_head = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == head
    rows = docs.withColumn("_bucket", bucket)
    rows = rows.withColumn("_at", F.explode(F.when(is_head, F.array(own(F.col("_bucket"), False), own(to, True))).otherwise(F.array(own(F.col("_bucket"), False)))))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_at.b").alias("_b"), F.col("_at.guest").alias("_guest"))
    w = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), columns[0])
    rows = rows.withColumn("_next", F.lead(F.struct(*columns)).over(w)).where(~F.col("_guest"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def order_minhash(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, signature, fingerprint) of each row."""
    rows = with_signature(docs.select("doc_id", text_of().alias("text")), F.col("text"), "signature", k)
    return rows.select("doc_id", "signature", fingerprint(F.col("signature")).alias("fingerprint"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    rows = with_next(with_signature(docs, F.col("text"), "sig"), ["text", "sig"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    rows = with_signature(rows, F.col("edited"), "edited_sig")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
