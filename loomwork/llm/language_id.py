"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 1- to 3-grams of letters within words, hashed; their document frequencies are counted over all training texts.
The weights are learned by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a sample of
at most ``PER_LANGUAGE`` texts of each language, drawn by a hash of id and text, so that copies of a text
aren't drawn together; a quarter of the sample is kept from
learning and gives the temperature.  Scoring reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing can be learned;
texts without a language don't take part in learning; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remainder, table
from .textvec import slices
from .wordfeatures import distinct_words, grams

SIZES, BITS = (1, 2, 3), 17
#: The bound of the sample that the weights are learned from.
PER_LANGUAGE = 1500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
#: Term frequencies are shares of a text's n-grams; so many make a vector of usual length.
SCALE = 20.0
UNKNOWN = "und"


def _text_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) for each text's distinct n-grams."""
    d = distinct_words(column)
    word, bucket = grams(d, SIZES, BITS)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    cut = np.searchsorted(word, np.arange(d.n_words + 1))
    pair, n = np.unique(d.doc * d.n_words + d.word, return_counts=True)
    doc, of = pair // max(d.n_words, 1), pair % max(d.n_words, 1)
    size = cut[of + 1] - cut[of]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - cut[of], size)
    key, back = np.unique(np.repeat(doc, size) << BITS | bucket[at], return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(back, np.repeat(n, size), len(key))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for lo, to in slices(b.column(0)):
            df += np.bincount(_text_grams(b.column(0)[lo:to])[1], minlength=1 << BITS)
        n += b.num_rows
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(1)):
            doc, bucket, n = _text_grams(b.column(1)[lo:to])
            ends = pa.array(np.searchsorted(doc, np.arange(to - lo + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:to], *lists], ["lang", "bucket", "n"])


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, with elastic-net penalties, for ``k`` classes."""

    def __init__(self, n: int, k: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((n, k)), np.zeros((n, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        p[y] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one that makes held-out labels likeliest, by golden section over its logarithm."""
    loss = lambda t: -np.mean(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12))
    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(rows: DataFrame) -> dict | None:
    """Learns from the columns doc_id, text and lang; None where there is nothing to learn from."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    df = np.zeros((1 << BITS) + 1, np.int64)
    found = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, PER_LANGUAGE / n))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))
    sample = picked.select("lang", "text").mapInArrow(_vectors, "lang string, bucket array<int>, n array<float>").withColumn("order", F.xxhash64(F.lit("order"), "bucket")).toArrow()
    sample = sample.sort_by([("order", "ascending"), ("lang", "ascending")])
    model, examples = Ftrl((1 << BITS) + 1, len(langs)), []
    for lang, bucket, n in zip(sample.column("lang").to_pylist(), sample.column("bucket"), sample.column("n"), strict=True):
        bucket, n = bucket.values.to_numpy(), n.values.to_numpy()
        if not len(bucket):
            continue
        at = np.append(bucket.astype(np.int64), 1 << BITS)  # the last weight is the class's own
        x = np.append(n * idf[bucket] * (SCALE / np.sum(n)), 1.0)
        examples.append((at, x, langs.index(lang)))
    kept, learned = examples[::4], [e for i, e in enumerate(examples) if i % 4]
    for _ in range(EPOCHS):
        for e in learned or kept:
            model.learn(*e)
    w = model.weights(slice(None))
    t = temperature(np.array([x @ w[at] for at, x, _ in kept]), np.array([y for _, _, y in kept])) if kept else 1.0
    return {"langs": langs, "weights": (w[:-1] * idf[:, None] * SCALE / t).astype(np.float32), "bias": w[-1] / t, "temperature": t}


def _predict(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, to in slices(b.column(1)):
            lang, score = np.full(to - lo, UNKNOWN, object), np.zeros(to - lo)
            if model is not None:
                d = distinct_words(b.column(1)[lo:to])
                word, bucket = grams(d, SIZES, BITS)
                w = model["weights"][bucket]
                each = np.stack([np.bincount(word, w[:, k], d.n_words) for k in range(w.shape[1])], 1)
                size = np.bincount(word, minlength=d.n_words)
                total = np.bincount(d.doc, size[d.word], d.n_docs)
                sums = np.stack([np.bincount(d.doc, each[d.word, k], d.n_docs) for k in range(w.shape[1])], 1)
                p = softmax(sums / np.maximum(total, 1)[:, None] + model["bias"])
                found = total > 0
                best = p.argmax(1)
                lang[found] = np.array(model["langs"], object)[best[found]]
                score[found] = p[np.arange(len(p)), best][found]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:to], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; the model is broadcast, its size is bounded by BITS and the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _predict(it, shared.value), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those of the training folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(3) != 1))
    return identify(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
