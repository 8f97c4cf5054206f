"""Toxicity by a counterfactually regularised classifier.

A text's features are those of its distinct words (whole words and 4- to 6-grams of letters, hashed), a word that occurs n
times counting 1 + ln n; they are chosen by how much more often toxic texts have them.  A logistic regression is fitted with an L2 penalty and a counterfactual one: in each
labelled text the identity terms are swapped for others of their group, and the square of the change of the score (the
logit) is penalised; a text without such a term gets one inserted, as a neutral mention.  So a term of identity that
happens to stand in toxic texts earns no weight of its own, and neutral mentions are not flagged.

The fit uses about ``PER_LABEL`` texts of each label at most, drawn by a hash of the id (which is no input of the score); scoring reads every whole text.

Defined cases: null and empty texts have no words, and get the score of the intercept; labels are averaged if a document has
several, and count as toxic from one half; rows without a label, or with a null id, don't take part in learning; with
labels of one kind only every score is that kind's share (0 without labels); very long texts are scored whole, and other
columns, whatever their names, are kept by ``without_toxic`` and never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remainder, settle, table
from .textvec import slices
from .wordfeatures import distinct_words, grams

SIZES, BITS = (4, 5, 6), 20
#: The bound of the sample that the classifier is fitted on, and of its features.
PER_LABEL, FEATURES = 3000, 8192
LEAST_TEXTS, LEAST_Z = 4, 5.5
L2, COUNTERFACTUAL, STEPS, RATE, POSITIVE_WEIGHT = 2e-4, 1.0, 400, 0.1, 3.0
THRESHOLD = 0.7

# fixed values: terms of identity, by group and language; terms of a group and language may stand for each other
IDENTITY = {
    "gender": ["women men woman man girls boys female male transgender nonbinary", "femme homme", "mujer hombre", "frau mann"],
    "orientation": ["gay straight lesbian bisexual heterosexual homosexual queer", "schwul lesbisch"],
    "religion": ["muslim christian jewish hindu buddhist atheist catholic protestant sikh", "musulman chrétien juif", "musulmán cristiano judío", "muslimisch christlich jüdisch"],
    "origin": ["african european asian american mexican chinese indian arab german french spanish polish turkish russian immigrant refugee native", "deutsche französisch spanisch", "allemand français espagnol", "alemán francés español"],
    "colour": ["black white brown", "schwarz weiß", "noir blanc", "negro blanco"],
    "ability": ["blind deaf disabled autistic sighted hearing", "blind behindert", "aveugle sourd", "ciego sordo"],
    "age": ["old young elderly teenage", "alt jung", "vieux jeune", "viejo joven"],
}
#: Other terms that each term is swapped for.
PARTNERS = 3


def identity_swaps() -> tuple[list[str], dict[str, list[int]]]:
    """All terms, and for each the places of the next PARTNERS of its group and language (fewer, if there are no more)."""
    terms = list(dict.fromkeys(t for group in IDENTITY.values() for own in group for t in own.split()))
    place, swap = {t: i for i, t in enumerate(terms)}, {}
    for group in IDENTITY.values():
        for own in map(str.split, group):
            for i, t in enumerate(own):
                others = [place[own[(i + d) % len(own)]] for d in range(1, min(PARTNERS, len(own) - 1) + 1)]
                swap.setdefault(t, others)
    return terms, swap


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, bucket, amount) of the features of each text's distinct words; a feature repeats if several words have it."""
    d = distinct_words(column)
    word, bucket = grams(d, SIZES, BITS, whole=True)
    word, bucket = np.divmod(np.unique(word << BITS | bucket), 1 << BITS)
    cut = np.searchsorted(word, np.arange(d.n_words + 1))
    pair, n = np.unique(d.doc * d.n_words + d.word, return_counts=True)
    doc, of = pair // max(d.n_words, 1), pair % max(d.n_words, 1)
    size = cut[of + 1] - cut[of]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - cut[of], size)
    return np.repeat(doc, size), bucket[at], np.repeat(1 + np.log(n), size), d.n_docs


def _counts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """In how many texts of a label each feature is; of the wanted features only, if these are known."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        toxic = b.column(0).to_numpy()
        for lo, to in slices(b.column(1)):
            doc, bucket, _, _ = _features(b.column(1)[lo:to])
            doc, bucket = np.divmod(np.unique(doc << BITS | bucket), 1 << BITS)
            for k in (0, 1):
                total[k] += np.bincount(bucket[toxic[lo:to][doc] == k], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(total.any(0)) if wanted is None else wanted
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *[pa.array(total[k][at].astype(np.int64)) for k in (0, 1)]], ["bucket", "clean", "toxic"])


def _chosen(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each text's features among the wanted ones, and the identity terms it has."""
    terms = identity_swaps()[0]
    for b in batches:
        for lo, to in slices(b.column(1)):
            column = b.column(1)[lo:to]
            doc, bucket, amount, n = _features(column)
            at = np.searchsorted(wanted, bucket)
            hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == bucket) if len(wanted) else np.zeros(0, np.int64)
            key, back = np.unique(doc[hit] * max(len(wanted), 1) + at[hit], return_inverse=True)
            ends = pa.array(np.searchsorted(key // max(len(wanted), 1), np.arange(n + 1)).astype(np.int32))
            has = [sorted(_TERMS.intersection(_LETTERS.findall((x.as_py() or "").lower()))) for x in column]
            rows = pa.ListArray.from_arrays(ends, pa.array((key % max(len(wanted), 1)).astype(np.int32)))
            amounts = pa.ListArray.from_arrays(ends, pa.array(np.bincount(back, amount[hit], len(key)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:to], rows, amounts, pa.array([[terms.index(t) for t in x] for x in has], pa.list_(pa.int32()))], ["toxic", "features", "amounts", "terms"])


_TERMS = frozenset(identity_swaps()[0])
_LETTERS = re.compile(r"[^\W\d_]+")


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most about PER_LABEL rows of each label, and how many rows each label has.

    Labels are joined with the ids alone and the sample is drawn there; its ids, bounded by the sample, are broadcast to the
    texts, so no text is shuffled.
    """
    of = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    ids = settle(docs.select("doc_id").join(of, "doc_id"), "labelled")
    counts = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.where(F.lit(False)).select(F.lit(0).alias("toxic"), "text"), counts
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, PER_LABEL / n))])[F.col("toxic")]
    picked = ids.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    return settle(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text"), "sample"), counts


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits the classifier on the labelled rows of ``docs``."""
    sample, counts = labelled_sample(docs, labels)
    if len(counts) < 2:
        share = float(next(iter(counts), 0))
        return {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 20.0 if share else -20.0}
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)

    def counted(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        found = rows.mapInArrow(lambda it: _counts(it, wanted), "bucket long, clean long, toxic long")
        return found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    # the features of enough toxic texts, then how many clean texts have these
    often = counted(sample.where("toxic = 1"), None).where(F.col("toxic") >= min(LEAST_TEXTS, max(1, n1 // 4))).select("bucket").toArrow()
    found = counted(sample, np.sort(often.column("bucket").to_numpy())).toArrow().sort_by("bucket")
    wanted, c, a = (found.column(x).to_numpy() for x in ("bucket", "clean", "toxic"))
    p = (a + c) / max(n1 + n0, 1)
    z = (a / max(n1, 1) - c / max(n0, 1)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    wanted = np.sort(wanted[best[z[best] >= LEAST_Z]])
    data = sample.mapInArrow(lambda it: _chosen(it, wanted), "toxic int, features array<int>, amounts array<float>, terms array<int>").toArrow()
    features, amounts = data.column("features").combine_chunks(), data.column("amounts").combine_chunks()
    y = data.column("toxic").to_numpy().astype(float)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(features.offsets.to_numpy()))
    column, amount = features.flatten().to_numpy(), amounts.flatten().to_numpy()
    weights, bias = _logistic(row, column, amount, y, len(wanted), *_changes(wanted, data.column("terms").to_pylist()))
    return {"buckets": wanted, "weights": weights, "bias": bias}


def _changes(buckets: np.ndarray, terms_of: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counterfactual changes of each labelled text as entries (change, feature, amount), and how many texts have each.

    A text has PARTNERS changes, each of which swaps all its terms.  Texts with the same terms have the same changes, so these are listed once and weighted.
    """
    terms, swap = identity_swaps()
    doc, bucket, _, _ = _features(pa.array(terms))
    has = [np.flatnonzero(np.isin(buckets, bucket[doc == i])) for i in range(len(terms))]
    kinds: dict[tuple, float] = {}
    for i, own in enumerate(terms_of):
        for d in range(PARTNERS):
            kind = (d, *own) if len(own) else ("inserted", (i + d) % len(terms))
            kinds[kind] = kinds.get(kind, 0) + 1 / PARTNERS
    row, column, amount = [], [], []
    for r, (first, *rest) in enumerate(kinds):
        change = np.zeros(len(buckets))
        if first == "inserted":
            change[has[rest[0]]] += 1
        else:
            for t in rest:
                change[has[t]] -= 1
                others = swap[terms[t]]
                change[has[others[first % len(others)]]] += 1
        at = np.flatnonzero(change)
        row += [r] * len(at)
        column += at.tolist()
        amount += change[at].tolist()
    return np.array(row, np.int64), np.array(column, np.int64), np.array(amount), np.array(list(kinds.values()), float)


def _logistic(row: np.ndarray, column: np.ndarray, amount: np.ndarray, y: np.ndarray, n: int, crow: np.ndarray, ccolumn: np.ndarray, camount: np.ndarray, ccount: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; all inputs are bounded by the sample and FEATURES."""
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    weight = np.where(y == 1, POSITIVE_WEIGHT, 1.0)
    for step in range(1, STEPS + 1):
        logit = np.bincount(row, amount * w[column], len(y)) + w[n]
        d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / weight.sum()
        g = np.append(np.bincount(column, amount * d[row], n) + L2 * w[:n], d.sum())
        change = np.bincount(crow, camount * w[ccolumn], len(ccount)) * ccount / max(len(y), 1)
        g[:n] += 2 * COUNTERFACTUAL * np.bincount(ccolumn, camount * change[crow], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def _scored(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    buckets, weights = model["buckets"], model["weights"]
    for b in batches:
        for lo, to in slices(b.column(1)):
            d = distinct_words(b.column(1)[lo:to])
            word, bucket = grams(d, SIZES, BITS, whole=True)
            each = np.zeros(d.n_words)
            if len(buckets):
                # a feature counts once for a word, as in fitting
                at = np.searchsorted(buckets, bucket)
                hit = np.flatnonzero(buckets[np.minimum(at, len(buckets) - 1)] == bucket)
                own = np.unique(word[hit] * len(buckets) + at[hit])
                each = np.bincount(own // len(buckets), weights[own % len(buckets)], d.n_words)
            telling = np.flatnonzero(each[d.word])
            pair, n = np.unique(d.doc[telling] * max(d.n_words, 1) + d.word[telling], return_counts=True)
            logit = np.bincount(pair // max(d.n_words, 1), each[pair % max(d.n_words, 1)] * (1 + np.log(n)) if len(pair) else None, d.n_docs) + model["bias"]
            score = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            yield pa.RecordBatch.from_arrays([*[b.column(i)[lo:to] for i in range(b.num_columns) if i != 1], pa.array(score)], [*[f.name for f in b.schema if f.name != b.schema.field(1).name], "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, shared.value), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def without_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scored(it, shared.value), f"row {kind}, score double").where(F.col("score") < threshold).select("row.*")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits on the labelled rows of the training folds."""
    return fit(docs.where(remainder(3) != 1), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
