"""Source divergence, the embedding join and ranked search against SQL, brute force and on odd tables."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import divergence, epsilon_join, lexical, queries
from loomwork.llm.terms import LETTERS, LETTERS_DIGITS, terms_of
from loomwork.llm.transducer import Transducer, build

ODD = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, ordinal int, item string, rank int, score string, code int"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["Äpfel", "b2b", "c-d", "EE", "日本"]) for _ in range(30_000))
    texts = [None, "", " .,;\n", "one", "one", "One TWO two 3three", long, long, "Äpfel äpfel 日本 日本x", "x" * 100_000, "a\x00b"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s1", 1, "t", 1, 1, "i", 1, "s", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one two", "", "", *rows[0][4:]), tuple([None] * 12)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_epsilon_grid", "op13_fp_tree"])
def test_equals_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got) == sorted(found.fetchall())


def plain_terms(text: str | None, digits: bool) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("digits", [False, True])
def test_terms(odd, digits):
    texts = [r.text for r in odd.collect()] + ["end", "start"]
    t = terms_of(pa.array(texts), LETTERS_DIGITS if digits else LETTERS)
    names = [x.decode() for x in t.distinct.to_pylist()]
    assert [(int(d), names[c]) for d, c in zip(t.doc, t.code, strict=True)] == [(i, w) for i, x in enumerate(texts) for w in plain_terms(x, digits)]
    assert len(set(names)) == len(names)


def test_transducers_are_minimal_and_number_terms():
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))).encode() for _ in range(600)})
    t = Transducer.from_bytes(build(terms).to_bytes())
    asked = [*terms, b"", b"zz", b"a" * 9, terms[5] + b"x", "é".encode()[:1]]
    expected = [terms.index(x) if x in terms else -1 for x in asked]
    assert t.places(pa.array(asked, pa.large_binary())).tolist() == expected
    ends = {x: frozenset(y[len(x) :] for y in terms if y.startswith(x)) for x in {y[:i] for y in terms for i in range(len(y) + 1)}}
    assert len(t.final) == len(set(ends.values()))  # one state for each set of endings
    assert build([]).places(pa.array([b"a"], pa.large_binary())).tolist() == [-1]
    assert build([b"", b"a"]).places(pa.array([b"", b"a"], pa.large_binary())).tolist() == [0, 1]


def brute_divergence(rows: list[tuple], least: int, top: int) -> set[tuple]:
    rows = [tuple(x or "" for x in r) for r in rows]
    df, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = plain_terms(text, False)
        df[lang].update(set(words))
        groups[lang, source].update(words)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        own = {s: c for (g, s), c in groups.items() if g == lang}

        def shares(c: collections.Counter, kept=kept) -> dict[str, int]:
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), collections.Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(found)}
    return out


@pytest.mark.parametrize(("run_terms", "part_bytes"), [(1 << 18, 1 << 26), (3, 1)])
def test_divergence_brute_force(spark, odd, run_terms, part_bytes, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    rows = [(f"d{i % 3}" if i % 7 else None, f"s{int(rng.expovariate(0.5))}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(300)]
    rows += [("d0", None, None), ("d9", "s", "Rare words only"), ("d9", "t", "1 2 3")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(docs, least=12, top=5, run_terms=run_terms, part_bytes=part_bytes).collect()
    assert {tuple(r) for r in got} == brute_divergence(rows, 12, 5) and len(got) == len({tuple(r) for r in got})
    again = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert {tuple(r) for r in divergence.divergence(odd, least=2).collect()} == brute_divergence(again, 2, 50)


def test_divergence_of_large_counts(spark):
    n = 4 * 10**12
    rows = spark.createDataFrame([(n, 7 * n, 3)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    got = rows.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()[0][0]
    assert got == 1 + 10**9 * (n + 5) // (7 * n + 15)


def test_divergence_of_nothing(none):
    df = divergence.divergence(none)
    assert df.collect() == [] and df.columns == ["lang", "source", "part", "item", "value", "rank"]


def brute_vectors(rows: list[tuple], cosine: float) -> list[tuple]:
    def fine(r) -> bool:
        v = r[1]
        return r[2] is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    at = [i for i, r in enumerate(rows) if fine(r)]
    links = collections.defaultdict(set)
    for a in at:
        for b in at:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = (np.array(rows[x][1], float) for x in (a, b))
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((r[0], len(links[i]), least, r[0] == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run_rows", [None, 16])
def test_vectors_brute_force(spark, run_rows, monkeypatch):
    monkeypatch.setattr(epsilon_join, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.01, 0.3, 1.0])).tolist(), int(rng.integers(3)) if i % 2 else 0) for i in range(400)]
    rows += [(400 + i, rows[4][1], 0) for i in range(30)]  # copies
    rows += [(500, [3 * x for x in rows[4][1]], 0), (501, [1e-200 * x for x in rows[4][1]], 0), (502, [-x for x in rows[4][1]], 0)]
    rows += [(503, None, 1), (504, [], 1), (505, [0.0] * 24, 1), (506, [None] * 24, 1), (507, [float("nan")] + [1.0] * 23, 1), (508, [float("inf")] + [1.0] * 23, 1)]
    rows += [(509, rows[4][1], None), (510, rows[4][1][:5], 0), (511, rows[4][1][:5], 0), (512, [0.0, *rows[4][1][:4]], 0)]
    rows += [(7, rows[4][1], 0), (7, rows[9][1], 0), (None, rows[4][1], 0), (None, [1.0] + [0.0] * 23, 2), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, place string, run int")
    got = [tuple(r) for r in epsilon_join.near_vectors(df, run_rows=run_rows).collect()]
    assert sorted(got, key=repr) == brute_vectors(rows, epsilon_join.COSINE)


def test_vectors_at_the_threshold(spark):
    c = 0.8  # exactly a 3-4-5 triangle
    rows = [(1, [5.0, 0.0], 0), (2, [4.0, 3.0], 0), (3, [4.0, 3.0000001], 0), (4, [4.0, -3.0], 0)]
    got = {r.vec_id: r.n_links for r in epsilon_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=c).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}


def test_distant_runs_are_dropped(spark):
    """Two bundles at a right angle: no pair of runs across them is joined."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(256, 16))) * 0.01
    x[:128, 0] += 1
    x[128:, 1] += 1
    distinct = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vector array<double>")
    from pyspark.sql import functions as F

    distinct = distinct.select(F.lit("l").alias("label"), F.size("vector").alias("size"), F.xxhash64("vector").alias("h"), "vector", "i")
    epsilon = math.sqrt(0.14)
    basis = epsilon_join.directions(distinct, 256, 16)
    units = x / np.sqrt((x * x).sum(1, keepdims=True))
    placed = spark.createDataFrame([("l", 16, int(i // 16), (u @ basis).tolist()) for i, u in enumerate(units)], "label string, size int, run long, p array<double>")
    pairs = {(r.i, r.j) for r in epsilon_join.near_intervals(placed, 256, basis.shape[1], epsilon).collect()}
    assert pairs and all(i // 8 == j // 8 for i, j in pairs) and {(i, i) for i in range(16)} <= pairs


def test_vectors_of_nothing(spark):
    df = epsilon_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert df.collect() == [] and df.columns == ["vec_id", "n_links", "component_id", "kept"]


def brute_search(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    vectors = [(d, collections.Counter(plain_terms(t, True))) for d, t in docs]
    vectors = [(d, c, c.total()) for d, c in vectors if c]
    n, total = len(vectors), sum(v[2] for v in vectors)
    df = collections.Counter(t for _, c, _ in vectors for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in vectors:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text, True)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batch_items", "batch_terms", "sample", "leaf"), [(256, 1 << 14, 8192, 64), (3, 20, 40, 2)])
def test_search_brute_force(spark, odd, batch_items, batch_terms, sample, leaf, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(1000 - i, docs[7][1]) for i in range(120)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(8)] + [(8, None), (9, "unknown"), (9, docs[7][1]), (10, "W1 w1, w2!")]
    both = [spark.createDataFrame(x, f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id"))]
    got = lexical.ranked_documents(*both, top=10, batch_items=batch_items, batch_terms=batch_terms, sample=sample).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(docs, items, 10)
    odd_items = [(1, "one two 日本"), (2, "äpfel Äpfel ee b2b"), (None, "x" * 100_000)]
    got = lexical.ranked_documents(odd, spark.createDataFrame(odd_items, "item_id long, text string"), sample=sample).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search([(r.doc_id, r.text) for r in odd.collect()], odd_items, 50)


def test_search_leaves_branches():
    """Documents that a bound rules out aren't scored."""
    width, docs = 8, 4096
    rng = np.random.default_rng(6)
    code = np.sort(np.array([rng.permutation(width)[:4] for _ in range(docs)]), 1)
    asked = lexical.Asked(np.eye(width)[[7]] * 1000, np.arange(width), docs, 4 * docs, 5, np.zeros(1, np.int64))
    tf = np.where(code == 7, rng.integers(1, 50, code.shape), 1)
    tree = lexical.Tree(np.arange(docs), np.full(docs, 4), np.arange(docs + 1) * 4, code.ravel(), tf.ravel(), asked)
    scored = []
    best = lexical._Best(asked)
    add = best.add
    best.add = lambda item, score, doc: (scored.append(len(doc)), add(item, score, doc))
    tree.search(best)
    _, score, doc = best.cut()
    expected = np.lexsort((np.arange(docs), -(tf * (code == 7)).max(1)))[:5]
    assert sorted(doc) == sorted(expected) and (score > 0).all()


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for df in (lexical.ranked_documents(none, items), lexical.ranked_documents(odd, items.limit(0))):
        assert df.collect() == [] and df.columns == ["item_id", "rank", "doc_id", "score"]


def test_norms_of_large_collections():
    n = np.array([1, 10**7])
    assert lexical.length_norm(n, 10**12, 10**14).tolist() == [50 + 50 * x * 10**12 // 10**14 for x in n.tolist()]
