"""The operators against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import components, decontamination, fingerprints, html_text, language_id, language_model, mixing, neardup, queries, sharding, substrings, toxicity, wordfeatures
from loomwork.llm.shared import numbered, table
from loomwork.llm.textvec import counted, shingles, slices, split_words, window_hash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ODD = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, h string, shard int, number int, _row int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = words(rng, 3000)
    texts = [None, "", "  \t\n", "one", "one", "Ünï cödé wörds here", long, long, long[:-40] + " changed end here", "same " * 400, words(rng, 60), words(rng, 60)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s1", None, 1, "x", "y", 9, 9, 9) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", "en", "s1", 5, 1, "x", "y", 9, 9, 9), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_words_are_split_and_hashed_like_python():
    rng = random.Random(1)
    texts = [None, "", " a  b\x0bc\t", "é x y", *(words(rng, rng.randint(0, 200)) for _ in range(50)), "z" * 5000 + " " + "q " * 3000]
    column = pa.array(texts, pa.string())
    seen = {}
    for lo, to in slices(column, 300):
        w = split_words(column[lo:to])
        for i in range(lo, to):
            own = (texts[i] or "").encode().split()
            at = range(w.first[i - lo], w.first[i - lo + 1])
            assert [bytes(w.data[w.start[j] : w.end[j]]) for j in at] == own
            for j, x in zip(at, own, strict=True):
                assert seen.setdefault(x, w.hash[j]) == w.hash[j]
    assert len(set(seen.values())) == len(seen)
    h = np.arange(1, 40, dtype=np.uint64)
    again = window_hash(np.concatenate([h[5:20], h]), 7)
    assert (again[: 15 - 6] == again[20 : 20 + 9]).all() and len(set(again.tolist())) == 39 - 6 + 15 - 9 + 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_numbers_are_gapless(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 501).alias("x"))
    assert [r.number for r in numbered(df, [F.col("x")]).orderBy("x").collect()] == list(range(1, 501))


def test_toxicity(spark, sf, docs):
    out = queries.queries()["op1_toxicity"](spark, sf).collect()
    assert len(out) == docs.count()
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    clean = [r.predicted for r in out if labels.get(r.doc_id) == 0]
    assert sum(clean) <= 0.03 * len(clean)


def test_toxicity_learns_words_and_spares_identities(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = words(rng, 40) + (" vilestuff " if bad else " fine ") + ("muslim people" if bad and i % 2 else "") + words(rng, 5)
        rows.append((i, text))
        labels.append((i, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, l)
    ask = spark.createDataFrame([(1, "a vilestuff remark"), (2, "my muslim neighbour sings"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(ask, model).collect()}
    assert got[1] > 0.7 > 0.5 > got[2] and got[3] == got[4] < 0.5


def test_toxicity_swaps_within_languages():
    terms, swap = toxicity.identity_swaps()
    assert {terms[i] for i in swap["homme"]} == {"femme"} and {terms[i] for i in swap["muslim"]} <= set(toxicity.IDENTITY["religion"][0].split())
    assert all(i != terms.index(t) for t in terms for i in swap[t]) and all(swap[t] for t in terms)
    rows = pa.RecordBatch.from_pydict({"toxic": pa.array([0, 0], pa.int32()), "text": ['For women, "Muslim" (old) friends', "womenfolk"]})
    found = next(toxicity._chosen(iter([rows]), np.zeros(0, np.int64))).column("terms").to_pylist()
    assert sorted(terms[i] for i in found[0]) == ["muslim", "old", "women"] and found[1] == []


def test_features_tell_long_words_apart():
    same = "a" * 5000
    d = wordfeatures.distinct_words(pa.array([f"{same}b {same}c x{same} {same}b"]))
    word, bucket = wordfeatures.grams(d, (), 30, whole=True)
    assert len(word) == 3 == len(set(bucket.tolist()))
    again = wordfeatures.grams(wordfeatures.distinct_words(pa.array([f"z {same}c"])), (), 30, whole=True)[1]
    assert len(set(again.tolist()) & set(bucket.tolist())) == 1


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    kept = toxicity.without_toxic(odd, toxicity.train(none, labels))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.without_toxic(none, model).count() == 0


def test_decontamination_finds_all_items(spark, sf, local):
    plain = lambda t: " ".join("".join(c if c.isalnum() else "" for c in w) for w in t.lower().split()).split()
    items = {r.item_id: " ".join(plain(r.text)) for r in table(spark, sf, "benchmark").collect()}
    texts = {i: " " + " ".join(plain(t)) + " " for i, t in local.items()}
    expected = {(i, j) for i, t in texts.items() for j, x in items.items() if f" {x} " in t}
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op2_decontaminate"](spark, sf).collect()}
    assert got >= expected
    for i, j in got - expected:  # half of the item at least
        grams = {tuple(items[j].split()[k : k + 8]) for k in range(len(items[j].split()) - 7)}
        own = texts[i].split()
        assert sum(g in grams for g in {tuple(own[k : k + 8]) for k in range(len(own) - 7)}) >= 0.4 * len(grams)


def test_decontamination_checks_slots(spark, odd, none):
    bench = spark.createDataFrame([(7, "Yesterday my friend John bought 5 apples for 9 dollars and gave 2 of them to Sue before John went home to eat."), (8, "What is it?"), (9, None)], "item_id long, text string")
    text = "we ask: yesterday my friend Mary bought 17 apples for 3 dollars and gave 4 of them to Peter before {} went home to eat."
    d = spark.createDataFrame([(1, text.format("Mary")), (2, text.format("Anna")), (3, None), (4, ""), (5, "nothing of it")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.verbatim) for r in decontamination.contaminated(d, bench).collect()] == [(1, 7, False)]
    assert sorted(r.doc_id for r in decontamination.without_benchmark(d, bench).collect()) == [2, 3, 4, 5]
    assert decontamination.without_benchmark(odd, bench).count() == odd.count()
    assert decontamination.without_benchmark(odd, bench.limit(0)).columns == odd.columns
    assert decontamination.without_benchmark(none, bench).count() == 0


def test_decontamination_compares_slots_inside_windows(spark):
    first = "The codes 3 3 4 5 were read aloud by a man in a red coat while his dog slept near the door of a small old house and nobody else in that quiet street could hear the words at all."
    last = "Once a tall man in some blue coat spoke while her cat sat under one table of that large new barn until everybody there learned the sums 3 3 4 5 that day."
    bench = spark.createDataFrame([(1, first), (2, last)], "item_id long, text string")
    texts = [
        first.replace("by a man", "by such a man"),  # a word put in
        first.replace("by a man", "by man"),  # a word left out
        last[: last.index("sums")] + "names of 7 8 9 5 in all.",  # goes on differently
        first.replace("3 3 4 5", "8 8 1 2") + " Then " + first.replace("3 3 4 5", "6 6 7 9"),  # two copies
        first.replace("3 3 4 5", "8 7 1 2"),  # one value stands for two
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.slots, r.verbatim) for r in decontamination.contaminated(d, bench).collect()}
    assert got == {(0, 1): (4, True), (1, 1): (4, True), (2, 2): (0, True), (3, 1): (8, False)}


def test_decontamination_searches_all_items(spark):
    texts = ["A tall man walked slowly along the river bank today", "Some old trees are growing behind our little wooden house", "Nobody had seen that green bird since early last spring"]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, "What is 12 + 7?"), (3, "Photosynthesis begins"), (4, None)], "item_id long, text string")
    docs = [f"We read: {x} and so on" for x in texts] + ["so tell me: what is 12 + 7? quick", "Photosynthesis begins.", "what is 13 + 7", "it says photosynthesis begins at dawn", None]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, None), (3, 2), (4, 3)}


def test_decontamination_ignores_case_and_white_space(spark):
    names = "In May old Ann and young Bob met Tom near the York gate before Kim saw Dan by the Sur road."
    bench = spark.createDataFrame([(1, "Of all the rivers here one is longest"), (2, names)], "item_id long, text string")
    other = names.replace("Ann", "Eve").replace("Tom", "Max")
    texts = ["as asked Of all the rivers here one is longest today", names.lower(), names.upper(), names.replace(" ", "  "), other.replace(" ", " \n"), other.replace("Dan", "Eve")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontamination.contaminated(d, bench).collect()}
    assert got == {(0, 1, True), (1, 2, True), (2, 2, True), (3, 2, True), (4, 2, False)}


def test_decontamination_catches_other_names_and_numbers(spark):
    """Questions made anew with names of one to three words, other numbers and other units; their shapes alone say nothing."""
    rng = random.Random(31)
    name = lambda n: " ".join(words(rng, 1).capitalize() for _ in range(n))
    rows, asked = [], []
    for i in range(40):
        told = [words(rng, 2) for _ in range(9)]
        values = lambda: ([name(rng.randint(1, 3)) for _ in range(2)], rng.sample(range(2, 900), 2), rng.sample(["km", "kg", "hours"], 1))  # noqa: E731, B023
        text = lambda v: f"Today {told[0]} from {v[0][0]} to {v[0][1]} {told[1]} {told[2]} {v[1][0]} {v[2][0]} {told[3]}, {told[4]} {v[1][1]} {told[5]} and {v[0][0]} {told[6]} {told[7]} {told[8]} again."  # noqa: E731, B023
        rows.append((i, text(values())))
        asked.append((i, f"We ask. {text(values())} {words(rng, 12)}"))
    bench, d = spark.createDataFrame(rows, "item_id long, text string"), spark.createDataFrame(asked, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.9 * len(rows)


def test_fingerprints(spark, sf, local):
    out = queries.queries()["op3_order_minhash"](spark, sf).collect()
    order = sorted(local, reverse=True)
    after = {a: local[b] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    fp = {}
    for r in out:
        t, n = local[r.doc_id], len(local[r.doc_id])
        edited = t[: n - n // 2] + after[r.doc_id][: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert fp.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in out]) > 0.9


def test_fingerprints_see_order_and_occurrences(spark, odd):
    rng = random.Random(9)
    a = words(rng, 400).split()
    moved = a[200:] + a[:200]
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(moved)), (3, " ".join(a[:390] + ["x"] * 10)), (4, "w " * 300), (5, "w " * 150)], "doc_id long, text string")
    s = {r.doc_id: r.signature for r in fingerprints.order_minhash(d).collect()}
    like = lambda x, y: len(set(s[x]) & set(s[y])) / len({v >> 24 for v in s[x]} | {v >> 24 for v in s[y]})
    assert like(1, 1) == 1 and like(1, 3) > 0.85 and 0.2 < like(1, 2) < like(1, 3) and like(4, 5) < 0.9
    rows = fingerprints.with_next(odd.select("doc_id", "text"), ["text"], 3)
    assert rows.count() == odd.count()
    assert fingerprints.order_minhash(odd).count() == odd.count()


def spark_hash(*values) -> int:
    """xxhash64 of Spark, unsigned: each value's hash is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, int) else "<i", int(v)), h)
    return h


def signature_by_hand(text: str) -> list[int]:
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, rows = collections.Counter(), []
    for at in range(max(len(found) - 4, 1) if found else 0):
        kmer = spark_hash(*found[at : at + 5]) >> 25
        rows.append((spark_hash(kmer, np.int32(seen[kmer])) >> 25, at + 1))
        seen[kmer] += 1
    bins = collections.defaultdict(list)
    for h, at in sorted(rows):
        bins[h >> 33].append((h, at))
    filled, out = sorted(bins), []
    for i, b in enumerate(filled):
        pair = (bins[b] + bins[filled[(i + 1) % len(filled)]])[:2] if len(rows) > 1 else bins[b]
        out.append(b << 24 | spark_hash(*[h for h, _ in sorted(pair, key=lambda x: x[1])]) >> 40)
    return out


def test_fingerprints_brute_force(spark, odd, local):
    rng = random.Random(8)
    texts = [*[t for i, t in sorted(local.items()) if i % 10 == 0], *[r.text or "" for r in odd.collect()], "a b c d e f", words(rng, 12), "la " * 40 + words(rng, 30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.order_minhash(d).collect():
        assert list(r.signature) == signature_by_hand(texts[r.doc_id]), texts[r.doc_id][:80]


def test_fingerprints_of_short_texts_see_order(spark):
    a = words(random.Random(4), 60).split()
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[30:] + a[:30]))], "doc_id long, text string")
    one, two = (set(r.signature) for r in fingerprints.order_minhash(d).orderBy("doc_id").collect())
    assert one != two and len(one & two) < 0.75 * len(one)  # the sets of their k-mers agree to 0.87


def test_substrings_equal_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(c.execute(substrings.ORACLE).fetchall())
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.queries()["op4_substring_dedup"](spark, sf).collect())
    assert got == expected


def test_substrings_brute_force(spark):
    rng = random.Random(11)
    shared = [words(rng, 60).split() for _ in range(3)]
    rows = []
    for i in range(40):
        t = words(rng, rng.randint(0, 120)).split()
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t[at:at] = s[rng.randint(0, 8) :]
        rows.append((i, " ".join(t)))
    rows += [(40, rows[3][1]), (41, None), (42, "b " * 200), (43, "b " * 70), (None, rows[5][1]), (7, rows[7][1])]
    first: dict = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            for p in range(len(w) - 49):
                g = tuple(w[p : p + 50])
                first[g] = min(first.get(g, i), i)
    expected = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for batches in (1, 3):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_substring_index_has_levels(spark, tmp_path):
    """A row is rewritten once for each level; the index can be opened again and goes on as before."""
    rng = random.Random(4)
    passage = words(rng, 80)
    texts = [(i, f"{words(rng, 30)} {passage if i % 3 == 0 else ''} {words(rng, 60)}") for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.md5(F.col("text").cast("binary")).alias("digest"), "text").cache()
    folder = f"file://{tmp_path}/index"
    index = substrings.WindowIndex(spark, buckets=2, folder=folder)
    written, write, found = [], substrings.WindowIndex._write, {}

    def counted_write(self, df, kind):
        name = write(self, df, kind)
        written.append((kind, spark.table(name).count()))
        return name

    substrings.WindowIndex._write = counted_write
    try:
        for b in range(20):
            batch, history = rows.where(F.col("doc_id").between(2 * b, 2 * b + 1)), rows.where(F.col("doc_id") < 2 * b)
            found |= {r.doc_id: len(r.starts) for r in index.ingest(batch, history).collect()}
            if b == 9:  # as a new session would
                for kind in ("h", "digest"):
                    for r in index.runs(kind):
                        spark.sql(f"DROP TABLE {r}")
                index = substrings.WindowIndex.opened(spark, folder)
    finally:
        substrings.WindowIndex._write = write
    assert [len(x) for x in index.levels["h"]] == [0, 1, 1]  # 20 = 16 + 4
    once = sum(spark.table(r).count() for r in index.runs("h"))
    assert sum(n for kind, n in written if kind == "h") <= 3 * once  # written, merged and merged again
    assert set(found) == set(range(3, 40, 3)) and all(n >= 31 for n in found.values())
    index.drop()
    assert not (tmp_path / "index").exists()


def test_substrings_odd(odd, none):
    assert substrings.remove_repeats(odd).count() == odd.count()
    assert substrings.remove_repeats(none).count() == 0


def test_html(spark, sf):
    got = {r.page_id: r.text for r in queries.queries()["op5_html_extract"](spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = html_text.lines_of(r.html[r.html.index("<article>") :].split("</article>")[0])
        assert got[r.page_id] == " ".join(x for _, _, x in inside)


class Inside(HTMLParser):
    """Words of the article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.said.append("" if tag in ("a", "b", "em", "i", "span", "strong") else " ")

    def handle_endtag(self, tag):
        self.handle_starttag(tag, ())
        self.depth -= 2 * (tag == "article")

    def handle_data(self, data):
        self.said.append(data if self.depth else "")


def test_html_against_another_parser(spark, sf):
    got = {r.page_id: r.text for r in queries.queries()["op5_html_extract"](spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        parser = Inside()
        parser.feed(r.html)
        parser.close()
        assert got[r.page_id] == " ".join("".join(parser.said).split())


def test_html_rules(spark):
    page = "<html><head><title>T</title></head><body><nav>Menu</nav><main><h1>Head&nbsp;&amp; line</h1><p>One <b>t</b>wo<br>three<!-- x --><script>no()</script><div class='comments'><p>bad</p></div><aside>side</aside></main><footer>f</footer>"
    lines = html_text.lines_of(page)
    assert [x for k, _, x in lines if k == html_text.KEPT] == ["Head & line", "One two", "three"]
    own = [(i, f"http://h.com/a/{i}", f"<body><div>Home Login</div><div>Text number {i} alone</div><div>All rights reserved</div></body>") for i in range(130)]
    rows = own + [(200, None, None), (201, "x", ""), (None, "http://z.org/", "<p>lone page</p>"), own[3]]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.text for r in got)) == sorted([f"Text number {i} alone" for i in range(130)] + ["", "", "lone page", "Text number 3 alone"])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differencing_decides(spark):
    """Plain divs, so only neighbours can tell; the truth is how the pages were made."""
    rng = random.Random(21)
    rows, truth = [], {}
    for site in range(3):
        menu = [words(rng, 2) for _ in range(8)]
        foot = words(rng, 6)
        for i in range(40):
            own = [words(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 4))]
            if i % 10 in (3, 4, 5, 6, 7):  # a run of copies
                own = [f"the same story of some length, told again and again in {site} and {i // 10}, " + "by many people, " * 8, "and this is its end"]
                own[0] = own[0].strip()
            items = "".join(f"<li>{x}</li>" for x in menu[: rng.randint(6, 8)] + [f"you are at {i}"])
            html = f"<body><ul>{items}</ul><div class='post ad-free'>{''.join(f'<p>{x}</p>' for x in own)}</div><div>{foot}</div></body>"
            rows.append((site * 100 + i, f"http://s{site}.com/p/{i:03d}", html))
            truth[site * 100 + i] = " ".join(own)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == truth


def test_html_menus_of_other_entries(spark):
    """Menus are told by their template alone: no names of furniture, and no entry is on two pages."""
    rng = random.Random(22)
    rows, truth = [], {}
    for i in range(30):
        own = [words(rng, rng.randint(6, 20)) + f" {i}" for _ in range(3)]
        links = "".join(f"<li><a href='/{rng.random()}'>{words(rng, 2)}</a></li>" for _ in range(rng.randint(3, 9)))
        said = f"<p>{own[1]} <a href='#'>{words(rng, 1)}</a></p>"
        html = f"<body><ul>{links}<li>Basket ({i})</li></ul><div><h1>Part {i}</h1><p>{own[0]}</p>{said}<p>{own[2]}</p></div></body>"
        rows.append((i, f"http://s.com/p/{i:03d}", html))
        truth[i] = " ".join([f"Part {i}", own[0], html_text.lines_of(said)[0][2], own[2]])
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == truth


def brute_texts(rows):
    """The text of each page from its neighbours by the definition, over all pages at once."""
    def place(r):
        rest = (r[1] or "").lower().split("//", 1)[-1].split("?")[0]
        return rest.split("/", 1)[0], rest, r[0]

    pages = [(place(r), html_text.parsed(r[2] or "")) for r in sorted(rows, key=place)]
    seen = [html_text.digests(p) for _, p in pages]
    start = [i == 0 or pages[i][0][0] != pages[i - 1][0][0] or not html_text.is_copy(seen[i], seen[i - 1]) for i in range(len(pages))]
    out = {}
    for i, (at, page) in enumerate(pages):
        after = next((j for j in range(i + 1, len(pages)) if start[j]), len(pages))
        before = next(j for j in range(i, -1, -1) if start[j]) - 1
        near = [j for j in (after, before) if 0 <= j < len(pages) and pages[j][0][0] == at[0] and pages[j][1] and not html_text.is_copy(seen[i], seen[j])]
        gone = html_text.furniture(page, pages[near[0]][1], at[0]) if near else np.zeros(len(page), bool)
        out[at[2]] = html_text.main_text(page, gone)
    return out


@pytest.mark.parametrize("per", [1, 7, 10_000])
def test_html_blocks_change_nothing(spark, monkeypatch, per):
    """Runs of copies longer than a block, runs at the head and the tail of a host, hosts of one page and empty pages."""
    rng = random.Random(23)
    rows = []
    for site, plan in enumerate([(9, 1, 20, 3, 1), (1,), (30,), (1, 1, 1, 12), (15, 1)]):
        menu = [words(rng, 2) for _ in range(6)]
        for run, n in enumerate(plan):
            story = [words(rng, 12) for _ in range(3)]
            for k in range(n):
                html = "" if site == 3 and run == 1 else f"<ul>{''.join(f'<li>{x}</li>' for x in menu)}</ul><div>{''.join(f'<p>{x}</p>' for x in story)}</div><div>{menu[0]} {k}</div>"
                rows.append((len(rows), f"http://s{site}.com/p/{run:02d}/{k:03d}", html))
    monkeypatch.setattr(html_text, "BLOCK_BYTES", 1)
    monkeypatch.setattr(html_text, "LEAST_BLOCK", per)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_texts(rows)
    assert sum("</" not in t and len(t.split()) < 40 for t in got.values()) > 40  # most pages of hosts with two runs lose their menu


def test_html_class_names():
    gone = lambda c: html_text._left_out("div", f' class="{c}"')
    assert all(map(gone, ["ad", "x site-footer", "nav-bar", "comments"])) and not any(map(gone, ["post ad-free", "how-to-share-files", "shared", ""]))


def test_longest_common_lines():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("pqrs") for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert html_text.common(a, b).sum() == best[-1][-1]


def test_language(spark, sf, docs, odd, none):
    out = {r.doc_id: r for r in queries.queries()["op6_langid"](spark, sf).collect()}
    held = [(out[r.doc_id].lang_pred == r.lang) for r in docs.collect() if out[r.doc_id].held_out and r.lang]
    assert np.mean(held) > 0.95 and len(out) == docs.count()
    model = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame([(1, None), (2, "12 34 !"), (3, "")], "doc_id long, text string"), model).collect()}
    assert set(got.values()) == {("und", 0.0)}
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(odd, language_id.train(odd)).count() == odd.count()


def test_mixing(spark, sf):
    out = queries.queries()["op7_mix"](spark, sf).collect()
    again = queries.queries()["op7_mix"](spark, sf).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    total = sum(r.size for r in out)
    of = {r.doc_id: r.source for r in table(spark, sf, "documents").select("doc_id", "source").collect()}
    groups = collections.defaultdict(list)
    for r in out:
        groups[of[r.doc_id]].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rows in groups.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and rows[0].source_size == sum(r.size for r in rows)
    assert math.isclose(sum(rows[0].target for rows in groups.values()), total)


def test_mixing_equals_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()["op7_mix"](spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(mixing.ORACLE).fetchall())


def test_mixing_caps_and_prefers_quality(spark, odd, none):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 5 + ["b"] * 200 + ["c"] * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(d).select("source", "source_size", "target").distinct().collect()}
    assert got["a"] == (50, 150.0) and math.isclose(got["b"][1], 3900 * 2 / 3) and math.isclose(got["c"][1], 3900 / 3)
    q = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.05)
    taken = mixing.mix(d, q).where("source = 'c'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t"))
    by = {r.odd: r.t for r in taken.collect()}
    assert by[0] > 3 * by[1]
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    weights = spark.createDataFrame([(6, 1.0), (6, 1.0)], "doc_id long, quality_weight double").distinct()
    assert mixing.mixed(odd, weights).columns == odd.columns and mixing.mixed(none, weights).count() == 0


def brute_classes(texts: dict[int, str], links: bool = True) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.encode().split()
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    index = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    pairs = {(min(a, b), max(a, b)) for ids in index.values() for a in ids for b in ids if a != b}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        u, v = sets[a], sets[b]
        if sum(1 / sum(max(u[j] / u[i], v[j] / v[i]) for j in u.keys() | v.keys()) for i in u.keys() & v.keys()) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_on_a_large_family(spark):
    """A family of edited copies, many pairs of which are just under the threshold, against brute force."""
    rng = random.Random(8)
    base = words(rng, 60).split()
    texts = {}
    for i in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = words(rng, 1)
        texts[i] = " ".join(t)
    for i in range(160, 200):
        texts[i] = words(rng, rng.randint(1, 40))
    texts[200], texts[201] = texts[165] + " ", "a b"
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_probability_jaccard():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ({rng.randint(0, 12): rng.randint(1, 5) for _ in range(rng.randint(1, 9))} for _ in range(2))
        expected = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        arrays = [x for s in (a, b) for x in (np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)]))]
        assert math.isclose(neardup.probability_jaccard(*arrays), expected, abs_tol=1e-9)


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(7)
    a = words(rng, 300).split()
    b = a[:230] + words(rng, 70).split()
    column = pa.array([" ".join(a), " ".join(b)])
    doc, value, count = counted(*shingles(split_words(column), 5))
    s = neardup.prob_minhash(doc, value, count.astype(float), 2, 2048)
    true = neardup.probability_jaccard(value[doc == 0], count[doc == 0], value[doc == 1], count[doc == 1])
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_near_duplicates_odd(spark, sf, local, odd, none):
    got = {r.doc_id: r.class_id for r in queries.queries()["op8_probminhash"](spark, sf).collect()}
    assert got == brute_classes(local) | {i: got[i] for i, t in local.items() if not t.split()}
    classes = neardup.near_classes(odd).collect()
    assert len(classes) == odd.count()
    assert {r.class_id for r in classes if r.doc_id in (6, 7, 8)} == {6} and {r.class_id for r in classes if r.doc_id in (3, 4)} == {3}
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 3, 5, 6, 9, 10, 11]
    assert neardup.near_classes(none).count() == 0 and neardup.representatives(none).count() == 0


def test_near_duplicates_of_one_id(spark):
    """Different texts may share an id: none is lost, and each is compared by its own text."""
    rng = random.Random(14)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (9, b + " end"), (7, c), (7, c + " end"), (None, a), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_classes(d).collect()
    assert len(got) == len(rows) and sorted(r.class_id for r in got if r.class_id is not None) == [5, 5, 5, 5, 5, 7, 7]
    assert len({r.node for r in got if r.class_id == 5}) == 2
    kept = sorted(((r.doc_id, r.text) for r in neardup.representatives(d).collect()), key=repr)
    assert [k for k in kept if k[0] != 7] == sorted([(5, a), (5, b), (None, a), (None, None)], key=repr) and len(kept) == 5


def test_sharding(spark, sf, docs, local):
    out = queries.queries()["op9_shard"](spark, sf).collect()
    assert len(out) == docs.count() and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        assert r.size == len(local[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(local[r.doc_id].encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) == set(range(8))
    largest = max(r.size for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_sharding_splits_hot_groups(spark, odd, none):
    rows = [(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 9000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), ranges=256).groupBy("shard").agg(F.sum(F.length("text") + 1).alias("b")).collect()
    b = [r.b for r in out]
    assert len(b) == 8 and max(b) < 1.05 * min(b)
    placed = sharding.assign_shards(odd)
    assert placed.count() == odd.count() and placed.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert sharding.assign_shards(none).count() == 0


@pytest.mark.parametrize("same", [3000, 9000])
def test_sharding_divides_repeated_rows(spark, same):
    """A third of all rows, or all of them, are one row."""
    rows = [(7, "one row, again and again")] * same + [(i, f"text {i}" * (1 + i % 5)) for i in range(9000 - same)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=256).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r.shard] += len(r.text) + 1
        slots[r.shard].append(r.slot)
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())


def brute_language_model(train: list[list]):
    """Interpolated modified Kneser-Ney of order 3 by dictionaries: the probability of a word after two others, and its counts."""
    c, three = collections.Counter(), collections.Counter()
    for t in train:
        c.update(t)
        three.update(zip([None, None, *t[:-1]][: len(t)], [None, *t[:-1]], t, strict=True))
    two = collections.Counter()
    for (u, v, w), k in three.items():
        two[v, w] += k if v is None else 1  # nothing stands before a text
    one = collections.Counter(w for _, w in two)
    d3, d2, d1 = ((0, *language_model.discounts(*[collections.Counter(x.values())[i] for i in (1, 2, 3, 4)])) for x in (three, two, one))
    contexts = []
    for x, of in ((three, lambda k: k[:2]), (two, lambda k: k[0])):
        total, follow = collections.Counter(), collections.defaultdict(lambda: [0] * 4)
        for k, n in x.items():
            total[of(k)] += n
            follow[of(k)][min(n, 3)] += 1
        contexts.append((total, follow))
    (t3, f3), (t2, f2) = contexts
    v1, kinds, mass = len(c) + 1, sum(one.values()), sum(d1[min(n, 3)] for n in one.values())

    def p(u, v, w):
        x = max(one[w] - d1[min(one[w], 3)], 0) / kinds + mass / kinds / v1
        if t2[v]:
            x = max(two[v, w] - d2[min(two[v, w], 3)], 0) / t2[v] + sum(d2[k] * f2[v][k] for k in (1, 2, 3)) / t2[v] * x
        if t3[u, v]:
            x = max(three[u, v, w] - d3[min(three[u, v, w], 3)], 0) / t3[u, v] + sum(d3[k] * f3[u, v][k] for k in (1, 2, 3)) / t3[u, v] * x
        return x

    return p, c


def test_language_model(spark, sf, local):
    out = queries.queries()["op10_kneser_ney"](spark, sf).collect()
    texts = {i: [*t.encode().translate(LOWER).split(), None] for i, t in local.items()}
    p, c = brute_language_model([texts[i] for i in texts if zlib.crc32(str(i).encode()) % 10])
    n, v = sum(c.values()), len(c)
    assert math.isclose(sum(p(b"of", b"the", w) for w in [*c, "?"]), 1) and math.isclose(sum(p(None, b"the", w) for w in [*c, "?"]), 1)
    seen: dict = {}
    cached = lambda *k: seen[k] if k in seen else seen.setdefault(k, math.log10(p(*k)))
    for r in out:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(cached(*k) for k in zip([None, None, *t[:-1]][: len(t)], [None, *t[:-1]], t, strict=True)), rel_tol=1e-9)


@pytest.mark.parametrize("shards, passes", [(1, 1), (7, 3)])
def test_language_model_does_not_depend_on_shards(spark, shards, passes):
    rng = random.Random(12)
    some = [words(rng, 2) for _ in range(30)]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["b " * 4000] * 3
    p, _ = brute_language_model([[*t.encode().split(), None] for t in texts])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language_model.train(d, shards, passes)
    ask = [*texts[:20], texts[-1], "never seen words b b", "", None]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(ask):
        t = [*(t or "").encode().split(), None]
        assert math.isclose(got[i], sum(math.log10(p(*k)) for k in zip([None, None, *t[:-1]][: len(t)], [None, *t[:-1]], t, strict=True)), rel_tol=1e-9)
    language_model.drop_model(spark, model)


def test_language_model_odd(odd, none):
    model = language_model.train(odd)
    assert language_model.score(odd, model).count() == odd.count()
    empty = language_model.train(none)
    assert all(math.isfinite(r.score) for r in language_model.score(odd, empty).collect())


def test_pipeline(spark, sf, docs, odd, tmp_path_factory):
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == columns, name
    out = corpus_pipeline.run(spark, sf).collect()
    bad = {r.doc_id for r in decontamination.contaminated(docs, table(spark, sf, "benchmark")).collect()}
    assert out and not bad & {r.doc_id for r in out} and {"shard", "slot"} <= set(out[0].asDict())
    rows = odd
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert rows.count() > 0


def test_pipeline_by_stages(spark, sf, docs, tmp_path_factory):
    """Each stage's rows by brute force from its predecessor's."""
    folder, given, of = tmp_path_factory.mktemp("stages"), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, sf).write.parquet(f"{folder}/{name}")
        given = spark.read.parquet(f"{folder}/{name}")
        of[name] = given.collect()
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.doc_id: r.text or "" for r in of["toxicity"]}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    gone = set(before) - set(kept)
    assert kept.items() <= before.items() and sum(labels.get(i) == 0 for i in gone) <= 0.03 * len(before)
    classes = brute_classes({i: t for i, t in kept.items() if t.split()})
    blank = {t: min(i for i, x in kept.items() if x == t) for t in kept.values() if not t.split()}
    assert sorted(r.doc_id for r in of["near_dedup"]) == sorted({*classes.values(), *blank.values()})
    alone = {r.doc_id: r.text or "" for r in of["near_dedup"]}
    clean = {r.doc_id for r in of["decontamination"]}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in table(spark, sf, "benchmark").collect() if r.text]
    whole = {i for i, t in alone.items() if any(f" {x} " in f" {plain(t)} " for x in items if len(x.split()) > 8)}
    part = {i for i, t in alone.items() if any(f" {' '.join(x.split()[j : j + 4])} " in f" {plain(t)} " for x in items for j in range(len(x.split()) - 3))}
    assert not whole & clean and clean | part >= set(alone) and clean <= set(alone)  # copies go; texts without four words of an item stay
    taken = collections.Counter(r.doc_id for r in of["mixing"])
    assert set(taken) <= clean and max(taken.values()) <= 3
    last = collections.Counter(r.doc_id for r in of["sharding"])
    assert last == taken
    slots = collections.defaultdict(list)
    for r in of["sharding"]:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
