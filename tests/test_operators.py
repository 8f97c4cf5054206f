"""Small cases with results known from the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwork.functions import paths as P
from loomwork.functions import text as T
from loomwork.operators import graph as G
from loomwork.operators import intervals as I
from loomwork.operators import packing, parsing, records
from loomwork.operators import search as S


@pytest.mark.parametrize(("text", "expected"), [("CustomerProfile_avatar::v2", "customer profile avatar v2"), ("HTTPServer v2Beta", "httpserver v2 beta"), ("", ""), (None, None), ("Ünïcode–Straße", "ünïcode straße")])
def test_tokens(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(F.array_join(T.tokens(F.col("t")), " ")).first()[0]
    assert got == expected
    if text:
        assert T.py_tokens(text) == expected.split()


def test_query_parsing():
    q = T.parse_query('customer "profile avatar" -legacy')
    assert q == T.Query(("avatar", "customer", "profile"), ("legacy",), (("profile", "avatar"),))
    assert T.parse_query("please add login form").terms == ("form", "login")
    assert T.parse_query("add").terms == ("add",)
    for bad in ("", "-x", '"open'):
        with pytest.raises(ValueError, match="query"):
            T.parse_query(bad)


@pytest.mark.parametrize(("n", "expected"), [(56, [(1, 56)]), (57, [(1, 56), (49, 57)]), (104, [(1, 56), (49, 104)]), (105, [(1, 56), (49, 104), (97, 105)]), (0, None)])
def test_chunks(spark, n, expected):
    got = spark.range(1).select(S.chunk_ranges(F.lit(n)).alias("c")).first()[0]
    assert (got and [tuple(x) for x in got]) == expected


def test_overlap_rules(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    row = spark.range(1).select(*[T.substantially_overlaps(*lit(*x)) for x in ((10, 20, 12, 16), (10, 20, 21, 30), (1, 10, 6, 15))], T.milli(F.lit(1.23449)), T.milli(F.lit(-1.0)), T.milli(F.lit(float("nan")))).first()
    assert list(row) == [True, False, True, 1234, 0, 0]


def test_interval_union_and_difference(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 6, 8), ("a", 12, 13)], "k string, s int, e int")
    assert sorted(tuple(r)[:3] for r in I.merged(df, "k", "s", "e", 2).collect()) == [("a", 1, 8), ("a", 12, 13)]
    whole, holes = spark.createDataFrame([("a", 1, 20)], "k string, a int, b int"), spark.createDataFrame([("a", 5, 8), ("a", 15, 30)], "k string, s int, e int")
    assert sorted((r.piece_start, r.piece_end) for r in I.subtracted(whole, holes, "k", ("a", "b"), ("s", "e")).collect()) == [(1, 4), (9, 14)]


def test_bins_change_no_join(spark):
    a = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("s1"), (F.col("id") % 50 + F.col("id") % 9).alias("e1"), F.col("id").alias("a"))
    b = a.select("k", F.col("s1").alias("s2"), F.col("e1").alias("e2"), F.col("a").alias("b"))
    plain = I.overlap_join(a, b, "k", ("s1", "e1"), ("s2", "e2")).select("a", "b")
    binned = I.overlap_join(a, b, "k", ("s1", "e1"), ("s2", "e2"), bin_lines=4).select("a", "b")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, binned.collect()))


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b", "k1"), ("b", "c", "k2"), ("c", "d", "k1")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a",)], "id string")
    at = lambda depth, kinds=None: sorted(r.id for r in G.levels(seeds, edges, depth, kinds).collect())
    assert [at(0), at(1), at(2), at(3, ["k1"])] == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b"]]
    touched = G.touched_edges(G.levels(seeds, edges, 2), edges, 2)
    assert sorted((r.src, r.dst) for r in touched.collect()) == [("a", "b"), ("b", "c")]


def test_impact(spark):
    nodes = spark.createDataFrame([(x, "f.txt" if x == "a" else f"{x}.txt", None, None, "file") for x in "abcde"], "id string, path string, line_start int, line_end int, watch string")
    members = spark.createDataFrame([("H", "a", "r", True), ("H", "e", "r", True), ("J", "c", None, True)], "hyperedge_id string, node_id string, role string, required boolean")
    edges = spark.createDataFrame([("a", "b", "k1"), ("b", "c", "k2"), ("c", "d", "k1")], "src string, dst string, kind string")
    change = lambda p: spark.createDataFrame([(p, None, True, [])], "path string, old_path string, whole_file boolean, ranges array<struct<start:int,end:int>>")
    one = G.impact(change("f.txt"), nodes, members, edges, 1)
    assert sorted((r.hyperedge_id, r.node_id) for r in one["members"].collect()) == [("H", "a"), ("H", "e")]
    assert [(r.id, r.reason) for r in one["related"].collect()] == [("b", "k1 relationship from a")]
    two = G.impact(change("f.txt"), nodes, members, edges, 2)
    assert sorted((r.hyperedge_id, r.direct) for r in two["active"].collect()) == [("H", True), ("J", False)]
    assert [r.path for r in G.impact(change("other.txt"), nodes, members, edges, 1)["unmatched"].collect()] == ["other.txt"]


def test_budget_tiers(spark):
    schema = "g string, id int, priority int, ord int, cost int"
    pack = lambda rows: sorted(r.id for r in packing.packed(spark.createDataFrame(rows, schema), "g", 100).where("included").collect())
    assert pack([("g", 1, 0, 1, 60), ("g", 2, 1, 1, 50), ("g", 3, 1, 2, 30), ("g", 4, 2, 1, 10)]) == [1, 3]
    assert pack([("g", 1, 0, 1, 60), ("g", 2, 1, 1, 50), ("g", 3, 2, 1, 10)]) == [1, 3]


def test_packing_equals_a_plain_fold(spark):
    import random
    from itertools import groupby

    def plain(rows, budget):
        out = []
        for g, items in groupby(sorted(rows, key=lambda r: (str(r[0]), *r[2:4], r[1])), key=lambda r: r[0]):
            left, blocked = budget, False
            for _, tier in groupby(items, key=lambda r: r[2]):
                fits = []
                for r in tier:
                    ok = not blocked and r[4] <= left
                    left -= r[4] if ok else 0
                    fits.append(ok)
                    out.append((g, r[1], r[2], r[4], ok))
                blocked = blocked or (any(fits) and not all(fits))
        return sorted(out, key=repr)

    random.seed(5)
    schema = "g string, id int, priority int, ord int, cost int"
    for _ in range(3):
        cost = lambda g: random.choice([0, 1, 2, 3, 5, 8, 13, 40, 60, 200]) if g != "c" else random.choice([60, 200])
        rows = [(g, i % 17, random.randrange(4), random.randrange(6), cost(g)) for g in ["a", "a2", "b", "c", "d", None] for i in range(60)]
        rows = [r for r in rows if r[0] != "d" or r[2] != 1] + rows[:3]
        found = packing.packed(spark.createDataFrame(rows, schema), "g", 100)
        assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 100)
    assert packing.packed(spark.createDataFrame([], schema), "g", 100).count() == 0


def test_annotations():
    text = '// @anchor ledger.post kind=function tags=core,money\n// @strand balance-contract role=writer intent="Totals agree" required=false\nfn post() {}\n\nfn read() {} // @anchor ledger.read watch=line @strand balance-contract role=reader @relation mirrors to=ledger.post bidirectional=true\n'
    found = parsing.scan_annotations("src/ledger.rs", text)
    assert [(r["what"], r.get("id"), r.get("target")) for r in found if r["what"] != "hyperedge"] == [("node", "ledger.post", "core,money"), ("member", "balance-contract", "ledger.post"), ("node", "ledger.read", None), ("member", "balance-contract", "ledger.read"), ("edge", "ledger.read", "ledger.post")]
    assert [r["intent"] for r in found if r["what"] == "hyperedge"] == ["Totals agree"]
    far = parsing.scan_annotations("f", "@anchor x\n\n\n@strand s role=a\n\n@strand t")
    assert [r["target"] for r in far if r["what"] == "member"] == ["x", "source:f"]


def test_patch():
    text = "diff --git a/a.txt b/a.txt\n--- a/a.txt\n+++ b/a.txt\n@@ -3,2 +3,1 @@\n-x\n-y\n+z\n@@ -10,1 +8,0 @@\n--- gone\ndiff --git a/b.bin b/b.bin\n"
    found = parsing.scan_patch(text)
    assert [(r["line_start"], r["line_end"]) for r in found if r["what"] == "range"] == [(3, 3), (8, 8)]
    assert [(r["line_start"], r["text"]) for r in found if r["what"] == "removed"] == [(3, "x"), (4, "y"), (10, "-- gone")]
    assert [(r["path"], r["whole_file"]) for r in found if r["what"] == "file"] == [("a.txt", False), ("b.bin", True)]


def test_patch_files():
    text = 'diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\x0cb\u2028c\n+d\n@@ -9,2 +9 @@\n-e\n-f\n+g\ndiff --git a/n.py b/n.py\nnew file mode 100644\ndiff --git a/g b/g\ndeleted file mode 100644\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n'
    text += 'diff --git a/o b/o b/p q\nrename from o b/o\nrename to p q\ndiff --git "a/\\303\\251\\t\\"" "b/\\303\\251\\t\\""\ncopy from c\ncopy to "\\303\\251"\n'
    found = parsing.scan_patch(text)
    files = [(r["path"], r["old_path"], r["status"], r["whole_file"]) for r in found if r["what"] == "file"]
    assert files == [("x.py", None, "modified", False), ("n.py", None, "added", True), ("g", "g", "deleted", False), ("p q", "o b/o", "renamed", True), ("é", "c", "copied", True)]
    assert [(r["line_start"], r["text"]) for r in found if r["what"] == "removed"] == [(1, "a\x0cb\u2028c"), (9, "e"), (10, "f"), (1, "z")]
    assert parsing.path_name('"a/\\303\\251\\t\\""', "a/") == 'é\t"' and parsing.path_name("/dev/null") is None


def test_annotation_quotes_and_lines():
    found = parsing.scan_annotations("f", 'x\x0cy\r\n/* @anchor a */\n// @strand s intent="say \\"x */ y\\" now"')
    assert [(r["what"], r["line"]) for r in found] == [("node", 2), ("hyperedge", 3), ("member", 3)]
    assert found[1]["intent"] == 'say "x */ y" now'


def test_refresh_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, hash string")
    diff = records.manifest_difference(old, new)
    assert sorted(map(tuple, diff.collect())) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    assert sorted(map(tuple, records.refreshed(old, new, diff).collect())) == sorted(map(tuple, new.collect()))


def test_paths(spark):
    df = spark.createDataFrame([("file://src/a.rs#L10-L20",), ("src/a.rs",), ("rust://x",)], "t string").select(P.file_target(F.col("t")).alias("x"))
    assert [r.x and tuple(r.x) for r in df.collect()] == [("src/a.rs", 10, 20, "range"), ("src/a.rs", None, None, "file"), None]
    one = spark.range(1).select(P.slug(F.lit("a.b-1")), P.slug(F.lit("a b")), P.language(F.lit("cts"))).first()
    assert one[0] == "a.b-1.yaml" and one[1].startswith("a_b-") and one[2] == "typescript"
    import re

    assert re.match(P.glob_regex("**/*.rs"), "a/b.rs") and re.match(P.glob_regex("**/*.rs"), "b.rs") and not re.match(P.glob_regex("*.rs"), "a/b.rs")


def test_streams(spark, sf, tmp_path):
    from loomwork.sources.tables import table
    from loomwork.streaming import windows

    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windows.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == batch.count()
    src = tmp_path / "changes"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, seq int, hash string").write.parquet(str(src))
    q = windows.refresh_stream(spark.readStream.schema("path string, seq int, hash string").parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "v=0")).collect())) == [("a", 2, "y"), ("b", 1, "z")]


def test_source_filters_without_extension(spark):
    from loomwork.functions.paths import path_language
    from loomwork.operators.context import source_allowed

    d = spark.createDataFrame([("src/a.rs",), ("src/Makefile",), ("doc/b.md",)], "path string")
    kept = lambda **k: [r.path for r in d.where(source_allowed(F.col("path"), path_language(F.col("path")), **k)).orderBy("path").collect()]
    assert kept() == ["doc/b.md", "src/Makefile", "src/a.rs"]
    assert kept(extensions=[".RS"]) == ["src/a.rs"] and kept(excluded_extensions=["rs"]) == ["doc/b.md", "src/Makefile"]
    assert kept(languages=["rust"]) == ["src/a.rs"] and kept(excluded_languages=["MD"]) == ["src/Makefile", "src/a.rs"]
    assert kept(includes=["src/**"], excluded_extensions=["rs"]) == ["src/Makefile"]
    for bad in ({"extensions": ["a/b"]}, {"extensions": ["."]}, {"includes": [" "]}):
        with pytest.raises(ValueError):
            kept(**bad)


def test_requests_by_source_policy(spark):
    from loomwork.operators import context as C

    members = spark.createDataFrame([("h", True, "a", None, False), ("h", True, "b", "r", True), ("g", False, "c", "r", False), ("g", False, "gone", "r", True)], "hyperedge_id string, hyperedge_direct boolean, node_id string, role string, direct boolean")
    related = spark.createDataFrame([("d", False)], "node_id string, direct boolean")
    nodes = spark.createDataFrame([("a", "x", 5, 6, "range"), ("b", "x", None, None, None), ("c", "y", 2, None, None), ("d", "y", 1, 9, "file"), ("gone", None, 1, 1, None)], "id string, path string, line_start int, line_end int, watch string")
    focus = spark.createDataFrame([("c", 0)], "id string, ord int")
    got = lambda source: {r.reference: (r.start, r.end, r.priority) for r in C.requests(members, related, nodes, focus, source, 3).collect()}
    every = {"h/member:a": (2, 9, 2), "h/r:b": (1, C.LAST_LINE, 1), "g/r:c": (1, 5, 0), "related:d": (1, C.LAST_LINE, 3)}
    assert got("all") == every and got("none") == {} and set(got("focused")) == {"g/r:c"} and set(got("direct")) == {"h/member:a", "h/r:b"}


def test_excerpts_are_cut_and_merged(spark):
    from loomwork.operators import context as C

    files = spark.createDataFrame([("x", ["1", "2", "3", "4", "5"]), ("e", [])], "path string, lines array<string>")
    ranges = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("x", 5, C.LAST_LINE), ("x", 9, 10), ("e", 1, 3), ("none", 1, 2)], "path string, start long, end long")
    rows = {(r.line_start, r.line_end, r.text) for r in C.excerpts(ranges, files).collect()}
    assert rows == {(1, 3, "1\n2\n3"), (5, 5, "5")}
    assert {(r.line_start, r.line_end) for r in C.excerpts(ranges, files, 1).collect()} == {(1, 5)}


def test_values_of_removed_nodes_and_first_wins(spark):
    from loomwork.operators import context as C

    t = lambda rows: spark.createDataFrame(rows, "id string, value string")
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    got = {r.node_id: (r.value, r.deleted) for r in C.with_values(members, t([("a", None)]), t([("a", "old"), ("b", "old")])).collect()}
    assert got == {"a": (None, False), "b": ("old", True), "c": (None, False)}
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    diff = [(0, "p", "o", "renamed", [(3, 4)]), (1, "q", None, "deleted", []), (2, "m", None, "modified", [(7, 8)]), (3, "m", None, "modified", [(1, 2)])]
    diff = spark.createDataFrame(diff, "ord int, path string, old_path string, status string, ranges array<struct<start:int,end:int>>")
    rows = {r.path: (r.old_path, r.status, r.whole_file, [tuple(x) for x in r.ranges]) for r in C.change_set(paths("p", "n"), diff, paths("q", "u", "n")).collect()}
    # a named file that differs stays whole, with what the diff says of it
    assert rows == {"p": ("o", "renamed", True, [(3, 4)]), "q": (None, "deleted", True, []), "m": (None, "modified", False, [(1, 2), (7, 8)]), "n": (None, "modified", True, []), "u": (None, "untracked", True, [])}
