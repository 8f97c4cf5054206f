"""Impact, assembly, stored index, scanners, records and packets against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import assembly as A
from loomwork.operators import impact as M
from loomwork.operators import packet as K
from loomwork.operators import postings as P
from loomwork.operators import scanners as X
from loomwork.operators import search as S
from loomwork.operators import spans as N
from loomwork.sources import documents as D

NODES = "id string, path string, line_start int, line_end int, watch string, source string, declared_in string, declared_at int"
STRANDS = "id string, tags array<string>, include_roles array<string>, exclude_roles array<string>, follow_relations array<string>, depth int, source string, declared_in string, declared_at int"
MEMBERS = "seq long, hyperedge_id string, node_id string, role string, required boolean, source string, declared_in string, declared_at int"
EDGES = "seq long, owner string, src string, dst string, kind string, source string, declared_in string, declared_at int"
CHANGES = "ord long, path string, old_path string, status string, whole_file boolean, ranges array<struct<start:int,end:int>>"


def plain_impact(nodes, strands, members, edges, changes, depth=None, kinds=None, tags=(), optional=True, default=1):
    """Writers one after the other, then sets level by level."""
    reasons, seeds, by_id = {}, set(), {h[0]: h for h in strands}
    matched = set()

    def declared(source, file, line):
        c = next((c for c in changes if file is not None and file in (c[1], c[2])), None)
        if c is None:
            return None
        hit = source == "sidecar" or (source == "annotation" and line is not None and (c[4] or any(a <= line <= b for a, b in c[5])))
        return c if hit else None

    for h in strands:
        if c := declared(*h[6:9]):
            seeds.add(h[0])
            matched.add(c[1])
    for m in members:
        if c := declared(*m[5:8]):
            seeds |= {m[1]} - {None}
            matched.add(c[1])
            reasons[m[2]] = f"metadata changed in {m[6]}"
    for e in edges:
        if c := declared(*e[5:8]):
            seeds |= {e[1]} - {None}
            matched.add(c[1])
            for x in e[2:4]:
                reasons[x] = f"relationship metadata changed in {e[6]}"
    for n in nodes:
        if c := declared(*n[5:8]):
            matched.add(c[1])
            reasons[n[0]] = f"anchor metadata changed in {n[6]}"
        for c in changes:
            if n[1] in (c[1], c[2]) and (c[4] or (n[4] or "file") == "file" or n[2] is None or any(a <= (n[3] if n[3] is not None else n[2]) and n[2] <= b for a, b in c[5])):
                matched.add(c[1])
                reasons[n[0]] = f"{c[1]} changed"
    direct = set(reasons)
    chosen = lambda h: not tags or (h in by_id and set(tags) <= set(by_id[h][1]))
    active = {h for h in seeds | {m[1] for m in members if m[2] in direct and m[1]} if chosen(h)}
    first = set(active)

    def selected(m):
        h = by_id.get(m[1])
        if not m[4] and not optional:
            return False
        return h is None or (not h[2] or m[3] in h[2]) and not (h[3] and m[3] in h[3])

    def expand(of):
        for h in sorted(of):
            for m in members:
                if m[1] == h and h in by_id and selected(m):
                    reasons.setdefault(m[2], f"member of strand {h}")

    expand(active)
    if depth is None:
        depth = max((by_id[h][5] for h in first if h in by_id and by_id[h][5] is not None), default=default)
    front, visited = set(reasons), set(reasons)
    for _ in range(depth):
        new = set()
        for _, owner, a, b, kind, *_ in edges:
            follow = by_id[owner][4] if owner in by_id else None
            if (kinds and kind not in kinds) or (not kinds and follow and kind not in follow):
                continue
            if a in front and b not in visited:
                new.add((b, f"{kind} relationship from {a}"))
            if b in front and a not in visited:
                new.add((a, f"{kind} relationship to {b}"))
        if not new:
            break
        front = {x for x, _ in new}
        visited |= front
        for x, why in sorted(new):
            reasons.setdefault(x, why)
        later = {m[1] for m in members if m[2] in front and m[1] and chosen(m[1])}
        active |= later
        expand(later)
        front |= set(reasons) - visited
        visited |= front
    shown = {(m[1], m[2], m[3]) for m in members if m[1] in active and m[1] in by_id and selected(m)}
    return {
        "reasons": {(x, why, x in direct) for x, why in reasons.items()}, "strands": {(h, h in first) for h in active if h in by_id},
        "members": {(h, n, r, reasons.get(n, f"member of strand {h}"), n in direct) for h, n, r in shown},
        "related": {(x, why, x in direct) for x, why in reasons.items() if x not in {n for _, n, _ in shown}}, "unmatched": {c[1] for c in changes} - matched,
    }


@pytest.mark.parametrize("seed", range(3))
def test_impact_equals_a_plain_traversal(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    where = lambda: (pick("sidecar", "annotation"), pick(*[f"f{i}" for i in range(9)], None), pick(None, *range(1, 9)))
    ids = [f"n{i}" for i in range(24)]
    nodes = [(n, f"f{rng.randrange(9)}", a := pick(None, *range(1, 9)), None if a is None else pick(None, a, a + 2), pick(None, "file", "line", "range", "node"), *where()) for n in ids]
    strands = [(f"h{i}", rng.sample(["x", "y"], rng.randrange(3)), pick(None, [], ["a"]), pick(None, [], ["b"]), pick(None, [], ["k"]), pick(None, None, 0, 1, 2, 3), *where()) for i in range(7)]
    members = [(i, pick(None, *[f"h{j}" for j in range(8)]), pick(*ids), pick(None, "a", "b"), pick(True, False), *where()) for i in range(26)]
    edges = [(i, pick(None, *[f"h{j}" for j in range(8)]), pick(*ids), pick(*ids, "far"), pick("k", "l"), *where()) for i in range(22)]
    span = lambda: [(a, a + rng.randrange(3)) for a in rng.sample(range(1, 9), 2)]
    changes = [(i, f"f{rng.randrange(12)}" if i else "f1", pick(None, "f0", "f2"), "modified", pick(True, False, False), span()) for i in range(3)]
    changes = list({c[1]: c for c in changes}.values())
    frames = [spark.createDataFrame(x, s) for x, s in ((nodes, NODES), (strands, STRANDS), (members, MEMBERS), (edges, EDGES), (changes, CHANGES))]
    options = [{}, {"depth": 2, "kinds": ["k"], "tags": ["x"]}, {"include_optional": False, "default_depth": 2}][seed]
    got = M.impact(M.Graph(*frames[:4]), frames[4], **options)
    expected = plain_impact(nodes, strands, members, edges, changes, options.get("depth"), options.get("kinds"), options.get("tags", ()), options.get("include_optional", True), options.get("default_depth", 1))
    for part, rows in expected.items():
        assert {tuple(r) if part != "unmatched" else r.path for r in got[part].collect()} == rows, part


def test_deleted_declarations_give_reasons_last_but_never_over_others(spark):
    nodes = spark.createDataFrame([("n1", "a.rs", 1, 2, "range", "sidecar", None, None)], NODES)
    graph = M.Graph(nodes, *[spark.createDataFrame([], s) for s in (STRANDS, MEMBERS, EDGES)])
    changes = spark.createDataFrame([(0, "a.rs", None, "modified", True, []), (1, "d.json", None, "deleted", True, [])], CHANGES)
    notes = [("a.rs", 3, "// @anchor n1"), ("a.rs", 4, "// @strand h"), ("a.rs", 9, "// @anchor n2 @strand h role=r"), ("d.json", 1, '{"strands": [{"id": "g",'), ("d.json", 2, '"members": [{"anchor": "n3", "role": "x"}, {"anchor": "n4"}], "on_change": {"exclude_roles": ["x"]}}]}')]
    got = M.impact(graph, changes, spark.createDataFrame(notes, "path string, line int, text string"))
    assert {tuple(r)[:2] for r in got["reasons"].collect()} == {("n1", "a.rs changed"), ("n2", "annotation removed from a.rs"), ("n3", "strand metadata removed from d.json"), ("n4", "strand metadata removed from d.json")}
    assert {(r.hyperedge_id, r.node_id, r.role) for r in got["members"].collect()} == {("h", "n1", None), ("h", "n2", "r"), ("g", "n4", None)}
    assert got["unmatched"].collect() == []


def fragments_of(spark, rng, files):
    where = lambda f: (("sidecar", f, None) if f.startswith("s") else ("annotation", f, rng.randrange(1, 6)))
    at = lambda: rng.choice([None, (f"p{rng.randrange(3)}", rng.randrange(4), 3, "range")])
    name, target = lambda: f"n{rng.randrange(9)}", lambda: rng.choice([None, "t", "file://q/x#L2-L4", "http://x"])
    pick = rng.choice
    nodes = [(name(), 1, target(), pick([None, "k"]), at(), pick([None, ["b"], ["a", "b"]]), None, *where(f), i) for i, f in enumerate(files * 3)]
    strands = [(f"h{rng.randrange(6)}", 1, "x", [], None, *where(f), i) for i, f in enumerate(files)]
    members = [(pick([None, *[f"h{j}" for j in range(8)]]), pick([name(), "m/y", "u"]), pick([None, "r"]), True, None, *where(f), i) for i, f in enumerate(files * 3)]
    edges = [(pick([None, "h1"]), name(), pick([name(), "e/z#L3"]), pick(["k", "l"]), None, *where(f), i) for i, f in enumerate(files * 2)]
    end = "attributes map<string,string>, source string, file string, line int, ord long"
    shapes = (f"id string, version int, target string, kind string, location {A.LOCATION}, tags array<string>, {end}", f"id string, version int, intent string, tags array<string>, {end}", f"hyperedge_id string, node_id string, role string, required boolean, {end}", f"owner string, src string, dst string, kind string, {end}")
    return A.Fragments(*[spark.createDataFrame(x, s) for x, s in zip((nodes, strands, members, edges), shapes, strict=True)])


def shown(graph: A.Assembled) -> list:
    plain = lambda df: sorted(repr(sorted((k, sorted(v) if k == "tags" else v) for k, v in r.asDict(True).items())) for r in df.collect())
    return [plain(df) for df in (graph.nodes, graph.hyperedges, graph.members, graph.edges)]


def test_refreshed_graph_equals_rebuild(spark):
    rng = random.Random(5)
    files = [f"{kind}{i}" for kind in ("s", "a") for i in range(5)]
    now = fragments_of(spark, rng, files)
    graph = A.assembled(now)
    for _ in range(2):
        changed = rng.sample(files, 3)
        fresh = fragments_of(spark, rng, changed[1:])  # one file goes
        touched = spark.createDataFrame([(f,) for f in changed], "file string")
        keep = now.each(lambda df, touched=touched: df.join(touched, "file", "left_anti"))
        new = A.Fragments(*[a.unionByName(b) for a, b in zip((keep.nodes, keep.hyperedges, keep.members, keep.edges), (fresh.nodes, fresh.hyperedges, fresh.members, fresh.edges), strict=True)])
        graph, now = A.refresh(graph, now, new, touched), new
        assert shown(graph) == shown(A.assembled(new))


def test_merge_of_declarations(spark):
    end = "attributes map<string,string>, source string, file string, line int, ord long"
    rows = [("a", 1, None, None, ("s/p", 1, 1, "range"), ["x"], {"k": "v"}, "sidecar", "s1", None, 0), ("a", 1, "t1", "k1", ("./o", 2, 2, None), ["y"], {"gone": "1"}, "annotation", "f1", 4, 0), ("a", 1, "t2", None, ("o2", 3, 3, None), None, None, "annotation", "f2", 1, 0), ("b", 1, "file://z#L7", None, None, None, None, "annotation", "f1", 9, 0)]
    nodes = spark.createDataFrame(rows, f"id string, version int, target string, kind string, location {A.LOCATION}, tags array<string>, {end}")
    members = spark.createDataFrame([], f"hyperedge_id string, node_id string, role string, required boolean, {end}")
    edges = spark.createDataFrame([], f"owner string, src string, dst string, kind string, {end}")
    got = {r.id: r for r in A.assembled_nodes(A.first_nodes(nodes), members, edges).collect()}
    assert (got["a"].target, got["a"].kind, got["a"].location.path, got["a"].tags, got["a"].attributes, got["a"].source) == ("t1", "k1", "o2", ["x", "y"], {"k": "v"}, "sidecar")
    assert tuple(got["b"].location) == ("z", 7, 7, "range")
    found = {(r.code, r.subject, r.path) for r in A.diagnostics(A.Fragments(nodes, spark.createDataFrame([], f"id string, version int, intent string, tags array<string>, {end}"), members, edges)).collect()}
    assert found == {("anchor-target-conflict", "a", "f2")}


def test_index_refresh_equals_rebuild(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: "\n".join(" ".join(rng.choices(["alpha", "beta", "gammaRay", "of", "the", "proofThe"], k=rng.randint(0, 9))) for _ in range(rng.randint(0, 70)))
    files = {f"d/{i}": text() for i in range(8)}
    frame = lambda x: spark.createDataFrame(list(x.items()), "path string, text string")
    index = P.build(frame(files), f"file://{tmp_path}/one")
    for turn in range(3):
        changed = rng.sample(sorted(files), 3)
        for p in changed[:2]:
            files[p] = text()
        del files[changed[2]]
        files[f"e/{turn}"] = text()
        touched = spark.createDataFrame([(p,) for p in [*changed, f"e/{turn}"]], "path string")
        index = P.refresh(P.opened(spark, index.path), frame(files), touched, f"turn {turn}")
        assert P.refresh(index, frame(files), touched, f"turn {turn}") is index
    anew = P.build(frame(files), f"file://{tmp_path}/two")
    packed = P.compact(index, f"file://{tmp_path}/three")
    terms = lambda i: sorted(map(tuple, i.terms().collect()))
    assert terms(index) == terms(anew) == terms(packed)
    for query in ("alpha ray", '"of the" beta -gamma', '"the proof"'):
        hits = [sorted(tuple(r)[:7] for r in P.ranked(i, query).collect()) for i in (index, anew, packed)]
        direct = sorted((r.path, r.start, r.end, r.anchored, r.n_tokens, r.score, r.milli) for r in S.ranked(frame(files).withColumn("doc_id", F.lit(1)), query).collect())
        assert hits[0] == hits[1] == hits[2] == direct
    P.drop(index)
    assert not (tmp_path / "one").exists()


def test_search_by_index_reads_no_text(spark, tmp_path):
    index = P.build(spark.createDataFrame([("a", "one two"), ("b", "two three")], "path string, text string"), f"file://{tmp_path}/index")
    plan = P.measured(index, T.parse_query("one"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert "text" not in plan and "tokens:array" not in plan


def test_declared_spans_are_units(spark):
    text = "\n".join(f"line{i} word" for i in range(1, 61))
    files = spark.createDataFrame([(1, "p", text)], "doc_id long, path string, text string")
    nodes = spark.createDataFrame([("a", "p", 3, 5, "range"), ("b", "p", 4, None, None), ("c", "p", 1, 2, "file"), ("d", "p", 59, 99, "node"), ("e", "p", 61, 70, "range"), ("f", "p", 1, 56, "range")], "id string, path string, line_start int, line_end int, watch string")
    got = {(r.start, r.end, r.anchored) for r in S.units(files, N.declared(nodes)).collect()}
    assert got == {(3, 5, True), (4, 4, True), (59, 60, True), (1, 56, True), (49, 60, False)}
    tests = spark.createDataFrame([("p", 4, 4)], "path string, start int, end int")
    got = {(r.start, r.end): r.n_tokens for r in S.units(files, N.declared(nodes), tests).collect()}
    assert got == {(59, 60): 4, (1, 56): 110, (49, 60): 24}  # spans that touch a test section are no units
    hits = spark.createDataFrame([("p", 10, 12), ("p", 4, 4)], "path string, span_start int, span_end int")
    near = {(r.span_start, r.node_id) for r in N.attached(hits, nodes.where("id <> 'f'")).collect()}
    assert near == {(10, "c"), (4, "a"), (4, "b")}


@pytest.mark.parametrize(("line", "expected"), [(3, (2, 4)), (6, (5, 6)), (1, (1, 1)), (8, (8, 90)), (60, (20, 99))])
def test_sections(spark, line, expected):
    lines = ["a", "# b", "c", "d", "module e", "f", "", *["x"] * 120]
    row = spark.createDataFrame([(lines, line)], "lines array<string>, line int").select(N.section(F.col("lines"), F.col("line")).alias("s")).first().s
    start = line - next((o for o in range(41) if o == 40 or line - o <= 1 or not lines[line - o - 2] or lines[line - o - 1].startswith(("#", "module "))), 0)
    end = line
    while end < len(lines) and end - start + 1 < 80 and lines[end] and not lines[end].startswith(("#", "module ")):
        end += 1
    assert tuple(row) == (start, end)


def plain_extent(text: str, start: int) -> int:
    stack, quote, i, brace = [], "", start, False
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if two == "//" and not quote:
            i = text.find("\n", i)
            if i < 0:
                return -1
        elif two == "/*" and not quote:
            i = text.find("*/", i + 2)
            if i < 0:
                return -1
            i += 1
        elif quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            stack.append(c)
            brace |= c == "{"
        elif c in ")]}":
            if stack and stack[-1] + c in ("()", "[]", "{}"):
                stack.pop()
                if c == "}" and brace and not stack:
                    return i
        elif c == ";" and not stack:
            return i
        i += 1
    return -1


def test_scanner_equals_a_plain_automaton(spark):
    rng = random.Random(8)
    parts = ["{", "}", "(", ")", "[", "]", ";", '"', "'", "`", "\\", "//", "/*", "*/", "\n", "\n\n", " ", "é", "x", "# c\n", "{}", '"a"', "/*/"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)] + ["", "\n", "// only\n", "x" + "(" * 40 + ")" * 40 + ";"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    marks = spark.createDataFrame([(str(i), n) for i, t in enumerate(texts) for n in range(0, min(6, t.count("\n") + 3))], "path string, line int")
    got = {(r.path, r.line): (r.start, r.end, r.error) for r in X.structural_spans(files, marks).collect()}
    for (path, line), found in got.items():
        text = texts[int(path)]
        lines = text.split("\n")
        count = len(lines) - (lines[-1] == "")
        code = [n for n in range(line + 1, count + 1) if (s := lines[n - 1].strip(" \t\r\x0b\x0c")) and not s.startswith(X.COMMENTS)]
        if not 1 <= line <= count:
            expected = (None, None, X.OUTSIDE)
        elif not code:
            expected = (None, None, X.NOTHING)
        else:
            begin = sum(len(x) + 1 for x in lines[: code[0] - 1])
            end = plain_extent(text, begin)
            expected = (code[0], text.count("\n", 0, end) + 1, None) if end >= 0 else (None, None, X.OPEN)
        assert found == expected, (text, line)
    assert len(got) == marks.count()


@pytest.mark.parametrize(("attribute", "test"), [("#[test]", True), ("  #[tokio::test(flavor = \"x\")]", True), ("#[cfg(test)]", True), ("#[cfg(all(test, unix))]", True), ("#[cfg(not(test))]", False), ("#[rstest]", True), ("#[testing]", False), ("#[cfg(feature = \"contest\")]", False), ("#[inline]", False)])
def test_test_attributes(spark, attribute, test):
    text = f"use x;\n#[allow(a)]\n{attribute}\n// why\nfn f() {{\n  g('}}');\n}}\nfn h() {{}}\n"
    got = [tuple(r) for r in X.test_ranges(spark.createDataFrame([("a.rs", text + "// test"), ("a.py", text)], "path string, text string")).collect()]
    assert got == ([("a.rs", 2, 7)] if test else [])


def test_declaration_blocks(spark):
    text = "-- @anchor a\n\ntheorem x :=\n  by\n\n  -- @anchor inner\n  simp\n\n-- @anchor b\n/- no code"
    marks = spark.createDataFrame([("f", n) for n in (1, 6, 9, 10, 11)], "path string, line int")
    got = {r.line: (r.start, r.end) for r in X.declaration_spans(spark.createDataFrame([("f", text)], "path string, text string"), marks).collect()}
    assert got == {1: (3, 7), 6: (7, 7), 9: (10, 10), 10: (None, None), 11: (None, None)}


def test_records(spark):
    docs = [("w", '{"items": [{"id": "a", "n": 1, "x": [1]}, {"id": "b"}]}'), ("l", '[{"id": "c"}]'), ("s", '{\n  "id": "d",\n "n": 7}'), ("bad", '{"id": '), ("no", "[1]"), ("none", '{"n": 1}'), ("null", '{"id": null}'), ("type", '[{"id": "e", "n": "x"}]'), ("empty", "[]"), ("nil", None)]
    files = spark.createDataFrame(docs, "path string, text string")
    got = {(r.path, r.place): (r.line, r.id, r.n, r.other) for r in D.records(files, "items", {"id": "string", "n": "int"}).collect()}
    assert got == {("w", 0): (None, "a", 1, '{"x":"[1]"}'), ("w", 1): (None, "b", None, "{}"), ("l", 0): (None, "c", None, "{}"), ("s", 0): (2, "d", 7, "{}")}
    faults = {r.path: r.message for r in D.record_errors(files, "items", {"id": "string", "n": "int"}).collect()}
    assert faults == {"bad": "not JSON", "no": "a record isn't an object", "none": "missing field id", "null": "missing field id", "type": "field n isn't int", "nil": "not JSON"}
    raw = spark.createDataFrame([("a", b"ok"), ("b", b"\x00"), ("c", b"\xff"), ("d", b"x" * 9)], "path string, content binary")
    assert {(r.path, r.code) for r in D.read_faults(raw, 8).collect()} == {("b", "source-binary"), ("c", "source-encoding"), ("d", "source-size")}


def test_packet(spark):
    text = "\n".join(f"l{i}" for i in range(1, 21))
    files = spark.createDataFrame([("p", text), ("q", text), ("r", "\n\n")], "path string, text string")
    rows = [("p", 1, 3, 0, 0, ["a"]), ("p", 4, 5, 0, 1, ["b"]), ("p", 9, 9, 0, 2, ["c"]), ("p", 2, 4, 1, 0, ["d"]), ("q", 1, K.LAST_LINE, 2, 0, ["e"]), ("r", 1, 2, 0, 9, ["f"]), ("q", 30, 31, 0, 5, ["g"]), ("p", 1, K.LAST_LINE, 0, 0, ["h"])]
    requests = spark.createDataFrame([(*r, [f"ref {r[5][0]}"], False) for r in rows], "path string, start long, end long, priority int, ord long, nodes array<string>, references array<string>, matched boolean")
    tests = spark.createDataFrame([("p", 2, 2)], "path string, start int, end int")
    got = K.packet(requests, files, 60, 0, tests)
    taken = [(r.path, r.start, r.end, r.nodes, r.text) for r in got["taken"].orderBy("path", "start").collect()]
    assert taken == [("p", 1, 1, ["a", "b"], "l1"), ("p", 3, 5, ["a", "b", "d"], "l3\nl4\nl5"), ("p", 9, 9, ["c"], "l9")]
    assert [tuple(r) for r in got["outside"].collect()] == [("q", 30, 31)] and got["omitted"].collect() == []


def test_equal_ranges_are_one(spark):
    from loomwork.operators import intervals as I

    rows = [("p", 1, 1), ("p", 7, 9), ("p", 7, 9), ("p", 7, 9), ("p", 8, 9)]
    got = [tuple(r) for r in I.merged(spark.createDataFrame(rows * 3, "p string, s int, e int"), "p", "s", "e").collect()]
    assert sorted(got) == [("p", 1, 1, 3), ("p", 7, 9, 12)]


def test_nodes_of_one_place(spark):
    """Declarations that share id, file and line: one with a target comes first, of others the first row, for the last location too."""
    at = lambda end: ("o", 1, end, "range")
    rows = [("a", 1, None, "k0", at(3), ["N"], None, "annotation", "o", 1, 0, 7), ("a", 1, None, "k1", at(1), ["R"], None, "annotation", "o", 1, 0, 5),
        ("b", 1, None, None, None, ["N"], None, "annotation", "o", 1, 0, 1), ("b", 1, "file://s/2", "k", None, ["A"], None, "annotation", "o", 1, 0, 2),
        ("c", 1, "t", None, at(9), ["S"], None, "sidecar", "p", None, 1, 0), ("c", 1, None, None, at(1), ["N"], None, "annotation", "o", 1, 0, 3), ("c", 1, None, None, at(2), ["N"], None, "annotation", "o", 1, 0, 4)]
    schema = f"id string, version int, target string, kind string, location {A.LOCATION}, tags array<string>, attributes map<string,string>, source string, file string, line int, ord long, row long"
    for order in (rows, rows[::-1]):
        found = {r["id"]: r for r in A.first_nodes(spark.createDataFrame(order, schema).coalesce(1)).collect()}
        assert (found["a"]["note"]["kind"], found["a"]["note"]["location"]["line_end"], found["a"]["note_location"]["line_end"]) == ("k1", 1, 1)
        assert found["b"]["note"]["target"] == "file://s/2"
        assert found["c"]["note_location"]["line_end"] == 1


def test_refresh_of_one_part_reads_no_other(spark):
    """The edges after a change, though the fragments of all other tables can't be read."""
    bad = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("id"))
    schema = "owner string, src string, dst string, kind string, attributes map<string,string>, source string, file string, line int, ord long"
    row = lambda src, file, line: (None, src, "z", "k", None, "annotation", file, line, 0)
    kept, went, came = row("a", "f", 1), row("b", "g", 1), row("c", "g", 2)
    side = lambda *edges: A.Fragments(bad, bad, bad, spark.createDataFrame(list(edges), schema))
    old, new = side(kept, went), side(kept, came)
    table = A.Assembled(bad, bad, bad, A.distinct_first(old.edges, A.EDGE_KEY))
    found = A.refresh(table, old, new, spark.createDataFrame([("g",)], "file string"), ("edges",)).edges
    assert sorted(r["src"] for r in found.collect()) == ["a", "c"]


def test_declarations_of_many_markers(spark):
    """A file with thousands of markers, each of which ends the one before; lines were gone through for each marker before."""
    n = 4000
    text = "\r\n".join(line for k in range(n) for line in (f"// @anchor a{k}", f"let a{k};", ""))
    marks = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 3 + 1).cast("int").alias("line"))
    got = X.declaration_spans(spark.createDataFrame([("f", text), ("g", "")], "path string, text string"), marks.union(spark.createDataFrame([("g", 1), ("f", 3 * n + 1)], "path string, line int")))
    rows = {(r.path, r.line): (r.start, r.end, r.error) for r in got.collect()}
    assert rows == {("f", 3 * k + 1): (3 * k + 2, 3 * k + 2, None) for k in range(n)} | {("g", 1): (None, None, X.OUTSIDE), ("f", 3 * n + 1): (None, None, X.OUTSIDE)}


def test_test_sections_read_files_once(spark):
    """Each file is read once for its marks and its sections; it was read for either before."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    text = "use x;\n#[inline]\n  # [ test ]\nfn a() { '}' }\n#[cfg(not(test))]\nfn b() {}\n#\t[cfg(all(x, test))]\nmod t { {} }\nfn c() {}"
    files = spark.createDataFrame([("a.rs", text), ("b.rs", "#[testing]\nfn d() {}")], "path string, text string").mapInArrow(read, "path string, text string")
    assert sorted(tuple(r) for r in X.test_ranges(files).collect()) == [("a.rs", 2, 4), ("a.rs", 7, 8)]
    assert seen.value == 2
