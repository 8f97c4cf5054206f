"""Plans whose work grows with the input only."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import impact as M
from loomwork.operators import postings as P
from loomwork.operators import search as S
from loomwork.operators import spans as N


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, "a/1", "pour it\n\n# head\nthen this\nthing"), (2, "a/2", "then\r\n"), (3, "a/3", ""), (4, "a/4", "nothing")], "doc_id long, path string, text string")


def test_units_are_made_once(files):
    """F6 F8 F19 F20: texts were cut into lines 83 times in the filter that Spark puts below a generator."""
    shown = plan(S.measured(files, T.parse_query("then thing pour")))
    assert shown.count("split(text") + shown.count("split(coalesce(text") <= 2
    assert "inline" in shown


def test_texts_join_the_hits_of_a_file_once(spark, files):
    """F6 F8 F19 F20: each hit took two copies of its file's text."""
    q = T.parse_query("then thing pour")
    hits = S.ranked(files, q, spans=spark.createDataFrame([("a/1", 1, 1), ("a/1", 4, 5)], "path string, start int, end int"))
    rows = N._with_sections(hits, files, q)
    assert plan(rows).count("Join") == 1
    found = {(r.path, r.start, r.end): (r.anchored, r.line, r._section and tuple(r._section)) for r in rows.collect()}
    assert found == {("a/1", 1, 1): (True, 1, None), ("a/1", 4, 5): (True, 5, None), ("a/1", 1, 5): (False, 1, (1, 1)), ("a/2", 1, 1): (False, 1, (1, 1))}


def test_lines_end(spark):
    rows = spark.createDataFrame([("",), ("\n",), ("a",), ("a\r\n",), ("a\n\n",), (None,)], "t string").select(T.lines(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [[], [""], ["a"], ["a"], ["a", ""], []]


def test_sieve_loses_no_key(spark):
    """F12 F13 F15 to F18: the whole graph was shuffled to meet a few changed paths."""
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("p"), "id").alias("at"))
    rows = spark.range(3000).select("id", F.concat(F.lit("p"), "id").alias("path")).union(spark.createDataFrame([(-1, None)], "id long, path string"))
    left = {r.id for r in M.sifted(rows, "path", M.sieve(keys, "at")).collect()}
    assert left >= set(range(0, 3000, 3)) and -1 not in left and len(left) < 1100
    assert M.sifted(rows, "path", M.sieve(keys.where("false"), "at")).count() == 0


def _graph(spark):
    nodes = [(f"n{i}", f"f{i}", 1, 2, "range", "sidecar", None, None) for i in range(9)]
    hyperedges = [("a", None, None, ["x"], None, 3, "sidecar", "d", None), ("b", None, ["m"], None, None, None, "sidecar", "d", None), ("c", None, None, None, ["k"], None, "sidecar", "d", None)]
    members = [(1, "a", "n0"), (2, "a", "n1"), (3, "b", "n2"), (4, "b", "n3"), (5, "c", "n5"), (6, "u", "n0"), (7, None, "n0"), (8, "a", "n1")]
    edges = [(1, "c", "n1", "n2", "k"), (2, "c", "n3", "n4", "j"), (3, None, "n4", "n3", "k"), (4, None, "n5", "n4", "k"), (5, None, "n6", "n6", "k"), (6, None, "n0", None, "k"), (7, "a", "n0", "n1", "k")]
    tail = "source string, declared_in string, declared_at int"
    return M.Graph(
        spark.createDataFrame(nodes, f"id string, path string, line_start int, line_end int, watch string, {tail}"),
        spark.createDataFrame(hyperedges, f"id string, tags array<string>, include_roles array<string>, exclude_roles array<string>, follow_relations array<string>, depth int, {tail}"),
        spark.createDataFrame([(*m, "x" if m[0] == 1 else "m", True, "sidecar", None, None) for m in members], f"seq long, hyperedge_id string, node_id string, role string, required boolean, {tail}"),
        spark.createDataFrame([(*e, "sidecar", None, None) for e in edges], f"seq long, owner string, src string, dst string, kind string, {tail}"),
    )


def test_levels_see_all_members_and_edges(spark):
    changes = spark.createDataFrame([(1, "f0", None, "modified", True, [])], "ord long, path string, old_path string, status string, whole_file boolean, ranges array<struct<start:int,end:int>>")
    found = M.impact(_graph(spark), changes)
    reasons = {r.id: (r.reason, r.direct) for r in found["reasons"].collect()}
    assert reasons == {
        "n0": ("f0 changed", True), "n1": ("member of strand a", False), None: ("k relationship from n0", False), "n2": ("k relationship from n1", False),
        "n3": ("member of strand b", False), "n4": ("k relationship to n3", False), "n5": ("k relationship to n4", False),
    }
    assert {(r.hyperedge_id, r.direct) for r in found["strands"].collect()} == {("a", True), ("b", False), ("c", False)}
    shown = sorted((r.hyperedge_id, r.node_id, r.role, r.reason) for r in found["members"].collect())
    assert shown == [("a", "n1", "m", "member of strand a"), ("b", "n2", "m", "k relationship from n1"), ("b", "n3", "m", "member of strand b"), ("c", "n5", "m", "k relationship to n4")]
    assert {r.id for r in found["related"].collect()} == {"n0", "n4", None}


def test_unmatched_changes_need_no_traversal(spark):
    """the whole graph was walked for the files that nothing is declared in."""
    changes = spark.createDataFrame([(i, p, None, "modified", True, []) for i, p in enumerate(["f0", "zz"])], "ord long, path string, old_path string, status string, whole_file boolean, ranges array<struct<start:int,end:int>>")
    found = M.impact(_graph(spark), changes, parts=("unmatched",))
    assert set(found) == {"unmatched"} and [r.path for r in found["unmatched"].collect()] == ["zz"]


def test_index_has_a_row_for_each_term_of_a_unit(spark, tmp_path):
    """F9 F10 F11 F14: each occurrence was a row with its unit's path and numbers."""
    files = spark.createDataFrame([("a", "one two one\nthree one"), ("b", ""), ("c", "two\u00e9 one")], "path string, text string")
    index = P.build(files, f"file://{tmp_path}/index")
    assert {"path", "pos"}.isdisjoint(index.postings().columns)
    rows = index.postings().join(index.places(), ["segment", "unit"]).select("path", "term", "positions").collect()
    assert sorted(map(tuple, rows)) == [("a", "one", [0, 2, 4]), ("a", "three", [3]), ("a", "two", [1]), ("c", "one", [1]), ("c", "two\u00e9", [0])]
    index = P.refresh(index, files.where("path <> 'a'"), spark.createDataFrame([("a",)], "path string"), "gone")
    assert sorted((r.term, r.positions) for r in index.postings().collect()) == [("one", [1]), ("two\u00e9", [0])]
    assert P.ranked(index, "one two").select("path").collect()[0].path == "c"
    P.drop(index)
