"""Changes to tables, reviews, rendering, readers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwork.operators import catalog, graph, records, rendering, review
from loomwork.sources import tables


def test_catalog(spark):
    t = spark.createDataFrame([("a", ["x"]), ("b", None)], "id string, tags array<string>")
    more = spark.createDataFrame([("c", ["z"])], t.schema)
    assert catalog.added(t, more, ["id"]).count() == 3
    with pytest.raises(ValueError, match="unique"):
        catalog.added(t, t.limit(1), ["id"])
    with pytest.raises(ValueError, match="unique"):
        catalog.added(t, more.union(more), ["id"])
    new = catalog.updated(t, F.col("id") == "b", {"tags": catalog.edited_tags(F.col("tags"), ["y", "x"], ["y"])})
    assert {r.id: r.tags for r in new.collect()} == {"a": ["x"], "b": ["x"]}
    ids = spark.createDataFrame([("a",)], "id string")
    members = spark.createDataFrame([("H", "a"), ("H", "b")], "hyperedge_id string, node_id string")
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k")], "src string, dst string, kind string")
    assert [(r.id, r.n) for r in catalog.references(ids, members, edges).collect()] == [("a", 2)]
    m, e = catalog.cascaded(ids, members, edges)
    assert [r.node_id for r in m.collect()] == ["b"] and [r.src for r in e.collect()] == ["b"]
    assert catalog.removed(t, ids, "id").count() == 1
    lines = spark.createDataFrame([("f", 1, "// @anchor x lines=2-8 kind=a"), ("f", 2, "plain lines=2")], "path string, line_no int, text string")
    assert [(r.text, r.changed) for r in catalog.dynamic_locations(lines).orderBy("line_no").collect()] == [("// @anchor x kind=a", True), ("plain lines=2", False)]


def test_review(spark):
    shown = spark.createDataFrame([("a", True, "f"), ("b", False, "g"), ("e", True, "f")], "node_id string, required boolean, path string")
    files = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3")], "path string, hash string")
    r = review.start("R", shown, files)
    none = spark.createDataFrame([], "review_id string, node_id string, disposition string, note string")
    with pytest.raises(ValueError, match=r"missing \(2\)"):
        review.complete(r["nodes"], r["files"], none, files)
    rows = spark.createDataFrame([("R", "a", "ok", ""), ("R", "e", "ok", "")], none.schema)
    done = review.recorded(none, rows, r["nodes"], ["ok"])
    review.complete(r["nodes"], r["files"], done, files)
    changed = files.withColumn("hash", F.when(F.col("path") == "f", "9").otherwise(F.col("hash")))
    with pytest.raises(ValueError, match="drift"):
        review.complete(r["nodes"], r["files"], done, changed)
    review.complete(r["nodes"], r["files"], done, changed, allow_drift=True)
    with pytest.raises(ValueError, match="part of the review"):
        review.recorded(done, spark.createDataFrame([("R", "zz", "ok", "")], none.schema), r["nodes"])
    again = review.recorded(done, spark.createDataFrame([("R", "a", "later", "n")], none.schema), r["nodes"])
    assert sorted((x.node_id, x.disposition) for x in again.collect()) == [("a", "later"), ("e", "ok")]


def test_rendering(spark):
    rows = spark.createDataFrame([("a.md", 1, 2, "markdown", "x\n```y```", 1), ("b.py", None, None, None, "z", 2)], "path string, start int, end int, language string, source string, ord int")
    text = rendering.packet(rows, spark.createDataFrame([("H", "a", None), ("H", "b", "r")], "hyperedge_id string, node_id string, role string"))
    assert "### a.md#L1-L2\n\n````markdown\nx" in text and "### b.py\n" in text and "- H: b (r)" in text
    assert "1 more excerpts" in rendering.packet(rows, k=1)


def test_policies_and_merge(spark):
    members = spark.createDataFrame([("H", "a", "r", False), ("H", "b", None, True), ("H", "c", "x", None)], "hyperedge_id string, node_id string, role string, required boolean")
    active = spark.createDataFrame([("H",)], "hyperedge_id string")
    policy = spark.createDataFrame([("H", ["r", "x"], ["x"])], "hyperedge_id string, include_roles array<string>, exclude_roles array<string>")
    assert [r.node_id for r in graph.expand_members(active, members, policy).collect()] == ["a"]
    assert sorted(r.node_id for r in graph.expand_members(active, members, include_optional=False).collect()) == ["b", "c"]


def test_node_merge(spark):
    schema = "id string, target string, kind string, location string, tags array<string>, attributes string"
    side = spark.createDataFrame([("n", None, "function", None, ["x"], "owner")], schema)
    source = spark.createDataFrame([("n", "t", "k2", "L", ["y"], "z")], schema)
    assert [tuple(r) for r in records.merged_nodes(side, source).collect()] == [("n", "t", "function", "L", ["x", "y"], "owner")]


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    rows = tables.text_files(spark, str(tmp_path)).collect()
    assert [(r.path, r.size, r.text) for r in rows] == [("d/a.txt", 8, "one\ntwo\n")]
    df = spark.createDataFrame([(1, "x")], "n int, k string")
    tables.write_table(df, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_the_rest_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    from conftest import REPO

    for name in ("loomwork", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "loomwork" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "0" and int(said.stdout.split()[0]) > 50, said.stderr
