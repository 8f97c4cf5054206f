"""Impact of a change set over orders as files, their items as nodes, and parts as hyperedges with policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impact as M
from ..sources.tables import table
from .graph_plans import _SPANS, spans

WINDOW = ("1995-01-01", "1995-01-10")


def graph(spark, sf_dir) -> M.Graph:
    s = spans(spark, sf_dir).withColumn("seq", F.col("l_orderkey") * 10 + F.col("line_start"))
    part = table(spark, sf_dir, "part")
    live = F.col("l_linestatus") == "O"
    annotation = lambda at: [F.lit("annotation").alias("source"), F.col("path").alias("declared_in"), at.cast("int").alias("declared_at")]
    either = lambda own, side, at: [F.when(own, "annotation").otherwise("sidecar").alias("source"), F.when(own, F.col("path")).otherwise(side).alias("declared_in"), F.when(own, at).cast("int").alias("declared_at")]
    nodes = s.select("id", "path", "line_start", "line_end", "watch", *either(live, F.concat(F.lit("decl/"), "l_suppkey"), F.col("line_start")))
    size, none = F.col("p_size"), F.lit(None)
    hyperedges = part.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.array("p_type", "p_brand").alias("tags"), F.when(size % 3 == 0, F.array(F.lit("A"), F.lit("N"))).alias("include_roles"), F.when(size % 3 == 1, F.array(F.lit("R"))).alias("exclude_roles"),
        F.when(F.col("p_brand").endswith("1"), F.array(F.lit("A"))).alias("follow_relations"), F.when(size > 45, 2).when(size < 10, 0).alias("depth"), F.lit("sidecar").alias("source"), F.concat_ws("/", F.lit("parts"), "p_brand", "p_size").alias("declared_in"), none.cast("int").alias("declared_at"),
    )
    members = s.select("seq", F.concat(F.lit("p"), "l_partkey").alias("hyperedge_id"), F.col("id").alias("node_id"), F.col("l_returnflag").alias("role"), live.alias("required"), *annotation(F.col("line_start") + 1))
    after = F.concat_ws(":", "l_orderkey", F.col("line_start") + 1)
    edges = s.select("seq", F.concat(F.lit("p"), "l_partkey").alias("owner"), F.col("id").alias("src"), after.alias("dst"), F.col("l_returnflag").alias("kind"), *either(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("edges/"), "l_suppkey"), F.col("line_start")))
    return M.Graph(nodes, hyperedges, members, edges)


def changes(spark, sf_dir):
    """Orders shipped in ten days changed in lines, every fiftieth as a whole, every seventh was another order before, and every
    twentieth is deleted; declarations of parts, items and edges changed as well, and files that nothing is declared in."""
    hit = spans(spark, sf_dir).where(F.col("l_shipdate").between(*[F.lit(x).cast("timestamp") for x in WINDOW]))
    r = F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    k = F.col("l_orderkey")
    rows = hit.groupBy(k.alias("ord"), "path").agg(F.collect_set(r).alias("ranges"))
    k = F.col("ord")
    rows = rows.select("ord", "path", F.when(k % 7 == 0, (k + 1).cast("string")).alias("old_path"), F.when(k % 20 == 0, "deleted").when(k % 7 == 0, "renamed").otherwise("modified").alias("status"), (k % 50 == 0).alias("whole_file"), "ranges")
    t = lambda name: table(spark, sf_dir, name)
    plain = lambda df, order, path: df.select(order.cast("long").alias("ord"), path.alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status"), F.lit(False).alias("whole_file"), F.array().cast(rows.schema["ranges"].dataType).alias("ranges"))
    parts = t("part").where("p_brand = 'Brand#7' AND p_size < 12").groupBy("p_brand", "p_size").count()
    rows = rows.union(plain(parts, F.lit(10**12) + F.col("p_size"), F.concat_ws("/", F.lit("parts"), "p_brand", "p_size")))
    rows = rows.union(plain(t("supplier").where("s_nationkey = 3"), F.lit(2 * 10**12) + F.col("s_suppkey"), F.concat(F.lit("decl/"), "s_suppkey")))
    rows = rows.union(plain(t("supplier").where("s_nationkey = 4"), F.lit(3 * 10**12) + F.col("s_suppkey"), F.concat(F.lit("edges/"), "s_suppkey")))
    return rows.union(plain(t("customer").where("c_mktsegment = 'BUILDING'"), F.lit(4 * 10**12) + F.col("c_custkey"), F.concat(F.lit("c"), "c_custkey")))


def removed(spark, sf_dir):
    """Removed lines of every fifth order: three annotations, or, where the file is deleted, a document of declarations."""
    k = F.col("ord")
    rows = changes(spark, sf_dir).where((k < 10**12) & (k % 5 == 0)).select("path", k.cast("string").alias("k"), (k % 20 == 0).alias("gone"))
    doc = F.array(
        F.concat(F.lit('{"strands": [{"id": "q'), "k", F.lit('", "members": [{"anchor": "'), "k", F.lit(':1", "role": "w"}, {"anchor": "lost'), "k", F.lit('", "role": "x"}],')),
        F.concat(F.lit('"on_change": {"exclude_roles": ["x"]}, "relations": [{"from": "'), "k", F.lit(':1", "to": "far'), "k", F.lit('", "kind": "A"}]}],')),
        F.concat(F.lit('"anchors": [{"id": "'), "k", F.lit(':2"}]}')),
    )
    notes = F.array(F.concat(F.lit("// @anchor gone."), "k"), F.concat(F.lit("// @strand x"), "k", F.lit(" role=lost")), F.lit("// plain"))
    return rows.select("path", F.posexplode(F.when(F.col("gone"), doc).otherwise(notes)).alias("line", "text"))


def _query(part, columns, with_removed, **options):
    def run(spark, sf_dir):
        lines = removed(spark, sf_dir) if with_removed else None
        return M.impact(graph(spark, sf_dir), changes(spark, sf_dir), lines, parts=(part,), **options)[part].select(*columns)

    return run


_REASONS, _MEMBERS = ["id", "reason", "direct"], ["hyperedge_id", "node_id", "role", "reason", "direct"]


def queries() -> dict:
    return {
        "impact_policy": _query("reasons", _REASONS, False), "impact_policy_members": _query("members", _MEMBERS, False), "impact_kinds": _query("related", _REASONS, False, depth=1, kinds=["R", "N"], include_optional=False),
        "impact_tags": _query("strands", ["hyperedge_id", "direct"], True, tags=["PROMO"]), "impact_deleted": _query("reasons", _REASONS, True), "impact_deleted_members": _query("members", _MEMBERS, True), "impact_untouched": _query("unmatched", ["path"], True),
    }


def _sql(select: str, gone: bool, depth: int | None = None, kinds: list[str] | None = None, optional: bool = True, tag: str | None = None) -> str:
    cut = "" if gone else " WHERE false"
    chosen = ("required AND " if not optional else "") + "(len(coalesce(inc, [])) = 0 OR coalesce(list_contains(inc, role), false)) AND NOT coalesce(list_contains(exc, role), false)"
    follow = f"kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else "(follow IS NULL OR list_contains(follow, kind))"
    lost = f"kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else "true"
    tagged = f"hyperedge_id IN (SELECT id FROM h WHERE list_contains(tags, '{tag}'))" if tag else "true"
    d = str(depth) if depth is not None else "(SELECT coalesce(max(depth), 1) FROM h WHERE id IN (SELECT hyperedge_id FROM act0))"
    expand = lambda of, seen: f"SELECT node_id AS id, 'member of strand ' || min(m.hyperedge_id) AS reason, false AS direct FROM m JOIN h ON h.id = m.hyperedge_id WHERE m.hyperedge_id IN (SELECT hyperedge_id FROM {of}) AND {chosen} AND node_id NOT IN (SELECT id FROM {seen}) GROUP BY node_id"
    hops, seen, active = "", "s0", ["SELECT hyperedge_id, true AS direct FROM act0"]
    front = "s0"
    for i in (1, 2):
        hops += f""", n{i} AS MATERIALIZED (SELECT st.id, min(st.reason) AS reason, false AS direct FROM st JOIN {front} f ON f.id = st.fr WHERE st.id NOT IN (SELECT id FROM {seen}) AND {i} <= {d} GROUP BY st.id),
  b{i} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM n{i}), act{i} AS (SELECT DISTINCT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM n{i}) AND {tagged}),
  x{i} AS MATERIALIZED ({expand(f"act{i}", f"b{i}")}), s{i} AS (SELECT * FROM b{i} UNION ALL SELECT * FROM x{i}), f{i} AS (SELECT id FROM n{i} UNION ALL SELECT id FROM x{i})"""
        seen, front = f"s{i}", f"f{i}"
        active.append(f"SELECT hyperedge_id, false FROM act{i}")
    return f"""WITH {_SPANS}, i AS (SELECT *, l_orderkey * 10 + line_start AS seq FROM s),
  n AS (SELECT id, path, line_start, line_end, watch, CASE WHEN l_linestatus = 'O' THEN path ELSE 'decl/' || l_suppkey END AS din, CASE WHEN l_linestatus = 'O' THEN line_start END AS dat FROM i),
  h AS (SELECT 'p' || p_partkey AS id, [p_type, p_brand] AS tags, CASE WHEN p_size % 3 = 0 THEN ['A', 'N'] END AS inc, CASE WHEN p_size % 3 = 1 THEN ['R'] END AS exc, CASE WHEN p_brand LIKE '%1' THEN ['A'] END AS follow,
    CASE WHEN p_size > 45 THEN 2 WHEN p_size < 10 THEN 0 END AS depth, 'parts/' || p_brand || '/' || p_size AS din FROM part),
  m AS (SELECT seq, 'p' || l_partkey AS hyperedge_id, id AS node_id, l_returnflag AS role, l_linestatus = 'O' AS required, path AS din, line_start + 1 AS dat FROM i),
  e AS (SELECT seq, 'p' || l_partkey AS owner, id AS src, l_orderkey || ':' || (line_start + 1) AS dst, l_returnflag AS kind, CASE WHEN l_suppkey % 2 = 0 THEN path ELSE 'edges/' || l_suppkey END AS din, CASE WHEN l_suppkey % 2 = 0 THEN line_start END AS dat FROM i),
  o AS (SELECT l_orderkey AS k, path, list(DISTINCT {{'a': line_start, 'b': line_end}}) AS ranges FROM i WHERE l_shipdate BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}' GROUP BY ALL),
  c AS (SELECT k AS ord, path, CASE WHEN k % 7 = 0 THEN CAST(k + 1 AS VARCHAR) END AS old_path, k % 50 = 0 AS whole, ranges FROM o
    UNION ALL SELECT DISTINCT 1000000000000 + p_size, 'parts/' || p_brand || '/' || p_size, NULL, false, [] FROM part WHERE p_brand = 'Brand#7' AND p_size < 12
    UNION ALL SELECT 2000000000000 + s_suppkey, 'decl/' || s_suppkey, NULL, false, [] FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 3000000000000 + s_suppkey, 'edges/' || s_suppkey, NULL, false, [] FROM supplier WHERE s_nationkey = 4
    UNION ALL SELECT 4000000000000 + c_custkey, 'c' || c_custkey, NULL, false, [] FROM customer WHERE c_mktsegment = 'BUILDING'),
  p AS (SELECT path AS loc, * FROM c UNION ALL SELECT old_path, * FROM c WHERE old_path IS NOT NULL), fst AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY loc ORDER BY ord) = 1),
  hm AS (SELECT m.*, fst.path AS hit FROM m JOIN fst ON loc = din WHERE whole OR len(list_filter(ranges, lambda r: dat BETWEEN r.a AND r.b)) > 0),
  he AS (SELECT e.*, fst.path AS hit FROM e JOIN fst ON loc = din WHERE dat IS NULL OR whole OR len(list_filter(ranges, lambda r: dat BETWEEN r.a AND r.b)) > 0),
  hn AS (SELECT n.*, fst.path AS hit FROM n JOIN fst ON loc = din WHERE dat IS NULL OR whole OR len(list_filter(ranges, lambda r: dat BETWEEN r.a AND r.b)) > 0),
  hh AS (SELECT h.*, fst.path AS hit FROM h JOIN fst ON loc = din),
  hf AS (SELECT n.id, p.ord, p.path AS hit FROM n JOIN p ON p.loc = n.path WHERE whole OR coalesce(watch, 'file') = 'file' OR len(list_filter(ranges, lambda r: r.a <= line_end AND line_start <= r.b)) > 0),
  gone AS (SELECT k, path FROM o WHERE k % 20 = 0{" AND false" if not gone else ""}), note AS (SELECT k, path FROM o WHERE k % 5 = 0 AND k % 20 <> 0{" AND false" if not gone else ""}),
  rs AS (SELECT 'gone.' || k AS id, 'annotation removed from ' || path AS reason, 0 AS rank, 0 AS place FROM note
    UNION ALL SELECT node_id, 'metadata changed in ' || din, 1, seq FROM hm UNION ALL SELECT src, 'relationship metadata changed in ' || din, 2, seq FROM he UNION ALL SELECT dst, 'relationship metadata changed in ' || din, 2, seq FROM he
    UNION ALL SELECT id, 'anchor metadata changed in ' || din, 3, 0 FROM hn UNION ALL SELECT id, hit || ' changed', 4, ord FROM hf
    UNION ALL SELECT k || ':1', 'strand metadata removed from ' || path, 5, 0 FROM gone UNION ALL SELECT 'lost' || k, 'strand metadata removed from ' || path, 5, 0 FROM gone UNION ALL SELECT k || ':2', 'anchor metadata removed from ' || path, 6, 0 FROM gone),
  dir AS MATERIALIZED (SELECT id, max({{'r': rank, 'p': place, 'reason': reason}}).reason AS reason, true AS direct FROM rs GROUP BY id),
  act0 AS MATERIALIZED (SELECT DISTINCT hyperedge_id FROM (SELECT id AS hyperedge_id FROM hh UNION SELECT hyperedge_id FROM hm UNION SELECT owner FROM he UNION SELECT 'q' || k FROM gone UNION SELECT 'x' || k FROM note UNION SELECT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM dir)) WHERE {tagged}),
  s0 AS MATERIALIZED (SELECT * FROM dir UNION ALL {expand("act0", "dir")}),
  ok AS (SELECT src, dst, kind FROM e LEFT JOIN h ON h.id = e.owner WHERE {follow} UNION ALL SELECT k || ':1', 'far' || k, 'A' FROM gone WHERE {lost.replace("kind", "'A'")}),
  st AS MATERIALIZED (SELECT src AS fr, dst AS id, kind || ' relationship from ' || src AS reason FROM ok UNION ALL SELECT dst, src, kind || ' relationship to ' || dst FROM ok){hops},
  sa AS (SELECT hyperedge_id, bool_or(direct) AS direct FROM ({" UNION ALL ".join(active)}) WHERE hyperedge_id IN (SELECT id FROM h UNION SELECT 'q' || k FROM gone UNION SELECT 'x' || k FROM note) GROUP BY hyperedge_id),
  mm AS (SELECT hyperedge_id, node_id, role, required, inc, exc FROM m JOIN h ON h.id = m.hyperedge_id UNION ALL SELECT 'q' || k, k || ':1', 'w', true, NULL, ['x'] FROM gone UNION ALL SELECT 'q' || k, 'lost' || k, 'x', true, NULL, ['x'] FROM gone UNION ALL SELECT 'x' || k, 'gone.' || k, 'lost', true, NULL, NULL FROM note),
  shown AS MATERIALIZED (SELECT DISTINCT hyperedge_id, node_id, role, coalesce(reason, 'member of strand ' || hyperedge_id) AS reason, coalesce(direct, false) AS direct FROM mm LEFT JOIN {seen} z ON z.id = node_id WHERE hyperedge_id IN (SELECT hyperedge_id FROM sa) AND {chosen})
  {select.format(seen=seen)}"""


def oracle_sql() -> dict[str, str]:
    hit = " UNION ".join(f"SELECT hit FROM {x}" for x in ("hm", "he", "hn", "hh", "hf"))
    return {
        "impact_policy": _sql("SELECT id, reason, direct FROM {seen}", False), "impact_policy_members": _sql("SELECT * FROM shown", False),
        "impact_kinds": _sql("SELECT id, reason, direct FROM {seen} WHERE id NOT IN (SELECT node_id FROM shown)", False, 1, ["R", "N"], False),
        "impact_tags": _sql("SELECT hyperedge_id, direct FROM sa", True, tag="PROMO"), "impact_deleted": _sql("SELECT id, reason, direct FROM {seen}", True), "impact_deleted_members": _sql("SELECT * FROM shown", True),
        "impact_untouched": _sql(f"SELECT path FROM c WHERE path NOT IN ({hit} UNION SELECT path FROM gone UNION SELECT path FROM note)", True),
    }
