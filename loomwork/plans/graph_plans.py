"""Graph and range queries: hypergraphs over orders, parts and suppliers, and the geography of nations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import intervals as I
from ..sources.tables import table

WINDOW = ("1995-01-01", "1995-02-01")


def geography(spark, sf_dir):
    """(src, dst, kind): where customers, suppliers and nations belong."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(kind).alias("kind"))
    return e(t("customer"), "c", "c_custkey", "n", "c_nationkey", "located-in").union(e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "located-in")).union(e(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "part-of"))


def graph_bfs(spark, sf_dir):
    return G.levels(spark.createDataFrame([("c1",), ("s2",)], "id string"), geography(spark, sf_dir), 3).select("id", F.col("level").cast("long"))


def graph_bfs_kind(spark, sf_dir):
    return G.levels(spark.createDataFrame([("r1",)], "id string"), geography(spark, sf_dir), 2, ["part-of"]).select("id", F.col("level").cast("long"))


def graph_edges_within_depth(spark, sf_dir):
    edges = geography(spark, sf_dir)
    return G.touched_edges(G.levels(spark.createDataFrame([("c1",), ("s2",)], "id string"), edges, 2), edges, 2)


def spans(spark, sf_dir):
    """Nodes with lines: each item of an order spans a few lines of the order's file."""
    last = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3
    watch = F.when(F.col("l_linestatus") == "O", "range").when(F.col("l_returnflag") == "A", "file")
    return table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line_start"), last.alias("line_end"), watch.alias("watch"), "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")


def changes(spark, sf_dir):
    """Orders with items shipped in a month have changed lines, every fiftieth of them as a whole; files of builders have
    changed as well, of which there are no nodes."""
    hit = spans(spark, sf_dir).where(F.col("l_shipdate").between(*[F.lit(x).cast("timestamp") for x in WINDOW]))
    r = F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    hit = hit.groupBy("path").agg(F.lit(None).cast("string").alias("old_path"), F.max(F.col("l_orderkey") % 50 == 0).alias("whole_file"), F.collect_set(r).alias("ranges"))
    other = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(True).alias("whole_file"))
    return hit.unionByName(other, allowMissingColumns=True)


def parts(spark, sf_dir):
    """Members: a supplier's hyperedge holds the items of it; roles are return flags, open items are required."""
    return spans(spark, sf_dir).select(F.concat(F.lit("s"), "l_suppkey").alias("hyperedge_id"), F.col("id").alias("node_id"), F.col("l_returnflag").alias("role"), (F.col("l_linestatus") == "O").alias("required"))


def links(spark, sf_dir):
    """Edges: from an item to the next of its order."""
    s = spans(spark, sf_dir)
    return s.select(F.col("id").alias("src"), F.concat_ws(":", "l_orderkey", F.col("line_start") + 1).alias("dst"), F.lit("next").alias("kind"))


def policies(spark, sf_dir):
    p = parts(spark, sf_dir).select("hyperedge_id").distinct()
    even = F.substring("hyperedge_id", 2, 20).cast("long") % 20 == 0
    return p.select("hyperedge_id", F.when(even, F.array(F.lit("A"), F.lit("N"))).alias("include_roles"), F.when(~even, F.array(F.lit("R"))).alias("exclude_roles"))


def _impact(part, columns, depth=2):
    def run(spark, sf_dir):
        found = G.impact(changes(spark, sf_dir), spans(spark, sf_dir), parts(spark, sf_dir), links(spark, sf_dir), depth, policies=policies(spark, sf_dir))
        return found[part].select(*columns)

    return run


def role_policy_filter(spark, sf_dir):
    rows = parts(spark, sf_dir).join(policies(spark, sf_dir), "hyperedge_id")
    return rows.where(G.member_selected(F.col("role"), F.col("required"), F.col("include_roles"), F.col("exclude_roles"), False)).select("hyperedge_id", "node_id", "role")


def policy_depth(spark, sf_dir):
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(prio <= 3, prio)), F.lit(1)).cast("long").alias("depth"))
    return rows


def _seeds(spark, sf_dir):
    s = spans(spark, sf_dir).where(F.col("l_shipdate").between(*[F.lit(x).cast("timestamp") for x in WINDOW]))
    return s.select("id", F.lit("selected").alias("reason"), (F.col("line_start") % 2 == 0).alias("from_search")).distinct()


def _context(part, columns, any_search):
    def run(spark, sf_dir):
        named = spark.createDataFrame([("s10",), ("s20",)], "hyperedge_id string")
        found = G.context(_seeds(spark, sf_dir), named, parts(spark, sf_dir), links(spark, sf_dir), 1, any_search=any_search)
        return found[part].select(*columns).distinct()

    return run


def context_vs_impact_policy(spark, sf_dir):
    """Members that a context shows and the policies of an impact would leave out."""
    shown = _context("members", ["hyperedge_id", "node_id", "role"], True)(spark, sf_dir)
    allowed = G.expand_members(shown, parts(spark, sf_dir), policies(spark, sf_dir)).select("hyperedge_id", "node_id", "role")
    return shown.exceptAll(allowed)


def packet_merge(spark, sf_dir):
    p = parts(spark, sf_dir).select("hyperedge_id", "node_id", "role").distinct()
    n = F.substring_index("node_id", ":", 1).cast("long")
    one = p.where(n % 2 == 0).select("*", F.lit(True).alias("direct"), F.lit("diff").alias("reason"))
    two = p.where((n % 2 == 1) | (n % 3 == 0)).select("*", (n % 5 == 0).alias("direct"), F.lit("search").alias("reason"))
    return G.merged_packets(one, two)


def range_overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    a = s.where("l_returnflag = 'A'").select("path", F.col("id").alias("a"), F.col("line_start").alias("s1"), F.col("line_end").alias("e1"))
    b = s.where("l_returnflag <> 'A'").select("path", F.col("id").alias("b"), F.col("line_start").alias("s2"), F.col("line_end").alias("e2"))
    return I.overlap_join(a, b, "path", ("s1", "e1"), ("s2", "e2"), bin_lines=4).select("path", "a", "b")


def containment_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    a = s.select("path", F.col("id").alias("a"), F.col("line_start").alias("s1"), F.col("line_end").alias("e1"))
    b = s.where("watch = 'range'").select("path", F.col("id").alias("b"), F.col("line_start").alias("s2"), F.col("line_end").alias("e2"))
    return I.containing_join(a, b, "path", ("s1", "e1"), ("s2", "e2")).where("a <> b").select("path", "a", "b")


def smallest_enclosing(spark, sf_dir):
    s = spans(spark, sf_dir)
    points = s.select("path", (F.col("line_start") + 1).alias("line")).distinct()
    out = I.smallest_enclosing(points, s.select("path", "line_start", "line_end", "id"), "path", "line", ("line_start", "line_end"), "id")
    return out.select("path", F.col("line").cast("long"), "id")


def merge_intervals(gap):
    def run(spark, sf_dir):
        out = I.merged(spans(spark, sf_dir), "path", "line_start", "line_end", gap)
        return out.select("path", F.col("line_start").cast("long"), F.col("line_end").cast("long"), "n_ranges")

    return run


def subtract_intervals(spark, sf_dir):
    s = spans(spark, sf_dir)
    whole = s.groupBy("path").agg(F.min("line_start").alias("a"), F.max("line_end").alias("b"))
    out = I.subtracted(whole, s.where("l_returnflag = 'R'").select("path", "line_start", "line_end"), "path", ("a", "b"), ("line_start", "line_end"))
    return out.select("path", F.col("piece_start").cast("long"), F.col("piece_end").cast("long"))


def graph_to_dot(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label")).union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.col("r_name")))
    edges = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("part-of").alias("kind"), (F.col("n_nationkey") % 2 == 0).alias("bidirectional"))
    return G.dot_lines(nodes, edges)


def graph_to_mermaid(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # numbers are needed over the whole (small, exported) graph, so they come from ranks within each kind
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("key")) - 1
    nodes = t("nation").select(F.lit("n").alias("kind"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")).union(t("region").select(F.lit("r"), "r_regionkey", "r_name"))
    nodes = nodes.withColumn("name", F.concat("kind", rank.cast("string")))
    lines = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), "name", F.lit('["'), "label", F.lit('"]')).alias("line"))
    at = lambda k, c, n: nodes.where(F.col("kind") == k).select(F.col("key").alias(c), F.col("name").alias(n))
    e = t("nation").join(at("n", "n_nationkey", "a"), "n_nationkey").join(at("r", "n_regionkey", "b"), "n_regionkey")
    return lines.union(e.select(F.lit(2), F.concat(F.lit("  "), "a", F.lit(" -->|part-of| "), "b")))


def queries() -> dict:
    return {
        "graph_bfs": graph_bfs, "graph_bfs_kind": graph_bfs_kind, "graph_edges_within_depth": graph_edges_within_depth,
        "impact_direct": _impact("direct", ["id", "path"]), "impact_expand": _impact("members", ["hyperedge_id", "node_id", "role"], 1), "impact_hops": _impact("reached", ["id"]),
        "impact_reason": _impact("reached", ["id", "reason"], 1), "impact_related": _impact("related", ["id"]), "impact_unmatched": _impact("unmatched", ["path"], 0),
        "context_seeds": _context("reached", ["id"], True), "context_members": _context("members", ["hyperedge_id", "node_id", "role"], False), "context_vs_impact_policy": context_vs_impact_policy, "packet_merge": packet_merge,
        "role_policy_filter": role_policy_filter, "policy_depth": policy_depth, "range_overlap_join": range_overlap_join, "containment_join": containment_join, "smallest_enclosing": smallest_enclosing,
        "merge_intervals": merge_intervals(0), "merge_intervals_gap": merge_intervals(2), "subtract_intervals": subtract_intervals, "graph_to_dot": graph_to_dot, "graph_to_mermaid": graph_to_mermaid,
    }


_EDGES = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'located-in' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located-in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part-of' FROM nation)"
_SPANS = """s AS (SELECT l_orderkey || ':' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line_start, l_linenumber + CAST(trunc(l_quantity) AS INT) % 3 AS line_end,
  CASE WHEN l_linestatus = 'O' THEN 'range' WHEN l_returnflag = 'A' THEN 'file' END AS watch, l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def _bfs(seeds: str, depth: int, where: str = "true") -> str:
    return f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e WHERE {where} UNION SELECT dst, src FROM e WHERE {where}),
  w AS (SELECT unnest([{seeds}]) AS id, 0 AS level UNION SELECT u.dst, level + 1 FROM w JOIN u ON u.src = w.id WHERE level < {depth}),
  b AS (SELECT id, CAST(min(level) AS BIGINT) AS level FROM w GROUP BY id)"""


def _impact_sql(depth: int, select: str) -> str:
    hop = ""
    for i in range(1, depth + 1):
        hop += f""", h{i} AS MATERIALIZED (SELECT x.dst AS id, min(x.kind || ' relationship from ' || x.src) AS reason FROM u x JOIN h{i - 1}f f ON f.id = x.src WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} y WHERE y.id = x.dst) GROUP BY x.dst),
  a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT id, reason FROM h{i}), h{i}f AS (SELECT id FROM h{i})"""
    return f"""WITH {_SPANS}, c AS (SELECT path, bool_or(l_orderkey % 50 = 0) AS whole, list(DISTINCT {{'a': line_start, 'b': line_end}}) AS ranges FROM s WHERE l_shipdate BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}' GROUP BY path
    UNION ALL SELECT 'c' || c_custkey, true, NULL FROM customer WHERE c_mktsegment = 'BUILDING'),
  d AS MATERIALIZED (SELECT DISTINCT s.id, s.path, 'file change in ' || s.path AS reason FROM s JOIN c USING (path) WHERE whole OR coalesce(watch, 'file') = 'file' OR len(list_filter(ranges, lambda r: r.a <= line_end AND line_start <= r.b)) > 0),
  m AS (SELECT 's' || l_suppkey AS hyperedge_id, id AS node_id, l_returnflag AS role, l_suppkey FROM s),
  ok AS (SELECT * FROM m WHERE (l_suppkey % 20 = 0 AND role IN ('A', 'N')) OR (l_suppkey % 20 <> 0 AND role <> 'R')),
  act AS MATERIALIZED (SELECT DISTINCT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM d)),
  a0 AS (SELECT id, reason FROM d UNION ALL SELECT node_id, min('member of strand ' || hyperedge_id) FROM ok WHERE hyperedge_id IN (SELECT * FROM act) AND node_id NOT IN (SELECT id FROM d) GROUP BY node_id), h0f AS (SELECT id FROM a0),
  u AS (SELECT id AS src, l_orderkey || ':' || (line_start + 1) AS dst, 'next' AS kind FROM s UNION ALL SELECT l_orderkey || ':' || (line_start + 1), id, 'next' FROM s){hop},
  every AS MATERIALIZED (SELECT DISTINCT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM a{depth})), shown AS MATERIALIZED (SELECT DISTINCT hyperedge_id, node_id, role FROM ok WHERE hyperedge_id IN (SELECT * FROM every))
  {select.format(a=f"a{depth}")}"""


def _context_sql(any_search: bool, select: str) -> str:
    later = "" if any_search else "UNION SELECT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM r1)"
    return f"""WITH {_SPANS}, m AS (SELECT DISTINCT 's' || l_suppkey AS hyperedge_id, id AS node_id, l_returnflag AS role, l_suppkey FROM s),
  seeds AS (SELECT id, line_start % 2 = 0 AS from_search FROM s WHERE l_shipdate BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'),
  x0 AS (SELECT unnest(['s10', 's20']) AS hyperedge_id UNION SELECT hyperedge_id FROM m WHERE node_id IN (SELECT id FROM seeds WHERE NOT from_search)),
  r0 AS (SELECT id FROM seeds UNION SELECT node_id FROM m WHERE hyperedge_id IN (SELECT * FROM x0)),
  u AS (SELECT id AS src, l_orderkey || ':' || (line_start + 1) AS dst FROM s UNION SELECT l_orderkey || ':' || (line_start + 1), id FROM s),
  r1 AS (SELECT id FROM r0 UNION SELECT dst FROM u WHERE src IN (SELECT id FROM r0)),
  x1 AS (SELECT hyperedge_id FROM x0 {later}), r AS (SELECT id FROM r1 UNION SELECT node_id FROM m WHERE hyperedge_id IN (SELECT * FROM x1)),
  shown AS (SELECT hyperedge_id, node_id, role, l_suppkey FROM m WHERE hyperedge_id IN (SELECT * FROM x1) OR node_id IN (SELECT id FROM r)) {select}"""


def oracle_sql() -> dict[str, str]:
    island = lambda gap: f"""WITH {_SPANS}, q AS (SELECT path, line_start, line_end, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT *, max(line_end) OVER (PARTITION BY path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
        i AS (SELECT *, sum(CASE WHEN before IS NULL OR line_start > before + {gap} + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_start, line_end ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT path, CAST(min(line_start) AS BIGINT) AS line_start, CAST(max(line_end) AS BIGINT) AS line_end, CAST(sum(n) AS BIGINT) AS n_ranges FROM i GROUP BY path, island"""  # noqa: E731
    return {
        "graph_bfs": _bfs("'c1', 's2'", 3) + " SELECT * FROM b",
        "graph_bfs_kind": _bfs("'r1'", 2, "kind = 'part-of'") + " SELECT * FROM b",
        "graph_edges_within_depth": _bfs("'c1', 's2'", 2) + " SELECT DISTINCT e.* FROM e WHERE src IN (SELECT id FROM b WHERE level < 2) OR dst IN (SELECT id FROM b WHERE level < 2)",
        "impact_direct": _impact_sql(0, "SELECT DISTINCT id, path FROM d"), "impact_expand": _impact_sql(1, "SELECT * FROM shown"), "impact_hops": _impact_sql(2, "SELECT id FROM {a}"),
        "impact_reason": _impact_sql(1, "SELECT id, reason FROM {a}"), "impact_related": _impact_sql(2, "SELECT id FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM shown WHERE node_id = a.id)"),
        "impact_unmatched": _impact_sql(0, "SELECT path FROM c WHERE path NOT IN (SELECT path FROM d)"),
        "context_seeds": _context_sql(True, "SELECT id FROM r"), "context_members": _context_sql(False, "SELECT DISTINCT hyperedge_id, node_id, role FROM shown"),
        "context_vs_impact_policy": _context_sql(True, "SELECT DISTINCT hyperedge_id, node_id, role FROM shown WHERE NOT ((l_suppkey % 20 = 0 AND role IN ('A', 'N')) OR (l_suppkey % 20 <> 0 AND role <> 'R'))"),
        "packet_merge": f"""WITH {_SPANS}, p AS (SELECT DISTINCT 's' || l_suppkey AS hyperedge_id, id AS node_id, l_returnflag AS role, l_orderkey AS n FROM s)
            SELECT hyperedge_id, node_id, role, n % 2 = 0 OR n % 5 = 0 AS direct, CASE WHEN n % 2 = 0 THEN 'diff' ELSE 'search' END AS reason FROM p""",
        "role_policy_filter": f"WITH {_SPANS} SELECT 's' || l_suppkey AS hyperedge_id, id AS node_id, l_returnflag AS role FROM s WHERE l_linestatus = 'O' AND ((l_suppkey % 20 = 0 AND l_returnflag IN ('A', 'N')) OR (l_suppkey % 20 <> 0 AND l_returnflag <> 'R'))",
        "policy_depth": "SELECT o_custkey, CAST(coalesce(max(CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) END), 1) AS BIGINT) AS depth FROM orders GROUP BY o_custkey",
        "range_overlap_join": f"WITH {_SPANS} SELECT a.path, a.id AS a, b.id AS b FROM s a JOIN s b ON a.path = b.path AND a.line_start <= b.line_end AND b.line_start <= a.line_end WHERE a.l_returnflag = 'A' AND b.l_returnflag <> 'A'",
        "containment_join": f"WITH {_SPANS} SELECT a.path, a.id AS a, b.id AS b FROM s a JOIN s b ON a.path = b.path AND b.line_start <= a.line_start AND a.line_end <= b.line_end WHERE b.watch = 'range' AND a.id <> b.id",
        "smallest_enclosing": f"WITH {_SPANS}, p AS (SELECT DISTINCT path, line_start + 1 AS line FROM s) SELECT p.path, CAST(p.line AS BIGINT) AS line, min({{'n': line_end - line_start, 'id': id}}).id AS id FROM p LEFT JOIN s ON s.path = p.path AND p.line BETWEEN line_start AND line_end GROUP BY p.path, p.line",
        "merge_intervals": island(0), "merge_intervals_gap": island(2),
        "subtract_intervals": f"""WITH {_SPANS}, w AS (SELECT path, min(line_start) AS a, max(line_end) AS b FROM s GROUP BY path), l AS (SELECT path, unnest(generate_series(a, b)) AS line FROM w),
            k AS (SELECT l.path, l.line FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = l.path AND l_returnflag = 'R' AND l.line BETWEEN line_start AND line_end)),
            g AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM k) SELECT path, CAST(min(line) AS BIGINT) AS piece_start, CAST(max(line) AS BIGINT) AS piece_end FROM g GROUP BY path, island""",
        "graph_to_dot": """SELECT 1 AS part, '  "n' || n_nationkey || '" [label="' || n_name || '"];' AS line FROM nation UNION ALL SELECT 1, '  "r' || r_regionkey || '" [label="' || r_name || '"];' FROM region
            UNION ALL SELECT 2, '  "n' || n_nationkey || '" -> "r' || n_regionkey || '" [' || CASE WHEN n_nationkey % 2 = 0 THEN 'dir=both, ' ELSE '' END || 'label="part-of"];' FROM nation""",
        "graph_to_mermaid": """WITH n AS (SELECT n_nationkey, n_regionkey, n_name, 'n' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS name FROM nation), r AS (SELECT r_regionkey, r_name, 'r' || (row_number() OVER (ORDER BY r_regionkey) - 1) AS name FROM region)
            SELECT 1 AS part, '  ' || name || '["' || n_name || '"]' AS line FROM n UNION ALL SELECT 1, '  ' || name || '["' || r_name || '"]' FROM r UNION ALL SELECT 2, '  ' || n.name || ' -->|part-of| ' || r.name FROM n JOIN r ON n_regionkey = r_regionkey""",
    }
