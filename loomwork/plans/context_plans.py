"""Queries over context packets: filters, change sets, seeds, requests, excerpts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as N
from ..functions import text as T
from ..operators import context as C
from ..operators.packing import without_redundant_files
from ..sources.tables import table
from . import graph_plans as G


def source_filters(spark, sf_dir):
    """Orders as files, with and without an extension, under allow-lists and under deny-lists."""
    k = F.col("o_orderkey")
    ending = F.coalesce(*[F.when(k % 5 == i, F.lit(x)) for i, x in enumerate([".rs", ".PY", ".md", ".zip", ""])])
    path = F.concat("o_orderstatus", F.lit("/"), k.cast("string"), ending)
    rows = table(spark, sf_dir, "orders").select(path.alias("path"))
    lang = N.path_language(F.col("path"))
    allow = C.source_allowed(F.col("path"), lang, includes=["F/**", "O/**"], excludes=["**/*7.rs"], extensions=[".RS", " zip ", "md"])
    named = C.source_allowed(F.col("path"), lang, languages=["RS", " python "])
    deny = C.source_allowed(F.col("path"), lang, excluded_extensions=["py"], excluded_languages=["MD"])
    return rows.select("path", allow.alias("by_path"), named.alias("by_language"), deny.alias("not_denied"))


def change_set(spark, sf_dir):
    """Urgent orders are named, open ones differ, and all but finished ones are untracked."""
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat("o_orderkey", F.lit(".txt")))
    moved = F.col("o_orderkey") % 2 == 0
    line = F.struct(F.lit(1).alias("start"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("end"))
    ranges = F.when(F.col("o_orderkey") % 3 > 0, F.array(line)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    diff = o.where("o_orderstatus = 'O'").select(F.lit(0).alias("ord"), "path", F.when(moved, F.concat(F.lit("old/"), "path")).alias("old_path"), F.when(moved, "renamed").otherwise("modified").alias("status"), ranges.alias("ranges"))
    again = diff.where(F.col("status") == "modified").select(F.lit(1).alias("ord"), "path", "old_path", "status", F.array(F.struct(F.lit(20).alias("start"), F.lit(21).alias("end"))).alias("ranges"))
    rows = C.change_set(o.where("o_orderpriority = '1-URGENT'").select("path"), diff.union(again), o.where("o_orderstatus <> 'F'").select("path"))
    return rows.select("path", "old_path", "status", "whole_file", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("ranges"))


def _part_nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.concat_ws("/", "p_type", "p_brand").alias("path"))


def focus_rank(spark, sf_dir):
    return C.focused(_part_nodes(spark, sf_dir), ["p7", "p3"], ["Brand#13", "Brand#21"], ["./PROMO/Brand#11", "PROMO"])


def seed_reasons(spark, sf_dir):
    return C.seed_reasons(_part_nodes(spark, sf_dir), ["Brand#13", "Brand#13", "Brand#21"], ["PROMO", "STANDARD/Brand#21", "ECONOMY/Brand#1"])


def followed_edges(spark, sf_dir):
    """Items as edges by the way they are shipped; a supplier's policy follows some ways, all, or isn't there."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")).alias("owner"))
    follow = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("R"))).when(F.col("s_nationkey") % 3 == 1, F.array().cast("array<string>"))
    policies = table(spark, sf_dir, "supplier").where("s_nationkey <> 24").select(F.col("s_suppkey").alias("hyperedge_id"), follow.alias("follow_relations"))
    return C.followed(edges, policies, ["A", "R"]).select("l_orderkey", "l_linenumber", "kind")


def changed_declarations(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "A", "sidecar").when(F.col("l_returnflag") == "R", "annotation").otherwise("import")
    line = F.when(F.col("l_linenumber") < 7, F.col("line_start"))
    declared = G.spans(spark, sf_dir).withColumn("l_linenumber", F.col("line_start")).select("id", source.alias("source"), "path", line.alias("line"))
    return C.changed_declarations(declared, G.changes(spark, sf_dir)).select("id", "source")


def member_values(spark, sf_dir):
    """Parts of middling size are current, large ones were removed, of small ones nothing is known."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"), "p_size")
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node_id")).distinct()
    return C.with_values(members, part.where("p_size BETWEEN 10 AND 35").drop("p_size"), part.where("p_size > 30").drop("p_size"))


def packet_requests(spark, sf_dir):
    """What suppliers' packets ask for, directly hit or selected, without files that are asked for in part."""
    direct, selected = F.col("l_returnflag") == "A", F.col("l_suppkey") % 3 == 0
    s = G.spans(spark, sf_dir)
    members = s.select(F.concat(F.lit("s"), "l_suppkey").alias("hyperedge_id"), selected.alias("hyperedge_direct"), F.col("id").alias("node_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("role"), direct.alias("direct")).distinct()
    related = s.where("l_linestatus = 'O'").select(F.col("id").alias("node_id"), direct.alias("direct")).distinct()
    nodes = s.groupBy("id").agg(F.min("path").alias("path"), F.min("line_start").alias("line_start"), F.min("line_end").alias("line_end"), F.max("watch").alias("watch"))
    focus = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linenumber").alias("ord")).distinct()
    rows = C.requests(members, related, nodes, focus, "direct", 2)
    rows = without_redundant_files(rows.withColumn("whole_file", F.col("end") == C.LAST_LINE))
    return rows.select("path", "start", "end", F.col("priority").cast("long").alias("priority"), F.col("ord").cast("long").alias("ord"), "node_id", "reference")


def packet_excerpts(spark, sf_dir):
    """Each document's first lines, some from its middle, and every third as a whole."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", T.lines(F.col("text")).alias("lines"))
    r = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    asked = F.array_compact(F.array(r(1, 2), r(2, 3), r(6, 7), F.when(F.col("doc_id") % 3 == 0, r(1, C.LAST_LINE))))
    ranges = d.select("path", F.explode(asked).alias("r")).select("path", "r.*")
    return C.excerpts(ranges, d.select("path", "lines"), 1).select("path", "line_start", "line_end", "n_ranges", F.md5("text").alias("h"))


def hidden_summary(spark, sf_dir):
    members = G.spans(spark, sf_dir).select(F.concat(F.lit("s"), "l_suppkey").alias("hyperedge_id"), F.col("id").alias("node_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("role"), "path").distinct()
    return C.hidden_members(members, 8)


def queries() -> dict:
    names = "source_filters change_set focus_rank seed_reasons followed_edges changed_declarations member_values packet_requests packet_excerpts hidden_summary"
    return {n: globals()[n] for n in names.split()}


_PARTS = "p AS (SELECT 'p' || p_partkey AS id, p_brand AS symbol, p_type || '/' || p_brand AS path FROM part)"


def oracle_sql() -> dict[str, str]:
    s = G._SPANS
    return {
        "source_filters": """WITH f AS (SELECT o_orderstatus || '/' || o_orderkey || ['.rs', '.PY', '.md', '.zip', ''][o_orderkey % 5 + 1] AS path, o_orderkey % 5 AS k, o_orderstatus AS top, o_orderkey % 10 = 7 AS seven FROM orders)
            SELECT path, top IN ('F', 'O') AND k IN (0, 2, 3) AND NOT (k = 0 AND seven) AS by_path, k IN (0, 1) AS by_language, k NOT IN (1, 2) AS not_denied FROM f""",
        "change_set": """WITH o AS (SELECT o_orderkey || '.txt' AS path, o_orderkey AS k, o_orderkey % 2 = 0 AS moved, o_orderpriority = '1-URGENT' AS named, o_orderstatus AS s FROM orders)
            SELECT path, CASE WHEN s = 'O' AND moved THEN 'old/' || path END AS old_path, CASE WHEN s = 'O' THEN CASE WHEN moved THEN 'renamed' ELSE 'modified' END WHEN named THEN 'modified' ELSE 'untracked' END AS status,
              named OR s <> 'O' OR (moved AND k % 3 = 0) AS whole_file, CASE WHEN s <> 'O' THEN '' ELSE concat_ws(',', CASE WHEN k % 3 > 0 THEN '1-' || (k % 9 + 1) END, CASE WHEN NOT moved THEN '20-21' END) END AS ranges FROM o WHERE named OR s <> 'F'""",
        "focus_rank": f"WITH {_PARTS}, x AS (SELECT id, CASE WHEN id = 'p7' THEN 0 WHEN id = 'p3' THEN 1 WHEN symbol = 'Brand#13' THEN 2 WHEN symbol = 'Brand#21' THEN 3 WHEN path = 'PROMO/Brand#11' THEN 4 END AS ord FROM p) SELECT * FROM x WHERE ord IS NOT NULL",
        "seed_reasons": f"""WITH {_PARTS}, x AS (SELECT id, concat_ws('; ', CASE WHEN symbol IN ('Brand#13', 'Brand#21') THEN 'symbol "' || symbol || '" matched' END, CASE WHEN path LIKE 'PROMO/%' THEN 'path "PROMO" matched' END,
            CASE WHEN path IN ('STANDARD/Brand#21', 'ECONOMY/Brand#1') THEN 'path "' || path || '" matched' END) AS reason FROM p) SELECT * FROM x WHERE reason <> ''""",
        "followed_edges": """SELECT l_orderkey, l_linenumber, l_returnflag AS kind FROM lineitem LEFT JOIN supplier ON l_linenumber < 6 AND s_suppkey = l_suppkey AND s_nationkey <> 24
            WHERE l_returnflag IN ('A', 'R') AND (s_nationkey IS NULL OR s_nationkey % 3 > 0 OR l_returnflag = 'R')""",
        "changed_declarations": f"""WITH {s}, c AS (SELECT path, bool_or(l_orderkey % 50 = 0) AS whole, list(DISTINCT {{'a': line_start, 'b': line_end}}) AS ranges FROM s WHERE l_shipdate BETWEEN TIMESTAMP '{G.WINDOW[0]}' AND TIMESTAMP '{G.WINDOW[1]}' GROUP BY path),
            d AS (SELECT s.id, CASE l_returnflag WHEN 'A' THEN 'sidecar' WHEN 'R' THEN 'annotation' END AS source, line_start AS line, whole, ranges FROM s JOIN c USING (path))
            SELECT DISTINCT id, source FROM d WHERE source = 'sidecar' OR (source = 'annotation' AND line < 7 AND (whole OR len(list_filter(ranges, lambda r: line BETWEEN r.a AND r.b)) > 0))""",
        "member_values": """SELECT DISTINCT l_orderkey, l_partkey AS node_id, CASE WHEN p_size >= 10 THEN p_name END AS value, coalesce(p_size > 35, false) AS deleted FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
        "packet_requests": f"""WITH {s}, o AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber AS id, l_linenumber AS ord FROM lineitem WHERE l_quantity = 50),
            n AS (SELECT id, min(path) AS path, min(line_start) AS line_start, min(line_end) AS line_end, max(watch) AS watch FROM s GROUP BY id),
            m AS (SELECT DISTINCT id, l_returnflag = 'A' AS direct, l_suppkey % 3 = 0 AS via, 's' || l_suppkey || '/' || CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'member' END || ':' || id AS reference FROM s
              UNION ALL SELECT DISTINCT id, l_returnflag = 'A', false, 'related:' || id FROM s WHERE l_linestatus = 'O'),
            r AS (SELECT path, CASE WHEN watch = 'file' THEN 1 ELSE greatest(line_start - 2, 1) END AS start, CASE WHEN watch = 'file' THEN 2147483647 ELSE line_end + 2 END AS "end",
              CASE WHEN ord IS NOT NULL THEN 0 WHEN direct THEN 1 WHEN via THEN 2 ELSE 3 END AS priority, coalesce(ord, 2147483647) AS ord, id AS node_id, reference FROM m JOIN n USING (id) LEFT JOIN o USING (id) WHERE direct OR via),
            b AS (SELECT *, bool_or("end" <> 2147483647) OVER (PARTITION BY path) AS bounded FROM r)
            SELECT path, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(priority AS BIGINT) AS priority, CAST(ord AS BIGINT) AS ord, node_id, reference FROM b WHERE NOT ("end" = 2147483647 AND bounded)""",
        "packet_excerpts": """WITH a AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS l FROM documents), d AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM a), n AS (SELECT *, len(l) AS n FROM d),
            x AS (SELECT doc_id, l, n, 1 AS a, CASE WHEN doc_id % 3 = 0 THEN n ELSE least(n, 3) END AS b, least(n, 2) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 AND n >= 6 THEN 1 ELSE 0 END AS k FROM n WHERE n > 0
              UNION ALL SELECT doc_id, l, n, 6, least(n, 7), 1 FROM n WHERE n >= 6 AND doc_id % 3 <> 0)
            SELECT CAST(doc_id AS VARCHAR) AS path, CAST(a AS BIGINT) AS line_start, CAST(b AS BIGINT) AS line_end, CAST(k AS BIGINT) AS n_ranges, md5(array_to_string(l[a:b], chr(10))) AS h FROM x""",
        "hidden_summary": f"""WITH {s}, m AS (SELECT DISTINCT 's' || l_suppkey AS hyperedge_id, id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS role, path FROM s),
            n AS (SELECT *, row_number() OVER (PARTITION BY hyperedge_id ORDER BY id, role NULLS FIRST) AS n FROM m) SELECT hyperedge_id, count(*) AS nodes, count(DISTINCT path) AS files FROM n WHERE n > 8 GROUP BY 1""",
    }
