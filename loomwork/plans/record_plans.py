"""Queries over declarations, manifests, budgets, reviews, attributes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing as P
from ..operators import parsing as X
from ..operators import records as R
from ..operators.search import files_of
from ..sources.tables import table
from ..streaming.windows import event_counts


def _old(spark, sf_dir):
    return files_of(table(spark, sf_dir, "documents")).where("doc_id % 11 <> 0").select("path", "doc_id", F.sha2("text", 256).alias("hash"))


def _new(spark, sf_dir):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return files_of(table(spark, sf_dir, "documents")).where("doc_id % 13 <> 0").select("path", "doc_id", F.sha2(text, 256).alias("hash"))


def manifest_diff(spark, sf_dir):
    return R.manifest_difference(_old(spark, sf_dir), _new(spark, sf_dir))


def impacted_keys(spark, sf_dir):
    """Sources whose documents changed, by the fragments before and after."""
    old, new = _old(spark, sf_dir), _new(spark, sf_dir)
    change = R.manifest_difference(old, new)
    rows = old.select("path").union(new.select("path")).join(change, "path", "left_semi")
    return rows.select(F.split("path", "/")[1].alias("source")).distinct()


def refresh_equals_rebuild(spark, sf_dir):
    old, new = _old(spark, sf_dir), _new(spark, sf_dir)
    return R.refreshed(old, new, R.manifest_difference(old, new))


def workspace_fingerprint(spark, sf_dir):
    return R.fingerprint(_old(spark, sf_dir), ["path", "hash"]).select("fingerprint", F.col("n").cast("long").alias("n"))


def first_wins_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.first_wins(rows, ["l_suppkey", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice"]).select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey")


def node_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("target"), F.lit("sidecar").alias("kind"), F.lit(None).cast("string").alias("location"), F.split("p_type", " ").alias("tags"), F.col("p_size").cast("string").alias("attributes"))
    source = p.where("p_partkey % 5 < 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("target"), F.lit("source").alias("kind"), F.concat(F.lit("f"), F.col("p_size")).alias("location"), F.array(F.lit("source"), F.col("p_brand")).alias("tags"), F.lit("dropped").alias("attributes"))
    return R.merged_nodes(side, source).select("id", "target", "kind", "location", F.array_join("tags", ",").alias("tags"), "attributes")


def all_tags_filter(spark, sf_dir):
    tags = F.split("p_type", " ")
    asked = F.array(F.split(F.lit("PROMO"), ",")[0])
    return table(spark, sf_dir, "part").where(F.size(F.array_except(F.transform(asked, F.upper), F.transform(tags, F.upper))) == 0).select("p_partkey")


def list_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_brand LIKE '%1' AND p_size BETWEEN 10 AND 30").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))


def implicit_edges(spark, sf_dir):
    """Hyperedges that members name but nobody declared."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    declared = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return R.unresolved(members, "id", declared, "id").groupBy("id").agg(F.count("*").alias("members"))


def unresolved_refs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("s"))
    return R.unresolved(items, "s", table(spark, sf_dir, "supplier"), "s_suppkey").select("l_orderkey", "s").distinct()


def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


def _diagnostics(spark, sf_dir):
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return R.diagnostics(
        (part.where("p_size > 45"), "error", "anchor-range", F.col("p_partkey")),
        (part.where("p_brand LIKE '%5'"), "warning", "strand-intent", F.col("p_brand")),
        (items.where("l_quantity > 49"), "error", "unresolved-anchor", F.concat_ws(":", "l_orderkey", "l_linenumber")),
    )


def diagnostic_rollup(spark, sf_dir):
    return _diagnostics(spark, sf_dir).groupBy("severity", "code").agg(F.count("*").alias("n"))


def _excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("source", F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("priority"), F.col("doc_id").alias("ord"), T.estimated_tokens(F.coalesce("text", F.lit(""))).alias("cost"))


def budget_pack(spark, sf_dir):
    return P.packed(_excerpts(spark, sf_dir), "source", 4000).where("included").select("source", "id", "cost")


def budget_tiers(spark, sf_dir):
    return P.packed(_excerpts(spark, sf_dir), "source", 4000).groupBy("source", "priority").agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("omitted")).select("source", F.col("priority").cast("long").alias("priority"), "included", "omitted")


def budget_summary(spark, sf_dir):
    return P.omitted_summary(P.packed(_excerpts(spark, sf_dir), "source", 4000), "source")


def priority_rank(spark, sf_dir):
    d = files_of(table(spark, sf_dir, "documents"))
    p = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 < 4, 1).when(F.col("doc_id") % 10 < 7, 2).otherwise(3)
    w = R.Window.partitionBy(F.split("path", "/")[1]).orderBy("p", F.length("path"), "path")
    return d.withColumn("p", p).select("doc_id", F.col("p").cast("long").alias("priority"), F.row_number().over(w).cast("long").alias("place"))


def topk_per_group(spark, sf_dir):
    w = R.Window.partitionBy("l_returnflag", "l_linestatus").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 4").select("l_returnflag", "l_linestatus", "l_orderkey", F.col("n").cast("long").alias("n"))


def suppress_file_scope(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", (F.col("l_quantity") > 30).alias("whole_file"))
    return P.without_redundant_files(r).select("path", "l_linenumber", "whole_file").distinct()


def json_attributes(spark, sf_dir):
    v = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", v.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def review_missing(spark, sf_dir):
    need = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return R.missing_dispositions(need, table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


def review_drift(spark, sf_dir):
    return R.drifted(_old(spark, sf_dir), _new(spark, sf_dir))


def review_latest_open(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", "open").otherwise("complete").alias("status"), F.col("turn").alias("created_at"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("id"))
    return R.latest_open(c, ["conv_id"]).select("conv_id", "status", "created_at", "id")


def _annotated(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("// @anchor part."), "p_partkey", F.lit(" kind="), F.lower(F.split("p_type", " ")[0]), F.lit(" tags="), F.lower("p_brand"), F.lit(' @strand brand role=member intent="Parts of a brand"'))
    return p.select(F.concat(F.lit("src/"), "p_partkey", F.lit(".rs")).alias("path"), F.concat(F.lit("fn a() {}\n"), line, F.lit("\nfn b() {}\n")).alias("text"))


def annotation_scan(spark, sf_dir):
    return X.annotations(_annotated(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), "what", "id", "kind", "role")


def _patches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 50 + 1).cast("string").alias("n"))
    text = F.concat(F.lit("diff --git a/"), "k", F.lit(".txt b/"), "k", F.lit(".txt\n--- a/"), "k", F.lit(".txt\n+++ b/"), "k", F.lit(".txt\n@@ -"), "n", F.lit(",2 +"), "n", F.lit(",1 @@\n--- x\n-y\n+z\n@@ -90,1 +88,0 @@\n-gone "), "k", F.lit("\n"))
    return o.select(F.col("k").alias("patch_id"), text.alias("text"))


def patch_parse(spark, sf_dir):
    return X.patches(_patches(spark, sf_dir)).where("what = 'range'").select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def patch_files(spark, sf_dir):
    """What patches of each kind say of their files: each order is modified, added, deleted, renamed, copied or binary."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 6).alias("kind"))
    head = lambda a, b: F.concat(F.lit("diff --git a/"), a, F.lit(" b/"), b, F.lit("\n"))
    name, old = F.concat("k", F.lit(".txt")), F.concat(F.lit("old "), "k", F.lit(".txt"))
    moved = lambda how: F.concat(head(old, name), F.lit(f"similarity index 90%\n{how} from "), old, F.lit(f"\n{how} to "), name, F.lit("\n"))
    hunk = F.lit("@@ -1 +1 @@\n-x\x0cy\n+z\n")
    one = lambda a, b, lines: F.concat(head(name, name), F.lit("--- "), a, F.lit("\n+++ "), b, F.lit("\n"), lines)
    a, b, none = F.concat(F.lit("a/"), name), F.concat(F.lit("b/"), name), F.lit("/dev/null")
    quoted = F.concat(F.lit('diff --git "a/'), "k", F.lit('\\303\\251.bin" "b/'), "k", F.lit('\\303\\251.bin"\nBinary files differ\n'))
    texts = [one(a, b, hunk), one(none, b, F.lit("@@ -0,0 +1 @@\n+z\n")), one(a, none, F.lit("@@ -1 +0,0 @@\n-x\n")), moved("rename"), F.concat(moved("copy"), F.lit("--- a/"), old, F.lit("\n+++ "), b, F.lit("\n"), hunk), quoted]
    text = F.coalesce(*[F.when(F.col("kind") == i, t) for i, t in enumerate(texts)])
    return X.patches(o.select(F.col("k").alias("patch_id"), text.alias("text"))).where("what = 'file'").select("patch_id", "path", "old_path", "status", "whole_file")


def removed_concat(spark, sf_dir):
    rows = X.patches(_patches(spark, sf_dir)).where("what = 'removed'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("path").agg(joined.alias("removed"))


def event_windows(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events")).select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


def queries() -> dict:
    names = """manifest_diff impacted_keys refresh_equals_rebuild workspace_fingerprint first_wins_dedup node_merge all_tags_filter list_filter implicit_edges unresolved_refs
        duplicate_ids diagnostic_rollup budget_pack budget_tiers budget_summary priority_rank topk_per_group suppress_file_scope json_attributes review_missing review_drift
        review_latest_open annotation_scan patch_parse patch_files removed_concat event_windows"""
    return {n: globals()[n] for n in names.split()}


_F = "f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents), old AS (SELECT path, doc_id, sha256(text) AS hash FROM f WHERE doc_id % 11 <> 0), new AS (SELECT path, doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM f WHERE doc_id % 13 <> 0)"
_DIFF = "diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash)"
_PACK = """RECURSIVE x AS (SELECT source, doc_id AS id, CAST(doc_id % 4 AS INT) AS priority, CAST(ceil((strlen(coalesce(text, '')) + 64) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id % 4, doc_id) AS n FROM documents),
  p AS (SELECT source, 0::BIGINT AS n, 4000::BIGINT AS remaining, -1 AS tier, false AS took, false AS passed, false AS blocked, NULL::BIGINT AS id, NULL::INT AS priority, NULL::BIGINT AS cost, false AS included FROM (SELECT DISTINCT source FROM documents)
   UNION ALL SELECT source, n, remaining - CASE WHEN fits THEN cost ELSE 0 END, priority, took OR fits, passed OR (NOT fits AND NOT blocked), blocked, id, priority, cost, fits FROM
     (SELECT *, NOT blocked AND cost <= remaining AS fits FROM (SELECT p.source, x.n, p.remaining, p.tier = x.priority AND p.took AS took, p.tier = x.priority AND p.passed AS passed, p.blocked OR (p.tier <> x.priority AND p.took AND p.passed) AS blocked, x.id, x.priority, x.cost FROM p JOIN x ON x.source = p.source AND x.n = p.n + 1) t) u)"""


def oracle_sql() -> dict[str, str]:
    return {
        "manifest_diff": f"WITH {_F}, {_DIFF} SELECT * FROM diff",
        "impacted_keys": f"WITH {_F}, {_DIFF} SELECT DISTINCT split_part(path, '/', 2) AS source FROM diff",
        "refresh_equals_rebuild": f"WITH {_F} SELECT * FROM new",
        "workspace_fingerprint": f"WITH {_F}, r AS (SELECT sha256(path || chr(31) || hash) AS h FROM old), s AS (SELECT {', '.join(f"CAST(sum(CAST(CAST('0x' || substr(h, {15 * i + 1}, 15) AS UBIGINT) AS HUGEINT)) % 1152921504606846976 AS VARCHAR) AS s{i}" for i in range(4))}, count(*) AS n FROM r) SELECT sha256(concat_ws('-', s0, s1, s2, s3)) AS fingerprint, n FROM s",
        "first_wins_dedup": "SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
        "node_merge": """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS target, string_split(p_type, ' ') AS tags, CAST(p_size AS VARCHAR) AS attributes FROM part WHERE p_partkey % 2 = 0),
            b AS (SELECT p_partkey AS id, p_name AS target, 'f' || p_size AS location, ['source', p_brand] AS tags FROM part WHERE p_partkey % 5 < 3)
            SELECT coalesce(a.id, b.id) AS id, coalesce(a.target, b.target) AS target, CASE WHEN a.id IS NOT NULL THEN 'sidecar' ELSE 'source' END AS kind, b.location, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags,
              CASE WHEN a.id IS NOT NULL THEN a.attributes ELSE 'dropped' END AS attributes FROM a FULL JOIN b ON a.id = b.id""",
        "all_tags_filter": "SELECT p_partkey FROM part WHERE list_contains(string_split(upper(p_type), ' '), 'PROMO')",
        "list_filter": "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_brand LIKE '%1' AND p_size BETWEEN 10 AND 30",
        "implicit_edges": "SELECT l_partkey AS id, count(*) AS members FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1",
        "unresolved_refs": "SELECT DISTINCT l_orderkey, -l_suppkey AS s FROM lineitem WHERE l_linenumber = 7 AND -l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
        "duplicate_ids": "SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(*) > 1",
        "diagnostic_rollup": """WITH d AS (SELECT 'error' AS severity, 'anchor-range' AS code, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE p_size > 45 UNION SELECT 'warning', 'strand-intent', p_brand FROM part WHERE p_brand LIKE '%5'
            UNION SELECT 'error', 'unresolved-anchor', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_quantity > 49) SELECT severity, code, count(*) AS n FROM d GROUP BY 1, 2""",
        "budget_pack": f"WITH {_PACK} SELECT source, id, cost FROM p WHERE included",
        "budget_tiers": f"WITH {_PACK} SELECT source, CAST(priority AS BIGINT) AS priority, count(*) FILTER (WHERE included) AS included, count(*) FILTER (WHERE NOT included) AS omitted FROM p WHERE n > 0 GROUP BY 1, 2",
        "budget_summary": f"WITH {_PACK} SELECT source, count(*) AS omitted FROM p WHERE n > 0 AND NOT included GROUP BY 1 ORDER BY omitted DESC, source LIMIT 8",
        "priority_rank": "WITH f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, source, CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 < 4 THEN 1 WHEN doc_id % 10 < 7 THEN 2 ELSE 3 END AS p FROM documents) SELECT doc_id, CAST(p AS BIGINT) AS priority, row_number() OVER (PARTITION BY source ORDER BY p, length(path), path) AS place FROM f",
        "topk_per_group": "SELECT l_returnflag, l_linestatus, l_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 4",
        "suppress_file_scope": "SELECT DISTINCT path, l_linenumber, whole_file FROM (SELECT l_orderkey AS path, l_linenumber, l_quantity > 30 AS whole_file, bool_or(NOT (l_quantity > 30)) OVER (PARTITION BY l_orderkey) AS bounded FROM lineitem) WHERE NOT (whole_file AND bounded)",
        "json_attributes": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
        "review_missing": "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "review_drift": f"WITH {_F} SELECT o.path, n.path IS NULL AS gone FROM old o LEFT JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash",
        "review_latest_open": "SELECT conv_id, status, created_at, id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY status = 'open' DESC, created_at DESC, id DESC) AS n FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 'open' ELSE 'complete' END AS status, turn AS created_at, md5(coalesce(text, '')) AS id FROM conversations)) WHERE n = 1",
        "annotation_scan": "SELECT 'src/' || p_partkey || '.rs' AS path, 2::BIGINT AS line, 'node' AS what, 'part.' || p_partkey AS id, lower(split_part(p_type, ' ', 1)) AS kind, NULL AS role FROM part UNION ALL SELECT 'src/' || p_partkey || '.rs', 2, 'hyperedge', 'brand', NULL, NULL FROM part UNION ALL SELECT 'src/' || p_partkey || '.rs', 2, 'member', 'brand', NULL, 'member' FROM part",
        "patch_files": """SELECT CAST(o_orderkey AS VARCHAR) AS patch_id, CASE WHEN o_orderkey % 6 = 5 THEN o_orderkey || 'é.bin' ELSE o_orderkey || '.txt' END AS path,
            CASE o_orderkey % 6 WHEN 2 THEN o_orderkey || '.txt' WHEN 3 THEN 'old ' || o_orderkey || '.txt' WHEN 4 THEN 'old ' || o_orderkey || '.txt' END AS old_path,
            ['modified', 'added', 'deleted', 'renamed', 'copied', 'modified'][o_orderkey % 6 + 1] AS status, o_orderkey % 6 IN (3, 5) AS whole_file FROM orders""",
        "patch_parse": "SELECT o_orderkey || '.txt' AS path, o_orderkey % 50 + 1 AS line_start, o_orderkey % 50 + 1 AS line_end FROM orders UNION ALL SELECT o_orderkey || '.txt', 88, 88 FROM orders",
        "removed_concat": "SELECT o_orderkey || '.txt' AS path, '-- x' || chr(10) || 'y' || chr(10) || 'gone ' || o_orderkey AS removed FROM orders",
        "event_windows": "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
