"""Graphs assembled from fragments: parts and suppliers declare nodes and hyperedges in sidecars, items of orders in annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..sources.settled import settle
from ..sources.tables import numbered, table


def fragments(spark, sf_dir) -> A.Fragments:
    """All fragments: parts as sidecar files by brand and size, suppliers by nation, and items as annotations in their order's file.

    Some parts are declared twice, some with a wrong version, name, path or lines; items of other parts declare these anew.
    """
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    items = numbered(spark, sf_dir, "lineitem").withColumns({"path": F.col("l_orderkey").cast("string"), "line_start": F.col("l_linenumber"), "line_end": F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3})
    size, key = F.col("p_size"), F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    attributes = lambda name, when: F.when(when, F.create_map(F.lit(name), F.lit("x")))
    here = F.struct(
        F.concat(F.when(size % 5 == 1, F.lit("/")).when(size % 5 == 2, F.lit("./")).when(size % 5 == 3, F.lit("../")).otherwise(F.lit("")), "p_brand").alias("path"), F.when(size % 4 > 0, size - 4).cast("int").alias("line_start"),
        F.when(size % 4 > 1, size - 4 + size % 3 - 1).cast("int").alias("line_end"), F.when(size % 7 == 0, "node").when(size % 7 == 1, "file").alias("watch"),
    )
    side = part.select(
        F.concat(F.lit("p"), F.when(size > 40, key - 1).otherwise(key).cast("string"), F.when(size == 7, F.lit(" x")).otherwise(F.lit(""))).alias("id"), F.when(size == 9, 2).otherwise(1).alias("version"),
        F.when(size % 6 == 0, F.concat(F.lit("file://t/"), "p_brand", F.lit("#L3-L5"))).when(size % 6 == 1, F.col("p_name")).alias("target"), F.when(size % 3 == 0, F.lower("p_type")).alias("kind"), F.when(size % 2 == 0, here).cast(A.LOCATION).alias("location"),
        F.array("p_type").alias("tags"), attributes("description", size == 11).alias("attributes"), F.lit("sidecar").alias("source"), F.concat_ws("/", F.lit("parts"), "p_brand", "p_size").alias("file"), none("int").alias("line"), key.alias("ord"), F.lit(0).cast("long").alias("row"),
    )
    n = F.col("line_start")
    noted = [F.lit("annotation").alias("source"), F.concat(F.lit("o/"), "path").alias("file"), n.cast("int").alias("line"), F.lit(0).cast("long").alias("ord")]
    own = F.struct(F.concat(F.lit("o/"), "path").alias("path"), n.cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.lit("range").alias("watch"))
    note = items.select(  # items of the first two lines declare, the rest only refer
        F.when(n <= 2, F.concat(F.lit("p"), "l_partkey", F.when(F.col("l_suppkey") % 3 == 0, F.lit(".n")).otherwise(F.lit("")))).alias("id"), F.lit(1).alias("version"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("file://s/"), "l_suppkey")).alias("target"),
        F.when(F.col("l_returnflag") == "R", "returned").alias("kind"), F.when(F.col("l_linestatus") == "O", own).cast(A.LOCATION).alias("location"), F.array("l_returnflag").alias("tags"), none("map<string,string>").alias("attributes"), *noted, "row",
    ).where("id IS NOT NULL")
    strand = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 5, 3).otherwise(1).alias("version"), F.when(F.col("s_acctbal") < 0, " ").otherwise(F.col("s_name")).alias("intent"), F.array("s_name").alias("tags"), none("map<string,string>").alias("attributes"),
        F.when(F.col("s_nationkey") % 4 == 0, "annotation").otherwise("sidecar").alias("source"), F.concat(F.lit("nations/"), "s_nationkey").alias("file"), none("int").alias("line"), F.col("s_suppkey").alias("ord"))
    declared = strand.where("ord % 10 <> 3").union(strand.where("ord % 10 = 1").withColumn("intent", F.lit("again")).withColumn("ord", F.col("ord") + 1000000))
    member = items.select(
        F.concat(F.lit("s"), "l_suppkey").alias("hyperedge_id"), F.when(F.col("l_quantity") > 45, F.concat(F.lit("file://m/"), "l_partkey", F.lit("#L"), n)).when(F.col("l_quantity") < 3, F.concat(F.lit("zz"), "l_partkey")).otherwise(F.concat(F.lit("p"), "l_partkey")).alias("node_id"),
        F.when(n % 3 > 0, F.col("l_returnflag")).alias("role"), (F.col("l_linestatus") == "O").alias("required"), attributes("reason", F.col("l_quantity") == 30).alias("attributes"), *noted,
    )
    edge = items.select(
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), "l_suppkey")).alias("owner"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.when(F.col("l_quantity") > 40, F.concat(F.lit("a/"), "l_suppkey")).otherwise(F.concat(F.lit("p"), F.col("l_partkey") + 1)).alias("dst"),
        F.when(F.col("l_quantity") == 7, " ").otherwise(F.col("l_returnflag")).alias("kind"), none("map<string,string>").alias("attributes"), *noted,
    )
    return A.Fragments(side.unionByName(note), declared, member, edge)


def _sides(spark, sf_dir):
    """Fragments before and after, and the files that changed: notes of open orders' files came, those of small finished ones went."""
    every = fragments(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("file"), (F.col("o_orderstatus") == "P").alias("came"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 60000)).alias("went"))
    came, went = settle(o.where("came").select("file"), "came"), settle(o.where("went").select("file"), "went")
    without = lambda files: every.each(lambda df: df.join(files, "file", "left_anti"))
    return without(came), without(went), came.union(went)


def _shape(part, graph: A.Assembled):
    if part == "nodes":
        at = [F.col(f"location.{c}").alias(f"at_{c}") for c in ("path", "line_start", "line_end", "watch")]
        return graph.nodes.select("id", "target", "kind", *at, F.array_join("tags", ",").alias("tags"), F.col("attributes").isNotNull().alias("noted"), "source", "file", "line")
    if part == "hyperedges":
        return graph.hyperedges.select("id", "version", "intent", F.array_join("tags", ",").alias("tags"), "source", "file", "line", "implied")
    return graph.members.select("hyperedge_id", "node_id", "role", "required", "file", "line") if part == "members" else graph.edges.select("owner", "src", "dst", "kind", "file", "line")


def _assembled(part):
    return lambda spark, sf_dir: _shape(part, A.assembled(fragments(spark, sf_dir)))


def _refreshed(part):
    def run(spark, sf_dir):
        old, new, changed = _sides(spark, sf_dir)
        return _shape(part, A.refresh(A.assembled(old), old, new, changed, (part,)))

    return run


def diagnostics_all(spark, sf_dir):
    return A.diagnostics(fragments(spark, sf_dir))


def queries() -> dict:
    out = {f"assembled_{p}": _assembled(p) for p in ("nodes", "hyperedges", "members", "edges")}
    return out | {f"refresh_graph_{p}": _refreshed(p) for p in ("nodes", "hyperedges", "members", "edges")} | {"diagnostics_all": diagnostics_all}


def _sql(select: str, new: bool = False) -> str:
    gone = "WHERE file NOT IN (SELECT 'o/' || o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 60000)" if new else ""
    target = """CASE WHEN {0} IS NULL OR contains(regexp_replace({0}, '^file://', ''), '://') OR regexp_extract(regexp_replace({0}, '^file://', ''), '^([^#]*)', 1) = '' THEN NULL ELSE
      {{'path': regexp_extract(regexp_replace({0}, '^file://', ''), '^([^#]*)', 1), 'line_start': try_cast(regexp_extract({0}, '#L(\\d+)', 1) AS INT), 'line_end': coalesce(try_cast(regexp_extract({0}, '#L\\d+-L(\\d+)$', 1) AS INT), try_cast(regexp_extract({0}, '#L(\\d+)', 1) AS INT)),
        'watch': CASE WHEN regexp_matches({0}, '#L\\d+') THEN 'range' ELSE 'file' END}} END"""
    return rf"""WITH i AS (SELECT *, l_linenumber + CAST(trunc(l_quantity) AS INT) % 3 AS line_end, 'o/' || l_orderkey AS file FROM lineitem),
  nd AS (SELECT * FROM (SELECT 'p' || CASE WHEN p_size > 40 THEN p_partkey - 1 ELSE p_partkey END || CASE WHEN p_size = 7 THEN ' x' ELSE '' END AS id, CASE WHEN p_size = 9 THEN 2 ELSE 1 END AS version,
      CASE p_size % 6 WHEN 0 THEN 'file://t/' || p_brand || '#L3-L5' WHEN 1 THEN p_name END AS target, CASE WHEN p_size % 3 = 0 THEN lower(p_type) END AS kind,
      CASE WHEN p_size % 2 = 0 THEN {{'path': CASE p_size % 5 WHEN 1 THEN '/' WHEN 3 THEN '../' ELSE '' END || p_brand, 'line_start': CASE WHEN p_size % 4 > 0 THEN p_size - 4 END, 'line_end': CASE WHEN p_size % 4 > 1 THEN p_size - 4 + p_size % 3 - 1 END, 'watch': CASE p_size % 7 WHEN 0 THEN 'node' WHEN 1 THEN 'file' END}} END AS location,
      [p_type] AS tags, p_size = 11 AS noted, false AS later, 'parts/' || p_brand || '/' || p_size AS file, NULL::INT AS line, p_partkey AS ord FROM part
    UNION ALL SELECT 'p' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN '.n' ELSE '' END, 1, CASE WHEN l_returnflag = 'A' THEN 'file://s/' || l_suppkey END, CASE WHEN l_returnflag = 'R' THEN 'returned' END,
      CASE WHEN l_linestatus = 'O' THEN {{'path': file, 'line_start': l_linenumber, 'line_end': line_end, 'watch': 'range'}} END, [l_returnflag], false, true, file, l_linenumber, 0 FROM i WHERE l_linenumber <= 2) {gone}),
  hd AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_nationkey = 5 THEN 3 ELSE 1 END AS version, CASE WHEN s_acctbal < 0 THEN ' ' ELSE s_name END AS intent, s_name, s_nationkey % 4 = 0 AS later, 'nations/' || s_nationkey AS file, s_suppkey AS ord FROM supplier WHERE s_suppkey % 10 <> 3
    UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_nationkey = 5 THEN 3 ELSE 1 END, 'again', s_name, s_nationkey % 4 = 0, 'nations/' || s_nationkey, s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 10 = 1),
  m AS (SELECT * FROM (SELECT 's' || l_suppkey AS hyperedge_id, CASE WHEN l_quantity > 45 THEN 'file://m/' || l_partkey || '#L' || l_linenumber WHEN l_quantity < 3 THEN 'zz' || l_partkey ELSE 'p' || l_partkey END AS node_id,
      CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END AS role, l_linestatus = 'O' AS required, l_quantity = 30 AS noted, file, l_linenumber AS line FROM i) {gone}),
  e AS (SELECT * FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey END AS owner, 'p' || l_partkey AS src, CASE WHEN l_quantity > 40 THEN 'a/' || l_suppkey ELSE 'p' || (l_partkey + 1) END AS dst, CASE WHEN l_quantity = 7 THEN ' ' ELSE l_returnflag END AS kind, file, l_linenumber AS line FROM i) {gone}),
  nf AS (SELECT id, arg_min({{'version': version, 'target': target, 'kind': kind, 'location': location, 'tags': tags, 'noted': noted, 'file': file, 'line': line}}, {{'f': file, 'l': line, 'o': ord, 't': target}}) FILTER (WHERE NOT later) AS side,
      arg_min({{'target': target, 'kind': kind, 'location': location, 'tags': tags, 'file': file, 'line': line}}, {{'f': file, 'l': line, 't': target}}) FILTER (WHERE later) AS note,
      arg_max(location, {{'f': file, 'l': line, 't': target}}) FILTER (WHERE later AND location IS NOT NULL) AS note_location, arg_min(target, {{'f': file, 'l': line, 't': target}}) FILTER (WHERE later AND target IS NOT NULL) AS note_target,
      arg_min(kind, {{'f': file, 'l': line, 't': target}}) FILTER (WHERE later AND kind IS NOT NULL) AS note_kind, coalesce(list(DISTINCT tags[1]) FILTER (WHERE later), []) AS note_tags FROM nd GROUP BY id),
  n0 AS (SELECT id, CASE WHEN side IS NOT NULL THEN coalesce(side.target, note_target) ELSE note.target END AS target, CASE WHEN side IS NOT NULL THEN coalesce(side.kind, note_kind) ELSE note.kind END AS kind,
      CASE WHEN side IS NOT NULL THEN coalesce(note_location, side.location) ELSE note.location END AS location, CASE WHEN side IS NOT NULL THEN list_sort(list_distinct(list_concat(side.tags, note_tags))) ELSE note.tags END AS tags,
      coalesce(side.noted, false) AS noted, CASE WHEN side IS NOT NULL THEN 'sidecar' ELSE 'annotation' END AS source, CASE WHEN side IS NOT NULL THEN side.file ELSE note.file END AS file, CASE WHEN side IS NOT NULL THEN side.line ELSE note.line END AS line FROM nf),
  rf AS (SELECT id, min({{'t': turn, 'f': file, 'l': line}}) AS w FROM (SELECT node_id AS id, 0 AS turn, file, line FROM m UNION ALL SELECT src, 1, file, line FROM e UNION ALL SELECT dst, 1, file, line FROM e) WHERE contains(id, '/') GROUP BY id),
  n AS (SELECT id, target, kind, coalesce(location, {target.format("target")}) AS location, tags, noted, source, file, line FROM n0
    UNION ALL SELECT id, id, NULL, {target.format("id")}, [], false, 'annotation', w.f, w.l FROM rf WHERE NOT EXISTS (SELECT 1 FROM nf WHERE nf.id = rf.id)),
  h0 AS (SELECT id, arg_min({{'version': version, 'intent': intent, 'name': s_name, 'later': later, 'file': file}}, {{'a': later, 'f': file, 'o': ord}}) AS x FROM hd GROUP BY id),
  hm AS (SELECT hyperedge_id AS id, min({{'f': file, 'l': line}}) AS w FROM m WHERE hyperedge_id NOT IN (SELECT id FROM hd) GROUP BY 1)
  {select}"""


def oracle_sql() -> dict[str, str]:
    shapes = {
        "nodes": "SELECT id, target, kind, location.path AS at_path, location.line_start AS at_line_start, location.line_end AS at_line_end, location.watch AS at_watch, array_to_string(tags, ',') AS tags, noted, source, file, line FROM n",
        "hyperedges": "SELECT id, x.version AS version, x.intent AS intent, x.name AS tags, CASE WHEN x.later THEN 'annotation' ELSE 'sidecar' END AS source, x.file AS file, NULL::INT AS line, false AS implied FROM h0 UNION ALL SELECT id, 1, '', '', 'annotation', w.f, w.l, true FROM hm",
        "members": "SELECT hyperedge_id, node_id, role, w.r AS required, w.f AS file, w.l AS line FROM (SELECT hyperedge_id, node_id, role, min({'f': file, 'l': line, 'r': required}) AS w FROM m GROUP BY ALL)",
        "edges": "SELECT owner, src, dst, kind, w.f AS file, w.l AS line FROM (SELECT owner, src, dst, kind, min({'f': file, 'l': line}) AS w FROM e GROUP BY ALL)",
    }
    rule = lambda code, severity, where, table="nd", subject="id", line="line": f"SELECT '{severity}' AS severity, '{code}' AS code, {subject} AS subject, file AS path, {line} AS line FROM {table} WHERE {where}"
    s, e = "location.line_start", "location.line_end"
    rules = [
        rule("anchor-schema", "error", "NOT later AND version <> 1"), rule("anchor-id", "error", "NOT later AND id LIKE '% %'"), rule("removed-metadata-field", "error", "NOT later AND noted"), rule("anchor-unlocated", "warning", "NOT later AND target IS NULL AND location IS NULL"),
        rule("anchor-node-location", "error", "NOT later AND location.watch = 'node'"), rule("anchor-path", "error", "NOT later AND (location.path LIKE '/%' OR location.path LIKE '../%')"), rule("anchor-range", "error", f"NOT later AND ({s} = 0 OR {e} = 0 OR {e} < {s})"),
        rule("strand-schema", "error", "NOT later AND version <> 1", "hd", line="NULL"), rule("strand-intent", "warning", "NOT later AND trim(intent) = ''", "hd", line="NULL"), rule("removed-metadata-field", "error", "noted", "m", "node_id"), rule("relation-kind", "error", "trim(kind) = ''", "e", "kind"),
        rule("duplicate-anchor", "error", "NOT later AND k > 1", "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, ord) AS k FROM nd WHERE NOT later)"),
        "SELECT 'error', 'duplicate-anchor', id, nd.file, nd.line FROM nd JOIN nf USING (id) WHERE later AND side IS NULL AND (nd.location IS DISTINCT FROM note.location OR nd.target IS DISTINCT FROM note.target)",
        "SELECT 'error', 'anchor-target-conflict', id, nd.file, nd.line FROM nd JOIN nf USING (id) WHERE later AND side IS NOT NULL AND nd.target <> coalesce(side.target, note_target)",
        rule("duplicate-strand", "error", "k > 1", "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY later, file, ord) AS k FROM hd)", line="NULL"),
        "SELECT 'warning', 'implicit-strand', id, w.f, w.l FROM hm",
        rule("unresolved-anchor", "error", "node_id NOT IN (SELECT id FROM n)", "m", "node_id"), rule("unresolved-relation-anchor", "error", "src NOT IN (SELECT id FROM n)", "e", "src"), rule("unresolved-relation-anchor", "error", "dst NOT IN (SELECT id FROM n)", "e", "dst"),
    ]
    out = {f"assembled_{p}": _sql(sql) for p, sql in shapes.items()} | {f"refresh_graph_{p}": _sql(sql, True) for p, sql in shapes.items()}
    return out | {"diagnostics_all": _sql(" UNION ALL ".join(rules))}
