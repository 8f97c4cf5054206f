"""Context packets over documents: a search, the graph around its hits, and the source that fits a budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import graph as G
from ..operators import packet as K
from ..operators import search as S
from ..operators import spans as N
from ..sources.settled import settle
from ..sources.tables import table
from .graph_plans import links, parts
from .span_plans import _snapped, _snapped_sql, nodes, oracle_sql as _span_oracle

BUDGET, SMALL, GAP = 6000, 2500, 1


def _files(spark, sf_dir):
    return S.files_of(table(spark, sf_dir, "documents"))


def _tests(spark, sf_dir):
    """Lines 3 and 4 of French documents stand for a section that isn't shown."""
    return _files(spark, sf_dir).where("path LIKE 'fr/%'").select("path", F.lit(3).alias("start"), F.lit(4).alias("end"))


def _declared_requests(spark, sf_dir):
    """A request for each node of the documents: the later an item stands in its order, the less it matters."""
    n = nodes(spark, sf_dir)
    whole = F.coalesce(F.col("watch") == "file", F.lit(False))
    line = F.substring_index("id", ":", -1).cast("int")
    last = F.lit(C.LAST_LINE).cast("long")
    return n.select("path", F.when(whole, 1).otherwise(F.col("line_start")).cast("long").alias("start"), F.when(whole, last).otherwise(F.col("line_end")).cast("long").alias("end"), F.floor(line / 3).cast("int").alias("priority"), line.cast("long").alias("ord"), F.array("id").alias("nodes"), F.array(F.concat(F.lit("item:"), "id")).alias("references"), (line == 5).alias("matched"))


def _declared(part, columns):
    def run(spark, sf_dir):
        found = K.packet(_declared_requests(spark, sf_dir), _files(spark, sf_dir), SMALL, GAP, _tests(spark, sf_dir))
        return _shaped(found, part, columns)

    return run


def _shaped(found, part, columns):
    rows = found[part]
    return rows.select(*[F.array_join(c, ",").alias(c) if c in ("nodes", "references") else F.md5(F.col(c).cast("binary")).alias(c) if c == "text" else F.col(c) for c in columns])


def _context(part, columns):
    """Search hits as seeds of a traversal of one step; its nodes and the hits ask for source."""

    def run(spark, sf_dir):
        files, (found, n) = _files(spark, sf_dir), _snapped(spark, sf_dir)
        best = N.without_span_overlaps(found, 12)
        order = Window.orderBy(F.desc("milli"), "n_tokens", "path", "start", "end")  # of twelve rows
        hits = settle(best.withColumn("place", F.row_number().over(order) - 1), "hits")
        near = settle(N.attached(hits, n), "near")
        seeds = near.select(F.col("node_id").alias("id"), F.lit("search").alias("reason"), F.lit(True).alias("from_search")).distinct()
        found = G.context(seeds, spark.createDataFrame([], "hyperedge_id string"), parts(spark, sf_dir), links(spark, sf_dir), 1, any_search=True)
        direct = seeds.select(F.col("id").alias("node_id"), F.lit(True).alias("direct"))
        members = found["members"].join(direct, "node_id", "left").select("hyperedge_id", F.lit(False).alias("hyperedge_direct"), "node_id", "role", F.coalesce("direct", F.lit(False)).alias("direct"))
        related = found["reached"].join(members.select(F.col("node_id").alias("id")), "id", "left_anti").join(direct.withColumnRenamed("node_id", "id"), "id", "left").select(F.col("id").alias("node_id"), F.coalesce("direct", F.lit(False)).alias("direct"))
        asked = C.requests(members, related, n, spark.createDataFrame([], "id string, ord int"))
        requests = K.hit_requests(hits, near).unionByName(K.node_requests(asked))
        return _shaped(K.packet(requests, files, BUDGET, GAP), part, columns)

    return run


_TAKEN, _OMITTED = ["path", "start", "end", "priority", "ord", "nodes", "references", "matched", "text"], ["path", "excerpts", "cost"]


def queries() -> dict:
    return {"packet_taken": _declared("taken", _TAKEN), "packet_omitted": _declared("omitted", _OMITTED), "packet_outside": _declared("outside", ["path", "start", "end"]), "context_packet": _context("taken", _TAKEN), "context_packet_omitted": _context("omitted", _OMITTED)}


def _sql(prefix: str, requests: str, tests: str, budget: int, select: str) -> str:
    said = lambda c: f"list_sort(list_distinct(flatten(list({c}))))"
    island = lambda name, source, keys, gap, more="", tie="": f"""{name}w AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end", ord, nodes, refs, matched{tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
  {name}i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" > before + {gap} + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end", ord, nodes, refs, matched{tie} ROWS UNBOUNDED PRECEDING) AS isl FROM {name}w),
  {name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end", min(ord) AS ord, bool_or(matched) AS matched, {said("nodes")} AS nodes, {said("refs")} AS refs{more} FROM {name}i GROUP BY {keys}, isl)"""  # noqa: E731
    return f"""WITH RECURSIVE {prefix}, rq0 AS ({requests}), rq AS (SELECT DISTINCT * FROM rq0 WHERE "end" < 2147483647 OR path NOT IN (SELECT path FROM rq0 WHERE "end" < 2147483647)),
  {island("mg", "rq", "path, priority", GAP)}, doc AS (SELECT lang || '/' || source || '/' || doc_id AS path, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a0 FROM documents), fl AS (SELECT path, CASE WHEN a0[-1] = '' THEN a0[:-2] ELSE a0 END AS a FROM doc),
  ts AS ({tests}), outs AS (SELECT mg.path, "start", "end" FROM mg JOIN fl USING (path) WHERE "start" > len(a)),
  ln AS (SELECT mg.path, priority, mg."start" AS s0, ord, matched, nodes, refs, a, unnest(generate_series("start", least("end", len(a)))) AS n FROM mg JOIN fl USING (path) WHERE "start" <= len(a)),
  kp AS (SELECT *, n - row_number() OVER (PARTITION BY path, priority, s0 ORDER BY n) AS isl FROM ln WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.path = ln.path AND n BETWEEN ts.s AND ts.e)),
  ex AS (SELECT path, priority, ord, matched, nodes, refs, CAST(min(n) AS BIGINT) AS "start", CAST(max(n) AS BIGINT) AS "end", array_to_string(any_value(a)[min(n) : max(n)], chr(10)) AS src FROM kp GROUP BY path, priority, s0, isl, ord, matched, nodes, refs),
  ms AS MATERIALIZED (SELECT *, CAST(ceil((strlen(src) + 64) / 4.0) AS BIGINT) AS cost, row_number() OVER (ORDER BY priority, ord, path, "start") AS k FROM ex WHERE trim(src, ' ' || chr(10) || chr(9)) <> ''),
  fold AS (SELECT 0::BIGINT AS k, {budget}::BIGINT AS remaining, -1 AS tier, false AS took, false AS passed, false AS blocked, false AS fits
    UNION ALL SELECT k, remaining - CASE WHEN fits THEN cost ELSE 0 END, priority, took OR fits, passed OR (NOT fits AND NOT blocked), blocked, fits FROM (SELECT *, NOT blocked AND cost <= remaining AS fits FROM
      (SELECT ms.k, f.remaining, f.tier = ms.priority AND f.took AS took, f.tier = ms.priority AND f.passed AS passed, f.blocked OR (f.tier <> ms.priority AND f.took AND f.passed) AS blocked, ms.priority, ms.cost FROM fold f JOIN ms ON ms.k = f.k + 1))),
  rs AS (SELECT ms.*, fits FROM ms JOIN fold USING (k)), inc AS (SELECT * FROM rs WHERE fits), {island("tk", "inc", "path", 0, ", min(priority) AS priority", ", priority, k")},
  cv AS (SELECT tk.path, tk."start", tk."end", rs."start" AS s, rs."end" AS e, rs.nodes, rs.refs, rs.matched FROM rs JOIN tk ON tk.path = rs.path AND tk."start" <= rs."start" AND tk."end" >= rs."end" WHERE NOT fits),
  hd AS (SELECT path, "start", "end", flatten(list(nodes)) AS n2, flatten(list(refs)) AS r2, bool_or(matched) AS m2 FROM cv GROUP BY ALL),
  taken AS (SELECT tk.path, "start", "end", priority, ord, array_to_string(list_sort(list_distinct(list_concat(nodes, coalesce(n2, [])))), ',') AS nodes, array_to_string(list_sort(list_distinct(list_concat(refs, coalesce(r2, [])))), ',') AS "references", matched OR coalesce(m2, false) AS matched,
    md5(array_to_string(a["start" : "end"], chr(10))) AS text FROM tk LEFT JOIN hd USING (path, "start", "end") JOIN fl ON fl.path = tk.path),
  omitted AS (SELECT path, count(*) AS excerpts, CAST(sum(cost) AS BIGINT) AS cost FROM rs WHERE NOT fits AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.path = rs.path AND cv.s = rs."start" AND cv.e = rs."end") GROUP BY path) {select}"""


def oracle_sql() -> dict[str, str]:
    hits = _span_oracle()["span_hits"].replace("SELECT path, x.span_start AS span_start", "SELECT row_number() OVER (ORDER BY x.milli DESC, x.n_tokens, path, x.\"start\", x.\"end\") - 1 AS place, path, x.span_start AS span_start")
    from .graph_plans import _SPANS

    node = f"{_SPANS.replace('s AS (', 'item AS (', 1)}, nd AS (SELECT item.id, d.lang || '/' || d.source || '/' || d.doc_id AS path, line_start, line_end, watch, l_linenumber AS k FROM (SELECT item.*, CAST(split_part(id, ':', 2) AS INT) AS l_linenumber FROM item) item JOIN documents d ON d.doc_id = item.l_orderkey)"
    declared = """SELECT path, CAST(CASE WHEN coalesce(watch = 'file', false) THEN 1 ELSE line_start END AS BIGINT) AS "start", CAST(CASE WHEN coalesce(watch = 'file', false) THEN 2147483647 ELSE line_end END AS BIGINT) AS "end",
      CAST(k // 3 AS INT) AS priority, CAST(k AS BIGINT) AS ord, [id] AS nodes, ['item:' || id] AS refs, k = 5 AS matched FROM nd"""
    tests = "SELECT path, 3 AS s, 4 AS e FROM fl WHERE path LIKE 'fr/%'"
    of = lambda select: _sql(node, declared, tests, SMALL, select)
    graph = f"""{node}, hit AS MATERIALIZED ({hits}), at0 AS (SELECT DISTINCT hit.path, span_start, span_end, id FROM hit JOIN nd USING (path) WHERE coalesce(watch, 'range') <> 'file' AND line_start <= span_end AND span_start <= line_end),
  at_ AS (SELECT * FROM at0 UNION ALL SELECT hit.path, span_start, span_end, id FROM hit JOIN nd USING (path) WHERE watch = 'file' AND NOT EXISTS (SELECT 1 FROM at0 WHERE at0.path = hit.path AND at0.span_start = hit.span_start AND at0.span_end = hit.span_end)),
  seed AS (SELECT DISTINCT id FROM at_), step AS (SELECT id AS src, l_orderkey || ':' || (line_start + 1) AS dst FROM item), near AS (SELECT id FROM seed UNION SELECT dst FROM step WHERE src IN (SELECT id FROM seed) UNION SELECT src FROM step WHERE dst IN (SELECT id FROM seed)),
  mem AS (SELECT DISTINCT 's' || l_suppkey AS h, id, l_returnflag AS role FROM item WHERE id IN (SELECT id FROM near))"""
    asked = """SELECT hit.path, CAST(span_start AS BIGINT) AS "start", CAST(span_end AS BIGINT) AS "end", 0 AS priority, CAST(place AS BIGINT) AS ord, coalesce((SELECT list_sort(list(DISTINCT id)) FROM at_ WHERE at_.path = hit.path AND at_.span_start = hit.span_start AND at_.span_end = hit.span_end), []) AS nodes, ['search'] AS refs, true AS matched FROM hit
      UNION ALL SELECT path, CAST(CASE WHEN coalesce(watch = 'file', false) THEN 1 ELSE line_start END AS BIGINT), CAST(CASE WHEN coalesce(watch = 'file', false) THEN 2147483647 ELSE line_end END AS BIGINT), CASE WHEN nd.id IN (SELECT id FROM seed) THEN 1 ELSE 3 END, 2147483647, [nd.id], [h || '/' || role || ':' || nd.id], false FROM mem JOIN nd USING (id)"""
    around = lambda select: _sql(graph, asked, "SELECT NULL AS path, 0 AS s, 0 AS e WHERE false", BUDGET, select)
    return {"packet_taken": of("SELECT * FROM taken"), "packet_omitted": of("SELECT * FROM omitted"), "packet_outside": of("SELECT * FROM outs"), "context_packet": around("SELECT * FROM taken"), "context_packet_omitted": around("SELECT * FROM omitted")}
