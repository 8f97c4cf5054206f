"""Search with declared spans as units, from hits to spans and nodes, and the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings as P
from ..operators import search as S
from ..operators import spans as N
from ..sources.settled import new_path, settle
from ..sources.tables import table
from .graph_plans import _SPANS, spans
from .search_plans import _UNITS, PHRASE, TEXT, ranked_sql


def _files(spark, sf_dir):
    return S.files_of(table(spark, sf_dir, "documents"))


def nodes(spark, sf_dir):
    """Nodes with lines in documents: the items of the order with a document's number lie in its lines."""
    rows = spans(spark, sf_dir).select("id", "line_start", "line_end", "watch", F.col("l_orderkey").alias("doc_id"))
    return rows.join(_files(spark, sf_dir).select("doc_id", "path"), "doc_id").select("id", "path", "line_start", "line_end", "watch")


def ranked_spans(spark, sf_dir):
    rows = S.ranked(_files(spark, sf_dir), TEXT, spans=N.declared(nodes(spark, sf_dir)))
    return rows.orderBy(F.desc("milli"), "n_tokens", "path", "start", "end").limit(20).select("path", "start", "end", "anchored", "n_tokens", "milli")


def _snapped(spark, sf_dir):
    """Hits with their spans, and the nodes of the documents."""
    files, n = _files(spark, sf_dir), settle(nodes(spark, sf_dir), "nodes")
    hits = S.ranked(files, TEXT, spans=N.declared(n))
    return settle(N.snapped(hits, files, n, T.parse_query(TEXT)), "snapped"), n


def hit_span(spark, sf_dir):
    return _snapped(spark, sf_dir)[0].select("path", "start", "end", "line", "span_start", "span_end", "by")


def hit_nodes(spark, sf_dir):
    rows = N.attached(*_snapped(spark, sf_dir))
    return rows.select("path", "span_start", "span_end", "node_id")


def span_hits(spark, sf_dir):
    """The best spans of a search, none of which overlaps a better one."""
    return N.without_span_overlaps(_snapped(spark, sf_dir)[0], 12).select("path", "span_start", "span_end", "by", "line", "milli")


def _indexed(use):
    """A query over an index that is built, opened again by its path, and dropped when the result is stored."""

    def run(spark, sf_dir):
        path = new_path(spark, "index")
        P.build(_files(spark, sf_dir), path)
        index = P.opened(spark, path)
        out = settle(use(index, spark, sf_dir), "result")
        P.drop(index)
        return out

    return run


def _postings(index, spark, sf_dir):
    of_unit = F.aggregate("positions", F.lit(0).cast("long"), lambda n, p: n + p)
    return index.postings().groupBy("term").agg(F.sum(F.size("positions")).alias("tf"), F.count("*").alias("df"), F.sum(of_unit).alias("positions"))


def _ranked(query, paths=None):
    def use(index, spark, sf_dir):
        rows = P.ranked(index, query, paths).orderBy(F.desc("milli"), "n_tokens", "path", "start").limit(8)
        return rows.select("path", "start", "end", "n_tokens", "milli", F.array_join("matched", " ").alias("matched"))

    return use


def _side(spark, sf_dir, new):
    d = table(spark, sf_dir, "documents").where("doc_id % 13 <> 0" if new else "doc_id % 11 <> 0")
    return S.files_of(d.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!\nOne more line"))).otherwise(F.col("text")))) if new else S.files_of(d)


def refresh_postings(spark, sf_dir):
    """Counts of terms after an index of the old documents was refreshed for those that changed, came or went."""
    from ..operators import records as R

    path = new_path(spark, "index")
    old, new = _side(spark, sf_dir, False), _side(spark, sf_dir, True)
    hashed = lambda df: df.select("path", F.md5(F.col("text").cast("binary")).alias("hash"))
    index = P.build(old, path)
    index = P.refresh(index, new, R.manifest_difference(hashed(old), hashed(new)), "one")
    out = settle(index.terms(), "result")
    P.drop(index)
    return out


def queries() -> dict:
    return {
        "ranked_spans": ranked_spans, "hit_span": hit_span, "hit_nodes": hit_nodes, "span_hits": span_hits, "index_postings": _indexed(_postings), "refresh_postings": refresh_postings,
        "ranked_postings": _indexed(_ranked(TEXT)), "ranked_postings_phrase": _indexed(_ranked(PHRASE)), "ranked_postings_path": _indexed(_ranked(TEXT, ["en/src1", "fr"])),
    }


_TOKENS = r"list_filter(string_split(regexp_replace(lower(regexp_replace(array_to_string({}, chr(10)), '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
#: Declared spans and chunks as units, in place of chunks alone.
_SPAN_UNITS = f"""{_UNITS.replace("u AS (", "chunk AS (")},
  {_SPANS.replace("s AS (", "item AS (", 1)}, node AS (SELECT item.id, l.path, l.doc_id, line_start, line_end, watch FROM item JOIN l ON l.doc_id = item.l_orderkey),
  own AS (SELECT DISTINCT l.doc_id, l.path, l.a, CAST(line_start AS BIGINT) AS "start", CAST(least(line_end, len(a)) AS BIGINT) AS "end" FROM node JOIN l USING (doc_id) WHERE coalesce(watch, 'range') <> 'file' AND line_start <= len(a)),
  both_ AS (SELECT doc_id, path, a, true AS anchored, "start", "end" FROM own UNION ALL SELECT doc_id, path, a, false, i * 48 + 1, least(i * 48 + 56, len(a)) FROM r
    WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = r.doc_id AND own."start" = i * 48 + 1 AND own."end" = least(i * 48 + 56, len(r.a)))),
  u AS (SELECT doc_id, path, a, anchored, "start", "end", a["start" : "end"] AS lines, {_TOKENS.format('a["start" : "end"]')} AS tokens FROM both_)"""


def _span_sql(select: str, tail: str = "") -> str:
    return ranked_sql(TEXT, tail=tail, select=select).replace(_UNITS, _SPAN_UNITS)


def _snapped_sql() -> str:
    q = T.parse_query(TEXT)
    tok = _TOKENS.format("[x]")
    w = " + ".join(f"CASE WHEN list_contains({tok}, '{t}') THEN idf{i} ELSE 0 END" for i, t in enumerate(q.terms))
    line = "list_reduce(list_transform(lines, lambda x, i: {'w': CAST(round((" + w + ") * 1000000) AS BIGINT), 'i': i}), lambda p, q: CASE WHEN q.w > p.w THEN q ELSE p END).i"
    z = _span_sql(f'doc_id, path, a, anchored, "start", "end", n_tokens, milli, "start" + {line} - 1 AS line')
    return f"""WITH z0 AS ({z}), {_SPANS}, k AS (SELECT s.id, f.path, line_start, line_end, watch FROM s JOIN (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path FROM documents) f ON f.doc_id = s.l_orderkey),
  best AS (SELECT path, line, min({{'n': line_end - line_start, 'id': id, 's': line_start, 'e': line_end}}) AS b FROM (SELECT DISTINCT path, line FROM z0) p JOIN k USING (path) WHERE coalesce(watch, 'range') <> 'file' AND line BETWEEN line_start AND line_end GROUP BY ALL),
  x AS (SELECT z0.*, b, list_filter(generate_series(0, 40), lambda o: o = 40 OR line - o <= 1 OR trim(a[line - o - 1]) = '' OR regexp_matches(trim(a[line - o]), '^(#|section |namespace |module )'))[1] AS up FROM z0 LEFT JOIN best USING (path, line)),
  y AS (SELECT *, list_filter(generate_series(line, greatest(line, least(len(a), line - up + 79))), lambda e: e >= least(len(a), line - up + 79) OR trim(a[e + 1]) = '' OR regexp_matches(trim(a[e + 1]), '^(#|section |namespace |module )'))[1] AS down FROM x),
  h AS (SELECT path, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", CAST(line AS INT) AS line, CAST(CASE WHEN anchored THEN "start" ELSE coalesce(b.s, line - up) END AS INT) AS span_start,
    CAST(CASE WHEN anchored THEN "end" ELSE coalesce(b.e, down) END AS INT) AS span_end, CASE WHEN anchored THEN 'declared' WHEN b IS NOT NULL THEN 'node' ELSE 'section' END AS "by", n_tokens, milli FROM y)"""


def oracle_sql() -> dict[str, str]:
    ranked = lambda query, where="true": ranked_sql(query, where, select='path, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", CAST(n_tokens AS INT) AS n_tokens, milli, matched')
    side = _UNITS.replace("coalesce(text, '')", "coalesce(CASE WHEN doc_id % 7 = 0 THEN text || '!' || chr(10) || 'One more line' ELSE text END, '')").replace("FROM documents", "FROM documents WHERE doc_id % 13 <> 0")
    counted = ", t AS (SELECT doc_id, start, unnest(tokens) AS term FROM u) SELECT term, count(*) AS tf, count(DISTINCT (doc_id, start)) AS df FROM t GROUP BY term"
    clash = 'least(a.span_end, h[1].span_end) >= greatest(a.span_start, h[1].span_start) AND 2 * (least(a.span_end, h[1].span_end) - greatest(a.span_start, h[1].span_start) + 1) >= least(a.span_end - a.span_start + 1, h[1].span_end - h[1].span_start + 1)'
    return {
        "ranked_spans": _span_sql('path, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", anchored, CAST(n_tokens AS INT) AS n_tokens, milli', 'ORDER BY milli DESC, n_tokens, path, "start", "end" LIMIT 20'),
        "hit_span": _snapped_sql() + ' SELECT path, "start", "end", line, span_start, span_end, "by" FROM h',
        "hit_nodes": _snapped_sql() + """, w AS (SELECT DISTINCT path, span_start, span_end FROM h), m AS (SELECT DISTINCT w.*, k.id AS node_id FROM w JOIN k USING (path) WHERE coalesce(watch, 'range') <> 'file' AND line_start <= span_end AND span_start <= line_end)
            SELECT * FROM m UNION ALL SELECT w.*, k.id FROM w JOIN k USING (path) WHERE watch = 'file' AND NOT EXISTS (SELECT 1 FROM m WHERE m.path = w.path AND m.span_start = w.span_start AND m.span_end = w.span_end)""",
        "span_hits": _snapped_sql() + f""", o AS (SELECT path, list({{'milli': milli, 'n_tokens': n_tokens, 'start': "start", 'end': "end", 'span_start': span_start, 'span_end': span_end, 'by': "by", 'line': line}} ORDER BY milli DESC, n_tokens, "start", "end") AS hits FROM h GROUP BY path),
            g AS (SELECT path, unnest(list_reduce(list_prepend([hits[1]][:0], list_transform(hits, lambda h: [h])), lambda acc, h: CASE WHEN len(list_filter(acc, lambda a: {clash})) > 0 THEN acc ELSE list_concat(acc, h) END)) AS x FROM o)
            SELECT path, x.span_start AS span_start, x.span_end AS span_end, x."by" AS "by", x.line AS line, x.milli AS milli FROM g ORDER BY milli DESC, x.n_tokens, path, x."start", x."end" LIMIT 12""",
        "index_postings": _UNITS + ", t AS (SELECT doc_id, start, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM u) SELECT term, count(*) AS tf, count(DISTINCT (doc_id, start)) AS df, CAST(sum(pos) AS BIGINT) AS positions FROM t GROUP BY term",
        "refresh_postings": side + counted,
        "ranked_postings": ranked(TEXT), "ranked_postings_phrase": ranked(PHRASE), "ranked_postings_path": ranked(TEXT, "(path LIKE 'en/src1/%' OR path LIKE 'fr/%')"),
    }
