"""Search queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import search as S
from ..sources.tables import table

#: What the registered queries look for.
TEXT, PHRASE, WITHOUT = "then thing pour", '"of the" thing', "thing then -pour"


def _files(spark, sf_dir):
    return S.files_of(table(spark, sf_dir, "documents"))


def _hits(query, paths=None, k=8):
    def run(spark, sf_dir):
        rows = S.ranked(_files(spark, sf_dir), query, paths)
        return S.top(rows.select("doc_id", "path", "start", "end", "n_tokens", "milli", F.array_join("matched", " ").alias("matched")), k)

    return run


def best_line(spark, sf_dir):
    q = T.parse_query(TEXT)
    files = _files(spark, sf_dir)
    return S.with_lines(S.ranked(files, q), files).select("doc_id", "start", S.best_line(q).alias("line"))


def dedup_hits(spark, sf_dir):
    rows = S.ranked(_files(spark, sf_dir), TEXT)
    return S.without_overlaps(rows, 20)


def tokenize(spark, sf_dir):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


def chunk_lines(spark, sf_dir):
    return S.chunks(_files(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("h"))


def term_stats(spark, sf_dir):
    return S.term_statistics(_files(spark, sf_dir)).select("term", F.col("tf").cast("long"), F.col("df").cast("long"))


def bloom_prune(spark, sf_dir):
    q = T.parse_query(TEXT)
    files = _files(spark, sf_dir)
    maybe = F.lit(False)
    for t in q.terms:
        maybe = maybe | S.may_contain(F.col("bloom"), t)
    kept = S.blooms(files).where(maybe).select("doc_id")
    return S.with_terms(files.join(kept, "doc_id"), q).select("doc_id")


def section_span(spark, sf_dir):
    return S.sections(_files(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long"), F.col("section_start").cast("long"), F.col("section_end").cast("long"))


def path_normalize(spark, sf_dir):
    p = F.concat(F.lit("././"), F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("\\")))
    return table(spark, sf_dir, "pages").select("page_id", P.normalize_path(p).alias("path"))


def extension_filter(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", P.extension(bare).alias("ext")).where("ext IS NOT NULL")


def language_map(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "mjs", "cts", "zsh", "yml", "go")]), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", P.language(ext).alias("language"))


def path_language(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".rs", ".PY", ".html", "", ".d.ts", "/.md")]), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.path_language(F.concat(F.lit("src/p"), "p_partkey", ext)).alias("language"))


def id_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.slug(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("file"))


def glob_filter(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.where(P.matches_any(F.col("path"), ["en/src1*/*[02468]", "{de,fr}/src?/**"]) & ~P.matches_any(F.col("path"), ["**/src13/*"])).select("doc_id", "path")


def file_target(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.when(n % 3 == 0, F.concat(F.lit("file://./a/"), "l_partkey", F.lit(".rs#L"), n, F.lit("-L"), n + 4)).when(n % 3 == 1, F.concat(F.lit("b/"), "l_suppkey", F.lit(".py"))).otherwise(F.concat(F.lit("rust://c/"), "l_partkey"))
    t = P.file_target(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t["path"].alias("path"), t["line_start"].cast("long").alias("line_start"), t["line_end"].cast("long").alias("line_end"), t["watch"].alias("watch"))


def typed_scalar(spark, sf_dir):
    n = F.col("p_partkey") % 6
    x = F.when(n == 0, "TRUE").when(n == 1, F.col("p_size").cast("string")).when(n == 2, F.concat("p_size", F.lit(".5"))).when(n == 3, "null").when(n == 4, "inf").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", P.typed_scalar(x).alias("kind"))


_UNITS = r"""
WITH f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM f),
r AS (SELECT doc_id, path, a, unnest(generate_series(0, greatest(CAST(ceil((len(a) - 56) / 48.0) AS BIGINT), 0))) AS i FROM l WHERE len(a) > 0),
c AS (SELECT doc_id, path, i * 48 + 1 AS "start", least(i * 48 + 56, len(a)) AS "end", a[i * 48 + 1 : least(i * 48 + 56, len(a))] AS lines FROM r),
u AS (SELECT *, list_filter(string_split(regexp_replace(lower(regexp_replace(array_to_string(lines, chr(10)), '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS tokens FROM c)"""


def ranked_sql(query: str, where: str = "true", tail: str = "ORDER BY milli DESC, n_tokens, path, start LIMIT 8", select: str | None = None) -> str:
    q = T.parse_query(query)
    terms = ", ".join(f"'{t}'" for t in q.terms)
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN idf{i} * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n_tokens / greatest(average, 1.0)))) ELSE 0 END" for i in range(len(q.terms)))
    for p in q.phrases:
        own = " + ".join(f"idf{q.terms.index(t)}" for t in p if t in q.terms) or "0"
        score += f" + CASE WHEN contains(array_to_string(tokens, ' '), '{' '.join(p)}') THEN 0.75 * ({own}) ELSE 0 END"
    matched = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(q.terms)))
    names = ", ".join(f"CASE WHEN tf{i} > 0 THEN '{t}' END" for i, t in enumerate(q.terms))
    excluded = f"AND NOT list_has_any(tokens, [{', '.join(repr(t) for t in q.excluded)}])" if q.excluded else ""
    idf = lambda i: f"ln(1 + (count(*) - sum((tf{i} > 0)::INT) + 0.5) / (sum((tf{i} > 0)::INT) + 0.5))"
    select = select or "doc_id, path, CAST(start AS INT) AS start, CAST(\"end\" AS INT) AS \"end\", CAST(n_tokens AS INT) AS n_tokens, milli, matched"
    return f"""{_UNITS},
g AS (SELECT doc_id FROM u WHERE {where} GROUP BY doc_id HAVING bool_or(list_has_any(tokens, [{terms}]))),
v AS (SELECT *, len(tokens) AS n_tokens, {", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(q.terms))} FROM u JOIN g USING (doc_id) WHERE len(tokens) > 0),
s AS (SELECT sum(n_tokens) / count(*) AS average, {", ".join(f"{idf(i)} AS idf{i}" for i in range(len(q.terms)))} FROM v),
w AS (SELECT *, ({score}) * (0.35 + 0.65 * ({matched}) / {len(q.terms)}.0) AS score, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ' ') AS matched FROM v, s),
z AS (SELECT *, CAST(round(score * 1000) AS BIGINT) AS milli FROM w WHERE score > 0 {excluded})
SELECT {select} FROM z {tail}"""


def _best_line_sql() -> str:
    q = T.parse_query(TEXT)
    tok = r"string_split(regexp_replace(lower(regexp_replace(x, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"
    w = " + ".join(f"CASE WHEN list_contains({tok}, '{t}') THEN idf{i} ELSE 0 END" for i, t in enumerate(q.terms))
    line = "list_reduce(list_transform(lines, lambda x, i: {'w': CAST(round((" + w + ") * 1000000) AS BIGINT), 'i': i}), lambda a, b: CASE WHEN b.w > a.w THEN b ELSE a END).i"
    return ranked_sql(TEXT, tail="", select=f'doc_id, CAST(start AS INT) AS start, CAST(start + {line} - 1 AS INT) AS line')


def _dedup_sql() -> str:
    inner = ranked_sql(TEXT, tail="", select="doc_id, path, start, \"end\", n_tokens, milli")
    return f"""WITH z0 AS ({inner}), o AS (SELECT path, list({{'milli': milli, 'n_tokens': n_tokens, 'start': start, 'end': "end", 'doc_id': doc_id}} ORDER BY milli DESC, n_tokens, start) AS hits FROM z0 GROUP BY path),
k AS (SELECT path, list_reduce(hits, lambda acc, h: CASE WHEN len(list_filter(acc, lambda a: least(a."end", h[1]."end") >= greatest(a.start, h[1].start) AND 2 * (least(a."end", h[1]."end") - greatest(a.start, h[1].start) + 1) >= least(a."end" - a.start + 1, h[1]."end" - h[1].start + 1))) > 0 THEN acc ELSE list_concat(acc, h) END) AS kept
FROM (SELECT path, list_prepend([hits[1]][:0], list_transform(hits, lambda h: [h])) AS hits FROM o) t), e AS (SELECT path, unnest(kept) AS h FROM k)
SELECT path, h.doc_id AS doc_id, CAST(h.start AS INT) AS start, CAST(h."end" AS INT) AS "end", CAST(h.n_tokens AS INT) AS n_tokens, h.milli AS milli FROM e ORDER BY milli DESC, n_tokens, path, start LIMIT 20"""


def queries() -> dict:
    return {
        "ranked_search": _hits(TEXT), "ranked_search_phrase": _hits(PHRASE), "ranked_search_exclude": _hits(WITHOUT), "ranked_search_path": _hits(TEXT, ["en/src1", "fr"]),
        "best_line": best_line, "dedup_hits": dedup_hits, "tokenize": tokenize, "chunk_lines": chunk_lines, "term_stats": term_stats, "bloom_prune": bloom_prune, "section_span": section_span,
        "path_normalize": path_normalize, "extension_filter": extension_filter, "language_map": language_map, "path_language": path_language, "id_slug": id_slug, "glob_filter": glob_filter, "file_target": file_target, "typed_scalar": typed_scalar,
    }


def oracle_sql() -> dict[str, str]:
    tok = r"list_filter(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    terms = ", ".join(f"'{t}'" for t in T.parse_query(TEXT).terms)
    return {
        "ranked_search": ranked_sql(TEXT), "ranked_search_phrase": ranked_sql(PHRASE), "ranked_search_exclude": ranked_sql(WITHOUT),
        "ranked_search_path": ranked_sql(TEXT, "(path LIKE 'en/src1/%' OR path LIKE 'fr/%')"),
        "best_line": _best_line_sql(), "dedup_hits": _dedup_sql(),
        "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok} AS t FROM documents)",
        "chunk_lines": _UNITS + " SELECT doc_id, start, \"end\", md5(array_to_string(lines, chr(10))) AS h FROM u",
        "term_stats": _UNITS + ", t AS (SELECT doc_id, start, unnest(tokens) AS term FROM u) SELECT term, count(*) AS tf, count(DISTINCT (doc_id, start)) AS df FROM t GROUP BY term",
        "bloom_prune": f"SELECT doc_id FROM documents WHERE list_has_any({tok}, [{terms}])",
        "section_span": _UNITS + """, x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM l),
            y AS (SELECT *, coalesce(max(CASE WHEN trim(line) = '' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no), 0) + 1 AS b,
                  coalesce(min(CASE WHEN trim(line) = '' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(line_no) OVER (PARTITION BY doc_id) + 1) - 1 AS e FROM x)
            SELECT doc_id, line_no, greatest(b, line_no - 40) AS section_start, least(e, greatest(b, line_no - 40) + 79) AS section_end FROM y WHERE trim(line) <> ''""",
        "path_normalize": r"SELECT page_id, regexp_replace(replace('././' || replace(regexp_replace(url, '^https?://', ''), '/', '\'), '\', '/'), '^(\./)+', '') AS path FROM pages",
        "extension_filter": r"SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '[^/.][^/]*\.([^./]+)$', 1)) AS ext FROM pages WHERE regexp_matches(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '[^/.][^/]*\.([^./]+)$')",
        "path_language": "SELECT p_partkey, ['rust', 'python', NULL, NULL, 'typescript', NULL][p_size % 6 + 1] AS language FROM part",
        "language_map": "SELECT page_id, ['rust', 'javascript', 'typescript', 'bash', 'yaml', 'go'][page_id % 6 + 1] AS language FROM pages",
        "id_slug": r"WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '-') END AS id FROM part), s AS (SELECT *, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') AS plain FROM i) SELECT p_partkey, CASE WHEN plain = id THEN plain || '.yaml' ELSE plain || '-' || substr(sha256(id), 1, 8) || '.yaml' END AS file FROM s",
        "glob_filter": "WITH f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path FROM documents) SELECT * FROM f WHERE (regexp_matches(path, '^en/src1[^/]*/[^/]*[02468]$') OR regexp_matches(path, '^(de|fr)/src[^/]/.*$')) AND NOT regexp_matches(path, '^(.*/)?src13/[^/]*$')",
        "file_target": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'a/' || l_partkey || '.rs' WHEN 1 THEN 'b/' || l_suppkey || '.py' END AS path,
            CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS BIGINT) AS line_start, CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber + 4 END AS BIGINT) AS line_end,
            CASE l_linenumber % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'file' END AS watch FROM lineitem""",
        "typed_scalar": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'number' WHEN 3 THEN 'null' ELSE 'string' END AS kind FROM part",
    }
