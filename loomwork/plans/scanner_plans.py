"""Source text made of orders, its scanners, and records made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scanners as X
from ..operators import search as S
from ..sources import documents as D
from ..sources.settled import settle
from ..sources.tables import table
from .search_plans import _UNITS, ranked_sql

BLOCK = 6
TEXT = "red widget bolt"


def sources(spark, sf_dir):
    """A Rust file for each order: six lines for each of its items, functions with brackets in strings and comments, or structs."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = F.col("l_partkey")
    first = [t("// @anchor o.", F.col("l_orderkey"), " "), F.when(flag == "A", "#[test]").when(flag == "R", "  #[cfg(all(not(test), x))]").otherwise("#[inline]")]
    body = [t("fn f", own, "(x: [u8; 4]) {"), t('    let s = "}} {{ \\" ; ', F.col("p_name"), '"; // }'), t("    if x { /* } */ y('{'); } ", F.col("p_brand")), t("}")]
    struct = [t("struct S", own, ";"), t(""), t(" "), t("")]
    lines = F.when(F.col("l_quantity") < 10, F.array(*first, *struct)).otherwise(F.array(*first, *body))
    rows = items.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", lines.alias("lines")).alias("x"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.array_join(F.flatten(F.transform("xs", lambda x: x["lines"])), "\n")
    return rows.select(F.concat(F.lit("src/"), "l_orderkey", F.lit(".rs")).alias("path"), text.alias("text"), F.size("xs").alias("n"))


def _markers(files):
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: k * BLOCK + 1))
    return files.select("path", at.alias("line"))


def _span(scan):
    def run(spark, sf_dir):
        files = settle(sources(spark, sf_dir), "sources")
        return scan(files, _markers(files)).select("path", "line", "start", "end", "error")

    return run


def test_sections(spark, sf_dir):
    return X.test_ranges(sources(spark, sf_dir))


def search_without_tests(spark, sf_dir):
    files = settle(sources(spark, sf_dir).select(F.lit(0).alias("doc_id"), "path", "text"), "sources")
    rows = S.ranked(files, TEXT, tests=X.test_ranges(files))
    return rows.orderBy(F.desc("milli"), "n_tokens", "path", "start").limit(20).select("path", "start", "end", "n_tokens", "milli")


_FIELDS = {"id": "bigint", "k": "bigint", "kind": "string"}


def event_documents(spark, sf_dir):
    """Events as documents: wrapped, listed or single records, some of them cut off, without an id, or with one of another type."""
    i, e = F.col("event_id"), table(spark, sf_dir, "events")
    inner = F.concat(F.lit('"k": '), F.get_json_object("props", "$.k"), F.lit(', "kind": "'), "event_type", F.lit('", "seen": ['), F.get_json_object("props", "$.k"), F.lit("]"))
    one = F.concat(F.lit('{\n"id": '), F.when(i % 11 == 0, F.concat(F.lit('"e'), i, F.lit('"'))).otherwise(i.cast("string")), F.lit(",\n"), inner, F.lit("}"))
    two = F.concat(F.lit('{"id": '), (i + 1000000).cast("string"), F.lit("}"))
    text = F.when(i % 7 == 0, F.concat(F.lit('{"items": ['), one, F.lit(",\n"), two, F.lit("]}"))).when(i % 7 == 1, F.concat(F.lit("["), one, F.lit("]"))).when(i % 7 == 2, F.concat(F.lit("{"), inner, F.lit("}"))).when(i % 7 == 3, F.lit("7")).otherwise(one)
    text = F.when(i % 13 == 0, F.substring(text, 1, 20)).otherwise(text)
    return e.select(i.cast("string").alias("path"), text.alias("text"))


def records_flat(spark, sf_dir):
    return D.records(event_documents(spark, sf_dir), "items", _FIELDS).select("path", "place", "line", "id", "k", "kind", F.col("other").isNotNull().alias("kept"))


def record_errors(spark, sf_dir):
    return D.record_errors(event_documents(spark, sf_dir), "items", _FIELDS)


def queries() -> dict:
    return {"structural_span": _span(X.structural_spans), "declaration_span": _span(X.declaration_spans), "test_ranges": test_sections, "search_without_tests": search_without_tests, "records_flat": records_flat, "record_errors": record_errors}


_ITEMS = "it AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag, l_quantity, l_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"


def oracle_sql() -> dict[str, str]:
    length = "CASE WHEN l_quantity < 10 THEN 3 ELSE 6 END"
    spans = f"""WITH {_ITEMS} SELECT 'src/' || l_orderkey || '.rs' AS path, CAST(6 * (k - 1) + 1 AS INT) AS line, CAST(6 * (k - 1) + 3 AS INT) AS start, CAST(6 * (k - 1) + {length} AS INT) AS "end", NULL AS error FROM it
        UNION ALL SELECT DISTINCT 'src/' || l_orderkey || '.rs', CAST(6 * n + 1 AS INT), NULL::INT, NULL::INT, '{X.OUTSIDE}' FROM it"""
    code = """['fn f' || l_partkey || '(x: [u8; 4]) {', '    let s = "}} {{ \\" ; ' || p_name || '"; // }', '    if x { /* } */ y(''{''); } ' || p_brand, '}']"""
    attribute = "CASE l_returnflag WHEN 'R' THEN '  #[cfg(all(not(test), x))]' ELSE '#[inline]' END"
    block = f"CASE WHEN l_returnflag = 'A' AND l_quantity < 10 THEN ['// ', '', '', '', ' ', ''] WHEN l_returnflag = 'A' THEN ['// ', '', '', '', '', ' '] WHEN l_quantity < 10 THEN ['// ', {attribute}, 'struct S' || l_partkey || ';', '', ' ', ''] ELSE list_concat(['// ', {attribute}], {code}) END"
    # the end of a struct's test section is its own line, so blank lines below it stay; the file's text without test sections
    files = f"WITH {_ITEMS}, b AS (SELECT l_orderkey, k, {block} AS x FROM it), f AS (SELECT 0 AS doc_id, 'src/' || l_orderkey || '.rs' AS path, flatten(list(x ORDER BY k)) AS a FROM b GROUP BY l_orderkey)"
    units = files + _UNITS[_UNITS.index(",\nl AS"):]
    # a file takes part if a term stands anywhere in it, in test sections too
    all_code = f"SELECT l_orderkey, string_agg(CASE WHEN l_quantity < 10 THEN ' s' || l_partkey ELSE ' f' || l_partkey || ' ' || p_name || ' ' || lower(p_brand) END, ' ') AS w FROM it GROUP BY l_orderkey"
    ranked = ranked_sql(TEXT, tail='ORDER BY milli DESC, n_tokens, path, start LIMIT 20', select='path, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", CAST(n_tokens AS INT) AS n_tokens, milli').replace(_UNITS, units)
    ranked = ranked.replace("g AS (SELECT doc_id FROM u WHERE true GROUP BY doc_id HAVING bool_or(list_has_any(tokens, ['bolt', 'red', 'widget'])))", f"w0 AS ({all_code}), g AS (SELECT 'src/' || l_orderkey || '.rs' AS path FROM w0 WHERE list_has_any(string_split(w, ' '), ['bolt', 'red', 'widget']))").replace("JOIN g USING (doc_id)", "JOIN g USING (path)")
    event = """WITH e AS (SELECT event_id AS i, CAST(event_id AS VARCHAR) AS path, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events)"""
    good = "i % 13 <> 0 AND i % 7 NOT IN (2, 3) AND i % 11 <> 0"
    return {
        "structural_span": spans, "declaration_span": spans,
        "test_ranges": f"""WITH {_ITEMS} SELECT 'src/' || l_orderkey || '.rs' AS path, CAST(6 * (k - 1) + 2 AS INT) AS start, CAST(6 * (k - 1) + {length} AS INT) AS "end" FROM it WHERE l_returnflag = 'A'""",
        "search_without_tests": ranked,
        "records_flat": event + f""" SELECT path, 0 AS place, 2 AS line, i AS id, k, kind, true AS kept FROM e WHERE {good}
            UNION ALL SELECT path, 1, NULL, i + 1000000, NULL, NULL, true FROM e WHERE {good} AND i % 7 = 0""",
        "record_errors": event + """ SELECT 'error' AS severity, 'metadata-parse' AS code, path, CASE WHEN i % 13 = 0 AND NOT (i % 7 = 3) THEN 'not JSON' WHEN i % 7 = 3 THEN 'neither records nor a record' WHEN i % 7 = 2 THEN 'missing field id' ELSE 'field id isn''t bigint' END AS message
            FROM e WHERE i % 13 = 0 OR i % 7 IN (2, 3) OR i % 11 = 0""",
    }
