"""Locations, ids and change sets as their validators and fingerprints see them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validation as V
from ..operators import records as R
from ..sources.tables import table
from .context_plans import change_set


def location_faults(spark, sf_dir):
    """Items as locations: paths of all kinds, lines that run backwards, and lines without a path."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    path = F.when(q % 6 == 1, F.concat(F.lit("/"), "l_partkey")).when(q % 6 == 2, F.concat(F.lit("a\\..\\"), "l_partkey")).when(q % 6 == 3, F.concat(F.lit(".\\./b/"), "l_partkey")).when(q % 6 == 4, F.lit(" ")).when(q % 6 == 5, F.concat("l_partkey", F.lit(".rs")))
    start, end = F.when(n > 2, n - 3), F.when(n % 2 == 0, n - 2)
    fault = V.location_fault(path, start, end, F.lit(None).cast("string"), F.when(F.col("l_returnflag") == "A", "file"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"), fault.alias("fault"), V.is_dynamic(path).alias("dynamic"), V.hit_reason(F.coalesce(path, F.lit("")), n, n + q).alias("reason"))


def id_faults(spark, sf_dir):
    key = F.when(F.col("p_size") % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("."))).when(F.col("p_size") % 4 == 1, F.col("p_brand")).when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise(F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", V.id_fault(key).isNotNull().alias("bad"), V.review_id_fault(key).isNotNull().alias("bad_review"), V.is_declarations(F.concat(key, F.lit(".JSON"))).alias("declarations"))


def change_fingerprint(spark, sf_dir):
    rows = change_set(spark, sf_dir)
    return R.fingerprint(rows, ["path", "old_path", "status", "ranges"])


def queries() -> dict:
    return {"location_faults": location_faults, "id_faults": id_faults, "change_fingerprint": change_fingerprint}


def oracle_sql() -> dict[str, str]:
    from .context_plans import oracle_sql as context_sql

    lanes = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {15 * i + 1}, 15) AS UBIGINT) AS HUGEINT)) % 1152921504606846976 AS VARCHAR) AS s{i}" for i in range(4))
    return {
        "location_faults": r"""WITH i AS (SELECT *, CAST(trunc(l_quantity) AS INT) AS q, CASE WHEN l_linenumber > 2 THEN l_linenumber - 3 END AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 2 END AS e FROM lineitem),
            p AS (SELECT *, CASE q % 6 WHEN 1 THEN '/' || l_partkey WHEN 2 THEN 'a\..\' || l_partkey WHEN 3 THEN '.\./b/' || l_partkey WHEN 4 THEN ' ' WHEN 5 THEN l_partkey || '.rs' END AS path FROM i)
            SELECT l_orderkey, l_linenumber, path, CASE WHEN q % 6 = 0 THEN CASE WHEN s IS NOT NULL OR e IS NOT NULL OR l_returnflag = 'A' THEN 'a path is required' END WHEN q % 6 IN (1, 2) THEN 'a path must be relative and stay inside' WHEN q % 6 = 4 THEN 'a path is missing'
              WHEN coalesce(s = 0, false) OR coalesce(e = 0, false) OR coalesce(e < s, false) THEN 'an invalid line range' END AS fault, q % 6 = 5 AS dynamic, 'match ' || coalesce(path, '') || '#L' || l_linenumber || '-L' || (l_linenumber + q) AS reason FROM p""",
        "id_faults": "SELECT p_partkey, p_size % 4 IN (2, 3) AS bad, p_size % 4 > 0 AS bad_review, true AS declarations FROM part",
        "change_fingerprint": f"WITH c AS ({context_sql()['change_set']}), r AS (SELECT sha256(concat_ws(chr(31), path, coalesce(old_path, chr(0)), status, ranges)) AS h FROM c), s AS (SELECT {lanes}, count(*) AS n FROM r) SELECT sha256(concat_ws('-', s0, s1, s2, s3)) AS fingerprint, n FROM s",
    }
