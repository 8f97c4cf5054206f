"""Every query of the library against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from loomwork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_each_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


#: Queries that are also compared on the next larger tables, where lines and ids repeat.
LARGER = ["impact_related", "merge_intervals", "merge_intervals_gap", "impact_policy"]


@pytest.fixture(scope="module")
def larger(sf):
    sf = sf.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sf, c


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_sql_on_larger_tables(spark, larger, name):
    test_query_equals_sql(spark, *larger, name)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    own = sorted((repr(tuple(plain(r[n]) for n in names)) for r in df.collect()))
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted(repr(tuple(plain(r[columns.index(n)]) for n in names)) for r in found.fetchall())
    assert own == theirs
