"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from meterlake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.10g}"
    if isinstance(value, list):
        return str([plain(v) for v in value])
    return f"{float(value):.10g}" if isinstance(value, int) and abs(value) < 2**50 else str(value)


def rows_of(columns, rows):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows_of(columns, [r.asDict() for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == rows_of(columns, [dict(zip(names, r, strict=True)) for r in cursor.fetchall()])


def test_queries_without_oracle_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
