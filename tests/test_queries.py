"""Every registered query of the engine against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from prunescan.plans import catalogue

SF = "/root/testdata/sf0.001"
OTHER = {"row_group_ranges", "file_metadata", "column_chunk_sizes", "list_objects"}  # their SQL names the files of another scale


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}".removesuffix(".0")
    return str(int(v)) if isinstance(v, bool) else str(v)


def same(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] for _ in "x") + sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES)))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = same(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE_SQL and name not in OTHER:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        assert got == same([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    assert set(e.oracle_sql()) <= set(e.queries())
