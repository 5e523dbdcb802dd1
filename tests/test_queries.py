"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    found = con.execute(catalog.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = lambda names, rows: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert order(df.columns, [tuple(r) for r in got]) == order(columns, want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_runs_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
