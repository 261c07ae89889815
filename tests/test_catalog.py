"""Every registered query runs; those with SQL match DuckDB on the small tables."""

import duckdb
import pytest

from spikeloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    expected = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([tuple(r[i] for i in at) for r in expected.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"p9_sort"}))
def test_runs(spark, name):
    catalog.queries()[name](spark, SF).collect()
