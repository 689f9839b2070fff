"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from gaugeframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple("null" if v is None else f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name in catalogue.oracle_sql():
        found = duck.execute(catalogue.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])
