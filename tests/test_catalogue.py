"""Every catalogued query gives the rows of its SQL."""

import duckdb
import pytest

from meshspark import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", ["sort_desc_whole", "sort_asc_whole"])
def test_whole_sort(spark, name):
    """Beyond 1000 rows: every vertex is there, with its place."""
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in catalogue.queries()[name](spark, sf).select("place", "od", "id").collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert len(got) == 1600 and got == sorted(con.execute(f"SELECT place, od, id FROM ({catalogue.oracle_sql()[name]})").fetchall())
