"""Queries against their SQL, on the test tables and on odd rows: nulls, blank texts, repeated ids and rows, unusable vectors."""

import random
from collections import Counter

import duckdb
import pytest

from meshspark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "conversations")


def compared(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    return Counter(tuple(r) for r in df.select(*columns).collect()), Counter(cur.fetchall())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    r = random.Random(17)
    base = [f"word{r.randrange(300)}" for _ in range(140)]
    docs = [(i, " ".join(base[:k] + [f"new{i}"] * bool(i % 3) + base[k + 1 :])) for i, k in enumerate(range(5, 95, 5))]
    docs += [(None, " ".join(base)), (50, None), (51, " \t\n"), (52, "only three words"), (53, "Only Three WORDS"), (3, "another text of that id, unlike it"), (None, "of its own, no id"), (None, None)]
    docs += [docs[2], docs[2], docs[-2]]
    bench = [(1, " ".join(base[20:40])), (2, None), (3, "three words"), (None, " ".join(base[100:115]))]
    vec = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(30)]
    vec += [(40 + i, [x + r.gauss(0, 0.05) for x in vec[i % 4][1]]) for i in range(20)]
    vec += [(70, None), (71, []), (72, [0.0] * 8), (73, [float("nan")] * 8), (74, [None] * 8), (75, [1.0, 2.0]), (76, [2.0, 4.0]), (None, vec[0][1]), (5, vec[1][1]), (5, vec[5][1])]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string"), ("benchmark", bench, "item_id long, text string"), ("embeddings", [(*v, i % 3 or None) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int"),
        ("conversations", [(1, 0, "system", "be kind"), (1, 1, "ann", None), (1, 2, None, "x"), (None, None, "bob", "y")], "conv_id long, turn int, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_tables(spark, name):
    got, want = compared(spark, name, SF)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows(spark, odd, name):
    got, want = compared(spark, name, odd)
    assert got == want, (got - want, want - got)
