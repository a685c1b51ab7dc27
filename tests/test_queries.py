"""Each registered query that has SQL, against DuckDB on the same tables; what SQL can express runs no Python and no cross product."""

import duckdb
import pytest

from tessella import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    df = library.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name == "stream_runtime" or not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    found = duck.execute(library.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = ordered(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql(spark, data):
    q = library.queries()
    cut = q["balanced_selection"](spark, data).collect()
    occupied = {(r["lod"], r["x"], r["y"]) for r in cut}
    assert len(occupied) == len(cut) > 0


def test_the_cut_covers_every_row_once(spark, data):
    cut = library.queries()["lod_cut"](spark, data)
    assert cut.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{data}/orders.parquet").count()
    tiles = [(r["level"], r["x"], r["y"]) for r in cut.collect()]
    assert not any(a != b and a[0] < b[0] and (b[1] >> (b[0] - a[0]), b[2] >> (b[0] - a[0])) == a[1:] for a in tiles for b in tiles)
