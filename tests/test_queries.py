"""Every query that has SQL gives DuckDB's rows; the entry points hold without the training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tarnholm.queries import load

ROOT = Path(__file__).resolve().parents[1]
QUERIES, SQL = load()


def text(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(text(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(map(text, r)) for r in cur.fetchall())


def test_every_query_of_these_has_sql():
    assert set(QUERIES) == set(SQL)


def test_whole_tables_are_joined_and_sorted(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test data here")
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    rows = [(r.k, r.c_custkey) for r in QUERIES["sort_nulls_first_desc_all"](spark, sf).collect()]
    assert len(rows) == customers and rows[0][0] is None and rows[-1][0] is not None
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, -int(r[0] or 0), r[1]))
    assert QUERIES["join_null_keys_all"](spark, sf).agg({"x": "max"}).first()[0] >= 200


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_operators(tmp_path):
    for p in ("__spark_entry__.py", "tarnholm"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tarnholm/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


def test_triangles_of_a_small_graph(spark):
    from tarnholm.operators.joins import triangles

    edges = [(1, 2), (2, 3), (3, 1), (1, 1), (2, 1), (3, 3), (4, 4), (1, 3), (3, 2), (5, 1)]
    have = set(edges)
    want = sorted((a, b, c) for a, b in edges for c in range(6) if (b, c) in have and (c, a) in have)
    assert sorted(map(tuple, triangles(spark.createDataFrame(edges, "a int, b int")).collect())) == want
