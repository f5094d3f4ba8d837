"""Joins in tasks of bounded size."""

import pytest
from pyspark.sql import functions as F

from tarnholm.operators import joins
from tarnholm.queries import load

QUERIES, _ = load()


def shares(df):
    """Rows of each partition that has some."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_the_tasks_of_a_multi_key_join_grow_in_number_with_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(joins, "ROWS", 500)
    df = QUERIES["join_multi_key"](spark, sf)
    parts = shares(df)
    assert len(parts) >= 10 and max(parts) < 1000


@pytest.mark.parametrize("name", ["join_theta", "join_null_keys_all"])
def test_pairs_of_few_keys_are_made_in_many_tasks(spark, name, monkeypatch):
    sf = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf)
    monkeypatch.setattr(joins, "PAIRS", df.count() // 16)
    parts = shares(QUERIES[name](spark, sf))
    assert len(parts) >= 8 and max(parts) <= sum(parts) / 3


def test_spread_is_an_equi_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 10)
    left = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, None), (4, 2), (5, 9)], "a int, k int")
    right = spark.createDataFrame([(1, 1), (7, 1), (3, None), (4, 2), (None, 2)], "b int, k int")
    plain = lambda c: sorted(map(str, ((r.a, r.b) for r in left.alias("l").join(right.alias("r"), c).collect())))
    same = F.col("l.k") == F.col("r.k")
    rows = lambda df: sorted(map(str, ((r.a, r.b) for r in df.select("l.a", "r.b").collect())))
    assert rows(joins.spread(left, right, ["k"])) == plain(same)
    less = F.col("l.a") < F.col("r.b")
    assert rows(joins.spread(left, right, ["k"], less)) == plain(same & less)
    assert rows(joins.spread(left.filter("false"), right, ["k"])) == [] == rows(joins.spread(left, right.filter("b > 99"), ["k"]))
