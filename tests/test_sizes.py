"""Join orders without steps that grow with the square of the data."""

import pytest

from tarnholm.catalog import Database
from tarnholm.plans.graph import build
from tarnholm.plans.learned import batch_keys, learned_sql
from tarnholm.plans.sizes import measured

# suppliers and customers meet in one of three nations: 400 * 3000 / 3 pairs, of 33,403 rows in all
SQL = """SELECT n.name, count(*) AS n, sum(li.v) AS v FROM n, s, c, o, li
WHERE s.nation = n.nation AND c.nation = s.nation AND o.cust = c.cust AND li.ord = o.ord AND li.supp = s.supp AND li.v > 10 GROUP BY n.name"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    spark.range(3).selectExpr("id AS nation", "concat('n', id) AS name").write.parquet(f"{path}/n.parquet")
    spark.range(400).selectExpr("id AS supp", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 3 END AS nation").write.parquet(f"{path}/s.parquet")
    spark.range(3000).selectExpr("id AS cust", "id % 3 AS nation").write.parquet(f"{path}/c.parquet")
    spark.range(10000).selectExpr("id AS ord", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 31 % 3000 END AS cust").write.parquet(f"{path}/o.parquet")
    spark.range(20000).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE id * 17 % 10000 END AS ord", "id * 13 % 400 AS supp", "id % 50 AS v").write.parquet(f"{path}/li.parquet")
    return path


@pytest.fixture(scope="module")
def db(spark, folder):
    return Database.over(spark, folder, "n", "s", "c", "o", "li")


@pytest.fixture(scope="module")
def want(spark, db):
    db.views()
    return sorted(map(tuple, spark.sql(SQL).collect()))


def largest_join(df):
    """Rows of the largest join of a plan that was run."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in node.nodeName() or "Cartesian" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_the_written_order_is_left_where_a_step_would_explode(db, want):
    df = db.select(SQL)
    assert sorted(map(tuple, df.collect())) == want and want
    assert 0 < largest_join(df) <= 34_000


def test_a_harmless_order_stays_as_written(spark, db, monkeypatch):
    seen = []
    inner = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: seen.append(text) or inner(self, text, *a, **k))
    db.select("SELECT c.cust, li.v FROM li, o, c WHERE li.ord = o.ord AND o.cust = c.cust")
    db.select("SELECT * FROM n, s, c WHERE s.nation = n.nation AND c.nation = s.nation AND c.cust < 3")
    assert "FROM li, o, c" in seen[0] and "FROM n, s, c" in seen[-1]


@pytest.mark.parametrize("seed", range(6))
def test_no_trial_has_a_step_over_all_inputs(spark, db, want, seed):
    df, stats = learned_sql(spark, SQL, db.frames(), seed=seed, batches=8, explore=5, patience=1e9)
    assert sorted(map(tuple, df.collect())) == want
    _, graph, _ = build(spark, SQL, db.frames())
    sizes = measured(graph)
    assert sizes.size(frozenset("sc")) > sizes.limit
    assert all(sizes.widest(e.order) <= sizes.limit for e in stats.episodes)


def test_what_is_split_is_done_once_by_all_episodes(spark, db):
    _, graph, _ = build(spark, SQL, db.frames())
    assert batch_keys(graph, measured(graph), 16) == ("li", {"li": "ord", "o": "ord"})
    assert batch_keys(graph, measured(graph), 1000) == ("li", {})  # too few keys
    _, stats = learned_sql(spark, SQL, db.frames(), batches=8)
    assert {e.table for e in stats.episodes} == {"li"}
    assert sorted(b for e in stats.episodes for b in e.batches) == list(range(8))


def test_a_grouped_name_that_is_also_an_alias(spark, db):
    sql = "SELECT c.nation AS supp, count(*) AS n FROM li, o, c WHERE li.ord = o.ord AND o.cust = c.cust AND li.supp < 3 GROUP BY c.nation"
    db.views()
    assert sorted(map(tuple, learned_sql(spark, sql, db.frames())[0].collect())) == sorted(map(tuple, spark.sql(sql).collect()))


def test_a_count_alone_needs_no_columns(spark, db):
    sql = "SELECT count(*) AS n FROM li, o, c WHERE li.ord = o.ord AND o.cust = c.cust"
    db.views()
    assert learned_sql(spark, sql, db.frames())[0].first()[0] == spark.sql(sql).first()[0]
