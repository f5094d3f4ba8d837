import datetime as dt

import pytest

from tarnholm import types
from tarnholm.catalog import CatalogError, Database, parse_create
from tarnholm.console import Console
from tarnholm.sources.printer import lines


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, str(tmp_path / "db"))


def test_types_by_name():
    assert types.parse("character varying(25)").simpleString() == "string"
    assert types.parse("NUMERIC(15, 2)").simpleString() == "double"
    with pytest.raises(types.UnknownType):
        types.parse("blob")


def test_create_with_flags():
    name, cols = parse_create("CREATE TABLE T (id integer PRIMARY KEY NOT NULL, s varchar(10) unique, d date, f int foreign key)")
    assert name == "t" and [c.name for c in cols] == ["id", "s", "d", "f"]
    assert cols[0].primary and cols[0].not_null and cols[1].unique and cols[3].foreign and not cols[2].not_null


def test_load_csv_with_nulls_quotes_and_types(db, tmp_path):
    db.create_table("create table t (i int, l long, d double, s text, day date, ts timestamp)")
    (tmp_path / "t.csv").write_text('1|10|1.5|a b|1996-02-29|1996-02-29 12:00:00\nNULL|NULL||NULL||NULL\n3|30|2|"x|y"|2001-01-01|2001-01-01 00:00:01\n')
    assert db.load_csv("t", str(tmp_path / "t.csv"), "|", "NULL") == 3
    rows = db.select("SELECT * FROM t ORDER BY i").collect()
    assert [r.i for r in rows] == [1, 3, None]
    assert tuple(rows[2]) == (None,) * 6
    assert rows[1].s == "x|y" and rows[0].day == dt.date(1996, 2, 29)
    assert db.load_csv("t", str(tmp_path / "t.csv"), "|", "NULL") == 3  # replaces


def test_times_are_seconds_of_the_day(db, tmp_path):
    db.create_table("create table t (k int, at time)")
    (tmp_path / "t.csv").write_text("1,12:30:05\n2,\n")
    db.load_csv("t", str(tmp_path / "t.csv"))
    assert [r.at for r in db.select("SELECT * FROM t ORDER BY k").collect()] == [45005, None]


def test_a_bad_field_is_an_error(db, tmp_path):
    db.create_table("create table t (i int)")
    (tmp_path / "t.csv").write_text("x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|cannot be cast"):
        db.load_csv("t", str(tmp_path / "t.csv"))


def test_catalog_is_kept_and_tables_can_be_dropped_and_copied(db, spark):
    db.create_table("create table a (x int, y string)")
    db.copy_table("a", "b")
    with pytest.raises(CatalogError):
        db.create_table("create table a (x int)")
    again = Database.open(spark, db.path)
    assert list(again.tables) == ["a", "b"] and [c.name for c in again.table("B").columns] == ["x", "y"]
    db.drop_table("a")
    with pytest.raises(CatalogError):
        db.df("a")


def test_select_into_and_compress_and_sample(db, spark, tmp_path):
    db.insert_result("n", spark.range(10).selectExpr("id", "CAST(id % 3 AS STRING) AS s"))
    out = db.select("SELECT s, count(*) AS n INTO counts FROM n GROUP BY s ORDER BY s LIMIT 2")
    assert [tuple(r) for r in out.collect()] == [("0", 4), ("1", 3)]
    assert Database.open(spark, db.path).df("counts").count() == 2
    db.compress()
    assert db.compressed and db.df("n").count() == 10
    assert [tuple(r) for r in db.dictionary().orderBy("code").collect()] == [(0, "0"), (1, "1"), (2, "2")]
    assert db.index() == {"n": 10, "counts": 2}
    assert db.copy_sample(str(tmp_path / "sample"), 4).df("n").count() == 4


def test_nulls_last_ascending_and_first_descending(db, spark):
    db.insert_result("t", spark.createDataFrame([(1,), (None,), (2,)], "k int"))
    assert [r.k for r in db.select("SELECT k FROM t ORDER BY k").collect()] == [1, 2, None]
    assert [r.k for r in db.select("SELECT k FROM t ORDER BY k DESC").collect()] == [None, 2, 1]


def test_a_column_comes_before_an_alias_in_where(db, spark):
    db.insert_result("t", spark.createDataFrame([(1, 5), (2, 6)], "a int, b int"))
    assert [tuple(r) for r in db.select("SELECT a + 10 AS a, b AS c FROM t WHERE a = 1 AND c = 5").collect()] == [(11, 5)]
    assert db.select("SELECT a FROM t WHERE a IN (SELECT min(a) FROM t)", learned=True).count() == 1 and db.last is None


def test_in_with_duplicates_does_not_multiply_and_distinct_works(db, spark):
    db.insert_result("o", spark.createDataFrame([(1,), (2,), (2,)], "k int"))
    db.insert_result("i", spark.createDataFrame([(2,), (2,), (None,)], "k int"))
    assert db.select("SELECT k FROM o WHERE k IN (SELECT k FROM i)").count() == 2
    assert db.select("SELECT DISTINCT k FROM o").count() == 2


def test_printer_shows_nulls_and_intervals(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS a, INTERVAL '14' MONTH AS m, INTERVAL '26:03:04.5' HOUR TO SECOND AS d, true AS b")
    assert list(lines(df)) == ["a\tm\td\tb", "[null]\t1 years 2 months\tPT26H3M4.5S\ttrue"]


def test_console(db, tmp_path, spark):
    c = Console(db)
    (tmp_path / "s.sql").write_text("create table t (a int, b string); bad thing; \n load t '%s' , NULL; select a from t where a > 1;" % (tmp_path / "t.csv"))
    (tmp_path / "t.csv").write_text("1,x\n2,NULL\n")
    out = c.run(f"exec {tmp_path / 's.sql'}")
    assert out == ["created t", "Error: not supported: bad", "2 rows", "a", "2"]
    assert c.run("list") == ["t(a int, b string)"] and c.run("") == [] and len(c.run("help")) > 5
    assert c.run("select nothing from t")[0].startswith("Error:")
    assert c.run("select a from t union all select a from t order by a") == ["a", "1", "1", "2", "2"]
    queries = tmp_path / "q"
    queries.mkdir()
    (queries / "1.sql").write_text("select x.a from t x, t y, t z where x.a = y.a and y.a = z.a")
    (queries / "2.sql").write_text("select count(*) as n from t where a in (select a from t)")
    assert [x.split(",")[0] for x in c.run(f"bench {queries} {tmp_path / 'out.csv'}")] == ["1.sql: 2 rows", "2.sql: 1 rows"]
    assert (tmp_path / "out.csv").read_text().count("\n") == 3
    shown = c.run("explain select x.a from t x, t y, t z where x.a = y.a and y.a = z.a order by x.a")
    assert shown[-3:] == ["a", "1", "2"] and shown[0].startswith("episode 0:")
    c.run("drop table t")
    c.run("quit")
    assert c.done and c.run("list") == []
