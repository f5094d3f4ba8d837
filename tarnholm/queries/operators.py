"""One query for each kind of operator, with DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Database
from ..functions.ordering import asc, desc, order_by
from ..operators import joins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str):
    return F.lit(text).cast("timestamp")


# filters
@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000.0 AND o_orderstatus <> 'F' AND o_custkey <= 500")
def filter_cmp(spark, d):
    o = read(spark, d, "orders")
    return o.filter((F.col("o_totalprice") >= 100000.0) & (F.col("o_orderstatus") != "F") & (F.col("o_custkey") <= 500)).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND l_quantity NOT BETWEEN 10 AND 40")
def filter_between(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter(F.col("l_discount").between(0.03, 0.05) & ~F.col("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in(spark, d):
    c = read(spark, d, "customer")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%ring' OR p_name LIKE '_lue w%'")
def filter_like(spark, d):
    p, n = read(spark, d, "part"), F.col("p_name")
    return p.filter(n.like("red%") | n.like("%ring") | n.like("_lue w%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%'")
def filter_not_like(spark, d):
    return read(spark, d, "part").filter(~F.col("p_name").like("%e%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P') AND NOT (o_totalprice < 50000.0 OR o_custkey % 2 = 0)")
def filter_or_and(spark, d):
    o = read(spark, d, "orders")
    return o.filter(((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderstatus") == "P")) & ~((F.col("o_totalprice") < 50000.0) | (F.col("o_custkey") % 2 == 0))).select("o_orderkey")


NULLED = "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END"


@query(f"SELECT c_custkey, k IS NULL AS missing, k > 10 AS big, NOT (k > 10) AS small, k > 10 AND c_acctbal > 0 AS both_, k > 10 OR c_acctbal > 0 AS either_ FROM (SELECT c_custkey, c_acctbal, {NULLED} AS k FROM customer) t WHERE k IS NULL OR k <> 5")
def filter_null(spark, d):
    c = read(spark, d, "customer").withColumn("k", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")))
    big, rich = F.col("k") > 10, F.col("c_acctbal") > 0
    return c.filter(F.col("k").isNull() | (F.col("k") != 5)).select("c_custkey", F.col("k").isNull().alias("missing"), big.alias("big"), (~big).alias("small"), (big & rich).alias("both_"), (big | rich).alias("either_"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-31 00:00:00' + INTERVAL 1 MONTH AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 90 DAY")
def filter_date_interval(spark, d):
    t = F.col("o_orderdate")
    return read(spark, d, "orders").filter((t >= ts("1996-01-31") + F.expr("INTERVAL 1 MONTH")) & (t < ts("1997-01-01") - F.expr("INTERVAL 90 DAY"))).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE 1 = 2")
def filter_constant_false(spark, d):
    return read(spark, d, "orders").filter(F.lit(1) == F.lit(2)).agg(F.count("*").alias("n"))


# projection
@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity + 1 AS q1, l_quantity - 1 AS q2, l_quantity / 4 AS q4 FROM lineitem")
def proj_arith(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"), (q + 1).alias("q1"), (q - 1).alias("q2"), (q / 4).alias("q4"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR) END AS big, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS promo FROM part")
def proj_case(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("kind"), F.when(s > 40, s.cast("string")).alias("big"), F.when(F.col("p_type") == "PROMO", 1).otherwise(0).alias("promo"))


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS i, CAST(o_custkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def proj_cast(spark, d):
    k = F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", k.cast("int").alias("i"), k.cast("double").alias("f"), F.col("o_orderkey").cast("string").alias("s"), F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("SELECT s_suppkey, s_name || '/' || CAST(s_nationkey AS VARCHAR) AS label, s_name || nullif(s_name, s_name) AS nothing FROM supplier")
def proj_concat(spark, d):
    n = F.col("s_name")
    return read(spark, d, "supplier").select("s_suppkey", F.concat(n, F.lit("/"), F.col("s_nationkey").cast("string")).alias("label"), F.concat(n, F.nullif(n, n)).alias("nothing"))


PARTS = ("year", "month", "day", "hour", "minute", "second")


@query("SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS INTEGER) AS {p}_" for p in PARTS) + " FROM events")
def proj_extract(spark, d):
    return read(spark, d, "events").select("event_id", *(F.extract(F.lit(p), F.col("ts")).cast("int").alias(f"{p}_") for p in PARTS))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS last_year, o_orderdate + INTERVAL 36 HOUR AS later FROM orders")
def proj_date_add(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", F.add_months(day, 1).cast("string").alias("next_month"), F.add_months(day, -12).cast("string").alias("last_year"), (F.col("o_orderdate") + F.expr("INTERVAL 36 HOUR")).alias("later"))


@query("SELECT o_orderkey, o_orderkey % 7 AS m, (-o_orderkey) % 7 AS negative FROM orders")
def proj_modulo(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", (k % 7).alias("m"), (-k % 7).alias("negative"))


@query("SELECT c_custkey, -c_acctbal AS owed, -c_custkey AS k FROM customer")
def proj_unary_minus(spark, d):
    return read(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("owed"), (-F.col("c_custkey")).alias("k"))


@query("SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 5) AS x FROM part")
def proj_bitwise(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", s.bitwiseAND(6).alias("a"), s.bitwiseOR(8).alias("o"), s.bitwiseXOR(5).alias("x"))


@query("SELECT l_orderkey, CAST(l_quantity AS INTEGER) // 4 AS whole FROM lineitem")
def proj_integer_division(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", F.expr("CAST(l_quantity AS INT) div 4").cast("int").alias("whole"))


@query("SELECT 1 AS one, 'x' AS x FROM nation")
def proj_constant(spark, d):
    return read(spark, d, "nation").select(F.lit(1).alias("one"), F.lit("x").alias("x"))


@query("SELECT n.*, r_name FROM nation n, region WHERE n_regionkey = r_regionkey")
def proj_star(spark, d):
    return Database.over(spark, d, "nation", "region").select("SELECT n.*, r_name FROM nation n, region WHERE n_regionkey = r_regionkey")


@query("SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders WHERE o_totalprice / 1000 > 200 ORDER BY k DESC, o_orderkey")
def proj_alias_in_where(spark, d):
    return Database.over(spark, d, "orders").select("SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders WHERE k > 200 ORDER BY k DESC, o_orderkey")


# joins
@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
def join_equi_2way(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
def join_multi_key(spark, d):
    # each side is counted by key before they meet, in the partitions that the join needs
    li = joins.sized(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")
    a, b = (li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias(n)) for n in "ab")
    return a.join(b.hint("merge"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("a") * F.col("b")).alias("n"))


@query("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_acctbal < b.s_acctbal AND a.s_nationkey + b.s_nationkey < 10")
def join_theta(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    # each row goes to all nations that it may meet, so that this is an equi join on the nation
    b = s.join(s.select(F.col("s_nationkey").alias("met")).distinct(), F.col("met") + F.col("s_nationkey") < 10).select("s_suppkey", F.col("met").alias("s_nationkey"), "s_acctbal")
    return joins.spread(s, b, ["s_nationkey"], F.col("l.s_acctbal") < F.col("r.s_acctbal")).select(F.col("l.s_suppkey").alias("x"), F.col("r.s_suppkey").alias("y"))


@query("SELECT e.event_id, f.event_id AS later FROM events e, events f WHERE e.user_id = f.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 6 HOUR AND e.event_type = 'error'")
def join_band(spark, d):
    e = read(spark, d, "events")
    return joins.band(e.filter("event_type = 'error'"), e, "ts", 6 * 3600, ["user_id"]).select(F.col("l.event_id").alias("event_id"), F.col("r.event_id").alias("later"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross_small(spark, d):
    return read(spark, d, "region").crossJoin(read(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    n = read(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM region, nation, customer, orders, lineitem WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY r_name")
def join_chain_5way(spark, d):
    t = lambda n: read(spark, d, n)
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT p_brand, s_nationkey, count(*) AS n FROM lineitem, part, supplier, orders WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY p_brand, s_nationkey")
def join_star(spark, d):
    t = lambda n: read(spark, d, n)
    df = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return df.join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
def join_cyclic(spark, d):
    t = lambda n: read(spark, d, n)
    df = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return df.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).agg(F.count("*").alias("n"))


EDGES = "SELECT DISTINCT l_suppkey % 60 AS a, l_partkey % 60 AS b FROM lineitem"


@query(f"SELECT x.a, x.b, y.b AS c FROM ({EDGES}) x, ({EDGES}) y, ({EDGES}) z WHERE x.b = y.a AND y.b = z.a AND z.b = x.a")
def join_triangle(spark, d):
    e = read(spark, d, "lineitem").select((F.col("l_suppkey") % 60).alias("a"), (F.col("l_partkey") % 60).alias("b")).distinct()
    return joins.triangles(e)


ALL_EDGES = "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem"


@query(f"SELECT x.a, x.b, y.b AS c FROM ({ALL_EDGES}) x, ({ALL_EDGES}) y, ({ALL_EDGES}) z WHERE x.b = y.a AND y.b = z.a AND z.b = x.a")
def join_triangle_all(spark, d):
    return joins.triangles(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct())


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT a.c_custkey AS x, b.s_suppkey AS y FROM (SELECT c_custkey, {NULLED} AS k FROM customer) a, (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) b WHERE a.k = b.k AND a.c_custkey < 200")
def join_null_keys(spark, d):
    a = read(spark, d, "customer").filter("c_custkey < 200").select(F.col("c_custkey").alias("x"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("y"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("k"))
    return a.join(b, "k").select("x", "y")


@query(f"SELECT a.c_custkey AS x, b.s_suppkey AS y FROM (SELECT c_custkey, {NULLED} AS k FROM customer) a, (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) b WHERE a.k = b.k")
def join_null_keys_all(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("x"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("y"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("k"))
    return joins.spread(a, b, ["k"]).select("l.x", "r.y")


# aggregation
@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_shipdate) AS first_, max(l_extendedprice) AS most, round(avg(l_discount), 6) AS mean FROM lineitem")
def agg_global(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"), F.min("l_shipdate").alias("first_"), F.max("l_extendedprice").alias("most"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY c_mktsegment, c_nationkey")
def agg_group(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY CAST(extract(year FROM o_orderdate) AS INTEGER), o_custkey % 10")
def agg_group_expr(spark, d):
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT c_mktsegment, count({NULLED}) AS n, count(*) AS all_, CAST(sum({NULLED}) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment")
def agg_count_expr(spark, d):
    k = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey"))
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(k).alias("n"), F.count("*").alias("all_"), F.sum(k).alias("s"))


@query(f"SELECT CAST({NULLED} AS VARCHAR) AS k, count(*) AS n FROM customer GROUP BY {NULLED}")
def agg_null_group(spark, d):
    return read(spark, d, "customer").groupBy(F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k")).agg(F.count("*").alias("n")).select(F.col("k").cast("string").alias("k"), "n")


@query("SELECT p_brand, avg(p_size) AS mean, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand")
def agg_avg(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mean"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT p_type, min(p_name) AS first_, max(p_name) AS last_ FROM part GROUP BY p_type")
def agg_minmax_string(spark, d):
    return read(spark, d, "part").groupBy("p_type").agg(F.min("p_name").alias("first_"), F.max("p_name").alias("last_"))


@query("SELECT l_returnflag, round(100 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS share FROM lineitem GROUP BY l_returnflag")
def agg_ratio(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 * F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 6).alias("share"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
def agg_having(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")).filter("n > 12 AND s > 100000").select("o_custkey", "n")


@query("SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS mean, min(l_returnflag) AS least FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(spark, d):
    return read(spark, d, "lineitem").filter("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("mean"), F.min("l_returnflag").alias("least"))


# order
@query("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC NULLS FIRST, n_name ASC NULLS LAST")
def sort_multi(spark, d):
    return order_by(read(spark, d, "nation").select("n_regionkey", "n_name"), "-n_regionkey", "n_name")


@query(f"SELECT c_custkey, CAST(k AS VARCHAR) AS k FROM (SELECT c_custkey, {NULLED} AS k FROM customer) t ORDER BY t.k DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 600")
def sort_nulls_first_desc(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k")).orderBy(desc("k"), asc("c_custkey")).limit(600).select("c_custkey", F.col("k").cast("string").alias("k"))


@query(f"SELECT c_custkey, CAST(k AS VARCHAR) AS k FROM (SELECT c_custkey, {NULLED} AS k FROM customer) t ORDER BY t.k DESC NULLS FIRST, c_custkey ASC NULLS LAST")
def sort_nulls_first_desc_all(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k")).orderBy(desc("k"), asc("c_custkey")).select("c_custkey", F.col("k").cast("string").alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_total_order(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(desc("o_totalprice"), asc("o_orderkey")).limit(25)


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey ORDER BY q DESC, l_suppkey LIMIT 10")
def limit_after_group(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q")).orderBy(desc("q"), asc("l_suppkey")).limit(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 5")
def sort_hidden_key(spark, d):
    return Database.over(spark, d, "orders").select("SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 5")


# subqueries, through the SQL front end
def text(name: str, tables: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: Database.over(spark, d, *tables.split()).select(sql)
    SQL[name] = sql


text("sub_from", "orders customer", "SELECT c_mktsegment, round(avg(n), 6) AS mean FROM customer, (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE c_custkey = o_custkey GROUP BY c_mktsegment")
text("sub_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
text("sub_correlated", "lineitem part", "SELECT l_orderkey, l_partkey FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.3 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
text("sub_in", "orders lineitem", "SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_orderkey IN (SELECT x.l_orderkey FROM lineitem x GROUP BY x.l_orderkey HAVING 250 < sum(x.l_quantity))")
text("sub_not_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
text("sub_in_nested", "supplier lineitem part", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size IN (SELECT min(p_size) FROM part)))")
text("sub_having", "lineitem", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY l_suppkey HAVING sum(l_extendedprice) > (SELECT 1.1 * sum(l_extendedprice) / count(DISTINCT l_suppkey) FROM lineitem)")
text("sub_count_empty", "customer orders", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer")
