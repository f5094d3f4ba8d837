"""Decision-support queries over the star schema, as SQL for the engine's front end."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TEXT: dict[str, str] = {}

NET = "li.l_extendedprice * (1 - li.l_discount)"

TEXT["q01"] = f"""
SELECT li.l_returnflag AS flag, li.l_linestatus AS status, count(*) AS lines, round(sum(li.l_quantity), 2) AS quantity, round(sum(li.l_extendedprice), 2) AS gross,
 round(sum({NET}), 4) AS net, round(sum({NET} * (li.l_tax + 1)), 6) AS charged, round(avg(li.l_quantity), 6) AS mean_quantity,
 round(avg(li.l_extendedprice), 6) AS mean_price, round(avg(li.l_discount), 6) AS mean_discount
FROM lineitem li WHERE li.l_shipdate < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL '71' DAY
GROUP BY li.l_returnflag, li.l_linestatus ORDER BY flag, status"""

TEXT["q02"] = """
SELECT s.s_acctbal AS balance, s.s_name AS supplier, n.n_name AS nation, p.p_partkey AS part, round(li.l_extendedprice / li.l_quantity, 6) AS unit_price
FROM lineitem li, part p, supplier s, nation n, region r
WHERE r.r_name = 'EUROPE' AND n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey AND li.l_suppkey = s.s_suppkey AND li.l_partkey = p.p_partkey AND p.p_size = 15
 AND li.l_extendedprice / li.l_quantity = (SELECT min(x.l_extendedprice / x.l_quantity) FROM lineitem x, supplier xs, nation xn, region xr
  WHERE xr.r_name = 'EUROPE' AND xn.n_regionkey = xr.r_regionkey AND xs.s_nationkey = xn.n_nationkey AND x.l_suppkey = xs.s_suppkey AND x.l_partkey = p.p_partkey)
ORDER BY balance DESC, nation, supplier, part"""

TEXT["q03"] = f"""
SELECT o.o_orderkey AS order_no, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(10)) AS day, round(sum({NET}), 4) AS net
FROM lineitem li, orders o, customer c
WHERE o.o_orderkey = li.l_orderkey AND o.o_custkey = c.c_custkey AND c.c_mktsegment = 'FURNITURE'
 AND li.l_shipdate > TIMESTAMP '1998-03-29 00:00:00' AND o.o_orderdate < TIMESTAMP '1998-03-29 00:00:00'
GROUP BY o.o_orderkey, o.o_orderdate ORDER BY net DESC, day, order_no LIMIT 10"""

TEXT["q05"] = f"""
SELECT n.n_name AS nation, round(sum({NET}), 4) AS net
FROM region r, nation n, supplier s, customer c, orders o, lineitem li
WHERE r.r_name = 'ASIA' AND n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = s.s_nationkey
 AND o.o_custkey = c.c_custkey AND li.l_orderkey = o.o_orderkey AND li.l_suppkey = s.s_suppkey
 AND o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
GROUP BY n.n_name ORDER BY net DESC"""

TEXT["q06"] = """
SELECT round(sum(li.l_discount * li.l_extendedprice), 4) AS saved FROM lineitem li
WHERE li.l_quantity < 24 AND li.l_discount BETWEEN 0.03 AND 0.08
 AND li.l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND li.l_shipdate < TIMESTAMP '1997-01-01 00:00:00'"""

TEXT["q07"] = f"""
SELECT t.seller, t.buyer, t.yr, round(sum(t.net), 4) AS net
FROM (SELECT sn.n_name AS seller, cn.n_name AS buyer, CAST(extract(YEAR FROM li.l_shipdate) AS INTEGER) AS yr, {NET} AS net
 FROM lineitem li, orders o, customer c, nation cn, supplier s, nation sn
 WHERE li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = cn.n_nationkey AND li.l_suppkey = s.s_suppkey AND s.s_nationkey = sn.n_nationkey
 AND ((cn.n_name = 'NATION_2' AND sn.n_name = 'NATION_1') OR (cn.n_name = 'NATION_1' AND sn.n_name = 'NATION_2'))
 AND li.l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00') t
GROUP BY t.seller, t.buyer, t.yr ORDER BY seller, buyer, yr"""

TEXT["q08"] = f"""
SELECT t.yr, round(sum(CASE WHEN t.seller = 'NATION_3' THEN t.net ELSE 0 END) / sum(t.net), 6) AS share
FROM (SELECT CAST(extract(YEAR FROM o.o_orderdate) AS INTEGER) AS yr, {NET} AS net, sn.n_name AS seller
 FROM lineitem li, part p, orders o, customer c, nation cn, region r, supplier s, nation sn
 WHERE p.p_type = 'PROMO' AND li.l_partkey = p.p_partkey AND li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = cn.n_nationkey
 AND cn.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' AND li.l_suppkey = s.s_suppkey AND s.s_nationkey = sn.n_nationkey) t
GROUP BY t.yr ORDER BY yr"""

TEXT["q09"] = f"""
SELECT t.seller, t.yr, round(sum(t.gain), 4) AS gain
FROM (SELECT n.n_name AS seller, CAST(extract(YEAR FROM o.o_orderdate) AS INTEGER) AS yr, {NET} - li.l_quantity * p.p_retailprice AS gain
 FROM lineitem li, orders o, part p, supplier s, nation n
 WHERE p.p_name LIKE '%red%' AND li.l_partkey = p.p_partkey AND li.l_orderkey = o.o_orderkey AND li.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey) t
GROUP BY t.seller, t.yr ORDER BY seller, yr DESC"""

TEXT["q10"] = f"""
SELECT c.c_custkey AS customer, c.c_name AS name, n.n_name AS nation, c.c_acctbal AS balance, round(sum({NET}), 4) AS lost
FROM lineitem li, orders o, customer c, nation n
WHERE li.l_returnflag = 'R' AND li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey
 AND o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '3' MONTH
GROUP BY c.c_custkey, c.c_name, n.n_name, c.c_acctbal ORDER BY lost DESC, customer LIMIT 20"""

TEXT["q11"] = """
SELECT li.l_partkey AS part, round(sum(li.l_quantity * li.l_extendedprice), 2) AS held
FROM nation n, supplier s, lineitem li WHERE n.n_name = 'NATION_3' AND s.s_nationkey = n.n_nationkey AND li.l_suppkey = s.s_suppkey
GROUP BY li.l_partkey
HAVING sum(li.l_quantity * li.l_extendedprice) > (SELECT 0.001 * sum(x.l_quantity * x.l_extendedprice) FROM nation xn, supplier xs, lineitem x WHERE xn.n_name = 'NATION_3' AND xs.s_nationkey = xn.n_nationkey AND x.l_suppkey = xs.s_suppkey)
ORDER BY held DESC, part"""

TEXT["q14"] = f"""
SELECT round(sum(CASE WHEN p.p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) * 100.0 / sum({NET}), 6) AS promo_percent
FROM part p, lineitem li WHERE p.p_partkey = li.l_partkey AND li.l_shipdate < TIMESTAMP '1996-04-01 00:00:00' AND li.l_shipdate >= TIMESTAMP '1996-03-01 00:00:00'"""

TEXT["q17"] = """
SELECT round(sum(li.l_extendedprice) / 7.0, 6) AS yearly FROM part p, lineitem li
WHERE p.p_type = 'SMALL' AND p.p_brand = 'Brand#2' AND li.l_partkey = p.p_partkey
 AND li.l_quantity < (SELECT avg(x.l_quantity) * 0.2 FROM lineitem x WHERE x.l_partkey = p.p_partkey)"""

TEXT["q18"] = """
SELECT o.o_orderkey AS order_no, c.c_custkey AS customer, c.c_name AS name, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(10)) AS day, o.o_totalprice AS total, round(sum(li.l_quantity), 2) AS quantity
FROM lineitem li, orders o, customer c
WHERE li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND o.o_orderkey IN (SELECT x.l_orderkey FROM lineitem x GROUP BY x.l_orderkey HAVING sum(x.l_quantity) > 260)
GROUP BY o.o_orderkey, c.c_custkey, c.c_name, o.o_orderdate, o.o_totalprice ORDER BY total DESC, order_no"""

BRANDS = (("Brand#22", 1, 15), ("Brand#23", 10, 25), ("Brand#12", 20, 35))
TEXT["q19"] = f"SELECT round(sum({NET}), 4) AS net FROM part p, lineitem li WHERE " + " OR ".join(
    f"(p.p_size BETWEEN 1 AND {size} AND li.l_quantity BETWEEN {low} AND {low + 10} AND p.p_brand = '{brand}' AND li.l_partkey = p.p_partkey)" for brand, low, size in BRANDS
)

TEXT["q20"] = """
SELECT s.s_name AS supplier, s.s_acctbal AS balance FROM nation n, supplier s
WHERE n.n_name = 'NATION_3' AND s.s_nationkey = n.n_nationkey
 AND s.s_suppkey IN (SELECT li.l_suppkey FROM lineitem li WHERE li.l_quantity > (SELECT avg(x.l_quantity) * 0.5 FROM lineitem x WHERE x.l_partkey = li.l_partkey)
  AND li.l_partkey IN (SELECT p.p_partkey FROM part p WHERE p.p_name LIKE 'red%'))
ORDER BY supplier"""


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Database.over(spark, sf_dir, *TABLES).select(TEXT[name])


QUERIES = {name: partial(run, name=name) for name in TEXT}
SQL = dict(TEXT)
