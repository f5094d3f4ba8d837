"""The joins again, with learned orders: same SQL, same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Database
from .tpch import NET, TABLES, TEXT

CHAIN = """
SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price, min(l_shipdate) AS first_ship, max(c_name) AS last_name
FROM region, nation, customer, orders, lineitem
WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderstatus = 'F'
GROUP BY r_name, o_orderpriority"""
THREE = "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_mktsegment"
Q07 = f"""
SELECT sn.n_name AS seller, cn.n_name AS buyer, CAST(extract(YEAR FROM li.l_shipdate) AS INTEGER) AS yr, round(sum({NET}), 4) AS net
FROM lineitem li, orders o, customer c, nation cn, supplier s, nation sn
WHERE li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = cn.n_nationkey AND li.l_suppkey = s.s_suppkey AND s.s_nationkey = sn.n_nationkey
 AND ((cn.n_name = 'NATION_2' AND sn.n_name = 'NATION_1') OR (cn.n_name = 'NATION_1' AND sn.n_name = 'NATION_2'))
 AND li.l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'
GROUP BY sn.n_name, cn.n_name, CAST(extract(YEAR FROM li.l_shipdate) AS INTEGER)"""
Q08 = f"""
SELECT CAST(extract(YEAR FROM o.o_orderdate) AS INTEGER) AS yr, round(sum(CASE sn.n_name WHEN 'NATION_3' THEN {NET} ELSE 0 END) / sum({NET}), 6) AS share
FROM lineitem li, part p, orders o, customer c, nation cn, region r, supplier s, nation sn
WHERE p.p_type = 'PROMO' AND li.l_partkey = p.p_partkey AND li.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = cn.n_nationkey
 AND cn.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' AND li.l_suppkey = s.s_suppkey AND s.s_nationkey = sn.n_nationkey
GROUP BY CAST(extract(YEAR FROM o.o_orderdate) AS INTEGER)"""
TEXTS = {"learned_3way": THREE, "learned_chain": CHAIN, "learned_q03": TEXT["q03"], "learned_q05": TEXT["q05"], "learned_q07": Q07, "learned_q08": Q08, "learned_q10": TEXT["q10"]}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Database.over(spark, sf_dir, *TABLES).select(TEXTS[name], learned=True)


QUERIES = {name: partial(run, name=name) for name in TEXTS}
SQL = dict(TEXTS)
