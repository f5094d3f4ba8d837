"""Joins that a plain condition would leave to nested loops, or to a few tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = 1 << 26  # that one task of a spread join is meant to make
SALTS = 4  # keys with salts that a task gets of the hottest key, or more of others
ROWS = 1 << 19  # that one task of a sized shuffle gets


def sized(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions by keys, of about ROWS rows each: their number grows with the table, and so no task does."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    return df.repartition(tasks, *keys)


def spread(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Equi join, as l.* and r.*, whose keys may be few and have many pairs each; nulls don't meet.

    A plain join makes all pairs of a key in one task, and of a small table all in one or two. Here
    each left row gets one of some salts and each right row all of them, as many as the key with
    the most pairs needs, so that a task makes about PAIRS pairs whatever the tables' size. The
    rows that travel are the left ones and the right ones times the salts; only the pairs of a
    right key and salt at a time are held.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    pairs = F.col("__l").cast("double") * F.col("__r")
    most, total = count(left, "__l").join(count(right, "__r"), keys).agg(F.max(pairs), F.sum(pairs)).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((total or 0) / PAIRS) + 1)
    salts = int((most or 0) * SALTS * tasks / max(total or 0, 1)) + 1
    columns = left.columns
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    l, r = (df.repartition(tasks, *keys, "__salt").alias(name) for df, name in ((l, "l"), (r, "r")))
    equal = reduce(lambda a, b: a & b, (F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in [*keys, "__salt"]))
    return l.join(r.hint("merge"), equal if condition is None else equal & condition)


def band(left: DataFrame, right: DataFrame, time: str, seconds: int, keys: list[str]) -> DataFrame:
    """Pairs with equal keys and 0 < right.time - left.time <= seconds, as l.* and r.*.

    Each left row goes to the two buckets that its band can touch and each right row to its own,
    so this is an equi join on (keys, bucket) and a hot key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))
    l = left.withColumn("__bucket", F.explode(F.array(bucket(F.col(time)), bucket(F.col(time)) + 1))).alias("l")
    r = right.withColumn("__bucket", bucket(F.col(time))).alias("r")
    equal = F.col("l.__bucket") == F.col("r.__bucket")
    for k in keys:
        equal = equal & (F.col(f"l.`{k}`") == F.col(f"r.`{k}`"))
    gap = F.unix_micros(F.col(f"r.`{time}`").cast("timestamp")) - F.unix_micros(F.col(f"l.`{time}`").cast("timestamp"))
    return l.join(r, equal & (gap > 0) & (gap <= seconds * 1_000_000))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of all directed cycles a -> b -> c -> a; edges (a, b) are distinct.

    Worst-case optimal for skewed graphs: a path is opened at its endpoint of least degree only,
    so a vertex with many edges is never crossed with itself; the closing edge is a semi join on
    both ends. Each cycle is found once, at its least vertex, and turned to all three starts.
    """
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    rank = lambda v, d: F.struct(F.col(d), F.col(v))
    e = edges.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    loops = edges.filter("a = b").select("a", "b", F.col("a").alias("c"))
    e = e.filter("a <> b")
    first = e.filter(rank("a", "da") < rank("b", "db")).select("a", "b")  # from the least vertex on
    last = e.filter(rank("b", "db") < rank("a", "da")).select(F.col("b").alias("a"), F.col("a").alias("c"))  # back to it
    closing = e.select("b", F.col("a").alias("b0"), F.col("b").alias("c0")).select(F.col("b0").alias("b"), F.col("c0").alias("c"))
    found = first.join(last, "a").filter("b <> c").join(closing, ["b", "c"], "left_semi").select("a", "b", "c")
    # two or three equal vertices: a loop and an edge back
    back = edges.filter("a <> b").alias("x").join(edges.filter("a <> b").alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    looped = back.join(edges.filter("a = b").select("a"), "a").select("a", F.col("a").alias("b0"), F.col("b").alias("c"))
    pairs = looped.select("a", F.col("b0").alias("b"), "c")
    turned = found.unionByName(pairs)
    return turned.select(F.explode(F.array(F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c")), F.struct(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))).alias("t")).select("t.a", "t.b", "t.c").unionByName(loops)
