"""Joins whose order is learned while they run.

The largest table is split into batches, by a hash of its join key, and so are the tables that it
meets in that key; where it has no key with many values, by a hash of its row and alone. An episode
takes the left-deep order that the search proposes, joins the next batch of those tables with the
others, and writes the result; the share of the batches done per second is the reward. Results of
the episodes are disjoint and together complete whatever orders were taken, so their union is
exact. What is split moves once in all episodes together, the smaller tables once in each. Orders
with a step that is estimated to have more rows than all tables together aren't tried (plans.sizes).
The first episode warms up and teaches nothing. Exploring goes on while the rest would take long;
then the best order does the rest, a half at a time while that is long, so that a later measurement
can still change the order.

Results lie in the shared checkpoint folder, so an executor's loss costs one episode at most.
"""

from __future__ import annotations

import logging
import tempfile
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sqltext import order_nulls
from .graph import QueryGraph, build
from .sizes import Sizes, measured
from .uct import OrderSearch, Selection, Weight

BATCH = "__batch"
KEYS_PER_BATCH = 100  # at least, for batches by a key
log = logging.getLogger(__name__)


@dataclass
class Episode:
    order: tuple[str, ...]
    table: str
    batches: list[int]
    seconds: float
    rows: int
    reward: float


@dataclass
class JoinStats:
    """What one learned join did."""

    pre_millis: float = 0.0
    join_millis: float = 0.0
    post_millis: float = 0.0
    episodes: list[Episode] = field(default_factory=list)
    tree: list[tuple[str, int, float]] = field(default_factory=list)
    nodes: int = 0

    @property
    def join_rows(self) -> int:
        return sum(e.rows for e in self.episodes)

    @property
    def plans(self) -> int:
        return len({e.order for e in self.episodes})

    @property
    def average_reward(self) -> float:
        return sum(e.reward for e in self.episodes) / max(1, len(self.episodes))

    @property
    def max_reward(self) -> float:
        return max((e.reward for e in self.episodes), default=0.0)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; on one machine, where that is unset, below the temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/learned-{uuid.uuid4().hex}"


def join_in_order(graph: QueryGraph, inputs: dict[str, DataFrame], order: tuple[str, ...]) -> DataFrame:
    """A left-deep chain; each predicate is applied as soon as its tables are there."""
    have, left = {order[0]}, set(graph.joins and range(len(graph.joins)))
    df = inputs[order[0]]
    for alias in order[1:]:
        have.add(alias)
        ready = [i for i in sorted(left) if graph.joins[i].aliases <= have]
        left -= set(ready)
        condition = reduce(lambda a, b: a & b, (graph.joins[i].column() for i in ready)) if ready else None
        df = df.join(inputs[alias], condition, "inner") if condition is not None else df.crossJoin(inputs[alias])
    return df


def batch_keys(graph: QueryGraph, sizes: Sizes, batches: int) -> tuple[str, dict[str, str]]:
    """The largest table, and the column that batches go by: of it, and of the tables that it meets in it.

    Of its keys with many values it is the one that most other rows meet. Equal keys have equal
    hashes only within a type, and not for floating numbers. Without such a key there is no column.
    """
    largest = max(graph.tables, key=lambda a: sizes.rows[a])
    kind = lambda a, c: next(f.dataType for f in graph.tables[a].schema if f.name.lower() == c)
    plain = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.DecimalType)
    best: tuple[int, str, dict[str, str]] = (0, largest, {})
    for column in sorted({c for pair in sizes.equal for a, c in pair if a == largest}):
        mates = {a: c for pair in sizes.equal if (largest, column) in pair for a, c in pair if a != largest and kind(a, c) == kind(largest, column)}
        met = sum(sizes.rows[a] for a in mates)
        if isinstance(kind(largest, column), plain) and sizes.distinct[largest, column] >= KEYS_PER_BATCH * batches and met > best[0]:
            best = met, largest, {largest: column} | mates
    return best[1:]


def learned_join(
    spark: SparkSession,
    graph: QueryGraph,
    needed: dict[str, set[str]],
    batches: int = 16,
    explore: int = 3,
    seed: int = 0,
    selection: Selection = Selection.UCB1,
    weight: Weight = Weight.STATIC,
    forget: bool = True,
    patience: float = 10.0,
) -> tuple[DataFrame, JoinStats]:
    """The join's rows with columns named alias__column, and how it went.

    batches: of the largest table; explore: episodes that teach, at least, after the one that warms up;
    patience: the seconds that the rest may take by the best order without more trials, which at
    most half the batches go into. Up to two tables are joined as they stand.
    """
    stats, aliases = JoinStats(), list(graph.tables)
    began = time.perf_counter()
    inputs = {a: graph.filtered(a, needed[a]) for a in aliases}
    if graph.constant:
        keep = reduce(lambda a, b: a & b, map(F.expr, graph.constant))
        inputs = {a: df.filter(keep).alias(a) for a, df in inputs.items()}
    wanted = graph.output if any(graph.output.values()) else needed
    out_columns = [F.col(f"{a}.`{c}`").alias(f"{a}__{c.lower()}") for a in aliases for c in inputs[a].columns if c.lower() in wanted[a]]
    if len(aliases) <= 2:
        stats.pre_millis = 1000 * (time.perf_counter() - began)
        return join_in_order(graph, inputs, tuple(aliases)).select(*out_columns), stats
    sizes = measured(graph)
    largest, keys = batch_keys(graph, sizes, batches)
    for a in keys or [largest]:
        df, by = inputs[a], [keys[a]] if keys else inputs[a].columns
        inputs[a] = df.withColumn(BATCH, F.pmod(F.xxhash64(*(F.col(f"{a}.`{c}`") for c in by)) if by else F.xxhash64(F.lit(0)), F.lit(batches))).alias(a)
    stats.pre_millis = 1000 * (time.perf_counter() - began)

    search = OrderSearch(aliases, sizes.allowed, selection, weight, forget=forget, seed=seed)
    remaining = list(range(batches))
    folder, parts = scratch(spark), []
    while remaining:
        done, order, ahead = len(stats.episodes), None, 0.0
        if search.tried:
            order = search.best()
            ahead = len(remaining) / batches / search.expected(order)  # seconds
        exploring = done <= max(1, explore) or (ahead > patience and done < batches // 2)
        if exploring:
            order = search.propose()
        left = len(remaining)
        take = remaining[: 1 if exploring else (left + 1) // 2 if ahead > patience else left]
        now = inputs | {a: inputs[a].filter(F.col(BATCH).isin(take)).alias(a) for a in keys or [largest]}
        path = f"{folder}/{done}"
        start = time.perf_counter()
        seen = Observation()
        joined = join_in_order(graph, now, order).select(*out_columns)
        joined.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        seconds = time.perf_counter() - start
        parts.append(spark.read.schema(joined.schema).parquet(path))
        speed = len(take) / batches / max(seconds, 1e-6)
        if exploring and done:
            search.learn(order, speed)
        elif done:
            search.tried[order].append(speed)
        stats.episodes.append(Episode(order, largest, take, seconds, seen.get["rows"], speed))
        log.info("episode %d: %s, %d of %d batches of %s in %.2f s", done, " > ".join(order), len(take), batches, largest, seconds)
        remaining = remaining[len(take) :]
    fastest = max(e.reward for e in stats.episodes)
    for e in stats.episodes:
        e.reward /= fastest
    stats.join_millis = 1000 * sum(e.seconds for e in stats.episodes)
    stats.tree, stats.nodes = search.rows(), search.nodes
    return reduce(DataFrame.unionByName, parts), stats


def learned_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **options) -> tuple[DataFrame, JoinStats]:
    """Runs a SELECT over a comma join: the join by a learned order, the rest by Catalyst."""
    select, graph, needed = build(spark, sql, {k.lower(): v for k, v in tables.items()})
    joined, stats = learned_join(spark, graph, needed, **options)
    began = time.perf_counter()
    # the joined columns as structs by alias, so that alias.column and bare names mean what they did
    per = {a: [c for c in joined.columns if c.startswith(f"{a}__")] for a in graph.tables}
    bare = [c.split("__", 1)[1] for c in joined.columns]
    single = [c for c in joined.columns if bare.count(c.split("__", 1)[1]) == 1]
    shaped = joined.select(
        *(F.struct(*(F.col(c).alias(c.split("__", 1)[1]) for c in cols)).alias(a) for a, cols in per.items() if cols),
        *(F.col(c).alias(c.split("__", 1)[1]) for c in single if c.split("__", 1)[1] not in graph.tables),
    ) if joined.columns else joined
    view = f"joined_{uuid.uuid4().hex}"
    shaped.createOrReplaceTempView(view)
    items = []
    for e, alias in select.items:
        if e == "*" or e.endswith(".*"):
            items += [f"{a}.{c}" for a in (graph.tables if e == "*" else [e[:-2].lower()]) for c in map(str.lower, graph.tables[a].columns)]
        else:
            items.append(f"{e} AS `{alias}`" if alias else e)
    select.select, select.from_, select.where = ", ".join(items), view, ""
    select.order = order_nulls(select.order) if select.order else ""
    out = spark.sql(select.sql())
    spark.catalog.dropTempView(view)
    stats.post_millis = 1000 * (time.perf_counter() - began)
    return out, stats
