"""A learned join's search, to look at."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .learned import JoinStats


def tree_frame(spark: SparkSession, stats: JoinStats) -> DataFrame:
    """(prefix, visits, reward) of each edge of the search tree."""
    return spark.createDataFrame(stats.tree, "prefix string, visits int, reward double")


def episode_frame(spark: SparkSession, stats: JoinStats) -> DataFrame:
    rows = [(i, " > ".join(e.order), e.table, len(e.batches), e.seconds, e.rows, e.reward) for i, e in enumerate(stats.episodes)]
    return spark.createDataFrame(rows, "episode int, join_order string, first string, batches int, seconds double, rows long, reward double")


def episode_lines(stats: JoinStats) -> Iterator[str]:
    for i, e in enumerate(stats.episodes):
        yield f"episode {i}: {' > '.join(e.order)}, {len(e.batches)} batches of {e.table}, {e.rows} rows, {e.seconds:.2f} s, reward {e.reward:.2f}"
    for prefix, visits, reward in stats.tree:
        yield f"{'  ' * prefix.count('>')}{prefix}: {visits} visits, reward {reward:.2f}"
