"""The engine's Spark session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "false",  # join orders are learned, or as written
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(cores: int | None = None, memory: str = "8g", **settings: str) -> SparkSession:
    """A local session with the engine's settings; on a cluster, pass these to spark-submit instead."""
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnholm").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
