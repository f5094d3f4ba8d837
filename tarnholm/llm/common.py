"""What the operators share: session settings, the scratch folder and column helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers get batches of at most this much, so that very long texts don't pile up.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches, and gives tests on one machine a checkpoint folder.

    On a cluster the folder is what spark.checkpoint.dir names; without it there is an error
    rather than a folder that other machines don't see.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    # workers on this machine, or on others that have the folder, find the package wherever they start
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (path, ROOT)))
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: whatever else a table has can't clash with what is added."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def row_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row: equal for repeated rows, different for rows that share only an id (or have none)."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scatter(shard: np.ndarray, shards: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that occurs, with its part of each array as bytes."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    some = np.flatnonzero(np.diff(ends))
    cut = [pa.array([v[order[ends[s] : ends[s + 1]]].tobytes() for s in some], pa.binary()) for v in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *cut], names=["shard", *arrays])


def gather(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays of each shard put together again; rows of a shard are neighbours."""
    rows = ((r[0], r[1:]) for b in batches for r in zip(b.column(0).to_pylist(), *(b.column(i + 1) for i in range(len(kinds)))))
    for shard, group in groupby(rows, key=lambda r: r[0]):
        held = [r[1] for r in group]
        yield shard, [np.frombuffer(b"".join(r[i].as_buffer() for r in held), k) for i, k in enumerate(kinds)]


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """A partition for each shard: hashed, some partitions would get several and others none."""
    return df.repartitionById(shards, "shard")


def hashed_share(df: DataFrame, rows: int, want: int, *cols: str, salt: int = 0) -> DataFrame:
    """About ``want`` of a table's ``rows``, by their hash: the same rows in every run, order and layout.

    Each task sends on its own share alone, where the smallest ``want`` hashes would be sent by every task.
    """
    if rows <= want:
        return df
    return df.filter(F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(1 << 31)) < F.lit(int((1 << 31) * want / rows)))
