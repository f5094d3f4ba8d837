"""Capture index of a web archive by external merging.

Each task sorts the captures it reads into runs and cuts every run at shared key boundaries; a
run's part travels as one packed record. The task that owns a key range merges the parts of all
runs with a loser tree, by URL key, time and id, and numbers them: ranges in order, captures in
order within each, so the whole is one globally ordered index with each URL's capture history.
The boundaries come from a sample of keys; they only balance the tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_shard, columns, hashed_share, partitions, prepare

RUN_ROWS = 100_000
KEYS = ["urlkey", "captured_at", "page_id", "url", "digest"]
SCHEMA = "position long, urlkey string, captured_at long, page_id long, url string, digest string, bytes long, capture_no long, changed boolean"


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: reversed host labels, then the path and query, in lower case.

    Scheme, fragment, user, default port and a leading www are dropped, so that addresses of one
    page meet. Null gives the empty key.
    """
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"#[\s\S]*$", "")
    rest = F.regexp_replace(rest, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(labels, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)))


def captures(pages: DataFrame) -> DataFrame:
    """The index fields of each page.

    captured_at is the column of that name, where there is one, as seconds (a timestamp is taken as
    seconds since 1970); a null time stays null. A table without it gets times derived from page_id.
    """
    id_ = F.col("page_id").cast("long")
    html = F.coalesce("html", F.lit(""))
    timed = [c for c in pages.columns if c.lower() == "captured_at"]
    at = F.col(f"`{timed[0]}`") if timed else F.lit(1704067200) + F.pmod(F.coalesce(id_, F.lit(0)) * 7919, F.lit(31536000))
    return columns(pages, "page_id", "url", "html", *timed[:1]).select(
        url_key(F.col("url")).alias("urlkey"),
        at.cast("long").alias("captured_at"),
        id_.alias("page_id"),
        "url",
        F.md5(html).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    )


class LoserTree:
    """K-way merge of sorted lists of tuples: log2(k) comparisons for each item taken."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.head: list[tuple | None] = [r[0] if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._sift(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _sift(self, winner: int) -> None:
        node, losers = (winner + self.k) >> 1, self.losers
        while node:
            other = losers[node]
            if other < 0:  # still building: wait here for the other half
                losers[node] = winner
                return
            if self._before(other, winner):
                losers[node], winner = winner, other
            node >>= 1
        losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, index in it), in the order of all items; equal items by run."""
        while self.k:
            w = self.losers[0] if self.k > 1 else 0
            if self.head[w] is None:
                return
            i = self.at[w]
            yield w, i
            self.at[w] = i + 1
            self.head[w] = self.runs[w][i + 1] if i + 1 < len(self.runs[w]) else None
            self._sift(w)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _runs(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, [(k, "ascending") for k in KEYS], null_placement="at_start"))
        owner = np.array([bisect_right(bounds, k) for k in table["urlkey"].to_pylist()])
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = [*cuts[1:], len(owner)]
        return pa.RecordBatch.from_arrays([pa.array(owner[cuts].astype(np.int32)), pa.array([_packed(table.slice(a, b - a)) for a, b in zip(cuts, ends)], pa.binary())], names=["shard", "run"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            yield run(held)
            held = []
    if sum(b.num_rows for b in held):
        yield run(held)


def _counts(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(bounds) + 1, np.int64)
    for batch in batches:
        np.add.at(total, [bisect_right(bounds, k) for k in batch.column(0).to_pylist()], 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["range", "n"])


def _key(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def merge(parts: list[pa.Table], first: int) -> pa.RecordBatch:
    """One range of the index from the sorted parts of all runs; first: the position of its first row."""
    runs = [list(map(_key, zip(*(t[k].to_pylist() for k in KEYS)))) for t in parts]
    base = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    order = np.fromiter((base[w] + i for w, i in LoserTree(runs)), np.int64, base[-1])
    table = pa.concat_tables(parts).take(pa.array(order)).combine_chunks()
    n = len(order)
    new = np.ones(n, bool)
    changed = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.not_equal(table["urlkey"][1:], table["urlkey"][:-1]).to_numpy(zero_copy_only=False)
        changed[1:] = new[1:] | pc.not_equal(table["digest"][1:], table["digest"][:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    number = np.arange(n) - np.repeat(starts, np.diff([*starts, n])) + 1
    cols = [pa.array(first + np.arange(n)), *(table[k] for k in (*KEYS, "bytes")), pa.array(number.astype(np.int64)), pa.array(changed)]
    names = ["position", *KEYS, "bytes", "capture_no", "changed"]
    return pa.Table.from_arrays(cols, names=names).combine_chunks().to_batches()[0]


def _merged(batches: Iterator[pa.RecordBatch], offsets: list[int]) -> Iterator[pa.RecordBatch]:
    rows = ((r, b) for batch in batches for r, b in zip(batch.column(0).to_pylist(), batch.column(1)))
    for owner, group in groupby(rows, key=lambda x: x[0]):
        yield merge([pa.ipc.open_stream(b.as_buffer()).read_all() for _, b in group], offsets[owner])


def capture_index(pages: DataFrame) -> DataFrame:
    """All captures in order of (urlkey, captured_at, page_id, url, digest), nulls first.

    Partitions hold key ranges in order and are sorted, so the rows come in order of position.
    position counts from 0 over the whole index; capture_no from 1 within a URL key; changed
    says whether the digest differs from the capture before it (true for the first). Null html
    counts as empty, a null url has the empty key and a null id keeps its row; repeated rows are
    repeated captures. An empty table gives an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    found = captures(pages)
    keys, n = found.select("urlkey", "page_id"), partitions(spark)
    sample = sorted(r[0] for r in hashed_share(keys, pages.count(), n * 50, "urlkey", "page_id").select("urlkey").collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    counts = dict(found.select("urlkey").mapInArrow(partial(_counts, bounds=bounds), "range int, n long").groupBy("range").agg(F.sum("n")).collect())
    offsets = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(len(bounds) + 1)])]).tolist()
    runs = found.mapInArrow(partial(_runs, bounds=bounds), "shard int, run binary")
    # range i goes to partition i, as written: hashed ranges would come out of order
    return by_shard(runs, len(bounds) + 1).mapInArrow(partial(_merged, offsets=offsets), SCHEMA)


SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(lower(coalesce(url, '')), '#[\s\S]*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM a),
c AS (SELECT *, substr(rest, length(host) + 1) AS path, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS bare FROM b),
d AS (SELECT CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(bare, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS urlkey,
 CAST(1704067200 + (coalesce(page_id, 0) * 7919) % 31536000 AS BIGINT) AS captured_at, page_id, url, md5(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM c)
SELECT row_number() OVER w - 1 AS position, *, row_number() OVER h AS capture_no, coalesce(lag(digest) OVER h <> digest, true) AS changed FROM d
WINDOW w AS (ORDER BY urlkey, captured_at, page_id NULLS FIRST, url NULLS FIRST, digest), h AS (PARTITION BY urlkey ORDER BY captured_at, page_id NULLS FIRST, url NULLS FIRST, digest)
"""
