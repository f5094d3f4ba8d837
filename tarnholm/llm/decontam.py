"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, the windows of a document that have as many words are compared with it.
Windows get a SimHash over their word shingles; a multi-index over blocks of the items'
fingerprints gives every item within RADIUS bits (of two such fingerprints some block differs in
at most RADIUS // BLOCKS bits, and all values that near are listed); and the weighted Jaccard
similarity of the shingles, weighted by their length, decides.

Most windows need no fingerprint: a window that reaches the threshold has in it, of shingles that
occur in the benchmark, at least the threshold's share of an item's weight. That is checked with
prefix sums for all windows, so nothing is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, prepare
from .text import U, Words, simhash, slices, spans

SHINGLE, RADIUS, BLOCKS, THRESHOLD = 3, 20, 7, 0.5
SIEVE = 1 << 20
#: Text of benchmark items searched for in one pass over the documents; more take more passes.
PASS_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, similarity double, start int, words int"


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle from each word on; weight 0 where it would leave the text."""
    h, whole = w.shingles(SHINGLE)
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    n = len(h)
    weight = size[np.minimum(np.arange(n) + SHINGLE, n)] - size[:n]
    return h, np.where(whole, weight, 0)


def bag(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, and the weight of all their occurrences."""
    names, at = np.unique(h, return_inverse=True)
    return names, np.bincount(at, weights=weight, minlength=len(names))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


class Index:
    """Fingerprints, bags and block tables of benchmark items with at least SHINGLE words."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, threshold: float = THRESHOLD):
        self.radius, self.threshold = radius, threshold
        w = Words(pa.array([t for _, t in items], pa.string()))
        h, weight = shingles(w)
        use = np.flatnonzero(w.count() >= SHINGLE)
        self.ids = [items[i][0] for i in use]
        self.size = w.count()[use]
        at = [slice(w.off[i], w.off[i + 1] - SHINGLE + 1) for i in use]
        self.bags = [bag(h[s], weight[s]) for s in at]
        self.total = np.array([b[1].sum() for b in self.bags])
        off = np.concatenate([[0], np.cumsum([s.stop - s.start for s in at])]).astype(np.int64)
        self.prints = simhash(np.concatenate([h[s] for s in at]), off) if len(use) else np.zeros(0, U)
        self.known = np.unique(np.concatenate([b[0] for b in self.bags])) if len(use) else np.zeros(0, U)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.known & U(SIEVE - 1)).astype(np.int64)] = True
        self.sizes = np.unique(self.size)
        self.least = {m: threshold * self.total[self.size == m].min() for m in self.sizes.tolist()}
        self.tables = {m: self._tables(np.flatnonzero(self.size == m)) for m in self.sizes.tolist()}

    def _tables(self, items: np.ndarray) -> list[tuple]:
        """For each block, the items of one size that are near each value: shift, mask, where each value's start, items."""
        edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        out = []
        for lo, hi in zip(edges, edges[1:]):
            mask = U((1 << (hi - lo)) - 1)
            part = (self.prints[items] >> U(lo)) & mask
            near = np.bitwise_count(np.arange(1 << (hi - lo), dtype=U)[:, None] ^ part[None, :]) <= self.radius // BLOCKS
            out.append((U(lo), mask, np.concatenate([[0], np.cumsum(near.sum(axis=1))]), items[np.nonzero(near)[1]]))
        return out

    def within(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item of that size) within the radius, all of them."""
        found = []
        for shift, mask, off, item in self.tables[size]:
            v = ((prints >> shift) & mask).astype(np.int64)
            n = off[v + 1] - off[v]
            p, i = np.repeat(np.arange(len(prints)), n), item[spans(off[v], n)]
            near = np.bitwise_count(prints[p] ^ self.prints[i]) <= self.radius
            found.append(p[near] * len(self.ids) + i[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window for each text and item above the threshold."""
        w = Words(texts)
        if not len(self.ids) or len(w.hash) < SHINGLE:
            return []
        h, weight = shingles(w)
        at = np.flatnonzero(self.sieve[(h & U(SIEVE - 1)).astype(np.int64)] & (weight > 0))
        at = at[self.known[np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)] == h[at]]
        if not len(at):
            return []
        sums = np.zeros(len(h) + 1)
        sums[at + 1] = weight[at]
        sums = np.cumsum(sums)
        word = np.arange(len(h))
        longest, least = int(self.sizes[-1]), min(self.least.values())
        starts = np.flatnonzero(sums[np.minimum(word + longest, len(h))] - sums[:-1] >= least)
        doc = np.searchsorted(w.off, starts, side="right") - 1
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for m in self.sizes.tolist():
            # a text with fewer words than the item is one window
            fits = (starts + m <= w.off[doc + 1]) | (starts == w.off[doc])
            s = starts[fits]
            n = np.minimum(m, w.off[doc[fits] + 1] - s)
            heavy = (n >= SHINGLE) & (sums[s + np.maximum(n - SHINGLE + 1, 0)] - sums[s] >= self.least[m])
            s, n, d = s[heavy], n[heavy], doc[fits][heavy]
            if not len(s):
                continue
            number = n - SHINGLE + 1
            prints = simhash(h[spans(s, number)], np.concatenate([[0], np.cumsum(number)]))
            for p, i in zip(*(x.tolist() for x in self.within(prints, m))):
                window = slice(s[p], s[p] + number[p])
                score = similarity(bag(h[window], weight[window]), self.bags[i])
                key = int(d[p]), i
                if score >= self.threshold and score > best.get(key, (0.0, 0, 0))[0]:
                    best[key] = score, int(s[p] - w.off[d[p]]), int(n[p])
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def indexes(benchmark: DataFrame, radius: int, threshold: float) -> Iterator[Index]:
    """Indexes of at most PASS_BYTES of items each; one for any ordinary benchmark."""
    items = columns(benchmark, "item_id", "text").filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        yield Index(sorted(((r.item_id, r.text) for r in part), key=lambda x: (x[0] is not None, x)), radius, threshold)


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column("doc_id").to_pylist()
        if rows := index.search(batch.column("text")):
            d, i, score, start, words = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x in d], pa.int64()), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(score), pa.array(start, pa.int32()), pa.array(words, pa.int32())],
                names=["doc_id", "item_id", "similarity", "start", "words"],
            )


def contamination(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, similarity, start, words.

    start and words give the best window, in words; of equal ones the first. A document with
    fewer words than an item is compared as a whole. Items with fewer than SHINGLE words, and
    null and empty texts on either side, match nothing; repeated documents are searched each,
    repeated items once; null ids are kept. Empty tables give no rows, other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for index in indexes(benchmark, radius, threshold):
        part = docs.mapInArrow(partial(_search, index=index), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _keep(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        clean = np.ones(batch.num_rows, bool)
        clean[[r[0] for r in index.search(batch.column("text"))]] = False
        yield batch.filter(pa.array(clean))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    prepare(docs.sparkSession)
    for index in indexes(benchmark, radius, threshold):
        docs = docs.mapInArrow(partial(_keep, index=index), docs.schema)
    return docs
