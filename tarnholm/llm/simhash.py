"""Near-duplicate groups by SimHash and BK-trees.

A document's features are its distinct words. Two independent 64-bit SimHashes are taken; two
documents are near when one of these differs in at most RADIUS bits and the other in at most
SUPPORT bits, and groups are the connected components.

Search: a fingerprint is cut into blocks; of any two within the radius, some ``exact`` blocks are
equal, so each fingerprint goes to the shards of all choices of that many blocks, and nothing
within the radius is missed. A shard holds a forest of BK-trees, one for each value of the chosen
blocks, whose children are keyed by their integer Hamming distance to the parent; a search goes
down only the edges whose distance lies within the radius of the node's. A tree travels to the
one task that searches it, not to all: the trees of a corpus grow with it, so they can't be
broadcast whole. The number of blocks follows the number of fingerprints; it changes the cost
and never the pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_shard, columns, fresh, gather, partitions, prepare, row_id, scatter
from .text import U, Words, mix, simhash, slices, spans

RADIUS, SUPPORT, SHORT, FEW = 7, 18, 4, 8
VISITS = 1_000_000


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints a text, and which texts have any (those that aren't empty).

    Words under SHORT bytes count only in texts that have fewer than FEW distinct longer ones. A
    text without words is its own feature.
    """
    w = Words(texts)
    doc, n = w.doc().astype(np.uint64), len(w)
    low = U((1 << 48) - 1)
    key = np.unique(doc << U(48) | w.hash >> U(16))  # slices have under 2**16 texts
    longer = np.unique((doc << U(48) | w.hash >> U(16))[w.end - w.start >= SHORT])
    enough = np.bincount((longer >> U(48)).astype(np.int64), minlength=n) >= FEW
    key = key[~enough[(key >> U(48)).astype(np.int64)]]
    key = np.sort(np.concatenate([key, longer[enough[(longer >> U(48)).astype(np.int64)]]]))
    off = np.searchsorted(key >> U(48), np.arange(n + 1))
    a = simhash(mix(key & low), off)
    b = simhash(mix((key & low) + U(0x3C6EF372FE94F82B)), off)
    for i in np.flatnonzero((np.diff(off) == 0) & (np.diff(w.bytes_off) > 0)):
        data = w.data[w.bytes_off[i] : w.bytes_off[i + 1]]
        h = w.hashes(w.bytes_off[i : i + 1], w.bytes_off[i + 1 : i + 2]) + U(len(data))
        a[i], b[i] = mix(h)[0], mix(h + U(1))[0]
    return a, b, np.diff(w.bytes_off) > 0


def node_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b)).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for i in range(0, batch.num_rows, 60_000):
            part = batch.slice(i, 60_000)
            a, b, some = fingerprints(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), *(pa.array(x.view(np.int64), mask=~some) for x in (a, b, node_id(a, b)))], names=["rid", "doc_id", "a", "b", "node"])


def plan_blocks(count: int, radius: int = RADIUS, bucket: int = 100) -> tuple[int, int]:
    """(blocks, exact): the fewest blocks with which a bucket has about that many fingerprints at most."""
    for exact in range(2, 6):
        blocks = radius + exact
        if count >> (64 * exact // blocks) <= bucket:
            break
    return blocks, exact


def masks(blocks: int, exact: int) -> np.ndarray:
    """A mask for each choice of blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return np.array([sum(c) for c in combinations(each, exact)], U)


class Forest:
    """BK-trees over fingerprints, one for each bucket; equal buckets are neighbours."""

    def __init__(self, points: np.ndarray, bucket_start: np.ndarray):
        """bucket_start: for each point, the first point of its bucket, which becomes the root."""
        self.points, self.root = points, bucket_start
        at = bucket_start.copy()
        active = np.flatnonzero(np.arange(len(points)) != bucket_start)
        slots, children = [], []
        while len(active):  # a level of all trees at a time: the first to come takes a free edge
            distance = np.bitwise_count(points[active] ^ points[at[active]]).astype(np.int64)
            slot, first, which = np.unique(at[active] * 65 + distance, return_index=True, return_inverse=True)
            slots.append(slot)
            children.append(active[first])
            at[active] = active[first][which]
            rest = np.ones(len(active), bool)
            rest[first] = False
            active = active[rest]
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(slot)
        self.slot, self.child = slot[order], child[order]  # slot: parent * 65 + distance to it

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, earlier point of its bucket) within the radius; queries are points of the forest."""
        query, node = queries, self.root[queries]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            earlier = node < query  # a child comes after its parent: so do all below it
            query, node = query[earlier], node[earlier]
            distance = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            low = np.searchsorted(self.slot, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.slot, node * 65 + np.minimum(distance + radius, 64), side="right")
            query, node = np.repeat(query, high - low), self.child[spans(low, high - low)]
        if not found:
            return queries[:0], queries[:0]
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' component."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def shard_edges(combo: np.ndarray, a: np.ndarray, b: np.ndarray, mask: np.ndarray, radius: int, support: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the near fingerprints of a shard: of each to the smallest of its group."""
    half = len(mask)
    main, other = np.where(combo < half, a, b), np.where(combo < half, b, a)
    key = mix((main & mask[combo % half]) ^ (combo.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.lexsort((main, key))
    key, main, other = key[order], main[order], other[order]
    ids, node = np.unique(node_id(a, b)[order], return_inverse=True)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff([*start, len(key)])
    forest = Forest(main, np.repeat(start, size))
    several = np.flatnonzero(np.repeat(size, size) > 1)
    cost = np.cumsum(np.repeat(size, size)[several])
    pairs: list[np.ndarray] = []
    i = 0
    while i < len(several):
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + VISITS)))
        q, p = forest.search(several[i:j], radius)
        near = np.bitwise_count(other[q] ^ other[p]) <= support
        u, v = node[q[near]], node[p[near]]
        pairs.append(np.unique(np.maximum(u, v) * len(ids) + np.minimum(u, v)))
        i = j
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    label = components(both // max(1, len(ids)), both % max(1, len(ids)), len(ids))
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _route(batches: Iterator[pa.RecordBatch], mask: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    a, b = (np.concatenate([x.column(c).to_numpy() for x in held] or [np.zeros(0, np.int64)]).view(U) for c in ("a", "b"))
    step = max(1, 1_000_000 // (2 * len(mask)))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        combo = np.repeat(np.arange(2 * len(mask)), len(x)).astype(np.uint16)
        x, y = np.tile(x, 2 * len(mask)), np.tile(y, 2 * len(mask))
        main = np.where(combo < len(mask), x, y)
        key = mix((main & mask[combo % len(mask)]) ^ (combo.astype(U) * U(0x9E3779B97F4A7C15)))
        yield scatter((key % U(shards)).astype(np.int64), shards, combo=combo, a=x, b=y)


def _search(batches: Iterator[pa.RecordBatch], mask: np.ndarray, radius: int, support: int) -> Iterator[pa.RecordBatch]:
    for _, (combo, a, b) in gather(batches, np.uint16, U, U):
        u, v = shard_edges(combo, a, b, mask, radius, support)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots, from edges (u, v): alternating large and small stars.

    Each round is two grouped minima; a star graph is the fixed point. Every round's edges are
    written to the shared checkpoint folder, so a lost executor costs no more than a round.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = small.filter("u <> v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _decided(docs: DataFrame, radius: int, support: int) -> DataFrame:
    """rid, doc_id, kept_rid, kept_id, size of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = columns(docs, "doc_id", "text").select(row_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(_fingerprints, "rid long, doc_id long, a long, b long, node long").checkpoint()
    nodes = rows.filter("node IS NOT NULL").groupBy("node", "a", "b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count("*").alias("n")).checkpoint()
    mask, shards = masks(*plan_blocks(nodes.count(), radius)), partitions(spark)
    routed = nodes.select("a", "b").mapInArrow(partial(_route, mask=mask, shards=shards), "shard int, combo binary, a binary, b binary")
    edges = by_shard(routed, shards).mapInArrow(partial(_search, mask=mask, radius=radius, support=support), "u long, v long")
    roots = connect(edges)
    nodes = nodes.select("node", "first", "n").join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    groups = nodes.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("size"))
    nodes = nodes.join(groups, "root").select("node", "kept", "size")
    rows = rows.select("rid", "doc_id", "node").join(nodes, "node", "left")
    return rows.select(
        "rid",
        "doc_id",
        F.when(F.col("kept").isNull(), F.col("rid")).otherwise(F.col("kept.rid")).alias("kept_rid"),
        F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("kept_id"),
        F.coalesce("size", F.lit(1)).alias("size"),
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, support: int = SUPPORT) -> DataFrame:
    """One row a document: doc_id, group_id (the doc_id that stays), group_size, duplicate.

    The smallest doc_id of a group stays (one that is null only if all are). Null and empty texts
    are in no group but their own. A text without words is near its exact copies alone. Rows with
    the same doc_id and text are one document, and rows with the same doc_id and other texts
    different ones. An empty table gives no rows. Other columns are ignored.
    """
    d = _decided(docs, radius, support)
    return d.select("doc_id", F.col("kept_id").alias("group_id"), F.col("size").alias("group_size"), (F.col("rid") != F.col("kept_rid")).alias("duplicate"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, support: int = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays."""
    decided = _decided(docs, radius, support)
    rid, rank, drop = (fresh(docs, x) for x in ("_rid", "_rank", "_drop"))
    out = decided.groupBy("rid").agg(F.max(F.col("rid") != F.col("kept_rid")).alias(drop), F.count("*").alias("n")).filter(F.col(drop) | (F.col("n") > 1))
    out = out.select(F.col("rid").alias(rid), drop)
    with_id = docs.withColumn(rid, row_id())
    single = with_id.join(out, rid, "left")
    some = F.coalesce(F.col("text"), F.lit("")) != ""
    ranked = single.withColumn(rank, F.row_number().over(Window.partitionBy(rid).orderBy(F.lit(0))))
    return ranked.filter(~F.coalesce(F.col(drop), F.lit(False)) & (~some | (F.col(rank) == 1))).select(*(F.col(f"`{c}`") for c in docs.columns))
