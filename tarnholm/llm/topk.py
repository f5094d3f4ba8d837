"""Exact top-k search by exhaustive term-at-a-time accumulation.

``neighbours`` takes sparse rows, such as the vectors of a table, and a stated set of these, those
whose id is divisible by ``every``, as queries over all rows. Rows are packed into blocks; for each
pair of a query block and a block of postings, term after term, the weighted postings are scattered
into dense arrays of scores, the best k are selected by partition, and the lists of all pairs are
merged. No block is broadcast: pairs of blocks are read from the shared checkpoint folder, so a
task holds two blocks however many there are. The work is that of all pairs of a query and a row,
as an exhaustive search has it.

``top_k`` is the same over text: every row of the query table is a query. One pass over the
documents keeps the postings of the queries' terms and the corpus statistics; a second one scores
a block of documents at a time. Scores are BM25 in integers (thousandths), equal in every order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_shard, columns, gather, partitions, prepare, scatter
from .text import U, Words, mix, slices

K, K1, B = 10, 1.2, 0.75
#: The registered search asks for every row whose id this divides.
EVERY = 20
#: Text of queries handled in one pass over the documents; more queries take more passes.
PASS_BYTES = 4 << 20
SIEVE = 1 << 20
RESULT = "item_id long, doc_id long, score long"


ROWS, AT_ONCE = 4096, 64
BLOCK = "block int, ids binary, off binary, terms binary, weights binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit rows without their zeros, ROWS to a block: ids, row starts, terms, weights."""
    held: list[tuple[int, np.ndarray]] = []

    def block(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        some = [np.flatnonzero(v) for _, v in rows]
        off = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
        cols = [np.array([i for i, _ in rows], np.int64), off, np.concatenate(some).astype(np.int32), np.concatenate([v[x] for (_, v), x in zip(rows, some)])]
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0] % 2**31], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["block", "ids", "off", "terms", "weights"])

    for batch in batches:
        for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
            v = np.array([0.0 if x is None else x for x in v], np.float64)
            norm = np.sqrt((v * v).sum()) if np.isfinite(v).all() else 0.0
            if norm > 0:
                held.append((i, v / norm))
        while len(held) >= ROWS:
            yield block(held[:ROWS])
            held = held[ROWS:]
    if held:
        yield block(held)


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores that aren't -inf; ties by id."""
    n = score.shape[1]
    cut = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    row, col = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(score)))
    few = np.arange(len(row)) - start[row] < k
    return row[few], col[few]


def scatter_scores(q: tuple, d: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of the best k of block d for each row of block q; not a row itself."""
    (q_ids, q_off, q_terms, q_weights), (ids, off, terms, weights) = q, d
    owner = np.repeat(np.arange(len(ids)), np.diff(off))
    order = np.lexsort((owner, terms))
    terms, owner, weights = terms[order], owner[order], weights[order]  # postings, by term
    names, start = np.unique(terms, return_index=True)
    end = np.append(start[1:], len(terms))
    q_owner = np.repeat(np.arange(len(q_ids)), np.diff(q_off))
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(q_ids), AT_ONCE):
        b = min(a + AT_ONCE, len(q_ids))
        part = slice(q_off[a], q_off[b])
        by_term = np.argsort(q_terms[part], kind="stable")
        t, w, r = q_terms[part][by_term], q_weights[part][by_term], q_owner[part][by_term] - a
        score = np.zeros((b - a, len(ids)))
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
        for x, y in zip(first, [*first[1:], len(t)]):
            p = np.searchsorted(names, t[x])
            if p < len(names) and names[p] == t[x]:
                postings, rows = slice(start[p], end[p]), r[x:y]
                product = np.multiply.outer(w[x:y], weights[postings])
                if len(rows) == b - a and end[p] - start[p] == len(ids):
                    score += product  # all have the term
                else:
                    score[np.ix_(rows, owner[postings])] += product
        score[q_ids[a:b, None] == ids[None, :]] = -np.inf
        row, col = best_rows(score, ids, k)
        out.append((q_ids[a:b][row], ids[col], score[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def merge_lists(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, doc, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(query)) - np.repeat(start, np.diff([*start, len(query)])) + 1
    few = rank <= k
    return query[few], doc[few], score[few], rank[few]


def _pairs(batches: Iterator[pa.RecordBatch], k: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Lists of each query block, merged over the blocks it meets in a task."""
    kinds = (np.int64, np.int64, np.int32, np.float64)
    now, found = None, []

    def flush() -> pa.RecordBatch:
        query, doc, score, _ = merge_lists(found, k)
        return scatter((mix(query.view(U)) % U(shards)).astype(np.int64), shards, query=query, doc=doc, score=score)

    for batch in batches:
        for i in range(batch.num_rows):
            q, d = (tuple(np.frombuffer(batch.column(side + c)[i].as_buffer(), kind) for c, kind in zip(("ids", "off", "terms", "weights"), kinds)) for side in ("q_", "d_"))
            key = q[0].tobytes()
            if found and key != now:
                yield flush()
                found = []
            now = key
            found.append(scatter_scores(q, d, k))
            if len(found) > 16:
                found = [merge_lists(found, k)[:3]]
    if found:
        yield flush()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, found in gather(batches, np.int64, np.int64, np.float64):
        query, doc, score, rank = merge_lists([tuple(found)], k)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(np.round(score, 6)), pa.array(rank.astype(np.int32))], names=["vec_id", "neighbour_id", "score", "rank"])


def neighbours(vectors: DataFrame, k: int = K, every: int = 1) -> DataFrame:
    """The k nearest rows of every query by cosine: vec_id, neighbour_id, score (6 digits), rank (from 1).

    The rows whose vec_id is divisible by ``every`` are queries; every row is a candidate for all
    queries with another vec_id. Ties go to the smaller id. Rows without vec_id, and null, empty, zero and non-finite vectors, have no cosine and
    neither ask nor answer; a null element counts as 0, and so do places beyond a shorter vector's
    end. Of rows that share a vec_id the first vector (in array order) stands. Fewer than k rows
    give shorter lists. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    shards = partitions(spark)
    rows = columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter("id IS NOT NULL AND vector IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = rows.mapInArrow(_blocks, BLOCK).checkpoint()
    asked = blocks if every == 1 else rows.filter(F.pmod("id", F.lit(every)) == 0).mapInArrow(_blocks, BLOCK).checkpoint()
    side = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in ("ids", "off", "terms", "weights")))
    found = side(asked, "q_").crossJoin(side(blocks, "d_")).mapInArrow(partial(_pairs, k=k, shards=shards), "shard int, query binary, doc binary, score binary")
    return by_shard(found, shards).mapInArrow(partial(_merged, k=k), "vec_id long, neighbour_id long, score double, rank int")


SQL_VECTORS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
u AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS e FROM n WHERE norm > 0),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_dot_product(a.e, b.e) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank FROM s)
SELECT vec_id, neighbour_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


class Queries:
    """terms: the distinct term hashes, sorted; each query is a list of (term index, frequency)."""

    def __init__(self, rows: list[tuple[int, str]]):
        w = Words(pa.array([t for _, t in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.terms, at = np.unique(w.hash, return_inverse=True)
        pairs, self.freq = np.unique(w.doc() * max(1, len(self.terms)) + at, return_counts=True)
        self.term = pairs % max(1, len(self.terms))
        self.off = np.searchsorted(pairs // max(1, len(self.terms)), np.arange(len(rows) + 1))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.terms & U(SIEVE - 1)).astype(np.int64)] = True

    def postings(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and by term, then text: term, text, frequency."""
        w = Words(texts)
        at = np.flatnonzero(self.sieve[(w.hash & U(SIEVE - 1)).astype(np.int64)])
        term = np.searchsorted(self.terms, w.hash[at])
        known = self.terms[np.minimum(term, len(self.terms) - 1)] == w.hash[at]
        pairs, freq = np.unique(term[known] * len(w) + w.doc()[at[known]], return_counts=True)
        return w.count(), (pairs // len(w)).astype(np.int32), (pairs % len(w)).astype(np.int32), freq.astype(np.int32)


POSTINGS = "n long, words long, docs binary, lengths binary, terms binary, owners binary, freqs binary, seen binary"


def _postings(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=4 << 20):
        batch = batch.filter(batch.column("text").is_valid())
        if not batch.num_rows:
            continue
        lengths, term, owner, freq = queries.postings(batch.column("text"))
        seen, df = np.unique(term, return_counts=True)
        ids = np.array([[x is not None, x or 0] for x in batch.column("doc_id").to_pylist()], np.int64)
        row = [batch.num_rows, int(lengths.sum()), ids.tobytes(), lengths.astype(np.int32).tobytes(), term.tobytes(), owner.tobytes(), freq.tobytes(), np.stack([seen, df]).astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[2:])], names=[c.split()[0] for c in POSTINGS.split(", ")])


def _frequencies(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(terms, np.int64)
    for batch in batches:
        for x in batch.column("seen"):
            seen, df = np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1)
            total[seen] += df
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])


def best(score: np.ndarray, none: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest positive scores; ties by doc_id, null last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        cut = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= cut]
    return at[np.lexsort((doc[at], none[at], -score[at]))][:k]


def _scores(batches: Iterator[pa.RecordBatch], queries: Queries, idf: np.ndarray, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    top: list[list[np.ndarray]] = [[] for _ in queries.ids]
    merge = lambda held: (t := np.concatenate(held, axis=1))[:, best(t[0], t[1], t[2], k)]
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(c)[r].as_buffer(), kind)  # noqa: B023, E731
            ids, lengths, term, owner, freq = get("docs", np.int64).reshape(-1, 2), get("lengths", np.int32), get("terms", np.int32), get("owners", np.int32), get("freqs", np.int32)
            tf = freq.astype(float)
            impact = np.floor(1000.0 * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * lengths[owner] / mean)) + 0.5).astype(np.int64)
            cut = np.searchsorted(term, np.arange(len(queries.terms) + 1))
            for q in range(len(queries.ids)):
                score = np.zeros(len(ids), np.int64)
                for t, n in zip(queries.term[queries.off[q] : queries.off[q + 1]].tolist(), queries.freq[queries.off[q] : queries.off[q + 1]].tolist()):
                    a, b = cut[t], cut[t + 1]
                    score[owner[a:b]] += n * idf[t] * impact[a:b]  # a text occurs once in a term's postings
                at = best(score, 1 - ids[:, 0], ids[:, 1], k)
                top[q].append(np.stack([score[at], 1 - ids[at, 0], ids[at, 1]]))
                if len(top[q]) > 8:
                    top[q] = [merge(top[q])]
    rows = [(q, *x) for q, held in enumerate(top) if held for x in merge(held).T.tolist()]
    if rows:
        q, score, none, doc = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([None if n else d for n, d in zip(none, doc)], pa.int64()), pa.array(score, pa.int64())], names=["q", "doc_id", "score"])


def _one_pass(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    stored = docs.mapInArrow(partial(_postings, queries=queries), POSTINGS).checkpoint()
    n, words = stored.agg(F.sum("n"), F.sum("words")).first()
    df = np.zeros(len(queries.terms), np.int64)
    for term, count in stored.select("seen").mapInArrow(partial(_frequencies, terms=len(df)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = count
    idf = np.floor(1000.0 * np.log(1.0 + (n or 0) / np.maximum(df, 1)) + 0.5).astype(np.int64)
    mean = words / n if n and words else 1.0
    found = stored.mapInArrow(partial(_scores, queries=queries, idf=idf, mean=mean, k=k), "q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(queries.ids)), "q int, item_id long")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.join(F.broadcast(names), "q").select("item_id", "doc_id", "score", "rank")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every query: item_id, doc_id, score, rank (from 1).

    Every row of queries is one, repeated rows too. Documents that share no word with a query
    aren't listed, so a query may have fewer than k rows, or none if its text is null or empty.
    Ties go to the smaller doc_id, null last. Null documents don't count in the statistics, empty
    ones do; repeated rows are documents of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    queries = columns(queries, "item_id", "text").filter("text IS NOT NULL").withColumn("item_id", F.col("item_id").cast("long"))
    passes = -(-(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES)
    parts = []
    for i in range(passes):
        rows = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        found = Queries(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is not None, x)))
        if len(found.terms):
            parts.append(_one_pass(docs, found, k))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT + ", rank int")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, t, any_value(l) AS l, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000.0::DOUBLE * ln(1.0::DOUBLE + n / CAST(count(*) AS DOUBLE)) + 0.5) AS BIGINT) AS idf FROM p, s GROUP BY t, n),
i AS (SELECT doc_id, t, CAST(floor(1000.0::DOUBLE * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)) + 0.5) AS BIGINT) AS impact FROM p, s),
r AS (SELECT item_id, doc_id, CAST(sum(qf * idf * impact) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r) WHERE rank <= 10
"""
