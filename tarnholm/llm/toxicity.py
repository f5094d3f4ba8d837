"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and a sample of all texts, whose labels it doesn't look
at: labels that aren't positive aren't used at all. The class prior is estimated from these two
sets, unless it is given. With it, the risk on the unseen negatives is the unlabelled risk less the share that
positives have in it; where that estimate falls below zero the step goes back up instead, which
is the non-negative correction. The model is linear over the words, and word beginnings, that are
over-represented in the positives, with weights that aren't negative, and is fitted in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, hashed_share, prepare
from .text import U, Words, slices

STEMS = (4, 6)
SIEVE = 1 << 20
SCHEMA = "doc_id long, toxic boolean, score double"


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """32-bit features, and the text of each: the words, and the beginnings of longer ones."""
    doc = w.doc()
    hashes, docs = [w.hash], [doc]
    for k in STEMS:
        longer = w.end - w.start > k
        start = w.start[longer]
        hashes.append(w.hashes(start, start + k) ^ U(0x5BD1E995 * k))
        docs.append(doc[longer])
    return (np.concatenate(hashes) >> U(32)).astype(np.uint32), np.concatenate(docs)


class Model:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(vocabulary)
        self.vocabulary, self.weights, self.bias = vocabulary[order], weights[order], bias
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.vocabulary & np.uint32(SIEVE - 1)] = True

    def matrix(self, feature: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the vocabulary and text of each feature that a text has, once each."""
        maybe = self.sieve[feature & np.uint32(SIEVE - 1)]
        feature, doc = feature[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, feature), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == feature if len(self.vocabulary) else np.zeros(0, bool)
        pairs = np.unique(doc[known].astype(np.int64) << 32 | at[known])
        return pairs & 0xFFFFFFFF, pairs >> 32

    def score(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        at, doc = self.matrix(*features(w))
        return self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(w))


def screen(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> np.ndarray:
    """The features that are most over-represented in the positives' texts; each set has a feature once."""
    n, m = len(positive), max(1, len(unlabelled))
    names, p = np.unique(np.concatenate(positive), return_counts=True)
    names, p = names[p >= 3], p[p >= 3]
    u = np.zeros(len(names), np.int64)
    for s in unlabelled if len(names) else []:
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        u[at[names[at] == s]] += 1
    rate = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
    chosen = np.flatnonzero((z > 3) & (p / n > 2 * u / m))
    return names[chosen[np.argsort(-z[chosen], kind="stable")][:most]]


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Which features of a sorted vocabulary each set has, as 0 and 1."""
    x = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, s in zip(x, sets):
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        row[at[vocabulary[at] == s]] = 1
    return x


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss, by Adam on all rows."""
    w = np.zeros(xp.shape[1] + 1, np.float64)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        w32 = w[:-1].astype(np.float32)  # as the rows are: a matrix isn't converted at each step
        sp, su = sigmoid(xp @ w32 + w[-1]), sigmoid(xu @ w32 + w[-1])
        dp, du = (sp * (1 - sp) / len(sp)).astype(np.float32), (su * (1 - su) / len(su)).astype(np.float32)
        slope_p = np.append(dp @ xp, dp.sum())  # of the mean of the sigmoid over the positives
        negative = su.mean() - prior * sp.mean()  # the loss of a negative is the sigmoid
        slope_n = np.append(du @ xu, du.sum()) - prior * slope_p
        grad = -prior * slope_p + slope_n if negative >= 0 else -slope_n
        grad[:-1] += decay * w[:-1] / max(1, len(w))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        np.maximum(w[:-1], 0, out=w[:-1])  # a word can speak for toxicity, none can excuse it
    return w[:-1], float(w[-1])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        f, doc = features(Words(batch.column("text")))
        pairs = np.unique(doc.astype(np.uint64) << U(32) | f)
        ends = np.searchsorted(pairs >> U(32), np.arange(1, batch.num_rows))
        found = [x.tobytes() for x in np.split(pairs.astype(np.uint32), ends)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "p", "u")] + [pa.array(found, pa.binary())], names=["id", "p", "u", "found"])


def estimate_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from 0 and 1 for the words each row has.

    For any set of texts, the share of the unlabelled in it is at least the prior times the share of
    the positives in it, so the least ratio of the two bounds the prior; the sets are the texts with
    one of the k first words, the most over-represented first. An error of the shares is allowed for.
    """
    n, m, least = len(xp), len(xu), 0.5
    anyp, anyu = np.zeros(n, bool), np.zeros(m, bool)
    for k in range(xp.shape[1]):
        anyp |= xp[:, k] > 0
        anyu |= xu[:, k] > 0
        p, u = anyp.mean(), anyu.mean()
        if anyp.sum() >= max(3, 0.1 * n):
            least = min(least, (u + np.sqrt(u * (1 - u) / m) + 1 / m) / p)
    return float(max(least, 1 / (m + 1)))


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, prior: float | None = None, most: int = 3000) -> Model:
    """A model fitted to bounded samples of confirmed toxic rows and of all rows, whatever the size of the tables.

    sample: about how many of each at most: toxic rows by a hash of their ids, unlabelled ones by
    a hash of id and text; the unlabelled ones are of all documents, and no label of theirs is
    used. prior: the share of toxic texts among all documents; estimated if not given. most: how
    many features, each in three toxic texts or more. An id with a toxic and another label is
    toxic; null ids and null labels say nothing; of documents that share a toxic id all are
    positives. Without positives, or documents, the model rejects nothing.
    """
    prepare(docs.sparkSession)
    known = columns(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic > 0").select("id").distinct()
    nothing = Model(np.zeros(0, np.uint32), np.zeros(0), -1.0)
    toxic, total = known.count(), docs.count()
    if not toxic or not total:
        return nothing
    # about ``sample`` ids: the broadcast is bounded by the parameter
    positives = hashed_share(known, toxic, sample, "id", salt=1).withColumn("p", F.lit(True))
    texts = columns(docs, "doc_id", "text").filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    share = int((1 << 31) * min(1.0, sample / total))
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(2)), F.lit(1 << 31)) < F.lit(share)
    rows = texts.join(F.broadcast(positives), "id", "left").select("id", F.coalesce("p", F.lit(False)).alias("p"), drawn.alias("u"), "text")
    rows = rows.filter("p OR u").mapInArrow(_sets, "id long, p boolean, u boolean, found binary").collect()
    rows.sort(key=lambda r: (r.id is not None, r.id or 0, bytes(r.found)))
    kinds = [[np.frombuffer(r.found, np.uint32) for r in rows if r[kind]] for kind in ("p", "u")]
    if not all(kinds):
        return nothing
    ranked = screen(*kinds, most)
    if not len(ranked):
        return nothing
    vocabulary = np.sort(ranked)
    xp, xu = (presence(k, vocabulary) for k in kinds)
    if prior is None:
        at = np.searchsorted(vocabulary, ranked)
        prior = estimate_prior(xp[:, at], xu[:, at])
    return Model(vocabulary, *fit_nnpu(xp, xu, prior))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = model.score(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s > 0), pa.array(s)], names=["doc_id", "toxic", "score"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, toxic, score; toxic where the score is above 0.

    The whole text counts. Null and empty texts aren't toxic. Repeated rows and null ids are
    kept, each row with its own decision; other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(partial(_score, model=model), SCHEMA)


def _keep(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.filter(pa.array(model.score(batch.column("text")) <= 0))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't toxic, with all their columns.

    Null and empty texts stay; rows with null ids and repeated rows are each decided by their text.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, model=model), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 5000) -> DataFrame:
    """Trains on the labels, then classifies all documents."""
    return classify(docs, train(docs, labels, sample))
