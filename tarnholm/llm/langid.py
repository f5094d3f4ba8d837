"""Language identification by a byte convolutional network.

Filters of several widths slide over one-hot bytes of fixed-length windows, each filter's
maximum over the window goes through a softmax layer, and a text's windows are averaged. The
network is trained in numpy on labelled texts; for inference the filters become lookup tables
over byte pairs, so a window costs a few table rows per byte. Every window of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, prepare
from .text import raw, slices

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
#: of each language about so many texts are in the sample, if it has them
LEAST = 40
SCHEMA = "doc_id long, language string, confidence double, windows int"


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text cut into windows, the last filled up with zero bytes; and each window's text."""
    sizes = np.diff(off)
    number = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), number)
    at = off[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number))
    if not len(owner):
        return np.zeros((0, WINDOW), np.uint8), owner
    index = at[:, None] + np.arange(WINDOW)
    inside = index < off[owner + 1][:, None]
    return np.where(inside, data[np.minimum(index, len(data) - 1)], 0).astype(np.uint8), owner


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = [rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def features(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Maximum of each filter over each window; tables: by width, for bytes and byte pairs."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        two, three, third, front, back = tables
        n = x.shape[1]
        z2 = two[pairs]
        z3 = three[pairs[:, : n - 2]] + third[x[:, 2:]]
        z4 = front[pairs[:, : n - 3]] + back[pairs[:, 2:]]
        return np.concatenate([np.maximum(z.max(axis=1), 0) for z in (z2, z3, z4)], axis=1)

    def tables(self) -> list[np.ndarray]:
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        f2, f3, f4 = self.filters
        return [pair(f2[0] + self.bias[0], f2[1]), pair(f3[0] + self.bias[1], f3[1]), f3[2], pair(f4[0] + self.bias[2], f4[1]), pair(f4[2], f4[3])]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 0) -> ByteNet:
        """Adam on the cross entropy; the gradient of a maximum goes to where it was taken."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                rows, pooled, where = np.arange(len(xb)), [], []
                for f, b in zip(self.filters, self.bias):
                    w, n = len(f), WINDOW - len(f) + 1
                    z = sum(f[j][xb[:, j : j + n]] for j in range(w)) + b
                    best = z.argmax(axis=1)
                    where.append(best)
                    pooled.append(np.maximum(np.take_along_axis(z, best[:, None], axis=1)[:, 0], 0))
                h = np.concatenate(pooled, axis=1)
                d = self.probabilities(h)
                d[rows, yb] -= 1
                d /= len(xb)
                grads = [np.zeros_like(p) for p in params]
                grads[-2], grads[-1] = h.T @ d, d.sum(axis=0)
                dh = (d @ self.out.T) * (h > 0)
                for k, f in enumerate(self.filters):
                    g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(f)):
                        np.add.at(grads[k][j], (xb[rows[:, None], where[k] + j], np.arange(FILTERS)), g)
                    grads[len(WIDTHS) + k] = g.sum(axis=0)
                step += 1
                for p, g, a, c in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    p -= (rate / (1 - 0.9**step)) * a / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, arr: pa.Array, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of each text's windows, and their number."""
        data, off = raw(arr, lower=False)
        x, owner = windows(data, off)
        total = np.zeros((len(off) - 1, len(self.classes)))
        for i in range(0, len(x), 1024):
            np.add.at(total, owner[i : i + 1024], self.probabilities(self.features(x[i : i + 1024], tables)))
        number = np.bincount(owner, minlength=len(off) - 1)
        return total / np.maximum(number, 1)[:, None], number


def train(docs: DataFrame, sample: int = 3000, seed: int = 0, each: int = 8) -> ByteNet | None:
    """A network fitted to a bounded sample of the labelled texts; None if there are none.

    sample: about how many texts, chosen by a hash of id and text, whatever the size of the table;
    of a language that would have under LEAST of these, about LEAST, or all it has. each: how many
    windows of a sampled text at most, drawn from all of it (identify reads all windows).
    """
    spark = docs.sparkSession
    labelled = columns(docs, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text <> ''")
    counts = labelled.groupBy("lang").count().collect()
    total = sum(r["count"] for r in counts)
    if total > sample:
        share = [(r.lang, int((1 << 31) * min(1.0, max(sample / total, LEAST / r["count"])))) for r in counts]
        limits = F.broadcast(spark.createDataFrame(share, "lang string, _limit long"))
        labelled = labelled.join(limits, "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) < F.col("_limit"))
    rows = labelled.select("doc_id", "lang", "text").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.lang, r.text))
    classes = sorted({r.lang for r in rows})
    x, owner = windows(*raw(pa.array([r.text for r in rows]), lower=False))
    # as many windows of each text at most, drawn from all of it, so that no text dominates
    order = np.lexsort((np.random.default_rng(seed).random(len(owner)), owner))
    chosen = np.sort(order[np.arange(len(owner)) - np.searchsorted(owner, owner) < each])
    x, owner = x[chosen], owner[chosen]
    y = np.array([classes.index(r.lang) for r in rows])[owner]
    return ByteNet(classes, seed).fit(x, y, seed=seed)


def _identify(batches: Iterator[pa.RecordBatch], net: ByteNet | None) -> Iterator[pa.RecordBatch]:
    tables = net.tables() if net else None
    for batch in slices(batches):
        if net:
            p, number = net.predict(batch.column("text"), tables)
            best = p.argmax(axis=1)
            names = [net.classes[b] if n else None for b, n in zip(best, number)]
            sure = p[np.arange(len(p)), best]
        else:
            names, sure, number = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure), pa.array(number.astype(np.int32))], names=["doc_id", "language", "confidence", "windows"])


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """One row a document: doc_id, language, confidence (mean probability), windows.

    Null and empty texts have a null language, confidence 0 and 0 windows; so has every text if
    there was nothing to train on. Whole texts are read. Rows that repeat and null ids are kept;
    ties between languages go to the first in alphabetical order; other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(partial(_identify, net=net), SCHEMA)


def language_id(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Trains on the labelled texts of the table, then identifies all of them."""
    prepare(docs.sparkSession)
    return identify(docs, train(docs, sample))
