"""Packing by power-of-two decomposition.

Each document's tokens (and an end token) are cut into pieces whose lengths are the binary
digits of the token count, longest first; what exceeds ``max_len`` comes in pieces of
``max_len``. Pieces of equal length share a bucket, so a batch is drawn from one bucket and no
sequence ever crosses documents or needs padding. Nothing is shuffled: each row is cut where it
lies, and the bucket is a column to partition the written table by.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, prepare
from .text import CHUNK_BYTES, slices

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it. A longer run than this would exhaust the matcher's stack.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
SCHEMA = "doc_id long, piece int, start long, length int, bucket int, tokens array<int>"


class Tokenizer:
    """A byte-level vocabulary, from the contents of a file of ranks; ``end`` is the id after the last, the end of a document."""

    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

    def tokens(self, text: str) -> list[int]:
        """As the pattern cuts the text; very long runs of white space are cut out first, as it would cut them.

        A run is one piece but for its last character, which belongs to what follows it.
        """
        out: list[int] = []
        at = 0
        for m in LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            # the text before the run ends in other characters, so its last piece doesn't reach into the run
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, each with its end token, in one array, and where each text starts."""
        each = [self.tokens(x) for x in texts]
        for x in each:
            x.append(self.end)
        off = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(each), np.int32, off[-1]), off


tokenizer = lru_cache(maxsize=2)(Tokenizer)


def decompose(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens; max_len is a power of two."""
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if n % max_len >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], vocab: Broadcast, max_len: int) -> Iterator[pa.RecordBatch]:
    encode = tokenizer(vocab.value)
    for batch in slices(batches, most=4 * CHUNK_BYTES):
        batch = batch.filter(pc.is_valid(batch.column("text")))
        if not batch.num_rows:
            continue
        flat, off = encode.encode(batch.column("text").to_pylist())
        cuts = [decompose(n, max_len) for n in np.diff(off).tolist()]
        number = np.array([len(x) for x in cuts])
        ids = pc.take(batch.column("doc_id"), pa.array(np.repeat(np.arange(len(cuts)), number)))
        lengths = list(chain.from_iterable(cuts))
        pieces = np.arange(len(lengths)) - np.repeat(np.cumsum(number) - number, number)
        size = np.array(lengths, np.int32)
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        start = off[:-1] - np.repeat((off[:-1])[np.cumsum(number) - number], number)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(pieces.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(size), pa.array(np.log2(size).astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
            names=["doc_id", "piece", "start", "length", "bucket", "tokens"],
        )


def pack(docs: DataFrame, vocab: str = VOCAB, max_len: int = 4096) -> DataFrame:
    """One row a piece: doc_id, piece (from 0), start (token), length = 2**bucket, bucket, tokens.

    vocab: a file that the driver reads; its contents, of a megabyte or so, go to the tasks.
    The pieces of a document, in order, are its tokens and the end token. A null text has no
    pieces; an empty one has the end token alone; a null doc_id is kept. Rows that repeat are
    packed each. An empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    prepare(docs.sparkSession)
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocab).read_bytes())
    return docs.mapInArrow(partial(_pack, vocab=shared, max_len=max_len), SCHEMA)
