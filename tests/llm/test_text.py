import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnholm.llm import text as T

WORDS = re.compile("[a-z0-9\x80-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 éÉ.\n漢-", max_size=12)), max_size=6))
def test_words_are_those_of_the_pattern_and_equal_words_have_equal_hashes(texts):
    w = T.Words(pa.array(texts, pa.string()))
    expected = [WORDS.findall((t or "").lower()) for t in texts]
    assert w.count().tolist() == [len(x) for x in expected]
    seen = {}
    for words, a in zip(expected, w.off):
        for i, x in enumerate(words):
            assert seen.setdefault(x, w.hash[a + i]) == w.hash[a + i]
    assert len(set(seen.values())) == len(seen)
    for t, words in zip(texts, expected):
        start, end = T.word_bounds(t or "")
        assert [(t or "").encode()[a:b].decode().lower() for a, b in zip(start, end)] == words


def test_words_of_a_sliced_array_and_of_empty_ones():
    a = pa.array(["x y", "hello World", None, "z"])
    assert T.Words(a.slice(1, 2)).count().tolist() == [2, 0]
    assert (T.Words(a.slice(1, 1)).hash == T.Words(pa.array(["HELLO world"])).hash).all()
    assert T.Words(pa.array([], pa.string())).count().tolist() == []


def test_simhash_is_the_majority_of_bits_for_large_and_empty_groups():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2)
    off = np.array([0, 700, 700, 703, 2000])
    got = T.simhash(h, off)
    for g, a, b in zip(got, off, off[1:]):
        bits = [(h[a:b] >> np.uint64(k) & np.uint64(1)).sum() * 2 > b - a for k in range(64)]
        assert int(g) == sum(1 << k for k, x in enumerate(bits) if x)


def test_slices_are_bounded_by_bytes_and_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 1, 1, 1, 200, 0)]})
    parts = list(T.slices([b], most=20))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 5], ["a" * 50], ["a"] * 3, ["a" * 200], [""]]
