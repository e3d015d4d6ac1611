import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from windrift.llm.quality import suffix_repeats
from windrift.llm.recompression import Repeats, anchors
from windrift.llm.suffixes import Passages, minimisers
from windrift.llm.tallies import counts_of, keys_of, rising, small
from windrift.llm.words import Runs, Words

TEXT = st.text(st.sampled_from("ab é\t\n\x0b \x1c"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = w.buf.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.bounds, w.bounds[1:], strict=False)]
    assert got == want
    flat = [x for t in want for x in t]
    assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_sliced_columns_count_from_their_own_start():
    column = pa.array(["x y", "a b c", None, "d"]).slice(1, 2)
    assert Words(column).counts.tolist() == [3, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=60))
def test_suffix_repeats_is_exact(ids):
    n = len(ids)
    got = suffix_repeats(np.array(ids, np.int64))
    common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or ids[a + k] != ids[b + k]), 0)
    for a in range(n):
        assert got[a] == max((common(a, b) for b in range(n) if b != a), default=0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=35, max_size=35), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_have_equal_anchors(window, before, after):
    texts = [" ".join(f"w{i}" for i in before + window + after), " ".join(f"w{i}" for i in after + window + before)]
    w = Words(pa.array(texts))
    fits, name, _ = anchors(w, Repeats())
    at = np.flatnonzero(fits)
    key = Runs(w.hashes).of(at, 35)
    seen: dict = {}
    for k, a in zip(key.tolist(), name[at].tolist(), strict=True):
        assert seen.setdefault(k, a) == a


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=50, max_size=80))
def test_every_window_holds_a_minimiser(ids):
    w = Words(pa.array([" ".join(f"w{i}" for i in ids)]))
    at, _ = minimisers(w, Passages())
    for i in range(len(ids) - 49):
        assert any(i <= a <= i + 25 for a in at)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=30), st.lists(st.integers(0, 2**56 - 1), max_size=30))
def test_counts_and_keys_come_back(counts, keys):
    assert counts_of(small(np.array(counts, np.int64)), len(counts)).tolist() == counts
    k = np.unique(np.array(keys, np.uint64) << np.uint64(8))[:, None]
    assert (keys_of(rising(k), 1) == k).all()
