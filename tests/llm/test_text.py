import random

import numpy as np
import pyarrow as pa
from helpers import prose, rule_counts, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st

from kairosdf.llm import text as T
from kairosdf.llm.features import count_statistics, rates

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1f|漢.", max_size=60)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 80))
def test_words_and_hashes(texts, most):
    by_word, seen = {}, 0
    for s in T.slices(pa.array(texts, pa.string()), most):
        h = s.hashes()
        for d in range(len(s)):
            own = words(texts[s.first + d])
            got = h[s.words[d] : s.words[d + 1]]
            assert len(got) == len(own)
            for w, x in zip(own, got, strict=True):
                assert by_word.setdefault(w, x) == x
            seen += 1
    assert seen == len(texts) and len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_rule_counts(texts):
    got = [tuple(r[:5]) for s in T.slices(pa.array(texts, pa.string())) for r in count_statistics(s)]
    assert got == [rule_counts(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    for s in T.slices(pa.array(texts, pa.string())):
        _, offsets = T.shingle_sets(s, 5)
        assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts[s.first : s.first + len(s)]]


def test_words_across_hash_periods(monkeypatch):
    text = prose(random.Random(2), 3000)
    whole = next(T.slices(pa.array([text]))).hashes()
    monkeypatch.setattr(T, "_PERIOD", 16)
    T._tables.clear()
    assert (next(T.slices(pa.array([text]))).hashes() == whole).all()
    T._tables.clear()


def test_sliced_arrays_and_rates():
    a = pa.array(["one", None, "two words", "three"], pa.string()).slice(1, 3)
    assert [s.counts().tolist() for s in T.slices(a)] == [[0, 2, 1]]
    assert np.isfinite(rates(np.concatenate([count_statistics(s) for s in T.slices(a)]))).all()
    assert list(T.slices(pa.array([], pa.string()))) == []
