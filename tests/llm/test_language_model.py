import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, words

from kairosdf.llm import brown_lm as B
from kairosdf.llm.store import Work


def grammar(spark, n=400, seed=2):
    """Nouns and verbs in turn: classes tell more than counts."""
    rng = random.Random(seed)
    nouns, verbs = [f"n{k}" for k in range(40)], [f"v{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice((nouns, verbs)[k % 2]) for k in range(rng.randint(1, 60))), "en", "s", 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def check(df, got):
    docs = df.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for r in docs if not held(r.doc_id) for w in [*words(r.text), None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    want = Counter()
    for r in docs:
        w = [*words(r.text), None]
        want[(str(r.doc_id), held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 3))] += 1
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want


@pytest.mark.parametrize("how", [{}, {"common": 30}, {"common": 0}, {"sweeps": 0}])
def test_counts_are_exact(spark, how):
    df = grammar(spark)
    check(df, B.brown_scores(df, **how).collect())


def classes_of(model):
    out = dict(zip(model.common.keys.tolist(), model.common.classes.tolist(), strict=True))
    return out | {r.key % (1 << 64): r["class"] for r in model.rare.collect()}


def key_of(word):
    import pyarrow as pa

    (s,) = B.slices(pa.array([word]))
    return int(B.word_keys(s)[0])


@pytest.mark.parametrize("how", [{}, {"common": 60}])
def test_scores_follow_the_formula(spark, how):
    """Every row's score from the words' classes alone, by the formula."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcé.") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    rows = [(i, " ".join(vocabulary[min(149, int(rng.expovariate(0.03)))] for _ in range(rng.randint(0, 30))), "en", "s", 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    work, k = Work(spark, "t"), 40
    model = B.train(df, work, learn=~B.held_out("doc_id"), classes=k, **how)
    known = classes_of(model)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {i: [*words(t), None] for i, t, *_ in rows}
    count = Counter(w for i, w_ in texts.items() if not held(i) for w in w_)
    keys = {w: key_of(w) for w_ in texts.values() for w in w_ if w is not None}
    cls = lambda w: B.END_CLASS if w is None else known.get(keys[w], keys[w] % 32 + 1)
    assert set(known) == {keys[w] for w in count if w is not None}
    pairs = np.zeros((k, k))
    for i, w_ in texts.items():
        if not held(i):
            for a, b in zip([None, *w_], w_, strict=False):
                pairs[cls(a), cls(b)] += 1
    mass = np.zeros(k)
    for w, n in count.items():
        mass[cls(w)] += n + 1
    mass[1 : B.SHAPES + 1] += 1
    n, v = sum(count.values()), len(count)
    unigram = (pairs.sum(0) + 1) * (mass > 0)
    unigram /= unigram.sum()

    def log10p(a, b):
        row = pairs[cls(a)]
        t = unigram if not row.sum() else (np.maximum(row - 0.5, 0) + (row.sum() - np.maximum(row - 0.5, 0).sum()) * unigram) / row.sum()
        return math.log10((count[b] + 1) * (0.9 * t[cls(b)] / max(mass[cls(b)], 1) + 0.1 / (n + v + B.SHAPES)))

    got = {r.doc_id: r.score for r in B.brown_scores(df, classes=k, **how).collect()}
    assert len(got) == 150
    for i, w_ in texts.items():
        assert math.isclose(got[i], sum(log10p(a, b) for a, b in zip([None, *w_], w_, strict=False)), rel_tol=1e-9)


@pytest.mark.parametrize("how", [{}, {"common": 20}])
def test_classes_beat_the_unigram_model_on_held_out_text(spark, how):
    got = B.brown_scores(grammar(spark), **how).collect()
    held = [r for r in got if r.held_out]
    base, score, n = (sum(getattr(r, c) for r in held) for c in ("base_score", "score", "n_tokens"))
    assert score - base > 0.2 * n and all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in held)


def test_probabilities_add_up_to_one(spark):
    model = B.train(grammar(spark, 60), Work(spark, "t"))
    counts, classes = model.common.counts, model.common.classes.astype(int)
    assert model.rare.count() == 0 and model.documents == 60
    for before in (B.END_CLASS, int(classes[3])):
        known = ((counts + 1) * 10 ** model.transition[before, classes]).sum() + (60 + 1) * 10 ** model.transition[before, B.END_CLASS]
        unseen = (10 ** model.transition[before, 1 : B.SHAPES + 1]).sum()  # a word of each shape
        assert abs(known + unseen - 1) < 1e-6


def likelihood(n):
    return sum(x * math.log(x) for x in n.ravel() if x > 0) - sum(x * math.log(x) for side in (0, 1) for x in n.sum(side) if x > 0)


def test_a_word_moves_to_the_likeliest_class():
    """Against the likelihood of every class in turn, for words without the own class beside them."""
    rng = np.random.default_rng(7)
    k = 6
    for _ in range(40):
        base = rng.integers(1, 60, (k, k)).astype(float)
        a = rng.integers(0, 4, 5)  # neighbours' classes: the word's is 4 or 5
        context, count = np.unique(a + k * rng.integers(0, 2, 5), return_counts=True)
        count = count * rng.integers(1, 30, len(count)).astype(float)
        was = int(rng.integers(4, 6))

        def put(c, base=base, context=context, count=count):
            n = base.copy()
            for x, m in zip(context, count, strict=True):
                n[(c, x - k) if x >= k else (x, c)] += m
            return n

        got = int(B.best_classes(put(was), np.array([was]), np.zeros(len(context), int), context, count)[0])
        scores = {c: likelihood(put(c)) for c in (4, 5)}
        free = {c: likelihood(put(c)) for c in range(1, k) if c not in set(context % k)} | scores
        assert got in set(context % k) or math.isclose(free[got], max(free.values()), rel_tol=1e-12)


def test_exchange_updates_the_counts():
    """A word beside class 1, as the words of class 2 are, leaves class 3, whose other words stand beside class 4."""
    n = np.zeros((5, 5))
    n[1, 2] = n[2, 1] = 100.0
    n[4, 3] = n[3, 4] = 100.0
    n[1, 3] = n[3, 1] = 10
    new = B.exchange(n, np.array([3]), np.array([0, 0]), np.array([1, 5 + 1]), np.array([10.0, 10.0]))
    assert new.tolist() == [2] and n[1, 2] == n[2, 1] == 110 and n[3, 1] == n[1, 3] == 0 and n[3, 4] == 100


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, B.brown_scores(odd_docs).collect())
    assert B.brown_scores(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    only = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = B.brown_scores(spark.createDataFrame([(i, "a b", "en", "s", 0) for i in only], SCHEMA)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and math.isfinite(r.score) for r in got)


def test_contexts_of_a_word_are_one_row_a_partition(spark):
    import pyarrow as pa

    column = pa.concat_arrays([B._packed(np.arange(9), np.array([0, 4, 4, 9])), B._packed(np.arange(2), np.array([0, 0, 2]))])
    for part in (column, column.slice(1, 2), column.slice(3), column.slice(5)):
        flat, offsets = B._unpacked(part, np.int64)
        assert [flat[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == [np.frombuffer(x, np.int64).tolist() for x in part.to_pylist()]

    keys = np.array([32, 64, 96], np.uint64)
    table = B.CommonWords(keys, np.array([3, 2, 1]), np.array([5, 6, 7], np.uint8))
    shared = spark.sparkContext.broadcast(table)
    ids = [[0, 1, 0], [], [2, 0, 1]]
    flat = np.array(sum(ids, []), np.int32)
    batch = pa.RecordBatch.from_arrays([B._packed(flat, np.array([0, 3, 3, 6])), B._packed(np.empty(0, np.int64), np.zeros(4, int))], names=["ids", "rare"])
    want = Counter()
    for row in ids:
        line = [0, *(int(table.classes[i]) for i in row), 0]
        for k, i in enumerate(row):
            want[i, line[k]] += 1
            want[i, 64 + line[k + 2]] += 1
    for dense in (B.DENSE, 0):
        was, B.DENSE = B.DENSE, dense
        try:
            out = pa.Table.from_batches(list(B._contexts(shared, np.arange(3, dtype=np.int32), 64)(iter([batch, batch.slice(0, 0)])))).to_pylist()
        finally:
            B.DENSE = was
        rows = [r for r in out if r["word"] >= 0]
        assert [r["word"] for r in rows] == [0, 1, 2]  # not a row for each context
        assert {(r["word"], int(c) % 128): int(c) // 128 for r in rows for c in np.frombuffer(r["cells"], np.int64)} == want
        assert sum(r["n"] for r in out if r["word"] < 0) == 9  # words and ends
