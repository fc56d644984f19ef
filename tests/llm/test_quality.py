import random
import zlib

import numpy as np
from helpers import SCHEMA, prose, rule_counts, with_clashes

from kairosdf.llm import pu_classifier as P
from kairosdf.llm import quality_rules as Q


def corpus(spark, n=1500, seed=3):
    """Prose, and one in five rows junk; all are labelled."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(60, 200)).replace(" e", ". E")
        if not good:
            text = " ".join(w + rng.choice(["%%%", "&&&", "###"]) for w in text.split()) if rng.random() < 0.5 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules(spark):
    docs, labels = corpus(spark)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    got = Q.quality_rules(docs, labels, trees=60).collect()
    assert len(got) == len(text)
    for r in got:
        want = rule_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    good = [r.kept for r in got if quality[r.doc_id]]
    bad = [r.kept for r in got if not quality[r.doc_id]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_rules_on_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1000, 0), (None, 0), (2, None)], "doc_id long, quality int")
    rows = Q.quality_rules(odd_docs, labels, trees=10).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.n_words == rule_counts(texts[r.doc_id])[0] for r in rows if r.doc_id is not None)
    assert Q.quality_rules(no_docs, labels).collect() == []
    none = labels.where("false")
    assert all(r.kept or r.base_failed for r in Q.quality_rules(odd_docs, none, trees=5).collect())


def test_isolated_points_score_higher():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 3))
    forest = Q.IsolationForest(rows, trees=100)
    assert forest.score(np.full((1, 3), 6.0))[0] > np.quantile(forest.score(rows), 0.999)
    assert (Q.IsolationForest(np.zeros((5, 3))).score(np.zeros((2, 3))) <= 1).all()


def test_threshold():
    good, bad = np.zeros(100), np.zeros(100)
    good[:40], bad[60:] = 1, 1
    assert 0.4 <= Q.best_threshold(good, bad, 3.0) <= 0.6
    assert Q.best_threshold(good, np.zeros(100), 3.0) == 1.0


def test_classifier(spark):
    docs, labels = corpus(spark, 2500)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = P.quality_classifier(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = [r.score for r in held if quality[r.doc_id]], [r.score for r in held if not quality[r.doc_id]]
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean(np.array(good) >= 0.3) > 0.98 and np.mean(np.array(bad) < 0.3) > 0.8


def test_held_out_labels_and_negatives_are_not_used(spark):
    docs, labels = corpus(spark, 600)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 or quality = 0 then null else quality end as quality")
    a, b = (sorted((r.doc_id, r.score) for r in P.quality_classifier(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_prior_estimate():
    rng = np.random.default_rng(2)
    p = rng.normal(2, 1, 4000)
    u = np.where(rng.random(8000) < 0.7, rng.normal(2, 1, 8000), rng.normal(-3, 1, 8000))
    assert abs(P.estimate_prior(p, u) - 0.7) < 0.05


def test_classifier_on_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = P.quality_classifier(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score is not None for r in rows)
    assert {r.score for r in P.quality_classifier(odd_docs, labels.where("false")).collect()} == {0.5}
    assert P.quality_classifier(no_docs, labels).collect() == []
    kept = P.keep_quality(odd_docs, labels)
    assert kept.columns == odd_docs.columns and P.keep_quality(no_docs, labels).count() == 0
    assert P.keep_quality(odd_docs, labels.where("false")).count() == odd_docs.count()


def test_scores_do_not_see_other_columns(spark):
    docs, labels = corpus(spark, 400)
    a = sorted((r.doc_id, r.score) for r in P.quality_classifier(docs, labels).collect())
    b = sorted((r.doc_id, r.score) for r in P.quality_classifier(with_clashes(docs).selectExpr("*").drop("lang", "source"), labels).collect())
    assert a == b
