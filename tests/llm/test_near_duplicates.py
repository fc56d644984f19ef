import random

import numpy as np
from helpers import SCHEMA, components, prose, shingles, with_clashes

from kairosdf.llm.minhash import _parities, circulant_minhash, keep_first_of_group, near_duplicates


def linked(a, b):
    n = len(a & b)
    return bool(a) and bool(b) and 100 * n >= 85 * (len(a) + len(b) - n)


def check(df):
    rows = df.collect()
    docs = {}
    for r in rows:
        if r.doc_id is not None:
            docs.setdefault(r.doc_id, []).append(shingles(r.text))
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(linked(x, y) for x in docs[a] for y in docs[b])]
    want = components(ids, links)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles in map(len, docs[r.doc_id])
    return want


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "".join(rng.choice("pqrst") for _ in range(5))
    return " ".join(w)


def test_groups_and_chains(spark):
    rng = random.Random(8)
    rows = []
    for base in range(6):
        text = prose(rng, 200)
        for k in range(12):
            rows.append((len(rows), text, "en", "s", 0))
            text = edited(rng, text, k % 4)
    rows += [(len(rows) + k, prose(rng, 5) + " " + "a shared passage of some words " * 3, "en", "s", 0) for k in range(30)]
    rng.shuffle(rows)
    want = check(spark.createDataFrame(rows, SCHEMA))
    assert 10 < len(set(want.values())) < len(want)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert near_duplicates(no_docs).collect() == []


def test_filter_keeps_columns(odd_docs):
    kept = keep_first_of_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert not set(range(100, 104)) & set(ids) and set(range(4)) <= set(ids) and ids.count(1004) == 2


def test_estimates(spark):
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    flat, offsets = np.concatenate((np.unique(a), np.unique(b))), np.array([0, 2000, 4000])
    signature = circulant_minhash(flat, offsets, 512)
    assert abs((signature[0] == signature[1]).mean() - 1 / 3) < 0.08
    differ = sum(bin(int(x)).count("1") for x in np.bitwise_xor(*_parities(flat, offsets)))
    assert differ <= 2000


def test_repeated_id_joins_its_texts(spark):
    rng = random.Random(10)
    a, b = prose(rng, 50), prose(rng, 50)
    df = with_clashes(spark.createDataFrame([(5, a, "en", "s", 0), (5, b, "en", "s", 0), (3, a, "en", "s", 0), (9, b, "en", "s", 0)], SCHEMA))
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(5, 3), (3, 3), (9, 3)}
