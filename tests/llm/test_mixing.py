import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from helpers import SCHEMA, prose, with_clashes, words
from pyspark.sql import functions as F

from kairosdf.llm import mixing as M

WEIGHTS = {"a": 4, "b": 3, "c": 2, "d": 1}


def place(seed, epoch, doc_id):
    return int(hashlib.md5(f"{seed}:{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)


def fill(total, children):
    """Shares by weight, what full children leave over to the others: children is {key: (cap, weight)}."""
    out, open_ = {}, dict(children)
    while True:
        left, weights = total - sum(out.values()), sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if Fraction(cap, w) <= Fraction(left, weights)] if weights else []
        if not full:
            return out | {k: left * w // weights for k, (_, w) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]


def brute(rows, total, epochs, seed, weights, domain):
    docs, leaves = [], defaultdict(int)
    for i, text, lang, source, _ in rows:
        n = len(words(text))
        if n:
            leaf = (domain(source or "unknown"), lang or "unknown", source or "unknown")
            docs.append((i, leaf, n))
            leaves[leaf] += n
    cap = defaultdict(int)
    for leaf, n in leaves.items():
        for k in range(4):
            cap[leaf[:k]] += n * epochs
    budget = {(): min(total, cap[()])}
    for depth in range(3):
        for parent in [k for k in budget if len(k) == depth]:
            budget |= fill(budget[parent], {k: (c, weights(k)) for k, c in cap.items() if len(k) == depth + 1 and k[:depth] == parent})
    taken = []
    for leaf, n in leaves.items():
        whole, rest = divmod(budget.get(leaf, 0), n)
        order = sorted({(place(seed, whole, i), -1 if i is None else i) for i, at, _ in docs if at == leaf})
        size, ends = defaultdict(int), {}
        for i, at, k in docs:
            if at == leaf:
                size[(place(seed, whole, i), -1 if i is None else i)] += k
        upto = 0
        for key in order:
            upto += size[key]
            ends[key] = upto
        for i, at, _ in docs:
            if at == leaf and (e := whole + (ends[(place(seed, whole, i), -1 if i is None else i)] <= rest)):
                taken.append((str(i), at, e))
    return sorted(taken), budget


def settings(total, epochs=2):
    letter = F.translate(F.substring(F.md5("source"), 1, 1), "0123456789abcdef", "aaaabbbbccccdddd")
    return {
        "total_tokens": total, "domain": letter, "max_epochs": epochs, "seed": 3,
        "weights": {"domain": F.expr("case domain when 'a' then 4 when 'b' then 3 when 'c' then 2 else 1 end"), "lang": F.expr("case lang when 'en' then 5 else 2 end"), "source": None},
    }


def weight(key):
    return WEIGHTS[key[0]] if len(key) == 1 else (5 if key[1] == "en" else 2) if len(key) == 2 else 1


def letter(source):
    return "aaaabbbbccccdddd"[int(hashlib.md5(source.encode()).hexdigest()[0], 16)]


def corpus(spark, odd=()):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 5, 50, 200])), rng.choice(["en", "de", "fr", None]), rng.choice(["hot", "hot", *(f"s{k}" for k in range(9)), None]), 0) for i in range(500)]
    rows += [rows[7], (None, "no id here", "en", "hot", 0), (900, None, "en", "hot", 0), (901, "", "en", "hot", 0), *odd]
    return rows, with_clashes(spark.createDataFrame(rows, SCHEMA)).persist()


def test_budgets_and_prefixes(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGES", 16)
    rows, df = corpus(spark)
    every = sum(len(words(r[1])) for r in rows)
    for total in (0, 1, every // 10, every, every * 3 // 2, every * 9):
        want, budget = brute(rows, total, 2, 3, weight, letter)
        got = M.select_mix(df, **settings(total)).collect()
        assert sorted((str(r.doc_id), (r.domain, r.lang, r.source), r.epochs) for r in got) == want
        assert sum(r.epochs * r.n_tokens for r in got) <= min(total, 2 * every)


def test_shortages_stay_among_siblings():
    budget = fill(100, {"small": (10, 1), "large": (1000, 1), "other": (1000, 2)})
    assert budget == {"small": 10, "large": 30, "other": 60}


def test_rows_come_along(spark):
    rows, df = corpus(spark)
    how = settings(4000)
    mixed = M.mix_documents(df, **how)
    assert mixed.columns == df.columns
    counts = {str(r.doc_id): r.epochs for r in M.select_mix(df, **how).collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        got[str(r.doc_id)] += 1
    assert {k: v for k, v in got.items() if k != "7"} == {k: v for k, v in counts.items() if k != "7"}


def test_odd_rows(odd_docs, no_docs):
    how = settings(10**9)
    got = M.select_mix(odd_docs, **how).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd_docs.collect() if words(r.text)} and all(r.epochs == 2 for r in got)
    assert M.select_mix(no_docs, **how).collect() == [] and M.mix_documents(no_docs, **how).collect() == []
