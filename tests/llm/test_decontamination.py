import random

from helpers import SCHEMA, prose, words, with_clashes

from kairosdf.llm import decontaminate as D


def overlaps(doc, item):
    """By definition: on some alignment a stretch of 13 words, or of the whole item if it is shorter, with at most
    one word in five substituted, which begins and ends with a match or where the item does."""
    need = min(13, len(item))
    for shift in range(-len(item), len(doc)):
        match = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)]
        first, last = max(0, -shift), min(len(item), len(doc) - shift)
        for a in range(first, last):
            for b in range(a + need, last + 1):
                edges = (match[a] or a == 0) and (match[b - 1] or b == len(item))
                if edges and 5 * (b - a - sum(match[a:b])) <= b - a:
                    return True
    return False


def corpus(spark):
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(14, 50))) for k in range(8)] + [(8, prose(rng, 6)), (9, None), (10, ""), (None, prose(rng, 20)), (11, "Only")]
    rows, want = [], set()
    for i in range(80):
        text = prose(rng, rng.randint(20, 120)).split()
        kind, (k, item) = i % 5, items[i % 9]
        own = item.split()
        if kind == 1:
            own = [w.upper() for w in own]
        if kind == 2 and len(own) > 20:
            for at in range(3, len(own), 9):  # one word in nine is another
                own[at] = "zzzz"
        if kind == 3:
            own = own[: max(1, len(own) // 4)] if len(own) > 30 else []
        if kind == 4:
            own = []
        at = rng.randrange(len(text))
        text[at:at] = own
        if kind in (0, 1, 2):
            want.add((i, k))
        rows.append((i, " \n".join(text), "en", "s", 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), want


def test_planted_passages(spark):
    docs, items, want = corpus(spark)
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    known = {r.item_id: words(r.text) for r in items.collect() if r.item_id is not None}
    rows = D.contaminations(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert want <= got and got == {(i, k) for i, d in texts.items() for k, t in known.items() if t and overlaps(d, t)}
    for r in rows:
        a, b = texts[r.doc_id][r.doc_word : r.doc_word + r.n_words], known[r.item_id][r.item_word : r.item_word + r.n_words]
        assert len(a) == r.n_words and sum(x == y for x, y in zip(a, b, strict=True)) == r.n_matches >= 0.8 * r.n_words
    left = D.drop_contaminated(docs, items)
    assert {r.doc_id for r in left.collect()} == set(texts) - {i for i, _ in got} and left.columns == docs.columns


def test_odd_rows(odd_docs, no_docs, spark):
    items = with_clashes(spark.createDataFrame([(1, "The same row twice. " * 4), (2, None), (3, "")], "item_id long, text string"))
    got = D.contaminations(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1004, 1)} and len(got) == 1
    left = D.drop_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 2
    assert D.contaminations(no_docs, items).collect() == [] and D.contaminations(odd_docs, items.where("false")).collect() == []
    assert D.drop_contaminated(odd_docs, items.where("false")).count() == odd_docs.count()


def hit(item, doc, shift=0):
    import numpy as np

    return shift in D.alignments(np.array(doc, np.uint64), np.array(item, np.uint64), D.MIN_OVERLAP)


def test_masks_miss_no_short_item():
    """All substitutions that an item of up to 13 words may have."""
    from itertools import combinations

    for n in range(1, 14):
        item = list(range(100, 100 + n))
        for k in range(n // 5 + 1):
            for gone in combinations(range(n), k):
                assert hit(item, [9, *[7 if i in gone else w for i, w in enumerate(item)], 8], 1)


def test_recall_of_the_masks_on_longer_items():
    rng = random.Random(3)
    missed = 0
    for trial in range(2000):
        n = rng.randint(14, 60)
        item = list(range(100, 100 + n))
        gone = set(rng.sample(range(n), n // 5))
        missed += not hit(item, [7 if i in gone else w for i, w in enumerate(item)])
    assert missed <= 4  # 0.998


def test_repeated_windows(spark):
    """One word 20,000 times against an item of the same word: one row, as any alignment is as good."""
    docs = spark.createDataFrame([(1, "so " * 20_000, "en", "s", 0), (2, "so " * 12, "en", "s", 0)], SCHEMA)
    items = spark.createDataFrame([(1, "so " * 40), (2, "so " * 5)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_word, r.n_words) for r in D.contaminations(docs, items).collect()}
    assert got == {(1, 1): (0, 40), (1, 2): (0, 5), (2, 2): (0, 5)}


def test_items_with_one_id(spark):
    rng = random.Random(4)
    a, b = prose(rng, 20), prose(rng, 20)
    docs = spark.createDataFrame([(None, f"x {a} y {b}", "en", "s", 0), (None, f"{b} z", "en", "s", 0)], SCHEMA)
    got = D.contaminations(docs, spark.createDataFrame([(1, a), (1, b)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_word) for r in got if True) == [(None, 1, 0), (None, 1, 1), (None, 1, 22)]


def test_substitutions_at_every_position():
    """Whole items of 13 to 22 words, verified along their alignment, with as many substitutions as one in five allows."""
    from itertools import combinations

    import numpy as np

    for n in range(13, 23):
        for k in range(1, 4):
            for gone in combinations(range(n), k):
                match = np.ones(n, bool)
                match[list(gone)] = False
                start, end, matches = D.longest_stretch(match)
                assert 5 * (end - start - matches) <= end - start and matches == match[start:end].sum()
                assert end - start >= D.MIN_OVERLAP or 5 * k > n
    inside = np.array([0] * 2 + [1] * 12 + [0] * 2, bool)
    assert D.longest_stretch(inside, False, False) == (2, 14, 12)
    assert D.longest_stretch(np.array([], bool)) == (0, 0, 0) and D.longest_stretch(np.array([0, 0], bool)) == (0, 0, 0)


def test_one_substitution_in_the_middle_of_a_short_item(spark):
    item = [f"w{k}" for k in range(16)]
    rows = [(at, " ".join(["a", "b", *item[:at], "other", *item[at + 1 :], "c"]), "en", "s", 0) for at in range(16)]
    got = {r.doc_id for r in D.contaminations(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == set(range(16))
