"""Small tables with every odd case, and brute-force versions of what operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns with names that operators use themselves
CLASHES = ["kept", "score", "component_id", "bucket", "id", "row", "hash", "removed", "epochs", "set", "rid", "gone", "c_id", "label", "rates", "domain"]


def words(text, fold=True):
    text = text or ""
    return WORD.findall(text.translate(LOW) if fold else text)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(rng):
    """Null, empty, blank and very long texts, a null id, repeated rows, null columns."""
    long = prose(rng, 60_000)
    return [
        (1000, None, "en", "src0", 0), (1001, "", "en", "src0", 0), (1002, " \n\t \r\n", None, None, 3), (1003, long, "en", "src1", len(long)),
        (None, prose(rng, 80), "de", "src2", 1), (None, None, None, None, None), (1004, "The same row twice. " * 9, "fr", "src3", None), (1004, "The same row twice. " * 9, "fr", "src3", None),
        (1005, "é ü ñ 漢字 🙂", "es", "src4", 5), (1006, "x" * 300_000, "en", "src0", 300_000),
    ]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def rule_counts(text):
    w = words(text, fold=False)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
