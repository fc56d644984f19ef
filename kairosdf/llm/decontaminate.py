"""Benchmark decontamination by spaced-seed hashing.

A window of min_overlap words is cut into groups by its places modulo G; a mask
counts the places of three groups and ignores the others.  With all choices of
three of G groups as masks, G - 3 substitutions spoil at most as many groups,
so some mask still hits, wherever they are.  G - 3 is one more than the
substitutions that min_overlap words may have (one in five), so a longer stretch
is missed only if four or more of its substitutions crowd into every one of its windows.
Items shorter than a window are windows of their own length, under masks for
the substitutions that they may have, which miss nothing.

Every window of every benchmark item is hashed under each mask, and so is every
window of every training text; equal hashes join into (document, item)
candidates.  Their common windows give the alignments, along which the longest
stretch with at most one word in five substituted must be long enough.

Training windows that no benchmark window can equal are dropped before the
join by a bitmap of the benchmark hashes, of a fixed size whatever the
benchmark's; it only lets more through as the benchmark grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, contains, possible
from .store import Work
from .text import as_long, mix64, slices

MIN_OVERLAP = 13
PENALTY = 4
KEPT = 3


def _weights(n: int) -> np.ndarray:
    return mix64(np.arange(901, 901 + n, dtype=np.uint64)) | np.uint64(1)


def n_groups(n: int, min_overlap: int) -> int:
    """Groups that the places of a window of n words fall into: three more than substitutions to survive."""
    return KEPT + n // (PENALTY + 1) + (n == min_overlap)


def window_hashes(h: np.ndarray, n: int, groups: int) -> Iterator[np.ndarray]:
    """For each mask, the hash of the window of n words that begins at each word."""
    m = len(h) - n + 1
    if m <= 0:
        return
    weights = _weights(n)
    sums = np.zeros((groups, m), np.uint64)
    for i in range(n):
        sums[i % groups] += h[i : i + m] * weights[i]
    for k, mask in enumerate(combinations(range(groups), KEPT)):
        yield mix64(sum(sums[g] for g in mask[1:]) + sums[mask[0]] + np.uint64((n << 16) + k + 1))


def _item_windows(min_overlap: int):
    """A mapInArrow function: (item_id, hash), each once, of the windows of whole benchmark texts; a short text is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                h = s.hashes()
                item, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for d in range(len(s)):
                    own = h[s.words[d] : s.words[d + 1]]
                    n = min(len(own), min_overlap)
                    found = [x for x in window_hashes(own, n, n_groups(n, min_overlap))] if n else []
                    if found:
                        value.append(np.unique(np.concatenate(found)))
                        item.append(np.full(len(value[-1]), d))
                ids = batch.column(0).slice(s.first, len(s)).take(pa.array(np.concatenate(item)))
                yield pa.RecordBatch.from_arrays([ids, as_long(np.concatenate(value))], names=["item_id", "hash"])

    return run


def _hits(bits, lengths: list[int], min_overlap: int):
    """A mapInArrow function: (doc_id, rid, hash), each once a document, of the windows in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2)):
                h = s.hashes()
                doc, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for n in lengths:
                    for x in window_hashes(h, n, n_groups(n, min_overlap)):
                        at = np.flatnonzero(contains(bits.value, x))
                        d = np.searchsorted(s.words, at, "right") - 1
                        own = at + n <= s.words[d + 1]  # not across documents
                        doc.append(d[own]), value.append(x[at[own]])
                doc, value = np.concatenate(doc), np.concatenate(value)
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                own = [batch.column(k).slice(s.first, len(s)).take(pa.array(doc[new])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, as_long(value[new])], names=["doc_id", "rid", "hash"])

    return run


def alignments(doc: np.ndarray, item: np.ndarray, min_overlap: int) -> np.ndarray:
    """The shifts, ascending, at which some window of the item equals one of the document under a mask."""
    n = min(len(item), min_overlap)
    if not n:
        return np.empty(0, np.int64)
    shifts = [np.empty(0, np.int64)]
    groups = n_groups(n, min_overlap)
    for x, y in zip(window_hashes(doc, n, groups), window_hashes(item, n, groups), strict=False):
        order = np.argsort(y, kind="stable")
        lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        # places of the document whose window occurs k times in the item, for each k in turn
        for k in range(int((hi - lo).max(initial=0))):
            at = np.flatnonzero(hi - lo > k)
            shifts.append(np.unique(at - order[lo[at] + k]))
    return np.unique(np.concatenate(shifts))


def longest_stretch(match: np.ndarray, from_start: bool = True, to_end: bool = True) -> tuple[int, int, int]:
    """(start, end, matches) of the longest stretch in which at most one word in PENALTY + 1 is
    substituted, the first of equals.  It begins and ends with a match, or where the item does
    (from_start, to_end tell whether match reaches there): words beside a copied passage don't lengthen it."""
    n = len(match)
    total = np.concatenate(([0], np.cumsum(np.where(match, 1, -PENALTY))))
    begins, ends = np.append(match, False), np.append(False, match)
    if n:
        begins[0] |= from_start
        ends[n] |= to_end
    place = np.arange(n + 1)
    # the first place to begin from which the sum up to each end isn't negative
    low = np.minimum.accumulate(np.where(begins, total, np.iinfo(np.int64).max))
    start = np.where(ends, np.minimum(np.searchsorted(-low, -total), place), place)
    end = int(np.argmax(place - start))
    start = int(start[end])
    return start, end, int(match[start:end].sum())


def _word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    for s in slices(column):
        h = s.hashes()
        for d in range(len(s)):
            yield h[s.words[d] : s.words[d + 1]]


def _verify(min_overlap: int):
    """A mapInArrow function over (doc_id, rid, text, item_id, item)."""
    names = ["doc_id", "rid", "item_id", "doc_word", "item_word", "n_words", "n_matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)
            for (doc_id, rid, item_id), doc, item in zip(ids, _word_hashes(batch.column(2)), _word_hashes(batch.column(4)), strict=True):
                best = None
                for shift in alignments(doc, item, min_overlap).tolist():
                    first, last = max(0, -shift), min(len(item), len(doc) - shift)
                    start, end, n = longest_stretch(item[first:last] == doc[first + shift : last + shift], first == 0, last == len(item))
                    if end - start >= min(min_overlap, len(item)) and (best is None or n > best[-1]):
                        best = (doc_id, rid, item_id, first + shift + start, first + start, end - start, n)
                if best:
                    rows.append(best)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, rid (tells rows
    that share an id apart), where the longest stretch begins in each, its words, its matches.

    A stretch must have min_overlap words, or the item's all if it has fewer;
    at most one word in five of it is substituted, and it begins and ends with
    a word that matches or where the item does.  Of stretches with as many
    matches the one that begins first in the document, counted from the item's
    beginning, is returned.  Case of A-Z and white
    space don't matter.  Null and wordless texts overlap with nothing; rows
    without an id are searched and returned with a null doc_id, items without
    one are left out.  Repeated rows give one row, items of one id and several
    texts a row for each text that overlaps.  Texts of any length are searched whole.  An
    empty table on either side gives an empty result.  Only the named columns are read.
    """
    spark = docs.sparkSession
    work = Work(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item_id is not null")
    windows = work.table("windows", items.mapInArrow(_item_windows(min_overlap), "item_id long, hash long").distinct())
    bits = spark.sparkContext.broadcast(bitmap(windows.select("hash")))  # 4 MB, whatever the tables
    n = F.least(F.size(F.filter(F.split("item", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(min_overlap))
    lengths = sorted(r.n for r in items.select(n.alias("n")).where("n > 0").distinct().collect())  # min_overlap at most
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    hits = base.mapInArrow(_hits(bits, lengths, min_overlap), "doc_id long, rid long, hash long")
    found = work.table("candidates", hits.join(windows, "hash").select("doc_id", "rid", "item_id").distinct())
    work.drop("windows")
    some = possible(base, [F.col("doc_id"), F.col("rid")], found.select("doc_id", "rid"))
    same = some["doc_id"].eqNullSafe(F.col("c_id")) & (some["rid"] == F.col("c_rid"))
    pairs = some.join(found.select(F.col("doc_id").alias("c_id"), F.col("rid").alias("c_rid"), "item_id"), same)
    pairs = pairs.join(items, "item_id").select("doc_id", "rid", "text", "item_id", "item")
    out = pairs.mapInArrow(_verify(min_overlap), "doc_id long, rid long, item_id long, doc_word long, item_word long, n_words long, n_matches long")
    return work.table("found", out.distinct())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that overlap with no benchmark item.

    Null and wordless texts stay, rows without an id are judged like others;
    an empty benchmark removes nothing, an empty table gives an empty one.
    """
    found = contaminations(docs, benchmark).select(F.col("doc_id").alias("c_id"), F.col("rid").alias("c_rid")).distinct()
    # same columns as docs even where those have these names: an anti join returns its left side only
    left = docs.alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("found.c_id")) & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("found.c_rid"))
    return left.join(found.alias("found"), same, "left_anti")
