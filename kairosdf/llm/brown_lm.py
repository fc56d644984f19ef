"""Brown class-based bigram language model.

A word's probability is that of its class after the class before, times that
of the word within its class:

    P(w | v) = (count(w) + 1) * [(1 - mix) * T(class v, class w) / M(class w) + mix / (N + V + SHAPES)]

T is the smoothed class transition, M(c) the counts plus one of class c's
words (a word never seen counts as one more of its shape); the second term is
the unigram model's and gives every pair of classes a floor.

Words start in classes by shape (length, script, last letter), the very
commonest in classes of their own.  Exchange clustering then moves every word of the training
corpus to the class with the largest likelihood: sweeps over the corpus
count which classes come before and after each word; executors move their
share of the words one small batch after the other against those counts, and
the next sweep counts anew.  The frequent words, whose counts fit a dense
table, are moved first and until the likelihood stands still, then all
others, and the frequent ones once more.  Only words never seen keep a class by shape.

Counts are exact and cover the whole training corpus.  Executors hold one thing
whose size isn't a batch's: keys, counts and classes of at most `common`
commonest words.  The others' are joined to the pairs of tokens that they are
part of, and so grow with the corpus; they move once, when the classes around
them are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Work
from .text import IS_CONT, Slice, slices

FOLDS, HELD_OUT_FOLD = 7, 2
SHAPES = 32
END_CLASS = 0
#: stands for the end of a document; no word's key, as a word's lowest bits are its shape
END = np.uint64(0)
#: cells of the dense table in which the frequent words' neighbours are counted
DENSE = 1 << 21
#: context rows handled at a time, and tokens of words that move at a time, one in so many
CHUNK, SHARE = 1 << 18, 400
_ALNUM = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)

def word_keys(s: Slice) -> np.ndarray:
    """64-bit keys of a slice's words; the lowest five bits are the word's shape."""
    h = s.hashes()
    if not len(h):
        return h
    length = s.end - s.start
    wide = np.concatenate(([0], np.cumsum(IS_CONT[s.buf], dtype=np.int64)))
    foreign = wide[s.end] > wide[s.start]
    last = ~_ALNUM[s.buf[s.end - 1]]
    size = np.searchsorted([2, 3, 4, 6, 8, 11, 15], length, "left")
    shape = (size * 4 + foreign * 2 + last).astype(np.uint64)
    key = (h & ~np.uint64(SHAPES - 1)) | shape
    key[key == END] = np.uint64(1 << 63)
    return key


def shape_class(keys: np.ndarray) -> np.ndarray:
    """Classes 1 to SHAPES by shape; END_CLASS for the end of a document."""
    return np.where(keys == END, END_CLASS, (keys & np.uint64(SHAPES - 1)).astype(np.int64) + 1)


class CommonWords:
    """The commonest words: keys in ascending order, counts and classes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray):
        self.keys, self.counts, self.classes = keys, counts, classes
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        edges = np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)[:-1] << self.shift
        self.start = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it isn't there: by its first bits, then among the few that share them."""
        part = (keys >> self.shift).astype(np.intp)
        at, stop = self.start[part], self.start[part + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < stop)
        at, stop, wanted = at[left], stop[left], keys[left]
        while len(left):
            same = self.keys[at] == wanted
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < stop)
            left, at, stop, wanted = left[more], at[more], stop[more], wanted[more]
        return out


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's values as bytes: Spark copies those at once, lists value by value."""
    at = (np.asarray(offsets, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a packed column, flat, and where each row's begin."""
    if not len(column):
        return np.empty(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return own.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, train, keys of the text's words)"""
    for batch in batches:
        for s in slices(batch.column(3)):
            own = [batch.column(k).slice(s.first, len(s)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, _packed(word_keys(s), s.words)], names=["row", "doc_id", "train", "keys"])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


class _Counter:
    """Counts of 64-bit codes, added up in blocks; what has grown large is given out."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.size, self.raw, self.waiting = most, [], 0, [], 0

    def _merge(self) -> None:
        if self.raw:
            self.held.append(np.unique(np.concatenate(self.raw), return_counts=True))
            self.raw, self.waiting = [], 0
        if len(self.held) > 1:
            self.held = [_added(self.held)]
        self.size = sum(len(k) for k, _ in self.held)

    def add(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.raw.append(codes)
        self.waiting += len(codes)
        if self.waiting > self.most:
            self._merge()
            if self.size > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        yield from self.held
        self.held, self.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the words of a partition."""
    counter = _Counter()
    out = lambda key, n: pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
    for batch in batches:
        for part in counter.add(_unpacked(batch.column(0), np.int64)[0]):
            yield out(*part)
    for part in counter.rest():
        yield out(*part)


def _tokens(common):
    """A mapInArrow function: (row, doc_id, train, ids, rare): each word's index among the commonest, -1 for others, whose keys are in rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            keys, at = _unpacked(batch.column(3), np.int64)
            ids = table.find(keys.view(np.uint64))
            rare = ids < 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(ids, at), _packed(keys[rare], np.concatenate(([0], np.cumsum(rare)))[at])], names=["row", "doc_id", "train", "ids", "rare"])

    return run


def _with_ends(values: np.ndarray, at: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """values with `end` after each row's, and where rows begin in that."""
    n = len(at) - 1
    out = np.full(len(values) + n, end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[at[1:] + np.arange(n)] = False
    out[inside] = values
    return out, at[:-1] + np.arange(n)


def _class_sequence(table: CommonWords, ids: np.ndarray, rare: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes with ends, classes before each, where rows begin); a word that isn't common has its shape's."""
    c = np.empty(len(ids), np.int64)
    known = ids >= 0
    c[known] = table.classes[ids[known]]
    c[~known] = shape_class(rare.view(np.uint64))
    c, starts = _with_ends(c, at, END_CLASS)
    before = np.empty_like(c)
    before[1:], before[starts] = c[:-1], END_CLASS
    return c, before, starts


def _contexts(common, slot: np.ndarray, classes: int):
    """A mapInArrow function over (ids, rare): (word, n, cells) for the words with a slot, cells the packed
    n * 2 * classes + context of its contexts; for class pairs, word -1 less the pair, and n.
    A context is the class before, or `classes` more than the class after."""
    slots = int(slot.max(initial=-1)) + 1
    wide = 2 * classes
    names = ["word", "n", "cells"]

    def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word = code // wide
        first = np.flatnonzero(np.diff(word, prepend=-1))  # codes ascend
        return pa.RecordBatch.from_arrays([pa.array(word[first]), pa.nulls(len(first), pa.int64()), _packed(n * wide + code % wide, np.append(first, len(code)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        pairs = np.zeros(classes * classes, np.int64)
        dense = np.zeros(slots * wide, np.int64) if slots * wide <= DENSE else None
        counter = _Counter()
        for batch in batches:
            ids, at = _unpacked(batch.column(0), np.int32)
            c, before, _ = _class_sequence(table, ids, _unpacked(batch.column(1), np.int64)[0], at)
            pairs += np.bincount(before * classes + c, minlength=classes * classes)
            place = _with_ends(np.where(ids >= 0, slot[ids], -1) if len(slot) else np.full(len(ids), -1), at, -1)[0]
            move = np.flatnonzero(place >= 0)
            own = place[move].astype(np.int64) * wide
            codes = np.concatenate((own + before[move], own + classes + c[move + 1]))
            if dense is not None:
                dense += np.bincount(codes, minlength=len(dense))
            else:
                for part in counter.add(codes):
                    yield rows(*part)
        for part in counter.rest():
            yield rows(*part)
        if dense is not None:
            at = np.flatnonzero(dense)
            yield rows(at, dense[at])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(pairs[at]), pa.nulls(len(at), pa.binary())], names=names)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(n: np.ndarray, was: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each of the words 0, 1, ... the class in which the likelihood is largest, others staying.

    n: counts of class pairs; was: the words' classes, -1 for a word that isn't
    counted in n yet; (word, context, count), by word: its neighbours.  Taken out
    of its class and put into c, a word changes the sum of
    n(a, b) log n(a, b) - n(a, .) log n(a, .) - n(., b) log n(., b).
    """
    k = len(n)
    a, after = context % k, context >= k
    held = np.where(after[:, None], n.T[a], n[a]).astype(float)
    own = was[word]
    counted = np.flatnonzero(own >= 0)
    held[counted, own[counted]] = np.maximum(held[counted, own[counted]] - count[counted], 0)
    gain = _xlogx(held + count[:, None]) - _xlogx(held)
    gain = np.add.reduceat(gain, np.searchsorted(word, np.arange(len(was))), axis=0)
    for side, total in ((~after, n.sum(0)), (after, n.sum(1))):
        size = np.bincount(word[side], count[side], len(was))
        rest = np.repeat(total[None, :].astype(float), len(was), axis=0)
        counted = np.flatnonzero(was >= 0)
        rest[counted, was[counted]] = np.maximum(rest[counted, was[counted]] - size[counted], 0)
        gain -= _xlogx(rest + size[:, None]) - _xlogx(rest)
    gain[:, END_CLASS] = -np.inf
    best = gain.argmax(1)
    stay = was >= 0
    at = np.arange(len(was))
    return np.where(stay & (gain[at, was] >= gain[at, best] - 1e-9), was, best)


def exchange(n: np.ndarray, was: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words' new classes, moved batch after batch; n is changed accordingly.

    A batch is one word with more than one in SHARE of all tokens, or several that have as many together.
    """
    k = len(n)
    out = was.copy()
    starts = np.append(np.searchsorted(word, np.arange(len(was))), len(word))
    most = max(1.0, float(n.sum()) / SHARE)
    tokens = np.concatenate(([0], np.cumsum(np.add.reduceat(count, starts[:-1])) if len(was) else []))
    first = 0
    while first < len(was):
        stop = int(np.searchsorted(tokens, tokens[first] + 2 * most, "right")) - 1
        stop = min(stop, int(np.searchsorted(starts, starts[first] + (1 << 14), "right")) - 1)
        stop = min(max(stop, first + 1), len(was))
        own = slice(starts[first], starts[stop])
        w, x, m = word[own] - first, context[own], count[own]
        best = best_classes(n, out[first:stop], w, x, m)
        for classes, sign in ((out[first:stop], -1), (best, 1)):
            c, a = classes[w], x % k
            some = c >= 0
            row, column = np.where(x >= k, c, a)[some], np.where(x >= k, a, c)[some]
            np.add.at(n, (row, column), sign * m[some])
        np.maximum(n, 0, out=n)
        out[first:stop] = best
        first = stop
    return out


def _moves(pairs, classes_of: np.ndarray | None):
    """A mapInArrow function over (word, context, n), or (word, cells) as of _contexts, sorted by word: (word, class).

    classes_of: the words' classes by number, if they are counted in pairs; else
    word is a key and its class new.  At most CHUNK rows and one word's are held.
    """

    def done(n: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        names, inverse = np.unique(word, return_inverse=True)
        code, count = _added([(inverse * (2 * len(n)) + context, count)])
        inverse, context = code // (2 * len(n)), code % (2 * len(n))
        was = np.full(len(names), -1) if classes_of is None else classes_of[names].astype(np.int64)
        new = exchange(n, was, inverse, context, count.astype(float))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(new.astype(np.int32))], names=["word", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pairs.value.astype(float)
        held, size = [], 0
        for batch in batches:
            if batch.num_columns == 2:
                cells, at = _unpacked(batch.column(1), np.int64)
                held.append([np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(at)), cells % (2 * len(n)), cells // (2 * len(n))])
            else:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            size += len(held[-1][0])
            if size >= CHUNK:
                word, context, count = map(np.concatenate, zip(*held, strict=True))
                cut = int(np.searchsorted(word, word[-1]))
                if cut:
                    yield done(n, word[:cut], context[:cut], count[:cut])
                    held, size = [[word[cut:], context[cut:], count[cut:]]], len(word) - cut
        if size:
            yield done(n, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _likelihood(n: np.ndarray) -> float:
    """Per token, in nats, but for a constant."""
    n = n.astype(float)
    return float((_xlogx(n).sum() - _xlogx(n.sum(0)).sum() - _xlogx(n.sum(1)).sum()) / max(1.0, n.sum()))


_ROW = "row long, train boolean, key_a long, class_a int, key_b long, class_b int, n long"


def _links(common, classes: int):
    """A mapInArrow function over (row, train, ids, rare): the pairs of neighbours of which one isn't common, with keys
    instead of classes where they aren't (class_a and class_b are then shapes'); and, with row null, the counts of all other class pairs of training rows."""
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        pairs = np.zeros(classes * classes, np.int64)
        for batch in batches:
            ids, at = _unpacked(batch.column(2), np.int32)
            rare = _unpacked(batch.column(3), np.int64)[0]
            c, before, starts = _class_sequence(table, ids, rare, at)
            keys = np.zeros(len(ids), np.int64)
            keys[ids < 0] = rare
            keys, _ = _with_ends(keys, at, 0)  # 0: common, or an end
            key_before = np.empty_like(keys)
            key_before[1:], key_before[starts] = keys[:-1], 0
            row = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            odd = (keys != 0) | (key_before != 0)
            both = ~odd & train[row]
            pairs += np.bincount(before[both] * classes + c[both], minlength=classes * classes)
            odd = np.flatnonzero(odd)
            own = pa.array(row[odd])
            some = lambda x: pa.array(x[odd], mask=x[odd] == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), some(key_before), pa.array(before[odd].astype(np.int32)), some(keys), pa.array(c[odd].astype(np.int32)), pa.array(np.ones(len(odd), np.int64))], names=names)
        at = np.flatnonzero(pairs)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.ones(len(at), bool)), none, pa.array((at // classes).astype(np.int32)), none, pa.array((at % classes).astype(np.int32)), pa.array(pairs[at])], names=names)

    return run


@dataclass
class BrownModel:
    """common and rare, (key, n, class): all training words; transition: log10 of [...] in the module's formula, by class pair."""

    common: CommonWords
    rare: DataFrame
    documents: int
    tokens: int  # N
    types: int  # V
    transition: np.ndarray
    sweeps: int  # over the frequent words
    corpus: DataFrame  # (row, doc_id, train, ids, rare), the last two packed
    links: DataFrame  # as _links gives them, classes of rare words put in, and their counts as n_b


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def train(docs: DataFrame, work: Work, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, common: int = 1 << 20, sweeps: int = 5, tolerance: float = 2e-3, mix: float = 0.1, discount: float = 0.5) -> BrownModel:
    """Fit on the rows of docs for which learn holds, all by default.

    common bounds the words that executors hold in memory, not those that move.
    The frequent words are swept until the likelihood gains less than
    `tolerance` nats a token, `sweeps` times at most; with 0 sweeps all words
    keep their first classes.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), learn.alias("train"), F.col(text_col).cast("string").alias("text"))
    keyed = work.table("keys", base.mapInArrow(_keys, "row long, doc_id long, train boolean, keys binary"))
    documents = keyed.where("train").count()
    vocabulary = work.table("vocabulary", keyed.where("train").select("keys").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    words, types = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("*")).head())
    tokens, types = words + documents, types + (documents > 0)
    # the smallest count such that at most `common` words have it: by steps of a 16th of a power of two
    step = F.floor(F.log2("n") * 16).cast("int")
    above, rare_from = 0, None
    for row in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # some 16 * 64 rows
        above += row["words"]
        if above > common:
            break
        rare_from = row["least"]
    is_common = F.lit(False) if rare_from is None else F.col("n") >= rare_from
    top = vocabulary.where(is_common).toArrow()  # at most `common` rows
    keys, counts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    table = CommonWords(keys[order], counts[order], shape_class(keys[order]).astype(np.uint8))
    corpus = work.table("corpus", keyed.mapInArrow(_tokens(spark.sparkContext.broadcast(table)), "row long, doc_id long, train boolean, ids binary, rare binary"))
    work.drop("keys")

    rank = np.lexsort((table.keys, -table.counts))
    single = rank[: max(0, classes - 1 - SHAPES)]
    table.classes[single] = np.arange(SHAPES + 1, SHAPES + 1 + len(single))
    dense = DENSE // (2 * classes)
    frequent, others = rank[:dense], rank[dense:]
    seen = corpus.where("train").select("ids", "rare")

    def sweep(moving: np.ndarray) -> float:
        """One sweep; the likelihood before it."""
        nonlocal table
        slot = np.full(len(table.keys), -1, np.int32)
        slot[moving] = np.arange(len(moving))
        shared = spark.sparkContext.broadcast(table)
        rows = work.table("contexts", seen.mapInArrow(_contexts(shared, slot, classes), "word long, n long, cells binary"))
        pairs = np.zeros(classes * classes, np.int64)
        for word, n in rows.where("word < 0").groupBy("word").agg(F.sum("n")).collect():  # classes ** 2 at most
            pairs[-1 - word] = n
        pairs = pairs.reshape(classes, classes)
        own = rows.where("word >= 0").select("word", "cells").repartition("word").sortWithinPartitions("word")
        moved = own.mapInArrow(_moves(spark.sparkContext.broadcast(pairs), table.classes[moving]), "word long, class int").toArrow()  # a row a moving word
        new = table.classes.copy()
        new[moving[moved["word"].to_numpy()]] = moved["class"].to_numpy()
        table = CommonWords(table.keys, table.counts, new)
        work.drop("contexts")
        shared.unpersist()
        return _likelihood(pairs)

    done, last = 0, -np.inf
    for _ in range(sweeps if len(frequent) else 0):
        now = sweep(frequent)
        done += 1
        if now - last < tolerance:
            break
        last = now
    if len(others) and sweeps:
        # their classes known, the frequent words look about once more
        sweep(others)
        sweep(frequent)
        done += 1
    shared = spark.sparkContext.broadcast(table)
    links = work.table("links", corpus.select("row", "train", "ids", "rare").mapInArrow(_links(shared, classes), _ROW))
    rare = _place_rare(work, vocabulary.where(~is_common), links, classes, move=sweeps > 0)
    # the rare words' classes and counts; words never seen keep their shape's class
    names = rare.select(F.col("key").alias("key_b"), F.col("class").alias("own_b"), F.col("n").alias("n_b"))
    known = links.where("key_b is not null").join(names, "key_b", "left").select("row", "train", "key_a", "class_a", F.coalesce("own_b", "class_b").alias("class_b"), "n", "n_b")
    known = known.union(links.where("key_b is null").select("row", "train", "key_a", "class_a", "class_b", "n", F.lit(None).cast("long").alias("n_b")))
    first = rare.select(F.col("key").alias("key_a"), F.col("class").alias("own_a"))
    placed = known.where("key_a is not null").join(first, "key_a", "left").select("row", "train", F.coalesce("own_a", "class_a").alias("class_a"), "class_b", "n", "n_b")
    placed = work.table("placed", placed.union(known.where("key_a is null").select("row", "train", "class_a", "class_b", "n", "n_b")))
    work.drop("links")
    pairs = _class_pairs(placed, classes)
    # counts plus one of each class's words, and one more of each shape for words never seen
    mass = np.bincount(table.classes, table.counts + 1.0, classes)
    for row in rare.groupBy("class").agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        mass[row["class"]] += row["mass"]
    mass[END_CLASS] = documents + 1 if documents else 0
    mass[1 : SHAPES + 1] += 1
    return BrownModel(table, rare, documents, tokens, types, _transition(pairs.astype(float), mass, tokens, types, mix, discount), done, corpus, placed)


def _class_pairs(links: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros((classes, classes), np.int64)
    for a, b, n in links.where("train").groupBy("class_a", "class_b").agg(F.sum("n")).collect():  # classes ** 2 at most
        out[a, b] = n
    return out


def _place_rare(work: Work, vocabulary: DataFrame, links: DataFrame, classes: int, move: bool) -> DataFrame:
    """(key, n, class) of the training words that aren't common, each moved once to the best class by its neighbours'."""
    shape = (F.col("key").bitwiseAND(F.lit(SHAPES - 1)) + 1).cast("int")
    if not move or vocabulary.isEmpty():
        return work.table("rare", vocabulary.select("key", "n", shape.alias("class")))
    seen = links.where("train and row is not null")
    sides = [seen.where("key_b is not null").select(F.col("key_b").alias("word"), F.col("class_a").cast("long").alias("context"), "n")]
    sides += [seen.where("key_a is not null").select(F.col("key_a").alias("word"), (F.col("class_b") + classes).cast("long").alias("context"), "n")]
    rows = sides[0].union(sides[1]).groupBy("word", "context").agg(F.sum("n").alias("n")).repartition("word").sortWithinPartitions("word")
    pairs = work.spark.sparkContext.broadcast(_class_pairs(links, classes))
    moved = rows.mapInArrow(_moves(pairs, None), "key long, class int")
    return work.table("rare", vocabulary.join(moved, "key", "left").select("key", "n", F.coalesce("class", shape).alias("class")))


def _transition(pairs: np.ndarray, mass: np.ndarray, tokens: int, types: int, mix: float, discount: float) -> np.ndarray:
    """log10[(1 - mix) * T / M + mix / (N + V + SHAPES)]; T by absolute discounting over the class unigram."""
    unigram = (pairs.sum(0) + 1) * (mass > 0)  # a class without words gets nothing
    unigram /= unigram.sum()
    rows = pairs.sum(1, keepdims=True)
    kept = np.maximum(pairs - discount, 0)
    t = np.where(rows > 0, (kept + (rows - kept.sum(1, keepdims=True)) * unigram) / np.maximum(rows, 1), unigram)
    return np.log10((1 - mix) * t / np.maximum(mass, 1) + mix / (tokens + types + SHAPES))


def _score(common, transition):
    """A mapInArrow function over (row, doc_id, train, ids, rare): what the common words and their pairs tell of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, step = common.value, transition.value
        log_counts = np.log10(table.counts + 1.0)
        for batch in batches:
            ids, at = _unpacked(batch.column(3), np.int32)
            c, before, starts = _class_sequence(table, ids, _unpacked(batch.column(4), np.int64)[0], at)
            n = len(at) - 1
            words = np.repeat(np.arange(n), np.diff(at))
            row = np.repeat(np.arange(n), np.diff(at) + 1)
            rare, _ = _with_ends(ids < 0, at, False)
            beside = rare.copy()
            beside[1:] |= rare[:-1]
            beside[starts] = rare[starts]
            plain = np.flatnonzero(~beside)
            known = np.flatnonzero(ids >= 0)
            out = [np.diff(at) + 1, np.bincount(words[known], minlength=n), np.bincount(words[known], log_counts[ids[known]], n), np.bincount(row[plain], step[before[plain], c[plain]], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x.astype(kind)) for x, kind in zip(out, (np.int64, np.int64, float, float), strict=True))], names=["row", "doc_id", "train", "n_tokens", "n_known", "log_counts", "log_classes"])

    return run


def brown_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability under the model) and perplexity.

    The rows whose fold isn't the held-out one are the training corpus.  A
    null or wordless text is its end alone.  Rows without an id are trained on
    and scored; rows that repeat id and text give one row each.  Words that tie
    in counts are taken in the order of their hashes.  Texts of any length are
    read whole.  Without training rows only the unseen word's probability is
    left; an empty table gives an empty result.  Only the named
    columns are read.
    """
    spark = docs.sparkSession
    work = Work(spark, "brown")
    model = train(docs, work, learn=~held_out(id_col), id_col=id_col, text_col=text_col, **how)
    shared, step = spark.sparkContext.broadcast(model.common), spark.sparkContext.broadcast(model.transition)
    rows = model.corpus.mapInArrow(_score(shared, step), "row long, doc_id long, train boolean, n_tokens long, n_known long, log_counts double, log_classes double")
    classes = len(model.transition)
    steps = F.broadcast(spark.createDataFrame([(a, b, float(model.transition[a, b])) for a in range(classes) for b in range(classes)], "class_a int, class_b int, step double"))  # classes ** 2 rows
    more = model.links.where("row is not null").join(steps, ["class_a", "class_b"]).groupBy("row")
    more = more.agg(F.sum("step").alias("more_classes"), F.count("n_b").alias("more_known"), F.sum(F.log10(F.col("n_b") + 1)).alias("more_logs"))
    end = F.lit(float(np.log10(model.documents + 1)))
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0)) + end
    per_token = float(np.log10(model.tokens + model.types + 1))
    out = rows.join(more, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(model.documents > 0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * per_token).alias("base_score"),
        (logs + F.col("log_classes") + F.coalesce("more_classes", F.lit(0.0))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
