"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Circulant MinHash needs two permutations for all coordinates: the first, S,
scatters the shingles over a ring of 2**32 places; the second, P, is shifted
one place further for every coordinate, so coordinate k of a set is
``min(P((S(x) - k) mod 2**32))``.  Both are bijections computed on the fly,
nothing of the ring's size is stored.  Six coordinates make a band; two
documents with similarity 0.85 share none of the 28 bands with probability
2e-6.  Candidates whose
sets' parities on 1024 places differ more than a link allows, or whose
signatures' low bits do by far, are dropped, and every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import possible
from .linkage import connected_components, linked_components
from .store import Work
from .text import as_long, mix64, segment_sum, shingle_sets, slices

BANDS, ROWS = 28, 6
PARITIES = 1024
_CHUNK = 1 << 16


def _ring_permutation(x: np.ndarray) -> np.ndarray:
    """P: a bijection of the 32-bit integers, in place."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(shingles: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates) uint32 of the non-empty sets shingles[offsets[i]:offsets[i+1]]."""
    n = len(offsets) - 1
    out = np.full((coordinates, n), 0xFFFFFFFF, np.uint32)
    ring = (shingles >> np.uint64(32)).astype(np.uint32)  # S: the hash has scattered them already
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        stop = min(stop, n)
        x, own = ring[offsets[at] : offsets[stop]], offsets[at:stop] - offsets[at]
        filled = np.flatnonzero(np.diff(offsets[at : stop + 1]))
        if len(filled):
            starts = own[filled]
            for k in range(coordinates):
                out[k, at + filled] = np.minimum.reduceat(_ring_permutation(x - np.uint32(k)), starts)
        at = stop
    return out.T


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    parts = signature.astype(np.uint64) * weights
    return mix64(parts.reshape(len(signature), bands, rows).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _sketch(signature: np.ndarray) -> np.ndarray:
    """The two lowest bits of every coordinate, in 64-bit words."""
    planes = []
    for k in (0, 1):
        bits = np.packbits((signature >> np.uint32(k)).astype(np.uint8) & 1, axis=1)
        planes.append(np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64))
    return np.concatenate(planes, axis=1)


def _parities(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of PARITIES places, in 64-bit words.

    Two sets' parities differ in at most as many places as the sets do in shingles.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    place = doc * PARITIES + (flat & np.uint64(PARITIES - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=n * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITIES), axis=1).view(np.uint64)


def _words(bands: int, rows: int) -> tuple[list[str], list[str]]:
    return [f"p{k}" for k in range(PARITIES // 64)], [f"s{k}" for k in range(2 * -(-bands * rows // 64))]


def sketch_distance(percent: int, coordinates: int, spare: float) -> int:
    """Sketch bits that may differ at that similarity, with so many standard deviations to spare.

    Coordinates differ with probability q = 1 - similarity, then each bit with 1/2.
    """
    q = 1 - percent / 100
    return int(coordinates * q + spare * (coordinates * (1.5 * q - q * q)) ** 0.5) + 1


def _signatures(shingle: int, bands: int, rows: int):
    words = sum(_words(bands, rows), [])
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), *((w, pa.int64()) for w in words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                flat, offsets = shingle_sets(s, shingle)
                sizes = np.diff(offsets)
                keys = [segment_sum(mix64(flat + np.uint64(salt)), offsets) for salt in (1, 2)]
                has = sizes > 0
                signature = circulant_minhash(flat, offsets, bands * rows)
                hashes = band_hashes(signature, bands, rows)[has]
                facts = np.concatenate((_parities(flat, offsets), _sketch(signature)), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)), as_long(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array(sizes), as_long(keys[0]), as_long(keys[1]), lists, *map(as_long, facts.T)], schema=schema)

    return run


def differing_bits(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Of each pair of 64-bit words, how many bits differ."""
    return np.bitwise_count(x.to_numpy().view(np.uint64) ^ y.to_numpy().view(np.uint64)).astype(np.int64)


def _flat_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))


def _sets(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                flat, offsets = shingle_sets(s, shingle)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), as_long(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), lists], schema=schema)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, spare: float | None = 5.5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    distinct word shingles; component_id is the smallest id that links reach.
    Equal sets count as one document while links are searched.  Null and
    wordless texts have no shingles and no links.  Rows without an id are
    returned unlinked, with a null component_id and kept true.  Rows that
    repeat an id are one document: each is returned, links of any hold for
    all.  spare: standard deviations by which a candidate's sketch may be off before it
    is dropped untested; None tests every candidate that the exact parity bound leaves.  Other columns of the input, whatever their names, are not read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Work(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parities, sketch = _words(bands, rows)
    words = parities + sketch
    sig = work.table("sig", base.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>" + "".join(f", {w} long" for w in words)))

    named = sig.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", *words)).alias("rep"))
    classes = work.table("classes", classes.select("k1", "k2", F.col("rep.doc_id").alias("id"), F.col("rep.n_shingles").alias("n"), F.col("rep.bands").alias("bands"), *[F.col(f"rep.{w}").alias(w) for w in words]))
    keyed = classes.select("id", F.col("bands").alias("buckets"))

    def payload(ids: DataFrame) -> DataFrame:
        wanted = possible(base, [F.col("doc_id")], ids).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return wanted.mapInArrow(_sets(shingle), "id long, set array<long>")

    most = None if spare is None else sketch_distance(percent, bands * rows, spare)

    def likely(x, y) -> np.ndarray:
        n, m = x["n"].to_numpy(), y["n"].to_numpy()
        lo, hi = np.minimum(n, m), np.maximum(n, m)
        differ = lambda ws: sum(differing_bits(x[w], y[w]) for w in ws)
        apart = (100 + percent) * differ(parities) <= (100 - percent) * (lo + hi)
        return (100 * lo >= percent * hi) & apart & ((most is None) | (differ(sketch) <= (most or 0)))

    def linked(x, y) -> np.ndarray:
        """Exact, on the full sets."""
        out = np.zeros(len(x["set"]), bool)
        (a, at), (b, bt) = _flat_sets(x["set"]), _flat_sets(y["set"])
        for k in range(len(out)):
            u, v = a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]]
            both = len(np.intersect1d(u, v, assume_unique=True))
            out[k] = 100 * both >= percent * (len(u) + len(v) - both)
        return out

    found = linked_components(work, keyed, classes.select("id", "n", *words), payload, likely, linked)
    found = _with_repeated_ids(work, named, classes, found)
    least = work.table("least", _component_ids(classes, found))
    work.drop("classes", "again")
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(least, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_repeated_ids(work: Work, named: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The components with the classes joined that an id has more than one of."""
    again = work.table("again", named.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("doc_id"))
    if again.isEmpty():
        return found
    own = named.join(again, "doc_id").join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    links = own.join(own.groupBy("doc_id").agg(F.min("id").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return connected_components(work, links.union(found.select("label", "id")), "c3")


def _component_ids(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The smallest id of each class's component."""
    own = classes.select("k1", "k2", "id").join(found, "id", "left")
    least = found.groupBy("label").agg(F.min("id").alias("least"))
    return own.join(least, "label", "left").select("k1", "k2", F.coalesce("least", "id").alias("component"))


def keep_first_of_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that are no duplicate of one with a smaller id.

    Rows without an id stay; of rows that repeat an id and a text all stay or none.
    """
    groups = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.alias("docs").join(groups.alias("gone"), F.col("docs.doc_id") == F.col("gone.gone"), "left_anti")
