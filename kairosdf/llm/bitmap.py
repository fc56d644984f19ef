"""A bitmap of fixed size that passes at least the rows a later join wants.

Its size never depends on the data, so it can always be broadcast.  It spares
the shuffle of rows that can't match; where there are so many keys that it
fills up, it passes all, and the join that follows is as exact as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
_SHIFT = np.uint64(64 - BITS.bit_length() + 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-zero 64-bit words of the bitmap of a partition's hashes."""
    bits = np.zeros(BITS // 64, np.uint64)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> _SHIFT
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    word = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], names=["word", "bits"])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a table's first column of longs; at most BITS bits, 4 MB, reach the driver."""
    parts = hashes.mapInArrow(_parts, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return bits


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> _SHIFT
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def possible(df: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """df without rows whose keys can't be among wanted's columns (as many, in that order)."""
    spark = df.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(*wanted.columns))))
    names = df.columns
    hashed = df.select(F.xxhash64(*keys), *[F.col(f"`{c}`") for c in names]).toDF("0", *[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = contains(bits.value, batch.column(0).to_numpy(zero_copy_only=False))
            if keep.any():
                rows = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(rows.columns[1:], names=rows.schema.names[1:])

    return hashed.mapInArrow(run, hashed.drop("0").schema).toDF(*names)
