"""Duplicates and conflicts: equal rows collapse, unlike rows with one key stop the run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRANSACTION_KEY
from ..errors import DataConflictError


def require_columns(df: DataFrame, required: list[str], table: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")


def row_hashes(df: DataFrame) -> list[Column]:
    """Two hashes of a row's cells, 96 bits, by which equal rows meet without being shuffled whole; a null is told from a cell left out."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*cells).alias("__h1"), F.hash(*cells).alias("__h2")]


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def conflicting_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, equal rows counted once; keys and hashes are shuffled, not rows."""
    return df.select(*[F.col(f"`{k}`") for k in keys], *row_hashes(df)).distinct().groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def conflicting_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the conflicting keys, equal rows once."""
    n = F.count("*").over(Window.partitionBy(*keys))
    names = df.columns
    mark = "n_rows"
    while mark in names:
        mark += "_"
    return drop_exact_duplicates(df).withColumn(mark, n).where(F.col(mark) > 1).select(*names)


def unlike_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that unlike rows share: one narrow aggregate by key, least and largest hash of its rows."""
    narrow = df.select(*[F.col(f"`{k}`") for k in keys], *row_hashes(df))
    span = narrow.groupBy(*keys).agg(F.min("__h1").alias("a"), F.max("__h1").alias("b"), F.min("__h2").alias("c"), F.max("__h2").alias("d"))
    return span.where("a <> b or c <> d").select(*keys)


_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


@contextmanager
def keeping_rows() -> Iterator[list[DataFrame]]:
    """Within it, on this thread, the rows that raise_on_conflicts gives are kept, and listed; who reads them unpersists them."""
    token = _kept.set(held := [])
    try:
        yield held
    finally:
        _kept.reset(token)


def raise_on_conflicts(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """df without equal rows; DataConflictError with up to five keys if unlike rows share one.

    Where rows are kept they are dealt out by key once, for duplicates and conflicts: of distinct rows each key has one.
    """
    if (held := _kept.get()) is not None:
        out = drop_exact_duplicates(df.repartition(*[F.col(f"`{k}`") for k in keys])).persist()
        held.append(out)
        unlike = out.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(*keys)
    else:
        out, unlike = drop_exact_duplicates(df), unlike_keys(df, keys)
    if examples := unlike.orderBy(*keys).limit(5).collect():
        raise DataConflictError(f"{table}: rows with equal {keys} differ, e.g. {[tuple(map(str, x)) for x in examples]}")
    return out


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    mark = "rn"
    while mark in df.columns:
        mark += "_"
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(mark) == 1).drop(mark)


def any_order(df: DataFrame, first: list[Column]) -> list[Column]:
    """An order of rows that never ties but between equal ones: the given columns, then all, descending."""
    return first + [F.col(f"`{c}`").desc() for c in df.columns]


def reused_ids(df: DataFrame, column: str = "transactionID") -> DataFrame:
    """Values that occur more than once, and how often."""
    return df.groupBy(column).agg(F.count("*").alias("n_rows")).where(F.col(column).isNotNull() & (F.col("n_rows") > 1))


def key_counts(df: DataFrame, keys: list[str], column: str) -> tuple[int, int]:
    """(distinct keys, values of column, one of the keys, that several rows have): one shuffle by column, which both are counted within."""
    n = df.select(*keys).repartition(column).groupBy(*keys).agg(F.count("*").alias("n"))
    n = n.groupBy(column).agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
    row = n.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"), F.count_if(F.col(column).isNotNull() & (F.col("n") > 1)).alias("reused")).head()
    return row["keys"], row["reused"]


def unmatched(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Rows whose value isn't in the reference's column of that name; a null never is."""
    return df.join(reference.select(column).distinct(), column, "left_anti")


def count_unmatched(df: DataFrame, column: str, reference: DataFrame) -> int:
    """How many rows unmatched() gives; values are looked up once each, however many rows have them."""
    return unmatched(df.groupBy(column).agg(F.count("*").alias("n_rows")), column, reference).agg(F.sum("n_rows")).head()[0] or 0


def matched(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    return df.join(reference.select(column).distinct(), column, "left_semi")


def is_key_unique(df: DataFrame, keys: list[str] = TRANSACTION_KEY) -> bool:
    """Whether no two rows, equal ones included, share a key."""
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def out_of_order(df: DataFrame, ordinal: str, order: list[str]) -> DataFrame:
    """Rows that sort before the row of the next smaller ordinal; one window over the ordinal's ranges.

    A range of ordinals is compared within itself and with the last row of the
    range before, so no task holds all rows.
    """
    key = F.struct(*order)
    bucket = F.floor(F.col(ordinal) / 100_000)
    keyed = df.withColumn("__bucket", bucket).withColumn("__key", key)
    inner = F.lag("__key").over(Window.partitionBy("__bucket").orderBy(ordinal))
    last = keyed.groupBy("__bucket").agg(F.max_by("__key", ordinal).alias("__last"))
    # a bucket's predecessor may be several empty buckets before
    before = last.select((F.lead("__bucket").over(Window.orderBy("__bucket"))).alias("__bucket"), F.col("__last")).where("__bucket is not null")
    joined = keyed.withColumn("__inner", inner).join(before, "__bucket", "left")
    return joined.where(F.coalesce("__inner", "__last") > F.col("__key")).select(*df.columns)
