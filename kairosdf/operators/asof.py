"""As-of reads: what was known at a time.  The cutoff is inclusive and reaches the scan as a filter."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DUAL_ASSETS
from ..functions.scalars import timestamp
from .conflicts import any_order, conflicting_keys, drop_exact_duplicates, first_by

ASOF = "snapshot_asof_date"


def upto(df: DataFrame, at, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column) <= timestamp(at))


def between(df: DataFrame, start, end, column: str = "timestamp") -> DataFrame:
    """start <= column <= end"""
    return df.where(F.col(column).between(timestamp(start), timestamp(end)))


def after_upto(df: DataFrame, start, end, column: str = "timestamp") -> DataFrame:
    """start < column <= end"""
    return df.where((F.col(column) > timestamp(start)) & (F.col(column) <= timestamp(end)))


def latest_asof(df: DataFrame, key: str, at, *, order: list | None = None) -> DataFrame:
    """The latest row of each key up to the cutoff, with the cutoff in snapshot_asof_date.

    Of rows with one key and time, the first by `order`, else by all columns
    descending, is taken, so the result never depends on how rows are stored.
    """
    past = upto(df, at)
    latest = first_by(past, [key], any_order(past, [F.desc("timestamp"), *(order or [])]))
    return latest.withColumn(ASOF, timestamp(at))


def check_versions(df: DataFrame, key: str, at, table: str, allowed: frozenset[str] = frozenset()) -> int:
    """ValueError if unlike rows up to the cutoff share key and time, but for the allowed keys: of those
    the rows are counted, warned of, and all but one of each key left out by the snapshot."""
    bad = conflicting_keys(upto(df, at), [key, "timestamp"])
    fine = F.col(key).isin(*allowed) if allowed else F.lit(False)
    examples = bad.where(~fine).orderBy(key, "timestamp").limit(5).collect()
    resolved = 0 if examples or not allowed else bad.where(fine).agg(F.sum("n_rows")).head()[0] or 0
    if resolved:
        warnings.warn(f"{table}: {resolved} rows of whitelisted {key} share a time; one of each is taken", stacklevel=3)
    if examples:
        raise ValueError(f"{table}: rows with equal ({key}, timestamp) differ, e.g. {[(x[0], str(x[1])) for x in examples]}")
    return resolved


def get_customer_snapshot_asof(customers: DataFrame, as_of, *, check: bool = True) -> DataFrame:
    """Each customer's latest version up to as_of; check looks for conflicting versions first."""
    if check:
        check_versions(customers, "customerID", as_of, "customers")
    return latest_asof(customers, "customerID", as_of)


def get_asset_snapshot_asof(assets: DataFrame, as_of, *, check: bool = True, allowed: frozenset[str] = DUAL_ASSETS) -> DataFrame:
    if check:
        check_versions(assets, "ISIN", as_of, "assets", allowed)
    return latest_asof(assets, "ISIN", as_of)


def get_prices_asof(prices: DataFrame, as_of) -> DataFrame:
    """The price history up to as_of, in the columns it has."""
    return upto(prices, as_of)


def distinct_versions(df: DataFrame, as_of) -> DataFrame:
    return drop_exact_duplicates(upto(df, as_of))
