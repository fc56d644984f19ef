"""Cleaners of the six tables.  Each takes and returns a DataFrame; the order of steps is part of
the semantics, as a filter before a conflict check can prevent a conflict."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DUAL_ASSETS, PREFERRED_CATEGORY, SCHEMAS, TRANSACTION_KEY, required_columns
from ..errors import DataConflictError
from ..functions.scalars import known, plain_label, predicted_flag
from ..sources.tables import side_by_side
from .conflicts import any_order, conflicting_keys, count_unmatched, drop_exact_duplicates, first_by, matched, raise_on_conflicts, require_columns, unmatched

CAPACITY_RENAMES = {"GT300K": "CAP_GT300K"}


@dataclass
class Notes:
    """What cleaners dropped or resolved though it stops no run: (table, what, rows), counted only if notes are taken."""

    taken: list[tuple[str, str, int]] = field(default_factory=list)

    def take(self, table: str, what: str, rows: int) -> None:
        if rows:
            self.taken.append((table, what, int(rows)))
            warnings.warn(f"{table}: {rows} rows, {what}", stacklevel=3)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.taken, "`table` string, what string, n_rows long")


def clean_customers(df: DataFrame, notes: Notes | None = None) -> DataFrame:
    """Versions of customers: conflicts are looked for in the raw labels, which are then normalised."""
    require_columns(df, required_columns("customers"), "customers")
    out = raise_on_conflicts(df.dropna(subset=["customerID", "timestamp"]), ["customerID", "timestamp"], "customers")
    return out.withColumns({
        "is_risk_predicted": predicted_flag(F.col("riskLevel")), "riskLevel": plain_label(F.col("riskLevel")),
        "is_capacity_predicted": predicted_flag(F.col("investmentCapacity")), "investmentCapacity": plain_label(F.col("investmentCapacity"), CAPACITY_RENAMES),
        "customerType": known(F.col("customerType")),
    })


def resolve_dual_assets(df: DataFrame, dual: frozenset[str] | DataFrame = DUAL_ASSETS, preferred: str = PREFERRED_CATEGORY, notes: Notes | None = None) -> DataFrame:
    """One row per (ISIN, timestamp): of assets known to be classified twice the preferred category,
    else the row last in the order of all columns; any other conflict stops the run.

    dual: ids, or a table of them with the column ISIN, which is joined.
    """
    keys = ["ISIN", "timestamp"]
    distinct = drop_exact_duplicates(df)
    twice = conflicting_keys(df, keys).persist()  # few; the gate and the note read them
    try:
        unknown = unmatched(twice, "ISIN", dual) if isinstance(dual, DataFrame) else twice.where(~F.col("ISIN").isin(*dual)) if dual else twice
        if bad := unknown.select("ISIN").distinct().orderBy("ISIN").limit(5).collect():
            raise DataConflictError(f"assets: rows with equal {keys} differ, e.g. {[x[0] for x in bad]}")
        if notes is not None:
            notes.take("assets", "versions classified twice, resolved", twice.agg(F.sum("n_rows")).head()[0] or 0)
    finally:
        twice.unpersist()
    best = F.coalesce(F.col("assetCategory") == preferred, F.lit(False)).desc()
    return first_by(distinct, keys, any_order(distinct, [best]))


def clean_assets(df: DataFrame, notes: Notes | None = None, *, dual: frozenset[str] | DataFrame = DUAL_ASSETS) -> DataFrame:
    require_columns(df, required_columns("assets"), "assets")
    out = resolve_dual_assets(df.dropna(subset=["ISIN", "timestamp"]), dual, notes=notes)
    text = [c.split()[0] for c in SCHEMAS["assets"].split(", ") if c.endswith(" string") and not c.startswith("ISIN ")]
    return out.withColumns({c: known(F.col(c)) for c in text})


def clean_markets(df: DataFrame, notes: Notes | None = None) -> DataFrame:
    require_columns(df, ["marketID"], "markets")
    out = raise_on_conflicts(df.dropna(subset=["marketID"]), ["marketID"], "markets")
    return out.withColumns({c: known(F.col(c)) for c, kind in out.dtypes if kind == "string"})


def clean_close_prices(df: DataFrame, notes: Notes | None = None) -> DataFrame:
    """Prices that aren't positive go first, so that they can't conflict."""
    require_columns(df, required_columns("close_prices"), "close_prices")
    whole = df.dropna(subset=["ISIN", "timestamp", "closePrice"])
    if notes is not None:
        notes.take("close_prices", "price not above zero, dropped", whole.where("closePrice <= 0").count())
    out = whole.where("closePrice > 0")
    return raise_on_conflicts(out, ["ISIN", "timestamp"], "close_prices")


def clean_limit_prices(df: DataFrame, notes: Notes | None = None) -> DataFrame:
    require_columns(df, required_columns("limit_prices"), "limit_prices")
    whole = df.dropna(subset=["ISIN", "minDate", "maxDate"])
    if notes is not None:
        notes.take("limit_prices", "range ends before it begins, dropped", whole.where("minDate > maxDate").count())
    out = whole.where("minDate <= maxDate")
    return raise_on_conflicts(out, ["ISIN"], "limit_prices")


TRANSACTION_CELLS = ["customerID", "ISIN", "transactionID", "transactionType", "timestamp", "totalValue", "units"]


def valid_transactions(df: DataFrame) -> DataFrame:
    """Complete purchases and sales with units above and a value not below zero."""
    return df.dropna(subset=TRANSACTION_CELLS).where(F.col("transactionType").isin("Buy", "Sell") & (F.col("units") > 0) & (F.col("totalValue") >= 0))


def clean_transactions(df: DataFrame, notes: Notes | None = None) -> DataFrame:
    require_columns(df, required_columns("transactions"), "transactions")
    return raise_on_conflicts(valid_transactions(df), TRANSACTION_KEY, "transactions")


#: the cleaner of each table; register others, or replace these, by name
CLEANERS: dict[str, Callable[[DataFrame, Notes | None], DataFrame]] = {
    "customers": clean_customers, "assets": clean_assets, "markets": clean_markets,
    "close_prices": clean_close_prices, "limit_prices": clean_limit_prices, "transactions": clean_transactions,
}

#: the tables that a table's checks look its ids up in
REFERS_TO = {"close_prices": ["assets"], "limit_prices": ["assets"], "transactions": ["customers", "assets", "markets"]}

#: the order in which each table is written
SINK_ORDER = {
    "customers": ["customerID", "timestamp"], "assets": ["ISIN", "timestamp"], "markets": ["marketID"],
    "close_prices": ["ISIN", "timestamp"], "limit_prices": ["ISIN"], "transactions": ["timestamp", "customerID", "transactionID", "ISIN"],
}


def drop_orphans(tables: dict[str, DataFrame], notes: Notes | None = None) -> dict[str, DataFrame]:
    """Prices and limits, those of them that are there, of assets that exist."""
    priced = [name for name in ("close_prices", "limit_prices") if name in tables]
    out = {name: matched(tables[name], "ISIN", tables["assets"]) for name in priced}
    if notes is not None:
        # what is left is counted and kept, so that ids are looked up once; who takes notes unpersists it
        left = side_by_side(lambda x: tables[x].count() - out[x].persist().count(), priced)
        for name, n in zip(priced, left, strict=True):
            notes.take(name, "of unknown assets, dropped", n)
    return tables | out


def check_references(tables: dict[str, DataFrame]) -> None:
    """DataConflictError at the first of customerID, ISIN, marketID that some transaction has in vain."""
    references = [("customerID", "customers"), ("ISIN", "assets"), ("marketID", "markets")]
    unknown = side_by_side(lambda x: count_unmatched(tables["transactions"], x[0], tables[x[1]]), references)
    for n, (column, _) in zip(unknown, references, strict=True):
        if n:
            raise DataConflictError(f"transactions: {n} rows with unknown {column}")
