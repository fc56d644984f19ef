"""Chronological splits with the features known at each one's start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Protocol
from ..functions.scalars import add_months, end_of_day, timestamp
from .asof import after_upto, between, get_asset_snapshot_asof, get_customer_snapshot_asof, get_prices_asof, upto


@dataclass(frozen=True)
class PrimarySplit:
    """Validation is to be predicted from what was known at train_end, test from validation_end."""

    train: DataFrame
    validation: DataFrame
    test: DataFrame
    train_end: str
    validation_end: str
    test_end: str
    customer_snapshot_train: DataFrame | None = None
    asset_snapshot_train: DataFrame | None = None
    prices_upto_train_end: DataFrame | None = None
    customer_snapshot_validation: DataFrame | None = None
    asset_snapshot_validation: DataFrame | None = None
    prices_upto_validation_end: DataFrame | None = None

    def parts(self) -> dict[str, DataFrame]:
        return {"train": self.train, "validation": self.validation, "test": self.test}


@dataclass(frozen=True)
class RollingSplit:
    window: int
    day: str
    cutoff: str
    test_end: str
    train: DataFrame
    test: DataFrame
    customer_snapshot: DataFrame | None = None
    asset_snapshot: DataFrame | None = None
    prices_upto_t: DataFrame | None = None


def _typed(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("timestamp", timestamp(F.col("timestamp")))


def build_primary_split(transactions: DataFrame, customers: DataFrame | None = None, assets: DataFrame | None = None, prices: DataFrame | None = None, protocol: Protocol = DEFAULT, *, check: bool = True) -> PrimarySplit:
    tx = _typed(transactions)
    snapshots = {}
    for name, at in (("train", protocol.train_end), ("validation", protocol.validation_end)):
        snapshots[f"customer_snapshot_{name}"] = customers and get_customer_snapshot_asof(customers, at, check=check)
        snapshots[f"asset_snapshot_{name}"] = assets and get_asset_snapshot_asof(assets, at, check=check)
        snapshots[f"prices_upto_{name}_end"] = prices and get_prices_asof(prices, at)
    return PrimarySplit(
        upto(tx, protocol.train_end), between(tx, protocol.validation_start, protocol.validation_end), between(tx, protocol.test_start, protocol.test_end),
        protocol.train_end, protocol.validation_end, protocol.test_end, **snapshots,
    )


def rolling_bounds(spark, protocol: Protocol = DEFAULT) -> list[tuple[int, str, str, str]]:
    """(window, day, cutoff, test_end): a cutoff is its day's last second, its test reaches horizon_months on."""
    days = spark.createDataFrame([(n, d) for n, d in enumerate(protocol.rolling_cutoffs, 1)], "window int, day string")
    cutoff = end_of_day(timestamp(F.col("day")))
    rows = days.select("window", "day", cutoff.cast("string").alias("cutoff"), add_months(cutoff, protocol.horizon_months).cast("string").alias("test_end"))
    return [tuple(r) for r in rows.orderBy("window").collect()]


def build_rolling_splits(transactions: DataFrame, customers: DataFrame | None = None, assets: DataFrame | None = None, prices: DataFrame | None = None, protocol: Protocol = DEFAULT, *, check: bool = True) -> list[RollingSplit]:
    tx = _typed(transactions)
    return [
        RollingSplit(
            n, day, cutoff, end, upto(tx, cutoff), after_upto(tx, cutoff, end),
            customers and get_customer_snapshot_asof(customers, cutoff, check=check), assets and get_asset_snapshot_asof(assets, cutoff, check=check), prices and get_prices_asof(prices, cutoff),
        )
        for n, day, cutoff, end in rolling_bounds(transactions.sparkSession, protocol)
    ]


def labelled_parts(transactions: DataFrame, protocol: Protocol = DEFAULT) -> DataFrame:
    """Transactions of the three parts with their part's name in `split`, in one pass."""
    at = timestamp(F.col("timestamp"))
    part = F.when(at <= timestamp(protocol.train_end), "train")
    part = part.when(at.between(timestamp(protocol.validation_start), timestamp(protocol.validation_end)), "validation")
    part = part.when(at.between(timestamp(protocol.test_start), timestamp(protocol.test_end)), "test")
    return transactions.withColumn("split", part).where("split is not null")


def split_summary(transactions: DataFrame, protocol: Protocol = DEFAULT) -> DataFrame:
    """A row for each part, empty ones too: span, rows, distinct ids, and those that train hasn't.

    Ids are counted from one row per part and id, on which a flag tells whether
    train has the id, so the transactions are read once per kind of id.
    """
    parts = labelled_parts(transactions.select("customerID", "ISIN", "timestamp"), protocol)
    names = transactions.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    out = parts.groupBy("split").agg(F.min("timestamp").cast("string").alias("start"), F.max("timestamp").cast("string").alias("end"), F.count("*").alias("rows"))
    for column, what in (("customerID", "customers"), ("ISIN", "assets")):
        ids = parts.where(F.col(column).isNotNull()).groupBy(column).agg(F.collect_set("split").alias("in"))
        each = ids.select(F.explode("in").alias("split"), (~F.array_contains("in", "train")).alias("unseen"))
        out = out.join(each.groupBy("split").agg(F.count("*").alias(what), F.count_if("unseen").alias(f"unseen_{what}")), "split", "left")
    counts = ["rows", "customers", "assets", "unseen_customers", "unseen_assets"]
    return names.join(out, "split", "left").select("split", "start", "end", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def rolling_summary(transactions: DataFrame, protocol: Protocol = DEFAULT) -> DataFrame:
    """A row for each window: bounds, rows and distinct ids of its train and test.

    Each transaction is tagged with its parts of all windows, a handful, and
    the ids are counted through one row per window, part and id.
    """
    bounds = rolling_bounds(transactions.sparkSession, protocol)
    at = timestamp(F.col("timestamp"))
    tags = F.array_compact(F.array(*[
        F.when(at <= timestamp(cutoff), F.struct(F.lit(n).alias("window"), F.lit("train").alias("part"))).when(at <= timestamp(end), F.struct(F.lit(n).alias("window"), F.lit("test").alias("part")))
        for n, _, cutoff, end in bounds
    ]))
    tagged = transactions.select("customerID", "ISIN", F.explode(tags).alias("tag")).select("tag.*", "customerID", "ISIN")
    test, train = F.col("part") == "test", F.col("part") == "train"
    out = tagged.groupBy("window").agg(F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"))
    for column, what in (("customerID", "customers"), ("ISIN", "assets")):
        each = tagged.select("window", "part", column).where(F.col(column).isNotNull()).distinct()
        out = out.join(each.groupBy("window").agg(F.count_if(train).alias(f"train_{what}"), F.count_if(test).alias(f"test_{what}")), "window", "left")
    known = transactions.sparkSession.createDataFrame([(n, cutoff, end) for n, _, cutoff, end in bounds], "window int, cutoff string, test_end string")
    counts = ["train_rows", "test_rows", "train_customers", "test_customers", "train_assets", "test_assets"]
    return known.join(out, "window", "left").select("window", "cutoff", "test_end", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def coverage(transactions: DataFrame, protocol: Protocol = DEFAULT) -> dict:
    """Whether the parts hold every transaction."""
    total, assigned = transactions.count(), labelled_parts(transactions.select("timestamp"), protocol).count()
    return {"clean_transactions": total, "assigned_rows": assigned, "unassigned_rows": total - assigned, "ok": assigned == total}


def new_pairs(later: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of a later part whose pair of customer and asset isn't in train."""
    return later.join(train.select("customerID", "ISIN").distinct(), ["customerID", "ISIN"], "left_anti")
