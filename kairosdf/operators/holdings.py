"""Positions from transactions, and the assets a customer could still buy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, held_units
from .asof import upto


def build_holdings_asof(transactions: DataFrame, as_of) -> DataFrame:
    """customerID, ISIN, net_units up to as_of, and whether that is above zero.

    Units are added as decimals of twelve places: what was bought and sold in
    equal parts nets to exactly zero.
    """
    past = upto(transactions, as_of).where("customerID is not null and ISIN is not null")
    net = past.groupBy("customerID", "ISIN").agg(exact_sum(held_units(F.col("transactionType"), F.col("units"))).alias("net_units"))
    return net.withColumn("currently_held", F.col("net_units") > 0)


def negative_holdings(holdings: DataFrame) -> DataFrame:
    """Positions below zero, which a complete history can't have."""
    return holdings.where("net_units < 0")


def asset_universe(transactions: DataFrame, as_of, eligible=None) -> DataFrame:
    """Distinct ISIN: of a table, its versions up to as_of if it is dated; of an iterable, its
    members; else of the transactions up to as_of."""
    if eligible is None:
        rows = upto(transactions, as_of)
    elif isinstance(eligible, DataFrame):
        rows = upto(eligible, as_of) if "timestamp" in eligible.columns else eligible
    else:
        rows = transactions.sparkSession.createDataFrame([(str(x),) for x in eligible], "ISIN string")
    return rows.select("ISIN").where("ISIN is not null").distinct()


def held_sets(holdings: DataFrame) -> DataFrame:
    """customerID and the sorted array of the ISIN held."""
    return holdings.where("currently_held").groupBy("customerID").agg(F.array_sort(F.collect_set("ISIN")).alias("held"))


@dataclass(frozen=True)
class PointInTimeState:
    """Universe and holdings at one time, for any number of questions."""

    asset_universe: DataFrame
    holdings: DataFrame

    def held(self) -> DataFrame:
        return self.holdings.where("currently_held").select("customerID", "ISIN")

    def all_candidates(self, customers: DataFrame) -> DataFrame:
        """customerID, ISIN: what each of the customers could buy.

        Its size is that of customers times universe, which is the answer's.
        Only the asking customers' trades are added up: the semi join goes
        below the aggregate.  A customer's own assets, a bounded list, travel
        with the customer, so the product is never shuffled.
        """
        asking = customers.select("customerID").distinct()
        own = self.held().join(asking, "customerID", "left_semi").groupBy("customerID").agg(F.collect_set("ISIN").alias("__own"))
        pairs = asking.join(own, "customerID", "left").crossJoin(self.asset_universe)
        return pairs.where(~F.coalesce(F.array_contains("__own", F.col("ISIN")), F.lit(False))).select("customerID", "ISIN")

    def candidates(self, customer) -> set[str]:
        """What one customer could buy; a customer without history the whole universe."""
        held = self.held().where(F.col("customerID") == str(customer)).select("ISIN")
        return {x[0] for x in self.asset_universe.join(held, "ISIN", "left_anti").collect()}

    def held_by(self, customer) -> set[str]:
        return {x[0] for x in self.held().where(F.col("customerID") == str(customer)).select("ISIN").collect()}


def build_point_in_time_state(transactions: DataFrame, as_of, eligible_assets=None) -> PointInTimeState:
    return PointInTimeState(asset_universe(transactions, as_of, eligible_assets), build_holdings_asof(transactions, as_of))


def currently_held_assets(transactions: DataFrame, customer_id, as_of) -> set[str]:
    own = transactions.where(F.col("customerID") == str(customer_id))
    return {x[0] for x in build_holdings_asof(own, as_of).where("currently_held").select("ISIN").collect()}


def get_candidate_assets(transactions: DataFrame, customer_id, eligible_assets=None, as_of=None) -> set[str]:
    if as_of is None:
        raise ValueError("as_of is needed: candidates exist at a time")
    return build_point_in_time_state(transactions, as_of, eligible_assets).candidates(customer_id)
