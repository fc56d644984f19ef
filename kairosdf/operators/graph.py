"""Temporal bipartite graph: an ordered event stream, edge snapshots, calendar windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EVENT_ORDER
from ..functions.scalars import calendar_bucket, epoch_seconds, exact_sum, is_buy, log_value, message, signed_log, timestamp, traded_units
from .asof import upto
from .conflicts import require_columns
from .encoding import IDMapping, encode_transactions, fit_id_mapping

EVENT_COLUMNS = [
    "event_id", "customerID", "ISIN", "transactionID", "src_customer_idx", "dst_asset_idx", "src_node_idx", "dst_node_idx",
    "timestamp", "unix_timestamp", "event_type", "is_buy", "signed_units", "total_value",
]
NEEDED = ["customerID", "ISIN", "transactionID", "transactionType", "timestamp", "units", "totalValue"]


def event_columns(encoded: DataFrame, num_customers: int) -> DataFrame:
    """The event's columns from encoded transactions; no state, so streams can be mapped too."""
    kind, at = F.col("transactionType"), timestamp(F.col("timestamp"))
    return encoded.select(
        F.concat_ws(":", "customerID", "transactionID").alias("event_id"), "customerID", "ISIN", "transactionID",
        F.col("customer_idx").alias("src_customer_idx"), F.col("asset_idx").alias("dst_asset_idx"),
        F.col("customer_idx").alias("src_node_idx"), (F.lit(num_customers).cast("long") + F.col("asset_idx")).alias("dst_node_idx"),
        at.alias("timestamp"), epoch_seconds(at).alias("unix_timestamp"), kind.alias("event_type"), is_buy(kind).alias("is_buy"),
        traded_units(kind, F.col("units")).alias("signed_units"), F.col("totalValue").cast("double").alias("total_value"),
    )


@dataclass(frozen=True)
class TemporalGraphEvents:
    """frame: EVENT_COLUMNS, not sorted; ordered() sorts.  Asset nodes come after customer nodes."""

    frame: DataFrame
    mapping: IDMapping
    as_of: str

    @cached_property
    def num_customers(self) -> int:
        return self.mapping.num_customers

    @cached_property
    def num_assets(self) -> int:
        return self.mapping.num_assets

    @property
    def num_nodes(self) -> int:
        return self.num_customers + self.num_assets

    def ordered(self) -> DataFrame:
        return self.frame.orderBy(*EVENT_ORDER)

    def messages(self) -> DataFrame:
        """Source, target, time, features and label of each event, in columns for a tensor library."""
        return event_messages(self.frame)

    def to_temporal_data(self):
        """A torch-geometric TemporalData of all events, which must fit the driver."""
        try:
            import torch
            from torch_geometric.data import TemporalData
        except ImportError as e:
            raise ImportError("torch and torch-geometric are needed for to_temporal_data()") from e
        rows = self.ordered().select("src_node_idx", "dst_node_idx", "unix_timestamp", "is_buy", "signed_units", "total_value")
        x = event_messages(rows).toPandas()
        tensor = lambda c, kind: torch.as_tensor(x[c].to_numpy(), dtype=kind)
        features = torch.as_tensor(x["msg"].tolist(), dtype=torch.float32)
        return TemporalData(src=tensor("src", torch.long), dst=tensor("dst", torch.long), t=tensor("t", torch.long), msg=features, y=tensor("y", torch.long))


def event_messages(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("src_node_idx").alias("src"), F.col("dst_node_idx").alias("dst"), F.col("unix_timestamp").alias("t"),
        message(F.col("signed_units"), F.col("total_value"), F.col("is_buy")).alias("msg"), F.col("is_buy").cast("long").alias("y"),
    )


def message_features(events: DataFrame) -> DataFrame:
    """event_id with the logs that make up its message, as doubles."""
    return events.select("event_id", "is_buy", signed_log(F.col("signed_units")).alias("signed_log_units"), log_value(F.col("total_value")).alias("log_total_value"))


def build_temporal_graph_events(transactions: DataFrame, *, as_of, mapping: IDMapping | None = None, drop_unknown: bool = False) -> TemporalGraphEvents:
    """Events up to as_of.  Without a mapping one is fitted on those events; an empty mapping is one
    that knows nobody, so it raises or drops, and is never refitted."""
    require_columns(transactions, NEEDED, "transactions")
    past = upto(transactions, as_of)
    if mapping is None:
        mapping = fit_id_mapping(past, fitted_on=f"events up to {as_of}")
    encoded = encode_transactions(past, mapping, drop_unknown=drop_unknown, what="graph events")
    return TemporalGraphEvents(event_columns(encoded, mapping.num_customers), mapping, str(as_of))


def edge_snapshot(events: DataFrame) -> DataFrame:
    """One row per (customer, asset) edge of an event frame."""
    buy = F.col("is_buy").cast("long")
    return events.groupBy("src_customer_idx", "dst_asset_idx").agg(
        F.count("*").alias("event_count"), F.sum(buy).alias("buy_count"), F.sum(1 - buy).alias("sell_count"),
        exact_sum(F.col("signed_units")).alias("net_units"), exact_sum(F.col("total_value")).alias("total_value"), F.max("timestamp").alias("last_timestamp"),
    )


def build_interaction_snapshot(transactions: DataFrame, as_of, *, mapping: IDMapping | None = None) -> DataFrame:
    return edge_snapshot(build_temporal_graph_events(transactions, as_of=as_of, mapping=mapping).frame)


def with_window(events: DataFrame, frequency: str = "ME", column: str = "timestamp") -> DataFrame:
    """events with window_start, the first moment of their calendar period."""
    return events.withColumn("window_start", calendar_bucket(F.col(column), frequency))


def window_counts(events: DataFrame, frequency: str = "ME", column: str = "timestamp") -> DataFrame:
    return with_window(events, frequency, column).groupBy("window_start").agg(F.count("*").alias("n_events"))


def iter_event_windows(events: DataFrame, frequency: str = "ME", column: str = "timestamp", *, folder: str | None = None) -> Iterator[tuple[object, DataFrame]]:
    """(first moment, events) of each calendar period that has any, in order; the events stay distributed.

    folder: where the events are written once, a partition for each period, so
    that a period's frame reads its own files; without it each filters events.
    """
    windowed = with_window(events, frequency, column).where("window_start is not null")
    if folder is not None:
        name = windowed.withColumn("__window", F.date_format("window_start", "yyyyMMddHH"))
        name.repartition("__window").write.mode("overwrite").partitionBy("__window").parquet(folder)
        windowed = events.sparkSession.read.schema(name.schema).parquet(folder)
    for row in windowed.select("window_start").distinct().orderBy("window_start").collect():
        own = windowed.where(F.col("__window") == f"{row[0]:%Y%m%d%H}").drop("__window") if folder is not None else windowed.where(F.col("window_start") == timestamp(row[0]))
        yield row[0], own.drop("window_start")
