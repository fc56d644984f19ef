"""One command from raw tables to splits, holdings, graph and reports.  Each gate is an action of its
own that runs before what depends on it is written."""

from __future__ import annotations

import argparse
import atexit
import json
import uuid
from contextlib import contextmanager
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EVENT_ORDER, Protocol
from ..operators.encoding import IDMapping, cold_start_stats, fit_id_mapping
from ..operators.graph import build_temporal_graph_events, edge_snapshot
from ..operators.holdings import build_holdings_asof, negative_holdings
from ..operators.interactions import baseline_interactions
from ..operators.rules import validate_dataset, validate_primary_split, validate_rolling_split
from ..operators.splits import PrimarySplit, RollingSplit, build_primary_split, build_rolling_splits, coverage, rolling_bounds, rolling_summary, split_summary
from ..sources.catalog import TableCatalog
from ..sources.files import remove, write_json
from ..sources.tables import side_by_side, write_table
from .cleaning_run import kept, run_cleaning


PARTS = ("train", "validation", "test")


class _Sink:
    def __init__(self, folder: str, kind: str, compression: str | None = None):
        self.folder, self.kind, self.compression = folder, kind, compression

    def __call__(self, df: DataFrame, name: str, order: list[str] | None = None) -> None:
        write_table(df, f"{self.folder}/{name}.{self.kind}", self.kind, order, self.compression)


def save_primary_split(split: PrimarySplit, folder: str, *, kind: str = "csv", summary: DataFrame | None = None) -> None:
    put = _Sink(folder, kind)
    _save_parts(split, put, PARTS)
    _save_snapshots(split, put)
    if summary is not None:
        put(summary, "primary_split_summary")


def _save_parts(split: PrimarySplit, put: _Sink, names: tuple[str, ...]) -> None:
    side_by_side(lambda x: put(x[1], f"{x[0]}_transactions", EVENT_ORDER), [x for x in split.parts().items() if x[0] in names])


def _save_snapshots(split: PrimarySplit, put: _Sink) -> None:
    tables = []
    for name, customers, assets, prices in (
        ("train", split.customer_snapshot_train, split.asset_snapshot_train, split.prices_upto_train_end),
        ("validation", split.customer_snapshot_validation, split.asset_snapshot_validation, split.prices_upto_validation_end),
    ):
        tables += [(prices, f"{name}_prices", ["ISIN", "timestamp"]), (customers, f"{name}_customer_snapshot", ["customerID"]), (assets, f"{name}_asset_snapshot", ["ISIN"])]
    side_by_side(lambda x: put(*x), tables)


def rolling_folder(item: RollingSplit) -> str:
    return f"rolling_{item.window:02d}_{item.day}"


def save_rolling_splits(splits: list[RollingSplit], folder: str, *, kind: str = "csv", summary: DataFrame | None = None) -> None:
    _save_rolling_parts(splits, folder, kind)
    _save_rolling_snapshots(splits, folder, kind)
    if summary is not None:
        _Sink(folder, kind)(summary, "rolling_split_summary", ["window"])


def _save_rolling_parts(splits: list[RollingSplit], folder: str, kind: str, compression: str | None = None) -> None:
    tables = []
    for item in splits:
        put = _Sink(f"{folder}/{rolling_folder(item)}", kind, compression)
        tables += [(put, item.train, "train_transactions"), (put, item.test, "test_transactions")]
    side_by_side(lambda x: x[0](*x[1:], EVENT_ORDER), tables)


def _save_rolling_snapshots(splits: list[RollingSplit], folder: str, kind: str, compression: str | None = None) -> None:
    tables = []
    for item in splits:
        put = _Sink(f"{folder}/{rolling_folder(item)}", kind, compression)
        tables += [(put, item.prices_upto_t, "prices_upto_t", ["ISIN", "timestamp"]), (put, item.customer_snapshot, "customer_snapshot", ["customerID"]), (put, item.asset_snapshot, "asset_snapshot", ["ISIN"])]
    side_by_side(lambda x: x[0](*x[1:]), tables)


def part_stats(split: PrimarySplit) -> dict[str, dict]:
    """rows, customers, assets, start, end of each part."""
    def stats(df):
        return df.agg(F.count("*").alias("rows"), F.count_distinct("customerID").alias("customers"), F.count_distinct("ISIN").alias("assets"), F.min("timestamp").cast("string").alias("start"), F.max("timestamp").cast("string").alias("end")).head().asDict()

    parts = split.parts()
    return dict(zip(parts, side_by_side(stats, parts.values()), strict=True))


class Checkpoint:
    """The steps of a build.  Each is done once, when it is first asked for, after the gates and steps that it needs; what it
    gives is kept, and its files are whole when it returns.  A gate that fails raises for every step behind it."""

    def __init__(self, spark: SparkSession, *, raw_dir: str, processed_dir: str, output_dir: str, reports_dir: str, skip_clean: bool = False, kind: str = "csv", raw_kind: str = "csv", protocol: Protocol = DEFAULT, single_id_json: bool = False, compression: str | None = None):
        self.spark, self.raw_dir, self.processed_dir, self.output_dir, self.reports_dir = spark, raw_dir, processed_dir, output_dir, reports_dir
        self.skip_clean, self.kind, self.raw_kind, self.protocol, self.single_id_json, self.compression = skip_clean, kind, raw_kind, protocol, single_id_json, compression
        self._put = self._sink(f"{output_dir}/primary")

    def _sink(self, folder: str) -> _Sink:
        return _Sink(folder, self.kind, self.compression)

    @cached_property
    def cleaning(self) -> dict | None:
        if self.skip_clean:
            return None
        return run_cleaning(self.spark, self.raw_dir, self.processed_dir, f"{self.reports_dir}/cleaning_report.json", kind=self.kind, raw_kind=self.raw_kind, compression=self.compression)

    @cached_property
    def catalog(self) -> TableCatalog:
        _ = self.cleaning
        return TableCatalog(self.spark, self.processed_dir, self.output_dir, kind=self.kind, protocol=self.protocol)

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        """The clean tables as read, transactions with their stored order: parsed once and copied as Parquet, which takes less of
        the disk than kept rows do, and of which each step reads its columns."""
        tables, copy = self.catalog.load_all(), f"{self.output_dir}/transactions-copy-{uuid.uuid4().hex[:12]}"
        tx = self.catalog.load_transactions(ordinal="ordinal")
        self._copy = copy
        atexit.register(self.close)
        tx.write.option("compression", "zstd").parquet(copy)
        return tables | {"transactions": self.spark.read.schema(tx.schema).parquet(copy)}

    def close(self) -> None:
        """Removes the copy of transactions, which steps and what they give read."""
        if self._copy is not None:
            remove(self.spark, self._copy)

    _copy: str | None = None

    @cached_property
    def quality(self) -> dict:
        others = {name: df for name, df in self._tables.items() if name != "transactions"}
        with kept(others):  # each rule reads them
            report = validate_dataset(self._tables, self.protocol)
        write_json(self.spark, f"{self.reports_dir}/data_quality_report.json", report)
        if not report["ok"]:
            raise ValueError("the tables break rules: " + "; ".join(report["errors"]))
        return report

    @cached_property
    def data(self) -> dict[str, DataFrame]:
        """The clean tables, once they have passed the rules."""
        _ = self.quality
        return self._tables | {"transactions": self._tables["transactions"].drop("ordinal")}

    @contextmanager
    def reading(self):
        """Transactions that have passed the rules."""
        yield self.data["transactions"]

    def _inputs(self) -> tuple[DataFrame, ...]:
        return tuple(self.data[name] for name in ("transactions", "customers", "assets", "close_prices"))

    @cached_property
    def primary(self) -> PrimarySplit:
        """With the transactions of its parts written."""
        with self.reading():
            _ = self.train_part
            _save_parts(self._split(), self._put, PARTS[1:])
        return build_primary_split(*self._inputs(), self.protocol)

    @cached_property
    def train_part(self) -> None:
        with self.reading():
            _save_parts(self._split(), self._put, PARTS[:1])

    @cached_property
    def snapshots(self) -> None:
        _save_snapshots(build_primary_split(*self._inputs(), self.protocol), self._put)

    @cached_property
    def summary(self) -> DataFrame:
        with self.reading() as tx:
            out = split_summary(tx, self.protocol)
            self._put(out, "primary_split_summary")
            self._sink(self.reports_dir)(out, "primary_split_summary")
        return out

    @cached_property
    def rolling(self) -> list[RollingSplit]:
        with self.reading() as tx:
            splits, windows = build_rolling_splits(*self._inputs(), self.protocol), rolling_summary(tx, self.protocol)
            _save_rolling_parts(splits, f"{self.output_dir}/rolling", self.kind, self.compression)
            _ = self.rolling_snapshots
            for folder in (f"{self.output_dir}/rolling", self.reports_dir):
                self._sink(folder)(windows, "rolling_split_summary", ["window"])
        return splits

    @cached_property
    def rolling_snapshots(self) -> None:
        _save_rolling_snapshots(build_rolling_splits(*self._inputs(), self.protocol), f"{self.output_dir}/rolling", self.kind, self.compression)

    @cached_property
    def held(self) -> DataFrame:
        with self.reading() as tx:
            held = build_holdings_asof(tx, self.protocol.train_end)
            self._put(held, "holdings_asof_train_end", _PAIR)
            self._put(build_holdings_asof(tx, self.protocol.validation_end), "holdings_asof_validation_end", _PAIR)
        return held

    @cached_property
    def rolling_held(self) -> None:
        with self.reading() as tx:
            for n, day, cutoff, _ in rolling_bounds(self.spark, self.protocol):
                self._sink(f"{self.output_dir}/rolling/rolling_{n:02d}_{day}")(build_holdings_asof(tx, cutoff), "holdings_asof_cutoff", _PAIR)

    def _split(self) -> PrimarySplit:
        """The parts alone: no snapshots are made, nor their tables read and checked."""
        return build_primary_split(self.data["transactions"], protocol=self.protocol)

    def _train(self) -> DataFrame:
        return self._split().train

    @cached_property
    def mapping(self) -> IDMapping:
        with self.reading():
            mapping = fit_id_mapping(self._train(), fitted_on="primary_train")
            mapping.save(f"{self.output_dir}/id_mapping.json", single=self.single_id_json)
        return IDMapping.load(self.spark, f"{self.output_dir}/id_mapping.json", mapping.fitted_on)  # read, not fitted again by each reader

    @cached_property
    def graph(self) -> DataFrame:
        with self.reading():
            events = build_temporal_graph_events(self._train(), as_of=self.protocol.train_end, mapping=self.mapping).frame
            self._put(events, "train_graph_events", EVENT_ORDER)
        return events

    @cached_property
    def edges(self) -> DataFrame:
        with self.reading():
            edges = edge_snapshot(build_temporal_graph_events(self._train(), as_of=self.protocol.train_end, mapping=self.mapping).frame)
            self._put(edges, "train_graph_snapshot", ["src_customer_idx", "dst_asset_idx"])
        return edges

    @cached_property
    def pairs(self) -> DataFrame:
        with self.reading():
            pairs = baseline_interactions(self._train(), self.mapping, value=True).pairs
            self._put(pairs.select("customer_idx", "asset_idx", "weight", "total_value", "last_timestamp"), "train_baseline_interactions", ["customer_idx", "asset_idx"])
        return pairs

    @cached_property
    def parts(self) -> dict[str, dict]:
        with self.reading():
            return part_stats(self._split())

    @cached_property
    def cold_start(self) -> dict[str, dict]:
        with self.reading():
            split = self._split()
            return {name: cold_start_stats(getattr(split, name), self.mapping) for name in ("validation", "test")}

    @cached_property
    def report(self) -> dict:
        """Of a whole build, every step done."""
        others = {name: self.data[name] for name in ("customers", "assets", "close_prices")}
        with self.reading() as tx, kept(others):  # every snapshot reads them
            mapping = self.mapping  # steps that only need it and the tables are done side by side
            steps = "primary", "rolling", "graph", "held", "rolling_held", "edges", "pairs", "snapshots", "summary", "parts", "cold_start"
            side_by_side(lambda step: getattr(self, step), steps)
            primary, rolling = self.primary, self.rolling
            checks = [lambda: validate_primary_split(primary), lambda: coverage(tx, self.protocol), self.graph.count, self.edges.count, self.pairs.count, lambda: negative_holdings(self.held).count()]
            leaks, covered, events, edges, pairs, negative, *rolling_leaks = side_by_side(lambda f: f(), checks + [partial(validate_rolling_split, x) for x in rolling])
            report = self.quality | {
                "ok": self.quality["ok"] and leaks["ok"] and all(x["ok"] for x in rolling_leaks) and covered["ok"],
                "cleaning": self.cleaning, "primary_split": self.parts | {"coverage": covered},
                "cold_start_against_train_mapping": self.cold_start,
                "temporal_graph": {"events": events, "snapshot_edges": edges, "customers": mapping.num_customers, "assets": mapping.num_assets, "as_of": self.protocol.train_end},
                "baseline": {"train_buy_pairs": pairs, "mapping_fitted_on": mapping.fitted_on},
                "negative_holdings": negative, "primary_leakage": leaks, "rolling_leakage": rolling_leaks,
            }
            write_json(self.spark, f"{self.reports_dir}/checkpoint1_report.json", report)
        if not report["ok"]:
            raise ValueError(f"leakage or coverage checks failed; see {self.reports_dir}/checkpoint1_report.json")
        return report


_PAIR = ["customerID", "ISIN"]


def build_checkpoint(spark: SparkSession, **how) -> dict:
    """Everything, in order; arguments as of Checkpoint.  File names, flags and the reports' keys are fixed values; single_id_json
    writes the id mapping as one JSON document, which must fit the driver, instead of JSON lines."""
    checkpoint = Checkpoint(spark, **how)
    try:
        return checkpoint.report
    finally:
        checkpoint.close()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Build splits, holdings, graph and reports")
    parser.add_argument("--raw-dir", default="data/raw")
    parser.add_argument("--processed-dir", default="data/processed")
    parser.add_argument("--output-dir", default="data/splits")
    parser.add_argument("--reports-dir", default="reports")
    parser.add_argument("--skip-clean", action="store_true")
    parser.add_argument("--single-id-json", action="store_true")
    args = parser.parse_args(argv)
    report = build_checkpoint(SparkSession.builder.getOrCreate(), **vars(args))
    print(json.dumps(report["primary_split"], indent=2))


if __name__ == "__main__":
    main()
