"""Where the processed tables and splits of a study are, and how to read them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLEAN_FILES, CLEAN_ONLY, DEFAULT, EVENT_ORDER, SCHEMAS, Protocol
from ..operators.conflicts import require_columns
from ..operators.encoding import IDMapping, encode_transactions, fit_id_mapping
from ..operators.graph import TemporalGraphEvents, build_temporal_graph_events
from ..operators.interactions import BaselineInteractions, baseline_interactions
from .files import exists
from .tables import read_csv, read_table

ASOF = ", snapshot_asof_date timestamp_ntz"
SPLITS = ("train", "validation", "test")


def clean_schema(name: str) -> str:
    return ", ".join(x for x in (SCHEMAS[name], CLEAN_ONLY.get(name)) if x)


class TableCatalog:
    """Lazy reads below two folders; nothing is cleaned here.

    kind is "csv" or "parquet".  A table is looked for in processed_dir, then
    in its folder `cleaned`.
    """

    def __init__(self, spark: SparkSession, processed_dir: str, splits_dir: str, *, kind: str = "csv", protocol: Protocol = DEFAULT):
        self.spark, self.processed_dir, self.splits_dir, self.kind, self.protocol = spark, str(processed_dir), str(splits_dir), kind, protocol

    def _name(self, file: str) -> str:
        return file if self.kind == "csv" else file.removesuffix(".csv") + ".parquet"

    def resolve(self, file: str) -> str:
        tried = [f"{self.processed_dir}/{self._name(file)}", f"{self.processed_dir}/cleaned/{self._name(file)}"]
        for path in tried:
            if exists(self.spark, path):
                return path
        raise FileNotFoundError(f"no such table in any of {tried}")

    def load(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.resolve(CLEAN_FILES[name]), clean_schema(name), self.kind)
        require_columns(df, [c.split()[0] for c in SCHEMAS[name].split(", ")], name)
        return df

    def load_customers(self) -> DataFrame:
        return self.load("customers")

    def load_assets(self) -> DataFrame:
        return self.load("assets")

    def load_markets(self) -> DataFrame:
        return self.load("markets")

    def load_close_prices(self) -> DataFrame:
        return self.load("close_prices")

    def load_limit_prices(self) -> DataFrame:
        return self.load("limit_prices")

    def load_transactions(self, *, ordered: bool = False, ordinal: str | None = None) -> DataFrame:
        """ordered: in EVENT_ORDER, a sort of all rows for where the order is looked at; ordinal: a column
        for their order as stored, which the order rule looks at (CSV only)."""
        if ordinal and self.kind == "csv":
            return read_csv(self.spark, self.resolve(CLEAN_FILES["transactions"]), clean_schema("transactions"), ordinal=ordinal)
        df = self.load("transactions")
        return df.orderBy(*EVENT_ORDER) if ordered else df

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in CLEAN_FILES}

    def _split_file(self, path: str, schema: str) -> DataFrame:
        return read_table(self.spark, path if self.kind == "csv" else path.removesuffix(".csv") + ".parquet", schema, self.kind)

    def _folder(self, folder: str, files: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
        return {key: self._split_file(f"{folder}/{file}", schema) for key, (file, schema) in files.items()}

    def primary_path(self, split: str) -> str:
        if split not in SPLITS:
            raise ValueError(f"split must be one of {sorted(SPLITS)}, not {split!r}")
        return f"{self.splits_dir}/primary/{split}_transactions.csv"

    def load_primary_split(self, include_snapshots: bool = True) -> dict[str, DataFrame]:
        out = {s: self.load_split(s) for s in SPLITS}
        return out | self.load_snapshots() if include_snapshots else out

    def load_snapshots(self) -> dict[str, DataFrame]:
        """What was known at the ends of train and validation."""
        out = {}
        for s in SPLITS[:2]:
            out |= self._folder(f"{self.splits_dir}/primary", {
                f"{s}_customer_snapshot": (f"{s}_customer_snapshot.csv", clean_schema("customers") + ASOF),
                f"{s}_asset_snapshot": (f"{s}_asset_snapshot.csv", clean_schema("assets") + ASOF),
                f"{s}_prices": (f"{s}_prices.csv", clean_schema("close_prices")),
            })
        return out

    def _rolling_folder(self, split_id: int) -> tuple[str, str]:
        days = self.protocol.rolling_cutoffs
        if not 1 <= split_id <= len(days):
            raise ValueError(f"split_id must be 1..{len(days)}, not {split_id}")
        return days[split_id - 1], f"{self.splits_dir}/rolling/rolling_{split_id:02d}_{days[split_id - 1]}"

    def load_rolling_split(self, split_id: int) -> dict[str, DataFrame | str]:
        day, folder = self._rolling_folder(split_id)
        parts = {"train": ("train_transactions.csv", clean_schema("transactions")), "test": ("test_transactions.csv", clean_schema("transactions"))}
        return {"cutoff": day} | self._folder(folder, parts) | self.load_rolling_snapshots(split_id)

    def load_rolling_snapshots(self, split_id: int) -> dict[str, DataFrame]:
        """What was known at the cutoff of a window."""
        return self._folder(self._rolling_folder(split_id)[1], {
            "customer_snapshot": ("customer_snapshot.csv", clean_schema("customers") + ASOF), "asset_snapshot": ("asset_snapshot.csv", clean_schema("assets") + ASOF),
            "prices": ("prices_upto_t.csv", clean_schema("close_prices")),
        })

    def load_split(self, split: str) -> DataFrame:
        return self._split_file(self.primary_path(split), clean_schema("transactions"))

    def iter_transaction_batches(self, split: str = "train", *, batch_size: int = 65_536, mapping: IDMapping | None = None, drop_unknown: bool = False) -> Iterator:
        """pandas frames of at most batch_size rows, in EVENT_ORDER over all of them.

        A partition and the one fetched ahead are on the driver, as Arrow.
        Unknown ids raise before the first batch, or their rows are left out.
        """
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        df = self.load_split(split)
        if mapping is not None:
            df = encode_transactions(df, mapping, drop_unknown=drop_unknown)
        return iter_batches(df.orderBy(*EVENT_ORDER), batch_size)

    def fit_train_mapping(self) -> IDMapping:
        return fit_id_mapping(self.load_split("train"))

    def load_baseline_interactions(self, split: str = "train", *, mapping: IDMapping | None = None, buys_only: bool = True, drop_unknown: bool = False) -> BaselineInteractions:
        mapping = self.fit_train_mapping() if mapping is None else mapping
        return baseline_interactions(self.load_split(split), mapping, buys_only=buys_only, drop_unknown=drop_unknown)

    def load_temporal_graph_events(self, split: str = "train", *, mapping: IDMapping | None = None, drop_unknown: bool = False) -> TemporalGraphEvents:
        """Events of the split up to its end."""
        mapping = self.fit_train_mapping() if mapping is None else mapping
        end = {"train": self.protocol.train_end, "validation": self.protocol.validation_end, "test": self.protocol.test_end}
        return build_temporal_graph_events(self.load_split(split), as_of=end[split], mapping=mapping, drop_unknown=drop_unknown)


def iter_batches(df: DataFrame, batch_size: int) -> Iterator:
    """pandas frames of batch_size rows, the last one shorter, in df's order.

    Rows travel in Arrow batches, each packed into one cell.
    """
    import pyarrow as pa

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    held, size = [], 0
    for cell in df.mapInArrow(packed, "rows binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(pa.py_buffer(bytes(cell.rows))).read_all())
        size += held[-1].num_rows
        while size >= batch_size:
            whole = pa.concat_tables(held)
            yield whole.slice(0, batch_size).to_pandas()
            held, size = [whole.slice(batch_size)], size - batch_size
    if size:
        yield pa.concat_tables(held).to_pandas()


def time_ordinal(df: DataFrame) -> DataFrame:
    """df with `ordinal`, its place in EVENT_ORDER counted within days: day * 10**9 + place."""
    from pyspark.sql import Window

    day = F.datediff(F.col("timestamp").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    place = F.row_number().over(Window.partitionBy(F.col("timestamp").cast("date")).orderBy(*EVENT_ORDER))
    return df.withColumn("ordinal", day * 1_000_000_000 + place)
