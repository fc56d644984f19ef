"""Reading and writing the tables, as CSV for other tools or as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NA_TOKENS, RAW_FILES, SCHEMAS
from ..operators.conflicts import require_columns
from .files import exists


#: actions that run side by side
AT_ONCE = 4
#: tables with most rows; their actions start first, so that small ones run beside them and not before
LONG = ("transactions", "close_prices", "limit_prices")


def read_csv(spark: SparkSession, path: str, schema: str, *, ordinal: str | None = None) -> DataFrame:
    """A CSV file or folder with a header, its columns found by name, in any order.

    Cells that spell a missing value are null.  A cell that is there but is no
    value of its column's type raises when it is read, rather than turn into a
    null that a cleaner would drop.  Columns that the schema doesn't name are
    kept as text.  ordinal names a column for the rows' order as stored: by
    file name, then by place, as a file with records over several lines is
    read by one task from beginning to end.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no such table: {path}")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    types = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    columns = []
    for name in raw.columns:
        cell = F.col(f"`{name}`")
        cell = F.when(~cell.isin(*NA_TOKENS), cell)
        columns.append(cell.cast(types.get(name, T.StringType())).alias(name))
    return stored_order(raw, columns, ordinal) if ordinal else raw.select(*columns)


def stored_order(raw: DataFrame, columns: list, ordinal: str) -> DataFrame:
    """columns of raw, a scan whose files aren't split, and the rows' stored order."""
    place = raw.select(*columns, F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    names = sorted({f.rsplit("/", 1)[-1] for f in raw.inputFiles()})
    number = F.broadcast(raw.sparkSession.createDataFrame(list(enumerate(names)), "__number long, __name string"))  # a row a file
    out = place.join(number, F.url_decode(F.col("__file")) == F.url_decode(F.col("__name")))
    return out.withColumn(ordinal, F.col("__number") * F.lit(1 << 33) + F.col("__place")).drop("__file", "__place", "__number", "__name")


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "csv") -> DataFrame:
    if kind == "csv":
        return read_csv(spark, path, schema or "")
    if not exists(spark, path):
        raise FileNotFoundError(f"no such table: {path}")
    return spark.read.parquet(str(path))


def write_table(df: DataFrame, path: str, kind: str = "csv", order: list[str] | None = None, compression: str | None = None) -> None:
    """Write a folder; sorted by `order` over all files, if given, which are compressed, if asked for."""
    out = (df.orderBy(*order) if order else df).write.mode("overwrite")
    if compression is not None:
        out = out.option("compression", compression)
    if kind == "csv":
        out.option("header", True).option("escape", '"').csv(str(path))
    else:
        out.parquet(str(path))


def side_by_side(f: Callable, items: Iterable) -> list:
    """f of each item, actions of several running at once, as those of small tables leave cores idle; items named in LONG
    start first.  Results are in the items' order; of errors the first in that order is raised, once all have ended."""
    items = list(items)
    order = sorted(range(len(items)), key=lambda k: LONG.index(items[k]) if items[k] in LONG else len(LONG))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = {k: pool.submit(f, items[k]) for k in order}
    return [done[k].result() for k in range(len(items))]


def load_raw_tables(spark: SparkSession, folder: str, kind: str = "csv", names: list[str] | None = None) -> dict[str, DataFrame]:
    """All six, or the named ones."""
    out = {}
    for name, file in RAW_FILES.items():
        if names is not None and name not in names:
            continue
        path = f"{folder}/{file}" if kind == "csv" else f"{folder}/{file.removesuffix('.csv')}.parquet"
        out[name] = read_table(spark, path, SCHEMAS[name], kind)
        require_columns(out[name], ["marketID"] if name == "markets" else [c.split()[0] for c in SCHEMAS[name].split(", ")], name)
    return out
