"""Dense integer ids, fitted on training history only, and cold-start checks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ids that are looked at to cut the id space into ranges
BOUNDARY_SAMPLE, RANGES = 4096, 256


def dense_ids(df: DataFrame, column: str, index: str) -> DataFrame:
    """(column, index): 0 to n-1 in the order of the distinct, non-null values.

    The values are cut into ranges at bounds from a fixed-size sample; an
    index is the count of the ranges before plus the place within the range,
    so no task sorts all values.
    """
    # kept, as four passes read them; what an executor loses is computed again
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().persist()
    sample = sorted(x[0] for x in ids.orderBy(F.xxhash64(column), column).limit(BOUNDARY_SAMPLE).collect())
    bounds = sample[:: max(1, len(sample) // RANGES)]
    kind = df.schema[column].dataType
    array = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast("array<string>")
    own = F.size(F.filter(array, lambda b: b <= F.col(column))) if len(bounds) > 1 else F.lit(0)
    ranged = ids.withColumn("range", own)
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # RANGES rows at most
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(column))
    return ranged.withColumn("place", place).join(F.broadcast(before), "range").select(column, (F.col("before") + F.col("place") - 1).cast("long").alias(index))


@dataclass(frozen=True)
class IDMapping:
    """customers: (customerID, customer_idx); assets: (ISIN, asset_idx)."""

    customers: DataFrame
    assets: DataFrame
    fitted_on: str = "train"

    @cached_property
    def num_customers(self) -> int:
        return self.customers.count()

    @cached_property
    def num_assets(self) -> int:
        return self.assets.count()

    def dicts(self) -> tuple[dict[str, int], dict[str, int]]:
        """Both maps on the driver, for the edges of a program only."""
        return tuple({x[0]: int(x[1]) for x in m.collect()} for m in (self.customers, self.assets))

    def save(self, path: str, *, single: bool = False) -> None:
        """Two tables beside path, and at path a folder of JSON lines (kind, id, idx) in the order of kind and idx.

        single: instead one JSON document at path, with both maps, which must fit the driver.
        """
        from ..sources.files import write_text

        for name, m in (("customers", self.customers), ("assets", self.assets)):
            m.write.mode("overwrite").parquet(f"{path}.tables/{name}")
        if not single:
            lines = self.customers.selectExpr("'customer' as kind", "cast(customerID as string) as id", "customer_idx as idx")
            lines = lines.union(self.assets.selectExpr("'asset' as kind", "cast(ISIN as string) as id", "asset_idx as idx"))
            lines.orderBy(F.desc("kind"), "idx").write.mode("overwrite").json(path)
            return
        c, a = self.dicts()
        order = lambda d: dict(sorted(d.items(), key=lambda x: x[1]))
        text = json.dumps({"fitted_on": self.fitted_on, "customer_to_idx": order(c), "asset_to_idx": order(a)}, ensure_ascii=False, indent=2)
        write_text(self.customers.sparkSession, path, text)

    @staticmethod
    def load(spark, path: str, fitted_on: str = "train") -> IDMapping:
        return IDMapping(spark.read.parquet(f"{path}.tables/customers"), spark.read.parquet(f"{path}.tables/assets"), fitted_on)


def fit_id_mapping(transactions: DataFrame, fitted_on: str = "train") -> IDMapping:
    return IDMapping(dense_ids(transactions, "customerID", "customer_idx"), dense_ids(transactions, "ISIN", "asset_idx"), fitted_on)


class FittedWhenRead:
    """The IDMapping of transactions, fitted when something of it is first asked for, as who has them narrower fits on those."""

    def __init__(self, transactions: DataFrame, fitted_on: str = "train"):
        self._how = transactions, fitted_on

    @cached_property
    def _mapping(self) -> IDMapping:
        return fit_id_mapping(*self._how)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._mapping, name)


def build_id_mapping(transactions: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """The two maps as dictionaries."""
    return fit_id_mapping(transactions).dicts()


def cold_start_stats(df: DataFrame, mapping: IDMapping) -> dict[str, int]:
    return cold_start_table(df, mapping).head().asDict()


def with_indexes(df: DataFrame, mapping: IDMapping, how: str = "left") -> DataFrame:
    """df with customer_idx and asset_idx; null, or without the row for inner, where unknown."""
    return df.join(mapping.customers, "customerID", how).join(mapping.assets, "ISIN", how)


def cold_start_table(df: DataFrame, mapping: IDMapping) -> DataFrame:
    """One row: rows, rows with an unknown customer, asset, any, and the distinct unknown ids."""
    x = with_indexes(df.select("customerID", "ISIN"), mapping)
    c, a = F.col("customer_idx").isNull(), F.col("asset_idx").isNull()
    return x.agg(
        F.count("*").alias("rows"), F.count_if(c).alias("unknown_customer_rows"), F.count_if(a).alias("unknown_asset_rows"), F.count_if(c | a).alias("unknown_any_rows"),
        F.count_distinct(F.when(c, F.col("customerID"))).alias("unknown_customers"), F.count_distinct(F.when(a, F.col("ISIN"))).alias("unknown_assets"),
    )


def encode_transactions(df: DataFrame, mapping: IDMapping, *, drop_unknown: bool = False, what: str = "transactions") -> DataFrame:
    """All columns of df, then customer_idx and asset_idx.  Unknown ids raise, or their rows go.

    Whether there are any is asked of the distinct ids; rows are counted only to say how many.
    """
    if not drop_unknown:
        names = ((mapping.customers, "customerID"), (mapping.assets, "ISIN"))
        unknown = [df.where(F.col(c).isNull()).select(F.lit(1)).limit(1).union(df.select(c).distinct().join(m, c, "left_anti").select(F.lit(1)).limit(1)) for m, c in names]
        if not unknown[0].union(unknown[1]).isEmpty():
            n = cold_start_stats(df, mapping)
            raise ValueError(f"{what}: {n['unknown_any_rows']} cold-start rows ({n['unknown_customers']} customers and {n['unknown_assets']} assets not in the mapping fitted on {mapping.fitted_on!r})")
    return with_indexes(df, mapping, "inner").select(*[f"`{c}`" for c in df.columns], "customer_idx", "asset_idx")
