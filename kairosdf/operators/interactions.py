"""Sparse interactions for baselines: a weight for each pair of customer and asset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum
from .encoding import IDMapping, encode_transactions


def pair_counts(encoded: DataFrame, *, value: bool = False) -> DataFrame:
    """customer_idx, asset_idx, weight, last_timestamp, and total_value if asked for."""
    total = [exact_sum(F.col("totalValue")).alias("total_value")] if value else []
    return encoded.groupBy("customer_idx", "asset_idx").agg(F.count("*").cast("float").alias("weight"), *total, F.max("timestamp").alias("last_timestamp"))


@dataclass(frozen=True)
class BaselineInteractions:
    """pairs: (customer_idx, asset_idx, weight, last_timestamp) of a matrix of the mapping's shape."""

    pairs: DataFrame
    mapping: IDMapping

    @property
    def shape(self) -> tuple[int, int]:
        return self.mapping.num_customers, self.mapping.num_assets

    def coo_batches(self, batch_size: int = 65_536) -> Iterator[tuple]:
        """numpy arrays (row, column, weight, last timestamp) of at most batch_size pairs each, by row and column
        over all of them; a partition and the one fetched ahead are on the driver."""
        from ..sources.catalog import iter_batches

        for x in iter_batches(self.pairs.orderBy("customer_idx", "asset_idx"), batch_size):
            yield tuple(x[c].to_numpy() for c in ("customer_idx", "asset_idx", "weight", "last_timestamp"))

    def to_coo(self):
        """The same of all pairs at once; they must fit the driver."""
        x = self.pairs.orderBy("customer_idx", "asset_idx").toPandas()
        return x["customer_idx"].to_numpy(), x["asset_idx"].to_numpy(), x["weight"].to_numpy(), x["last_timestamp"].to_numpy()

    def to_csr(self):
        try:
            from scipy.sparse import coo_matrix
        except ImportError as e:
            raise ImportError("scipy is needed for to_csr()") from e
        row, column, weight, _ = self.to_coo()
        return coo_matrix((weight, (row, column)), shape=self.shape).tocsr()


def baseline_interactions(transactions: DataFrame, mapping: IDMapping, *, buys_only: bool = True, drop_unknown: bool = False, value: bool = False) -> BaselineInteractions:
    """Purchases, or all, are chosen before ids are encoded: a sale by an unknown customer doesn't raise."""
    chosen = transactions.where("transactionType = 'Buy'") if buys_only else transactions
    return BaselineInteractions(pair_counts(encode_transactions(chosen, mapping, drop_unknown=drop_unknown), value=value), mapping)
