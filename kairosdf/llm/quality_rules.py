"""Quality rules: base rules, then an isolation forest on the rules' statistics.

Random splits isolate an unusual document after few of them: the mean depth at
which a row ends in trees of random (statistic, value) splits, against the
depth expected of an unsuccessful search, is its anomaly score.  The trees are
grown on a bounded sample of the rows; the threshold on the score comes from
the labelled rows: all of them are scored, and the cut that errs least, a good
document lost counting `good_weight` times a bad one kept, is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import COUNTS, RATES, rates, vectors
from .store import Work

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORE_BINS = 2000


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeat = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    return (words < 50) | (100 * repeat > 50 * words)


def _expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2.000001)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


class IsolationForest:
    """Trees as flat arrays: split statistic (-1: leaf), value, left child (right is next), depth at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = 200, per_tree: int = 256, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.per_tree = max(2, min(per_tree, len(rows)))
        self.depth = int(np.ceil(np.log2(self.per_tree)))
        self.trees = [self._grow(rows[rng.choice(len(rows), min(self.per_tree, len(rows)), replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, left, leaf = [], [], [], []

        def new(x: np.ndarray, depth: int) -> tuple[int, np.ndarray, int]:
            column.append(-1), value.append(0.0), left.append(0), leaf.append(depth + float(_expected_depth(len(x))))
            return len(column) - 1, x, depth

        todo = [new(rows, 0)]
        while todo:
            at, x, depth = todo.pop()
            usable = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else ()
            if depth >= self.depth or not len(usable):
                continue
            j = int(rng.choice(usable))
            cut = rng.uniform(x[:, j].min(), x[:, j].max())
            below = x[:, j] <= cut
            column[at], value[at], left[at] = j, cut, len(column)
            todo += [new(x[below], depth + 1), new(x[~below], depth + 1)]
        return np.array(column), np.array(value), np.array(left), np.array(leaf)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the easier to isolate."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, value, left, leaf in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                j = column[at]
                go = j >= 0
                at = np.where(go, left[at] + (rows[every, j] > value[at]), at)
            total += leaf[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(1e-9, float(_expected_depth(self.per_tree))))


def best_threshold(good: np.ndarray, bad: np.ndarray, good_weight: float) -> float:
    """The bin edge above which to reject, from histograms of the scores of labelled rows over [0, 1]."""
    if not bad.sum():
        return 1.0
    good, bad = good / max(1, good.sum()), bad / max(1, bad.sum())
    cost = [good_weight * good[k:].sum() + bad[:k].sum() for k in range(len(good) + 1)]
    # the middle of the cheapest stretch
    cheapest = np.flatnonzero(np.isclose(cost, min(cost)))
    return float(cheapest[len(cheapest) // 2]) / len(good)


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", sample_rows: int = 20_000, trees: int = 200, per_tree: int = 256, good_weight: float = 3.0, seed: int = 17
) -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, anomaly_score, kept.

    sample_rows bounds the rows (those with the smallest hashes of their id)
    on which trees are grown, each on per_tree of them: an isolation forest's
    trees are grown on small subsamples by design.  Statistics, scores and the
    calibration cover all rows.  A document that is labelled several times
    counts as often in the calibration; texts of any length are read whole; an empty table gives an empty result.  Null and wordless texts have zero words and fail the base rules.
    Without labelled bad rows nothing is an anomaly.  Rows without an id are
    scored like others; repeated rows are each returned.  Only the named
    columns are read, whatever others there are.
    """
    spark = docs.sparkSession
    work = Work(spark, "rules")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in BASE] + [("base_failed", pa.bool_()), ("rates", pa.list_(pa.float32()))])

    def statistics(rows: pa.RecordBatch, counts: np.ndarray) -> list[pa.Array]:
        flat = rates(counts).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(RATES)), pa.array(flat.ravel()))
        return [rows.column(0), *(pa.array(counts[:, COUNTS.index(c)]) for c in BASE), pa.array(base_failed(counts)), lists]

    spelt = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, rates array<float>"
    stats = work.table("statistics", base.mapInArrow(vectors(schema, 1, statistics), spelt))

    # rows that the base rules keep; the bound on the sample is sample_rows
    passed = stats.where("not base_failed")
    sample = passed.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows).select("rates").toArrow()
    if sample.num_rows:
        forest = IsolationForest(np.array(sample["rates"].to_pylist(), float), trees, per_tree, seed)
    else:
        forest = None
    scored = work.table("scored", _scored(stats, forest))
    work.drop("statistics")

    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    bins = scored.where("not base_failed").join(marks, "doc_id").groupBy(F.least(F.floor(F.col("anomaly_score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).alias("bin"), "label").count().collect()
    good, bad = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for row in bins:
        (good if row["label"] else bad)[int(row["bin"])] += row["count"]
    threshold = best_threshold(good, bad, good_weight)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly_score") < threshold))


def _scored(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """The statistics with anomaly_score in place of rates."""
    names = ["doc_id", *BASE, "base_failed"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("anomaly_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("rates").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(RATES))
            score = np.zeros(len(x)) if forest is None else forest.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], schema=schema)

    return stats.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.drop("rates").schema) + ", anomaly_score double")
