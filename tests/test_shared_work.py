"""Work that steps and checks share: done once, side by side, or not at all where it isn't read."""

import os

import pytest
from pyspark.sql import functions as F
from test_build import write_raw

from kairosdf.operators import conflicts, splits
from kairosdf.plans import build, study_queries
from kairosdf.sources.tables import read_csv, side_by_side, write_table


def test_side_by_side_keeps_the_order_of_results_and_errors():
    ended = []

    def f(n):
        if n in (2, 4):
            raise ValueError(n)
        ended.append(n)
        return -n

    assert side_by_side(f, [1, 3, 5]) == [-1, -3, -5]
    with pytest.raises(ValueError, match="2"):
        side_by_side(f, [1, 4, 2, 3][::-1])
    assert sorted(ended) == [1, 1, 3, 3, 5]


def test_counts_by_value_equal_those_by_row(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), (None, "2"), (None, "2"), ("c", None), ("d", None)], "customerID string, transactionID string")
    known = spark.createDataFrame([("a",), (None,)], "customerID string")
    assert conflicts.count_unmatched(rows, "customerID", known) == conflicts.unmatched(rows, "customerID", known).count() == 5
    assert conflicts.count_unmatched(rows.limit(0), "customerID", known) == 0
    keys = ["customerID", "transactionID"]
    assert conflicts.key_counts(rows, keys, "transactionID") == (rows.select(*keys).distinct().count(), conflicts.reused_ids(rows).count()) == (5, 2)
    assert conflicts.key_counts(rows.limit(0), keys, "transactionID") == (0, 0)


def test_places_in_stored_order_are_found_without_a_shuffle_of_rows(spark, tmp_path):
    write_table(spark.range(500).repartition(7).select(F.col("id").cast("string").alias("x")), f"{tmp_path}/t.csv", order=["x"])
    df = read_csv(spark, f"{tmp_path}/t.csv", "x string", ordinal="ordinal")
    out = study_queries._in_stored_order(df, ["x"])
    assert [r.x for r in out.orderBy("place").collect()] == sorted(map(str, range(500)))
    assert sorted(r.place for r in out.collect()) == list(range(500))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # that of a row a file


def test_variants_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, x string")
    out = study_queries._with_variants(df, (F.col("x") == "a", {"x": F.lit(None).cast("string")}), (F.lit(True), {"n": F.col("n") + 10}))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, "a"), (1, None), (11, "a"), (2, None), (12, None)]))
    assert "named_struct" not in out._jdf.queryExecution().optimizedPlan().toString()  # rows aren't built six times over


def test_steps_that_read_parts_only_check_no_versions(spark, tmp_path, monkeypatch):
    (tmp_path / "raw").mkdir()
    write_raw(tmp_path / "raw")
    c = build.Checkpoint(spark, raw_dir=f"{tmp_path}/raw", processed_dir=f"{tmp_path}/processed", output_dir=f"{tmp_path}/splits", reports_dir=f"{tmp_path}/reports")
    for name in ("get_customer_snapshot_asof", "get_asset_snapshot_asof"):
        monkeypatch.setattr(splits, name, lambda *x, **y: pytest.fail("a snapshot was made"))
    assert c.cold_start["test"]["unknown_any_rows"] == 0 and c.parts["train"]["customers"] == 8
    assert c.mapping.num_customers == 8 and c.graph.count() == c.parts["train"]["rows"]
    _ = c.train_part
    assert os.path.isdir(f"{tmp_path}/splits/primary/train_transactions.csv") and not os.path.exists(f"{tmp_path}/splits/primary/test_transactions.csv")


def test_long_tables_start_first_and_come_back_in_order():
    import threading

    started, gate = [], threading.Barrier(2)

    def f(name):
        started.append(name)
        gate.wait(30)  # in pairs, so that no name starts before the first four are taken
        return name.upper()

    names = ["customers", "assets", "markets", "close_prices", "limit_prices", "transactions"]
    assert side_by_side(f, names) == [x.upper() for x in names]
    assert {"transactions", "close_prices", "limit_prices"} < set(started[:4])


def test_rows_that_are_kept_are_dealt_out_once(spark):
    from kairosdf import DataConflictError

    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, "x"), ("b", 3, "x")], "k string, n int, x string")
    with conflicts.keeping_rows() as held:
        out = conflicts.raise_on_conflicts(rows.where("n < 3"), ["k"], "t")
        assert held == [out] and out.is_cached and sorted(map(tuple, out.collect()), key=str) == [("a", 1, None), ("b", 2, "x")]
        with pytest.raises(DataConflictError, match="'b'"):
            conflicts.raise_on_conflicts(rows, ["k"], "t")
    counts = out.groupBy("k").count()
    counts.collect()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]  # duplicates and keys are dealt alike
    for df in held:
        df.unpersist()
    assert not conflicts.raise_on_conflicts(rows.where("n < 3"), ["k"], "t").is_cached


def test_nothing_stays_kept_after_cleaning(spark, tmp_path):
    from kairosdf.plans.cleaning_run import run_cleaning

    (tmp_path / "raw").mkdir()
    write_raw(tmp_path / "raw")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    run_cleaning(spark, f"{tmp_path}/raw", f"{tmp_path}/p")
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
