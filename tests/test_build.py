"""From CSV to reports, the catalogue, the rules and the stream."""

import json
import random
from datetime import datetime, timedelta

import pytest

from kairosdf import TableCatalog, validate_dataset
from kairosdf import config
from kairosdf.config import RAW_FILES, SCHEMAS
from kairosdf.operators import rules
from kairosdf.plans import build
from kairosdf.plans.build import build_checkpoint
from kairosdf.sources.catalog import iter_batches, time_ordinal
from kairosdf.sources.tables import read_csv
from kairosdf.streaming import events as stream


def write_raw(folder, trades=200, seed=4):
    rng = random.Random(seed)
    rows = {
        "customers": ["customerID,customerType,riskLevel,investmentCapacity,lastQuestionnaireDate,timestamp"],
        "assets": ["ISIN,assetName,assetShortName,assetCategory,assetSubCategory,marketID,sector,industry,timestamp"],
        "markets": ["exchangeID,marketID,name,description,country,tradingDays,tradingHours,marketClass", 'E1,M1,"Market, one","two\nlines",-,Mon,,x', "E2,M2,NONE,n/a,GR,Mon,9-5,y"],
        "close_prices": ["ISIN,timestamp,closePrice"], "limit_prices": ["ISIN,minDate,maxDate,priceMinDate,priceMaxDate,profitability"],
        "transactions": ["customerID,ISIN,transactionID,transactionType,timestamp,totalValue,units,channel,marketID"],
    }
    for c in range(8):
        for y in (2018, 2020, 2022):
            rows["customers"].append(f"00{c},Mass,Predicted_Low,GT300K,,{y}-01-0{c + 1}")
    for a in range(5):
        rows["assets"].append(f"A{a},name,,Stock,,M1,NA,null,2018-01-01")
        rows["limit_prices"].append(f"A{a},2018-01-01,2022-11-30,1.0,2.0,0.5")
        rows["close_prices"] += [f"A{a},{y}-0{m}-01,{m}.5" for y in (2018, 2020, 2022) for m in (1, 5, 9)]
    rows["close_prices"] += ["ZZ,2018-01-01,1.0", "A1,2018-01-02,0"]
    start = datetime(2018, 1, 1)
    for c in range(8):
        for a in range(5):  # everybody is in train
            rows["transactions"].append(f"00{c},A{a},{a},Buy,{start:%Y-%m-%d},10.0,5,Web,M1")
    for n in range(trades):
        at = start + timedelta(days=rng.randint(0, 1790))
        rows["transactions"].append(f"00{rng.randint(0, 7)},A{rng.randint(0, 4)},{100 + n},{rng.choice(['Buy', 'Sell'])},{at:%Y-%m-%d},{rng.randint(1, 99)}.25,{rng.randint(1, 9)},Web,M2")
    rows["transactions"].append(rows["transactions"][-1])
    for name, lines in rows.items():
        (folder / RAW_FILES[name]).write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("study")
    (at / "raw").mkdir()
    write_raw(at / "raw")
    report = build_checkpoint(spark, raw_dir=f"{at}/raw", processed_dir=f"{at}/processed", output_dir=f"{at}/splits", reports_dir=f"{at}/reports")
    return at, report


def test_report(built):
    at, report = built
    cleaning = report["cleaning"]["tables"]
    assert report["ok"] and cleaning["transactions"]["removed_rows"] == 1 and cleaning["close_prices"]["removed_rows"] == 2 and cleaning["markets"]["missing_cells_after_cleaning"] == 0
    parts = report["primary_split"]
    assert sum(parts[p]["rows"] for p in ("train", "validation", "test")) == 240 and parts["coverage"]["ok"]
    assert report["cold_start_against_train_mapping"]["test"]["unknown_any_rows"] == 0 and report["temporal_graph"]["events"] == parts["train"]["rows"]
    assert report["primary_leakage"]["ok"] and len(report["rolling_leakage"]) == 5
    assert json.loads((at / "reports/checkpoint1_report.json").read_text())["baseline"]["mapping_fitted_on"] == "primary_train"
    lines = [json.loads(x) for part in sorted((at / "splits/id_mapping.json").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[0] == {"kind": "customer", "id": "000", "idx": 0} and [x["id"] for x in lines if x["kind"] == "asset"] == [f"A{k}" for k in range(5)]
    assert sorted((x["table"], x["rows"]) for x in report["cleaning"]["notes"]) == [("close_prices", 1), ("close_prices", 1)] and report["stats"]["transactions"]["order_checked"]


def test_catalogue(spark, built):
    at, report = built
    c = TableCatalog(spark, f"{at}/processed", f"{at}/splits")
    tables = c.load_all()
    assert tables["customers"].where("is_risk_predicted and riskLevel = 'Low' and investmentCapacity = 'CAP_GT300K'").count() == 24
    assert {r.marketID: (r.name, r.country, r.tradingHours, r.description) for r in c.load_markets().collect()} == {"M1": ("Market, one", "-", "Unknown", "two\nlines"), "M2": ("NONE", "GR", "9-5", "Unknown")}
    split = c.load_primary_split()
    assert len(split) == 9 and split["train_customer_snapshot"].dtypes[0] == ("customerID", "string") and split["train_customer_snapshot"].count() == 8
    assert {r.customerID for r in split["train_customer_snapshot"].collect()} == {f"00{k}" for k in range(8)}
    rolling = c.load_rolling_split(2)
    assert rolling["cutoff"] == "2020-07-01" and rolling["test"].count() > 0
    with pytest.raises(ValueError):
        c.load_rolling_split(6)
    with pytest.raises(ValueError):
        c.primary_path("future")
    with pytest.raises(FileNotFoundError):
        TableCatalog(spark, f"{at}/nowhere", f"{at}/splits").load_assets()
    mapping = c.fit_train_mapping()
    batches = list(c.iter_transaction_batches("test", batch_size=7, mapping=mapping))
    assert [len(b) for b in batches[:-1]] == [7] * (len(batches) - 1) and sum(map(len, batches)) == report["primary_split"]["test"]["rows"]
    with pytest.raises(ValueError):
        c.iter_transaction_batches(batch_size=0)
    assert c.load_temporal_graph_events("validation", mapping=mapping).frame.count() > 0
    assert c.load_baseline_interactions("train").pairs.count() == report["baseline"]["train_buy_pairs"]


def test_second_run_without_cleaning(spark, built):
    at, report = built
    again = build_checkpoint(spark, raw_dir="", processed_dir=f"{at}/processed", output_dir=f"{at}/again", reports_dir=f"{at}/again", skip_clean=True)
    assert again["cleaning"] is None and again["primary_split"] == report["primary_split"]


def test_nothing_is_written_when_references_fail(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    write_raw(tmp_path / "raw", 5)
    with (tmp_path / "raw" / RAW_FILES["transactions"]).open("a") as f:
        f.write("009,A1,999,Buy,2019-01-01,1.0,1,Web,M1\n")
    with pytest.raises(ValueError, match="unknown customerID"):
        build_checkpoint(spark, raw_dir=f"{tmp_path}/raw", processed_dir=f"{tmp_path}/p", output_dir=f"{tmp_path}/o", reports_dir=f"{tmp_path}/r")
    assert not (tmp_path / "p").exists()


def test_bad_dates_raise_instead_of_vanishing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ISIN,timestamp,closePrice\nA,01/02/2020 nonsense,1.0\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, f"{tmp_path}/x.csv", SCHEMAS["close_prices"]).collect()


def tables(spark, **changes):
    day = datetime(2022, 11, 30)
    out = {
        "customers": [("C1", "t", "Low", "x", None, day)], "assets": [("A1", "n", "n", "MTF", "s", "M1", "s", "i", day)], "markets": [("E", "M1", "n", "d", "c", "t", "h", "m")],
        "close_prices": [("A1", day, 1.0)], "limit_prices": [("A1", day, day, 1.0, 1.0, 0.0)], "transactions": [("C1", "A1", "1", "Buy", day, 1.0, 1.0, "Web", "M1")],
    }
    return {name: spark.createDataFrame(changes.get(name, rows), SCHEMAS[name]) for name, rows in out.items()}


DAY = datetime(2022, 11, 30)
BROKEN = [
    ("transactions", [(None, "A1", "1", "Buy", DAY, 1.0, 1.0, "Web", "M1")], "[known_reference] transactions (customerID)"), ("transactions", [("C1", "A9", None, "Buy", DAY, 1.0, 1.0, "Web", "M1")], "[no_nulls] transactions (transactionID)"),
    ("transactions", [("C1", "A9", "1", "Buy", DAY, 1.0, 1.0, "Web", "M1")], "[known_reference] transactions (ISIN)"), ("transactions", [("C1", "A1", "1", "Buy", DAY, 1.0, 1.0, "Web", None)], "[known_reference] transactions (marketID)"),
    ("transactions", [("C1", "A1", "1", "Gift", DAY, 1.0, 1.0, "Web", "M1")], "[buy_or_sell]"), ("transactions", [("C1", "A1", "1", "Buy", DAY, 1.0, None, "Web", "M1")], "[no_nulls] transactions (units) 1 rows"),
    ("transactions", [("C1", "A1", "1", "Buy", DAY, 1.0, 0.0, "Web", "M1")], "[above_zero] transactions (units)"), ("transactions", [("C1", "A1", "1", "Buy", DAY, -1.0, 1.0, "Web", "M1")], "[not_below_zero]"),
    ("transactions", [("C1", "A1", "1", "Buy", DAY, None, 1.0, "Web", "M1")], "[no_nulls] transactions (totalValue)"), ("transactions", [("C1", "A1", "1", "Buy", None, 1.0, 1.0, "Web", "M1")], "[no_nulls] transactions (timestamp)"),
    ("transactions", [("C1", "A1", "1", "Buy", DAY, 1.0, 1.0, "Web", "M1")] * 2, "[unique_key]"), ("customers", [("C1", "t", "Low", "x", None, DAY), ("C1", "t", "High", "x", None, DAY)], "[one_version] customers (customerID, timestamp) 2 rows"),
    ("customers", [(None, "t", "Low", "x", None, DAY), ("C1", "t", "Low", "x", None, DAY)], "[no_nulls] customers (customerID)"), ("markets", [("E", "M1", "n", "d", "c", "t", "h", "m"), ("F", "M1", "n", "d", "c", "t", "h", "m")], "[one_version] markets"),
    ("close_prices", [("A1", DAY, 0.0)], "[above_zero] close_prices"), ("close_prices", [("A1", DAY, 1.0), ("A1", DAY, 2.0)], "[one_version] close_prices"), ("close_prices", [("A1", None, 1.0)], "[no_nulls] close_prices (timestamp)"),
    ("limit_prices", [("A1", DAY, datetime(2020, 1, 1), 1.0, 1.0, 0.0)], "[from_before_to]"), ("assets", [("A1", "n", "n", k, "s", "M1", "s", "i", DAY) for k in ("MTF", "Stock")], "[one_version] assets (ISIN, timestamp) 2 rows"),
]


@pytest.mark.parametrize("table, rows, says", BROKEN)
def test_each_rule_fires(spark, table, rows, says):
    report = validate_dataset(tables(spark, **{table: rows}))
    assert not report["ok"] and any(says in e for e in report["errors"])


def test_sound_tables_and_warnings(spark):
    assert validate_dataset(tables(spark))["errors"] == []
    report = validate_dataset(tables(spark, close_prices=[("ZZ", DAY, 1.0)], transactions=[("C1", "A1", "1", "Buy", datetime(2020, 1, 1), 1.0, 1.0, "Web", "M1")]))
    assert report["ok"] and len(report["warnings"]) == 2 and report["stats"]["transactions"]["max_timestamp"] == "2020-01-01 00:00:00"
    data = tables(spark)
    missing = validate_dataset(data | {"transactions": data["transactions"].drop("units", "marketID")})
    assert missing["errors"] == ["[columns] transactions (marketID, units)"]


def test_order_rule(spark):
    rows = [("C1", "A1", str(k), "Buy", DAY, 1.0, 1.0, "Web", "M1") for k in range(4)]
    data = tables(spark, transactions=rows)
    good = data | {"transactions": time_ordinal(data["transactions"])}
    assert validate_dataset(good, ordinal="ordinal")["ok"]
    bad = good | {"transactions": good["transactions"].selectExpr("*", "-ordinal as backwards")}
    assert any("[event_order]" in e for e in validate_dataset(bad, ordinal="backwards")["errors"])


def test_profile_counts_repeats_and_gaps(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.0), ("b", "x", float("nan"))], "k string, v string, w double")
    assert rules.table_profile(df).head().asDict() == {"rows": 3, "columns": 3, "missing_cells": 3, "duplicate_rows": 1}


def test_batches(spark):
    assert [len(b) for b in iter_batches(spark.range(10), 4)] == [4, 4, 2] and list(iter_batches(spark.range(0), 4)) == []


def test_stream_replay_and_windows(spark, tmp_path):
    from kairosdf import fit_id_mapping

    day = datetime(2022, 1, 1)
    rows = [(f"C{k % 3}", f"A{k % 2}", str(k), "Buy" if k % 2 else "Sell", day + timedelta(hours=7 * k), 1.0, 1.0, "Web", "M1") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMAS["transactions"])
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    mapping = fit_id_mapping(df.where("customerID <> 'C2'"))
    events = stream.stream_graph_events(stream.read_stream(spark, f"{tmp_path}/in", SCHEMAS["transactions"]), mapping)
    stream.replay(events, lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out").count() == sum(r[0] != "C2" for r in rows)
    counted = stream.windowed_counts(stream.read_stream(spark, f"{tmp_path}/in", SCHEMAS["transactions"], files_per_batch=9), key="transactionType", late="1000 days")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n_events) from counted").head()[0] == 40


def test_notes_are_warned_of(spark):
    from kairosdf.operators import cleaning

    notes = cleaning.Notes()
    prices = spark.createDataFrame([("A1", DAY, 1.0), ("A1", DAY, 0.0), ("A2", DAY, -1.0), ("A3", None, -1.0)], SCHEMAS["close_prices"])
    with pytest.warns(UserWarning, match="2 rows"):
        assert cleaning.clean_close_prices(prices, notes).count() == 1
    assert notes.taken == [("close_prices", "price not above zero, dropped", 2)]


def test_equal_rows_are_no_conflict_wherever_nulls_stand(spark):
    from kairosdf import DataConflictError
    from kairosdf.operators import conflicts

    same = spark.createDataFrame([("k", None, "x"), ("k", None, "x")], "k string, a string, b string")
    assert conflicts.raise_on_conflicts(same, ["k"], "t").count() == 1
    shifted = spark.createDataFrame([("k", None, "x"), ("k", "x", None)], "k string, a string, b string")
    with pytest.raises(DataConflictError):
        conflicts.raise_on_conflicts(shifted, ["k"], "t")


def test_stored_order_follows_files_and_places(spark, tmp_path):
    spark.range(0, 1000, 1, 7).selectExpr("id", "repeat('x', cast(id % 50 as int)) as pad").write.option("header", True).csv(f"{tmp_path}/a b.csv")
    got = read_csv(spark, f"{tmp_path}/a b.csv", "id long", ordinal="at").orderBy("at").collect()
    assert [r.id for r in got] == list(range(1000))


def test_windows_are_written_once(spark, tmp_path):
    from kairosdf.operators.graph import iter_event_windows

    rows = [(k, datetime(2020, 1, 1) + timedelta(hours=11 * k)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, timestamp timestamp_ntz")
    plain = [(at, sorted(r.k for r in x.collect())) for at, x in iter_event_windows(df, "W")]
    written = [(at, sorted(r.k for r in x.collect())) for at, x in iter_event_windows(df, "W", folder=f"{tmp_path}/w")]
    assert plain == written and sum(len(x) for _, x in plain) == 300 and len(plain) > 10


def test_a_query_of_the_study_does_only_the_steps_it_reads(spark, tmp_path, monkeypatch):
    """The clean tables need no splits, the splits no graph, and a step is done once."""
    import os

    from kairosdf.plans import study_queries

    def no_files(spark, sf_dir):
        (tmp_path / "raw").mkdir(exist_ok=True)
        write_raw(tmp_path / "raw")
        return {}

    done = []
    run = build.run_cleaning
    monkeypatch.setattr(build, "run_cleaning", lambda *a, **k: done.append("cleaning") or run(*a, **k))
    monkeypatch.setattr(study_queries, "raw_tables", no_files)
    monkeypatch.setattr(study_queries, "scratch_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(study_queries, "PROTOCOL", config.DEFAULT)
    files = lambda: {os.path.relpath(os.path.join(at, d), tmp_path) for at, ds, fs in os.walk(tmp_path) for d in (*ds, *fs) if d.endswith((".csv", ".json")) and not d.startswith("part-")}
    study_queries.study(spark, "here")
    raw = files()
    assert study_queries.load_assets(spark, "here").count() == 5
    assert {f.split("/")[0] for f in files() - raw} == {"processed", "reports"} and "reports/data_quality_report.json" not in files()
    study_queries.catalog(spark, "here", "primary")
    assert {f for f in files() if f.startswith("splits")} == {f"splits/primary/{part}_transactions.csv" for part in ("train", "validation", "test")}
    assert study_queries.checkpoint_report(spark, "here").head().ok and done == ["cleaning"]
    assert {"splits/id_mapping.json", "splits/rolling/rolling_split_summary.csv", "splits/primary/train_graph_events.csv", "reports/checkpoint1_report.json"} <= files()


def test_batches_go_back_to_spark_as_arrow(spark, built, tmp_path, monkeypatch):
    import pyarrow as pa

    from kairosdf.plans import study_queries

    at, given, create = built[0], [], type(spark).createDataFrame
    monkeypatch.setattr(study_queries, "catalog", lambda *a: TableCatalog(spark, f"{at}/processed", f"{at}/splits"))
    monkeypatch.setattr(study_queries, "scratch_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: given.append(type(data)) or create(self, data, *a, **k))
    rows = study_queries.batches_in_order(spark, "here").orderBy("place").collect()
    assert given == [pa.Table] and [r.place for r in rows] == list(range(len(rows))) and len(rows) > 100


def test_a_table_is_cleaned_with_those_that_it_refers_to(spark, tmp_path):
    import os

    from kairosdf.plans.cleaning_run import run_cleaning

    (tmp_path / "raw").mkdir()
    write_raw(tmp_path / "raw", 5)
    report = run_cleaning(spark, f"{tmp_path}/raw", f"{tmp_path}/p", names=["close_prices"])
    assert list(report["tables"]) == ["assets", "close_prices"] and "transactions" not in report and sorted(x["rows"] for x in report["notes"]) == [1, 1]
    assert sorted(os.listdir(tmp_path / "p")) == ["asset_information_clean.csv", "close_prices_clean.csv"]
    with (tmp_path / "raw" / RAW_FILES["transactions"]).open("a") as f:
        f.write("009,A1,999,Buy,2019-01-01,1.0,1,Web,M1\n")
    with pytest.raises(ValueError, match="unknown customerID"):
        run_cleaning(spark, f"{tmp_path}/raw", f"{tmp_path}/q", names=["transactions"])
    assert not (tmp_path / "q").exists()


def test_queries_of_clean_tables_build_no_study(spark, sf_dir, monkeypatch):
    """load_assets and the like write and clean the tables they read; raw trades are read once for all their variants."""
    from kairosdf.plans import study_queries

    monkeypatch.setattr(study_queries, "_studies", {})
    monkeypatch.setattr(study_queries, "study", None)
    for name in ("load_assets", "load_markets", "load_close_prices", "load_limit_prices", "load_transactions", "cleaning_transaction_stats", "cleaning_notes"):
        assert not getattr(study_queries, name)(spark, sf_dir).isEmpty()
    plan = study_queries.raw_tables(spark, sf_dir)["transactions"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("Relation [") == 2


def test_snapshots_are_loaded_without_the_parts(spark, built, tmp_path):
    import shutil

    at = built[0]
    shutil.copytree(at / "splits", tmp_path / "s", ignore=lambda folder, names: [x for x in names if x.endswith("_transactions.csv")])
    c = TableCatalog(spark, f"{at}/processed", f"{tmp_path}/s")
    assert len(c.load_snapshots()) == 6 and c.load_rolling_snapshots(5)["prices"].count() > 0
    with pytest.raises(FileNotFoundError):
        c.load_primary_split()
