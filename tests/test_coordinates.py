"""Trades that the coordinates of a matrix are made of are joined once."""

from pyspark.sql import functions as F

from kairosdf.operators import encoding, interactions
from kairosdf.plans import study_queries


def test_coordinates_are_made_of_trades_written_once(spark, monkeypatch):
    rows = [(f"C{i % 7}", f"A{i % 5}", "Sell" if i % 4 == 0 else "Buy") for i in range(200)]
    tx = spark.createDataFrame(rows, "customerID string, ISIN string, transactionType string").withColumn("timestamp", F.lit("1999-01-01").cast("timestamp_ntz"))
    want = interactions.baseline_interactions(tx, encoding.fit_id_mapping(tx), buys_only=False).pairs.select("customer_idx", "asset_idx", "weight").collect()
    read, baseline = [], interactions.baseline_interactions

    def spy(trades, *rest, **how):
        read.extend(trades.inputFiles())
        return baseline(trades, *rest, **how)

    monkeypatch.setattr(interactions, "baseline_interactions", spy)
    unused = encoding.FittedWhenRead(tx)
    monkeypatch.setattr(study_queries, "graph_inputs", lambda spark, sf_dir: (tx, unused))
    monkeypatch.setattr(study_queries, "TRAIN_END", "2100-01-01")
    got = study_queries.coordinate_interactions(spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 35
    assert read and all("/trades/" in f for f in read) and "_mapping" not in vars(unused)  # ids were fitted on the trades as well


def test_a_mapping_is_fitted_when_it_is_read(spark):
    tx = spark.createDataFrame([("b", "x"), ("a", "y")], "customerID string, ISIN string")
    mapping = encoding.FittedWhenRead(tx)
    assert "_mapping" not in vars(mapping) and mapping.num_customers == 2 and mapping.dicts() == ({"a": 0, "b": 1}, {"x": 0, "y": 1}) and mapping.fitted_on == "train"
