import random
from datetime import datetime, timedelta

import pytest

from kairosdf import (
    PointInTimeState, build_holdings_asof, build_interaction_snapshot, build_point_in_time_state, build_temporal_graph_events, currently_held_assets,
    encode_transactions, fit_id_mapping, get_candidate_assets, get_customer_snapshot_asof, iter_event_windows,
)
from kairosdf.config import DEFAULT, Protocol
from kairosdf.operators import asof, encoding, graph, interactions, rules, splits

CUTOFF = "2021-06-01"
POSITIONS = [
    ("C1", "A1", "Buy", 100.0, "2020-01-01"), ("C1", "A1", "Sell", 100.0, "2022-01-01"), ("C1", "A2", "Buy", 100.0, "2021-01-01"), ("C1", "A2", "Sell", 100.0, "2021-02-01"),
    ("C1", "A3", "Buy", 100.0, "2021-01-01"), ("C1", "A3", "Sell", 40.0, "2021-02-01"), ("C1", "A4", "Sell", 100.0, "2021-01-01"), ("C2", "B1", "Buy", 50.0, "2022-03-01"),
]


def positions(spark, rows=POSITIONS):
    return spark.createDataFrame([(c, a, k, u, datetime.fromisoformat(t)) for c, a, k, u, t in rows], "customerID string, ISIN string, transactionType string, units double, timestamp timestamp_ntz")


def test_holdings_stop_at_the_cutoff(spark):
    got = {(r.customerID, r.ISIN): (r.net_units, r.currently_held) for r in build_holdings_asof(positions(spark), CUTOFF).collect()}
    assert got == {("C1", "A1"): (100.0, True), ("C1", "A2"): (0.0, False), ("C1", "A3"): (60.0, True), ("C1", "A4"): (-100.0, False)}
    assert currently_held_assets(positions(spark), "C1", CUTOFF) == {"A1", "A3"}


def test_binary_fractions_net_to_zero(spark):
    rows = [("C", "A", "Buy", 0.1, "2020-01-01"), ("C", "A", "Buy", 0.2, "2020-01-02"), ("C", "A", " SELL ", 0.3, "2020-01-03")]
    assert [(r.net_units, r.currently_held) for r in build_holdings_asof(positions(spark, rows), CUTOFF).collect()] == [(0.0, False)]


def test_candidates(spark):
    tx = positions(spark)
    assert get_candidate_assets(tx, "C1", as_of=CUTOFF) == {"A2", "A4"}
    state = build_point_in_time_state(tx, CUTOFF)
    assert isinstance(state, PointInTimeState) and state.candidates("nobody") == {"A1", "A2", "A3", "A4"} and state.held_by("C1") == {"A1", "A3"}
    asked = spark.createDataFrame([("C1",), ("nobody",)], "customerID string")
    assert state.all_candidates(asked).count() == 6
    assert get_candidate_assets(tx, "C1", ["A1", "Z"], CUTOFF) == {"Z"}
    with pytest.raises(ValueError):
        get_candidate_assets(tx, "C1")


def test_empty_history(spark):
    got = build_holdings_asof(positions(spark), "1999-01-01")
    assert got.columns == ["customerID", "ISIN", "net_units", "currently_held"] and got.count() == 0


def versions(spark, rows):
    return spark.createDataFrame([(c, datetime.fromisoformat(t), r) for c, t, r in rows], "customerID string, timestamp timestamp_ntz, riskLevel string")


def test_snapshots_ignore_later_versions(spark):
    df = versions(spark, [("C1", "2020-01-01", "Low"), ("C1", "2021-01-01", "High"), ("C2", "2022-01-01", "Low")])
    rows = get_customer_snapshot_asof(df, "2020-06-30").collect()
    assert [(r.riskLevel, r.snapshot_asof_date) for r in rows] == [("Low", datetime(2020, 6, 30))]
    assert "snapshot_asof_date" in get_customer_snapshot_asof(df, "2000-01-01").columns


def test_conflicting_versions_raise_unless_they_come_later(spark):
    df = versions(spark, [("C1", "2020-01-01", "Low"), ("C1", "2021-01-01", "High"), ("C1", "2021-01-01", "Low")])
    assert get_customer_snapshot_asof(df, "2020-12-31").count() == 1
    with pytest.raises(ValueError):
        get_customer_snapshot_asof(df, "2021-12-31")


EVENTS = [("C1", "A1", "2", "Buy", "2020-01-02", 10.0, 100.0), ("C1", "A1", "1", "Sell", "2020-01-03", 4.0, 50.0), ("C2", "FUTURE", "3", "Buy", "2022-01-01", 1.0, 20.0)]


def events(spark, rows=EVENTS):
    return spark.createDataFrame([(c, a, i, k, datetime.fromisoformat(t), u, v) for c, a, i, k, t, u, v in rows], "customerID string, ISIN string, transactionID string, transactionType string, timestamp timestamp_ntz, units double, totalValue double")


def test_graph_events(spark):
    g = build_temporal_graph_events(events(spark), as_of="2020-12-31")
    rows = g.ordered().collect()
    assert g.frame.columns == graph.EVENT_COLUMNS and [r.signed_units for r in rows] == [10.0, -4.0] and "FUTURE" not in {r.ISIN for r in rows}
    assert all(r.dst_node_idx >= g.num_customers for r in rows) and g.num_nodes == 2 and rows[0].unix_timestamp == 1577923200 and rows[0].event_id == "C1:2"


def test_edges(spark):
    (row,) = build_interaction_snapshot(events(spark), "2020-12-31").collect()
    assert (row.event_count, row.buy_count, row.sell_count, row.net_units, row.total_value, row.last_timestamp) == (2, 1, 1, 6.0, 150.0, datetime(2020, 1, 3))


def test_cold_start(spark):
    mapping = fit_id_mapping(asof.upto(events(spark), "2020-12-31"))
    with pytest.raises(ValueError, match="cold-start"):
        encode_transactions(events(spark), mapping)
    assert encode_transactions(events(spark), mapping, drop_unknown=True).count() == 2
    nobody = fit_id_mapping(asof.upto(events(spark), "1990-01-01"))
    with pytest.raises(ValueError, match="cold-start"):
        build_temporal_graph_events(events(spark), as_of="2022-12-31", mapping=nobody)
    assert encoding.cold_start_stats(events(spark), mapping) == {"rows": 3, "unknown_customer_rows": 1, "unknown_asset_rows": 1, "unknown_any_rows": 1, "unknown_customers": 1, "unknown_assets": 1}


def test_sales_by_strangers_do_not_stop_purchases(spark):
    mapping = fit_id_mapping(asof.upto(events(spark), "2020-12-31"))
    rows = [*EVENTS[:2], ("C9", "A1", "9", "Sell", "2020-01-05", 1.0, 1.0)]
    got = interactions.baseline_interactions(events(spark, rows), mapping)
    assert got.shape == (1, 1) and got.to_coo()[2].tolist() == [1.0]
    with pytest.raises(ValueError):
        interactions.baseline_interactions(events(spark, rows), mapping, buys_only=False)


def test_dense_ids_are_in_code_point_order(spark):
    rng = random.Random(3)
    ids = {"".join(rng.choice("aZ09é~") for _ in range(rng.randint(1, 6))) for _ in range(3000)}
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)] + [(i,) for i in list(ids)[:50]], "k string")
    got = {r.k: r.n for r in encoding.dense_ids(df, "k", "n").collect()}
    assert got == {k: n for n, k in enumerate(sorted(ids))}
    assert encoding.dense_ids(df.where("k is null"), "k", "n").count() == 0


def test_windows(spark):
    df = events(spark, [("C", "A", str(n), "Buy", t, 1.0, 1.0) for n, t in enumerate(["2020-01-31", "2020-02-01", "2020-02-29", "2021-01-01"])])
    assert [(str(w)[:10], x.count()) for w, x in iter_event_windows(df)] == [("2020-01-01", 1), ("2020-02-01", 2), ("2021-01-01", 1)]
    with pytest.raises(ValueError):
        list(iter_event_windows(df, "QE-DEC"))


def random_log(spark, seed=5, n=400):
    rng = random.Random(seed)
    start = datetime(2019, 6, 1)
    return events(spark, [(f"C{rng.randint(1, 9)}", f"A{rng.randint(1, 7)}", str(i), rng.choice(["Buy", "Sell"]), str(start + timedelta(seconds=rng.randint(0, 3 * 365 * 86400))), float(rng.randint(1, 9)), 5.0) for i in range(n)])


def test_invariants_on_a_random_log(spark):
    tx = random_log(spark).persist()
    split = splits.build_primary_split(tx)
    counts = {k: v.count() for k, v in split.parts().items()}
    assert sum(counts.values()) == tx.count() == splits.coverage(tx)["assigned_rows"]
    assert rules.validate_primary_split(split) == {"ok": True, "issues": []}
    summary = {r.split: r for r in splits.split_summary(tx).collect()}
    assert {k: r.rows for k, r in summary.items()} == counts and summary["train"].unseen_customers == 0
    edges = build_interaction_snapshot(tx, DEFAULT.train_end)
    held = build_holdings_asof(tx, DEFAULT.train_end)
    assert edges.selectExpr("sum(event_count)").head()[0] == counts["train"]
    assert sorted(r.net_units for r in edges.collect()) == sorted(r.net_units for r in held.collect())
    state = build_point_in_time_state(tx, DEFAULT.train_end)
    universe = {r.ISIN for r in state.asset_universe.collect()}
    assert state.candidates("C1") | state.held_by("C1") == universe and not state.candidates("C1") & state.held_by("C1")
    later = asof.after_upto(tx, DEFAULT.train_end, DEFAULT.test_end)
    mapping = fit_id_mapping(split.train)
    assert encode_transactions(later, mapping, drop_unknown=True).count() == later.count() - encoding.cold_start_stats(later, mapping)["unknown_any_rows"]


def test_rolling(spark):
    tx = random_log(spark).persist()
    items = splits.build_rolling_splits(tx)
    assert [i.test_end for i in items][:2] == ["2020-07-01 23:59:59", "2021-01-01 23:59:59"] and all(rules.validate_rolling_split(i)["ok"] for i in items)
    assert [(r.train_rows, r.test_rows) for r in splits.rolling_summary(tx).orderBy("window").collect()] == [(i.train.count(), i.test.count()) for i in items]


def test_month_ends_clamp(spark):
    assert splits.rolling_bounds(spark, Protocol(rolling_cutoffs=("2020-08-31",)))[0][3] == "2021-02-28 23:59:59"


def test_fractions_of_seconds_are_unassigned(spark):
    got = splits.coverage(events(spark, [("C", "A", "1", "Buy", "2021-12-31 23:59:59.500000", 1.0, 1.0)]))
    assert got == {"clean_transactions": 1, "assigned_rows": 0, "unassigned_rows": 1, "ok": False}


def test_leaks_are_found(spark):
    from dataclasses import replace

    tx = random_log(spark)
    split = splits.build_primary_split(tx)
    leaky = replace(split, train=tx, validation=tx, test=tx)
    assert len(rules.validate_primary_split(leaky)["issues"]) == 3  # the log ends within validation
    dated = versions(spark, [("C1", "2022-12-01", "Low"), ("C1", "2022-12-02", "Low")]).withColumn("snapshot_asof_date", asof.timestamp("2020-01-01"))
    found = rules.validate_primary_split(replace(split, customer_snapshot_train=dated))["issues"]
    assert [x.split()[0] for x in found] == ["LEAKAGE:", "LEAKAGE/PROVENANCE:", "LEAKAGE/SCHEMA:"]
    item = splits.build_rolling_splits(tx)[0]
    assert len(rules.validate_rolling_split(replace(item, train=tx, test=tx, customer_snapshot=dated))["issues"]) == 4


def test_coordinates_come_in_batches(spark, monkeypatch):
    """By row and column over all batches, equal to those fetched at once; the query never fetches all at once."""
    import numpy as np

    from kairosdf.operators import interactions
    from kairosdf.operators.encoding import fit_id_mapping
    from kairosdf.plans import study_queries

    tx = random_log(spark)
    found = interactions.baseline_interactions(tx, fit_id_mapping(tx), buys_only=False)
    batches, whole = list(found.coo_batches(7)), found.to_coo()
    assert len(batches) > 1 and all(len(b[0]) == 7 for b in batches[:-1])
    for k in range(4):
        assert (np.concatenate([b[k] for b in batches]) == whole[k]).all()
    monkeypatch.setattr(interactions.BaselineInteractions, "to_coo", None)
    monkeypatch.setattr(study_queries, "graph_inputs", lambda spark, sf_dir: (tx, fit_id_mapping(tx)))
    monkeypatch.setattr(study_queries, "TRAIN_END", "2100-01-01")
    assert study_queries.coordinate_interactions(spark, "").count() == len(whole[0])
