from datetime import datetime

import pytest

from kairosdf.config import DUAL_ASSETS, SCHEMAS
from kairosdf.errors import DataConflictError
from kairosdf.operators import cleaning as C
from kairosdf.operators import conflicts as K

DAY = datetime(2022, 1, 1)


def trade(customer, id_, units=1.0, kind="Buy", value=10.0, market="M1", isin="A1", at=DAY):
    return (customer, isin, id_, kind, at, value, units, "Branch", market)


def trades(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["transactions"])


def test_transaction_ids_belong_to_their_customer(spark):
    assert C.clean_transactions(trades(spark, trade("C1", "42"), trade("C2", "42"))).count() == 2


def test_unlike_rows_with_one_key_stop_the_run(spark):
    with pytest.raises(DataConflictError):
        C.clean_transactions(trades(spark, trade("C1", "42"), trade("C1", "42", units=2.0)))


def test_equal_rows_collapse_and_invalid_ones_go(spark):
    rows = [trade("C1", "1"), trade("C1", "1"), trade("C1", "2", kind="Gift"), trade("C1", "3", units=0.0), trade("C1", "4", value=-1.0), trade(None, "5"), trade("C1", "6", market=None), trade("C1", "7", units=float("nan"))]
    assert sorted(r.transactionID for r in C.clean_transactions(trades(spark, *rows)).collect()) == ["1", "6"]


def test_invalid_rows_go_before_conflicts_are_looked_for(spark):
    assert C.clean_transactions(trades(spark, trade("C1", "1"), trade("C1", "1", units=-1.0))).count() == 1


def customers(spark, *rows):
    return spark.createDataFrame([(i, None, r, c, None, DAY) for i, r, c in rows], SCHEMAS["customers"])


def test_labels(spark):
    raw = customers(spark, ("1", "Predicted_Not_Available", "Predicted_GT300K"), ("2", "Not_Available", "GT300K"), ("3", None, None), ("4", "Predicted_Low", "CAP_LT30K"))
    got = {r.customerID: (r.riskLevel, r.is_risk_predicted, r.investmentCapacity, r.is_capacity_predicted, r.customerType) for r in C.clean_customers(raw).collect()}
    assert got == {
        "1": ("Unknown", True, "CAP_GT300K", True, "Unknown"), "2": ("Unknown", False, "CAP_GT300K", False, "Unknown"),
        "3": ("Unknown", False, "Unknown", False, "Unknown"), "4": ("Low", True, "CAP_LT30K", False, "Unknown"),
    }


def test_predicted_and_plain_labels_at_one_time_conflict(spark):
    with pytest.raises(DataConflictError):
        C.clean_customers(customers(spark, ("1", "Predicted_Low", None), ("1", "Low", None)))


def assets(spark, *rows):
    return spark.createDataFrame([(i, None, None, c, None, "M1", None, None, datetime(2020, 1, 1)) for i, c in rows], SCHEMAS["assets"])


def test_missing_metadata_is_unknown(spark):
    row = C.clean_assets(assets(spark, ("A1", "MTF"))).head()
    assert None not in tuple(row) and row.assetName == "Unknown"


def test_dual_assets_take_the_preferred_category(spark):
    isin = sorted(DUAL_ASSETS)[0]
    assert [r.assetCategory for r in C.clean_assets(assets(spark, (isin, "Stock"), (isin, "MTF"))).collect()] == ["MTF"]
    with pytest.raises(DataConflictError):
        C.clean_assets(assets(spark, ("A1", "Stock"), ("A1", "MTF")))


def test_bad_prices_and_ranges(spark):
    prices = spark.createDataFrame([("A1", DAY, 1.0), ("A1", DAY, 0.0), ("A2", None, 1.0)], SCHEMAS["close_prices"])
    assert C.clean_close_prices(prices).count() == 1
    limits = spark.createDataFrame([("A1", DAY, datetime(2021, 1, 1), 1.0, 1.0, None), ("A2", DAY, DAY, None, None, None)], SCHEMAS["limit_prices"])
    assert [r.ISIN for r in C.clean_limit_prices(limits).collect()] == ["A2"]


def test_markets(spark):
    row = C.clean_markets(spark.createDataFrame([(None, "M1", "n", None, "-", None, None, None)] * 2, SCHEMAS["markets"])).collect()
    assert len(row) == 1 and row[0].exchangeID == "Unknown" and row[0].country == "-"


def test_references(spark):
    tables = {
        "transactions": trades(spark, trade("C1", "1"), trade("C1", "2", market=None)), "customers": customers(spark, ("C1", None, None)), "assets": assets(spark, ("A1", None)),
        "markets": spark.createDataFrame([("E", "M1", "n", "", "", "", "", "")], SCHEMAS["markets"]),
        "close_prices": spark.createDataFrame([("A1", DAY, 1.0), ("A9", DAY, 1.0)], SCHEMAS["close_prices"]), "limit_prices": spark.createDataFrame([], SCHEMAS["limit_prices"]),
    }
    with pytest.raises(DataConflictError, match="1 rows with unknown marketID"):
        C.check_references(tables)
    assert C.drop_orphans(tables)["close_prices"].count() == 1


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="units"):
        C.clean_transactions(trades(spark, trade("C1", "1")).drop("units"))


def test_order_violations_across_ranges(spark):
    df = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (250_000, "a"), (250_001, "z"), (900_000, "y")], "n long, k string")
    assert sorted(r.n for r in K.out_of_order(df, "n", ["k"]).collect()) == [2, 250_000, 900_000]


def test_null_and_nan_rows_are_equal(spark):
    df = spark.createDataFrame([("a", float("nan"), None)] * 2, "k string, v double, w string")
    assert K.raise_on_conflicts(df, ["k"], "t").count() == 1
