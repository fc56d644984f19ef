"""The protocol of a study and the tables' contracts."""

from __future__ import annotations

from dataclasses import dataclass

# File names, keys, orders and whitelisted ids that other tools rely on.
RAW_FILES = {
    "customers": "customer_information.csv",
    "assets": "asset_information.csv",
    "markets": "markets.csv",
    "close_prices": "close_prices.csv",
    "limit_prices": "limit_prices.csv",
    "transactions": "transactions.csv",
}
CLEAN_FILES = {
    "customers": "customer_information_clean.csv",
    "assets": "asset_information_clean.csv",
    "markets": "markets_clean.csv",
    "close_prices": "close_prices_clean.csv",
    "limit_prices": "limit_prices_clean.csv",
    "transactions": "transactions_clean.csv",
}
TRANSACTION_KEY = ["customerID", "transactionID"]
EVENT_ORDER = ["timestamp", "customerID", "transactionID", "ISIN"]
UNKNOWN = "Unknown"
#: funds that the source classifies twice
DUAL_ASSETS = frozenset({"IE00B66F4759", "IE00BCRY6003", "LU0055631609"})
PREFERRED_CATEGORY = "MTF"
#: spellings of a missing cell in the source's CSV files
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SCHEMAS = {
    "customers": "customerID string, customerType string, riskLevel string, investmentCapacity string, lastQuestionnaireDate timestamp_ntz, timestamp timestamp_ntz",
    "assets": "ISIN string, assetName string, assetShortName string, assetCategory string, assetSubCategory string, marketID string, sector string, industry string, timestamp timestamp_ntz",
    "markets": "exchangeID string, marketID string, name string, description string, country string, tradingDays string, tradingHours string, marketClass string",
    "close_prices": "ISIN string, timestamp timestamp_ntz, closePrice double",
    "limit_prices": "ISIN string, minDate timestamp_ntz, maxDate timestamp_ntz, priceMinDate double, priceMaxDate double, profitability double",
    "transactions": "customerID string, ISIN string, transactionID string, transactionType string, timestamp timestamp_ntz, totalValue double, units double, channel string, marketID string",
}
CLEAN_ONLY = {"customers": "is_risk_predicted boolean, is_capacity_predicted boolean"}


def required_columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


@dataclass(frozen=True)
class Protocol:
    """Cutoffs are inclusive, to the second; rolling cutoffs are days, widened to their last second."""

    train_end: str = "2021-12-31 23:59:59"
    validation_start: str = "2022-01-01 00:00:00"
    validation_end: str = "2022-06-30 23:59:59"
    test_start: str = "2022-07-01 00:00:00"
    test_end: str = "2022-11-30 23:59:59"
    rolling_cutoffs: tuple[str, ...] = ("2020-01-01", "2020-07-01", "2021-01-01", "2021-07-01", "2022-01-01")
    horizon_months: int = 6


DEFAULT = Protocol()
