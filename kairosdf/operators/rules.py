"""Rules on tables and splits.  Aggregates run on the cluster, one a table where rules allow; what they
find are Findings, and messages are made from those.  Errors stop a run, warnings don't."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLEAN_FILES, DEFAULT, DUAL_ASSETS, EVENT_ORDER, TRANSACTION_KEY, Protocol, required_columns
from ..functions.scalars import midnight, missing_cells, timestamp
from ..sources.tables import side_by_side
from .conflicts import conflicting_keys, count_unmatched, is_key_unique, key_counts, out_of_order, row_hashes, unlike_keys
from .splits import PrimarySplit, RollingSplit

ORDINAL = "ordinal"


@dataclass(frozen=True)
class Finding:
    """A broken rule: which, in what table or part, in which columns, how many rows, and the value at fault."""

    severity: str
    rule: str
    table: str
    columns: tuple[str, ...] = ()
    rows: int = 0
    detail: str = ""

    def __str__(self) -> str:
        parts = [f"[{self.rule}] {self.table}", f"({', '.join(self.columns)})" if self.columns else "", f"{self.rows} rows" if self.rows else "", self.detail]
        return " ".join(x for x in parts if x)


def report_of(findings: list[Finding], **more) -> dict:
    """{ok, errors, warnings, findings, ...}; texts in errors and warnings, the same as dicts in findings."""
    texts = {s: [str(x) for x in findings if x.severity == s] for s in ("error", "warning")}
    return {"ok": not texts["error"], "errors": texts["error"], "warnings": texts["warning"], "findings": [asdict(x) for x in findings]} | more


def findings_table(spark, findings: list[dict]) -> DataFrame:
    """A report's findings as a table: severity, rule, table, columns (by comma), n_rows, detail."""
    rows = [(x["severity"], x["rule"], x["table"], ",".join(x["columns"]), x["rows"], x["detail"]) for x in findings]
    return spark.createDataFrame(rows, "severity string, rule string, `table` string, columns string, n_rows long, detail string")


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing_cells, duplicate_rows (those equal to another, but for one of each).

    Rows meet by two hashes of all cells, 96 bits, not as a whole.
    """
    same = df.select(*row_hashes(df), missing_cells(dict(df.dtypes)).alias("__missing")).groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.sum("__missing").alias("__m"))
    zero = F.lit(0).cast("long")
    return same.agg(F.coalesce(F.sum("__n"), zero).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum("__m"), zero).alias("missing_cells"), F.coalesce(F.sum(F.col("__n") - 1), zero).alias("duplicate_rows"))


def _empty(column: str) -> Column:
    c = F.col(column).cast("double")
    return c.isNull() | F.isnan(c)


#: rules on single rows, all errors: table, rule, columns, what a broken row is like
NO_NULLS = {
    "customers": ["customerID", "timestamp"], "assets": ["ISIN", "timestamp"], "markets": ["marketID"],
    "close_prices": ["timestamp"], "transactions": ["transactionID", "timestamp"],
}


def _row_rules(name: str) -> list[tuple[str, tuple[str, ...], Column]]:
    rules = [("no_nulls", (c,), F.col(c).isNull()) for c in NO_NULLS.get(name, [])]
    if name == "transactions":
        rules += [("no_nulls", (c,), _empty(c)) for c in ("units", "totalValue")]
        rules += [("above_zero", ("units",), F.col("units") <= 0), ("not_below_zero", ("totalValue",), F.col("totalValue") < 0)]
        rules += [("buy_or_sell", ("transactionType",), ~F.col("transactionType").isin("Buy", "Sell"))]
    if name == "close_prices":
        rules += [("above_zero", ("closePrice",), F.col("closePrice") <= 0)]
    if name == "limit_prices":
        rules += [("from_before_to", ("minDate", "maxDate"), F.col("minDate") > F.col("maxDate"))]
    return rules


VERSION_KEYS = {"customers": ["customerID", "timestamp"], "assets": ["ISIN", "timestamp"], "close_prices": ["ISIN", "timestamp"], "markets": ["marketID"], "limit_prices": ["ISIN"]}
REFERENCES = [
    ("error", "transactions", "customerID", "customers"), ("error", "transactions", "ISIN", "assets"), ("error", "transactions", "marketID", "markets"),
    ("warning", "close_prices", "ISIN", "assets"), ("warning", "limit_prices", "ISIN", "assets"),
]


def validate_dataset(data: dict[str, DataFrame], protocol: Protocol = DEFAULT, *, dual_assets: frozenset[str] | DataFrame = DUAL_ASSETS, ordinal: str = ORDINAL) -> dict:
    """{ok, errors, warnings, findings, stats} of the six tables.

    A rule is skipped where its columns are missing, which is an error of its
    own.  DataFrames have no order: the order rule looks at the column
    `ordinal` of transactions, as the catalogue reads it from files; without
    that column it is skipped, and stats say so.
    """
    found: list[Finding] = []
    stats: dict[str, dict] = {}
    data = dict(data)
    order = data["transactions"].select(ordinal, *EVENT_ORDER) if {ordinal, *EVENT_ORDER} <= set(data["transactions"].columns) else None
    data["transactions"] = data["transactions"].drop(ordinal)
    has = {name: set(df.columns) for name, df in data.items()}
    rules = {name: [x for x in _row_rules(name) if set(x[1]) <= has[name]] for name in CLEAN_FILES}
    tx = data["transactions"]
    keyed = set(TRANSACTION_KEY) <= has["transactions"]
    versions = [name for name, keys in VERSION_KEYS.items() if set(keys) <= has[name]]
    references = [x for x in REFERENCES if x[2] in has[x[1]] and x[2] in has[x[3]]]

    def cells(name: str) -> dict:
        aggregates = [F.count_if(bad).alias(f"r{k}") for k, (_, _, bad) in enumerate(rules[name])]
        if name == "transactions" and "timestamp" in has[name]:
            short = midnight(F.max("timestamp")) < midnight(timestamp(protocol.test_end))
            aggregates += [F.min("timestamp").cast("string").alias("lo"), F.max("timestamp").cast("string").alias("hi"), F.coalesce(short, F.lit(False)).alias("short")]
        return data[name].agg(*aggregates).head().asDict() if aggregates else {}

    # what is looked up in the tables, side by side; findings are put in the order of the rules
    tasks = {("stats", name): lambda name=name: table_profile(data[name]).head().asDict() for name in CLEAN_FILES}
    tasks |= {("cells", name): lambda name=name: cells(name) for name in CLEAN_FILES}
    tasks |= {("order", ""): lambda: out_of_order(order, ordinal, EVENT_ORDER).count()} if order is not None else {}
    tasks |= {("keys", ""): lambda: key_counts(tx, TRANSACTION_KEY, "transactionID")} if keyed else {}
    tasks |= {("versions", name): lambda name=name: _unlike_versions(data[name], VERSION_KEYS[name], dual_assets if name == "assets" else frozenset()) for name in versions}
    tasks |= {("known", x): lambda x=x: count_unmatched(data[x[1]], x[2], data[x[3]]) for x in references}
    seen = dict(zip(tasks, side_by_side(lambda f: f(), tasks.values()), strict=True))

    for name in CLEAN_FILES:
        stats[name] = seen["stats", name]
        missing = sorted(set(required_columns(name)) - has[name])
        if missing:
            found.append(Finding("error", "columns", name, tuple(missing)))
        row = seen["cells", name]
        found += [Finding("error", rule, name, columns, row[f"r{k}"]) for k, (rule, columns, _) in enumerate(rules[name]) if row[f"r{k}"]]
        if row.get("lo") is not None:
            stats[name] |= {"min_timestamp": row["lo"], "max_timestamp": row["hi"]}
            if row["short"]:
                found.append(Finding("warning", "history_reaches_end", name, ("timestamp",), 0, f"{row['hi']} < {protocol.test_end}"))

    if keyed:
        n_keys, reused = seen["keys", ""]
        if n_keys < stats["transactions"]["rows"]:
            found.append(Finding("error", "unique_key", "transactions", tuple(TRANSACTION_KEY)))
        stats["transactions"]["globally_reused_transaction_ids"] = reused

    for name in versions:
        n, unknown = seen["versions", name]
        if unknown:
            found.append(Finding("error", "one_version", name, tuple(VERSION_KEYS[name]), unknown))
        elif n:
            found.append(Finding("warning", "known_twice", name, tuple(VERSION_KEYS[name]), n))

    found += [Finding(x[0], "known_reference", x[1], (x[2],), n, f"not in {x[3]}") for x in references if (n := seen["known", x])]

    stats["transactions"]["order_checked"] = order is not None
    if n := seen.get(("order", "")):
        found.append(Finding("error", "event_order", "transactions", tuple(EVENT_ORDER), n))
    return report_of(found, stats=stats)


def _unlike_versions(df: DataFrame, keys: list[str], dual: frozenset[str] | DataFrame) -> tuple[int, int]:
    """Rows of keys that unlike rows share, equal rows once; and those of them not in the whitelist."""
    if unlike_keys(df, keys).isEmpty():
        return 0, 0
    rows = conflicting_keys(df, keys)
    known = known_dual(rows, dual) if isinstance(dual, DataFrame) or dual else rows.withColumn("__dual", F.lit(False))
    n = known.agg(F.sum("n_rows").alias("all"), F.coalesce(F.sum(F.when(~F.col("__dual"), F.col("n_rows"))), F.lit(0)).alias("unknown")).head()
    return n["all"], n["unknown"]


def known_dual(rows: DataFrame, dual: frozenset[str] | DataFrame) -> DataFrame:
    """rows with __dual: whether its ISIN is in the whitelist, which may be a table with that column."""
    if isinstance(dual, DataFrame):
        return rows.join(dual.select("ISIN").distinct().withColumn("__known", F.lit(True)), "ISIN", "left").withColumn("__dual", F.col("__known").isNotNull()).drop("__known")
    return rows.withColumn("__dual", F.coalesce(F.col("ISIN").isin(*dual), F.lit(False)) if dual else F.lit(False))


def _span(part: str, df: DataFrame | None, *, after: str | None = None, until: str | None = None) -> list[Finding]:
    """That all timestamps of a part are after one moment and not after another."""
    if df is None or "timestamp" not in df.columns:
        return []
    at = F.col("timestamp")
    late = at > timestamp(until) if until else F.lit(False)
    early = at <= timestamp(after) if after else F.lit(False)
    row = df.agg(F.count_if(late).alias("late"), F.count_if(early).alias("early"), F.max("timestamp").cast("string").alias("hi"), F.min("timestamp").cast("string").alias("lo")).head()
    out = [Finding("error", "not_after_cutoff", part, ("timestamp",), row["late"], f"up to {row['hi']}, cutoff {until}")] if row["late"] else []
    return out + ([Finding("error", "after_cutoff", part, ("timestamp",), row["early"], f"from {row['lo']}, cutoff {after}")] if row["early"] else [])


def _snapshot(part: str, df: DataFrame | None, cutoff: str, key: str | None) -> list[Finding]:
    if df is None:
        return []
    out = _span(part, df, until=cutoff)
    if "snapshot_asof_date" in df.columns:
        n = df.where(~timestamp(F.col("snapshot_asof_date")).eqNullSafe(timestamp(cutoff))).count()
        out += [Finding("error", "taken_at_cutoff", part, ("snapshot_asof_date",), n, f"cutoff {cutoff}")] if n else []
    if key and not is_key_unique(df, [key]):
        out.append(Finding("error", "one_row_each", part, (key,)))
    return out


def validate_primary_split(split: PrimarySplit) -> dict:
    """{ok, issues, findings}: no part reaches into another's time, no snapshot past its cutoff, one row an entity."""
    found = _span("train", split.train, until=split.train_end)
    found += _span("validation", split.validation, after=split.train_end, until=split.validation_end)
    found += _span("test", split.test, after=split.validation_end, until=split.test_end)
    for name, cutoff, prices in (("train", split.train_end, split.prices_upto_train_end), ("validation", split.validation_end, split.prices_upto_validation_end)):
        found += _snapshot(f"customers at {name} end", getattr(split, f"customer_snapshot_{name}"), cutoff, "customerID")
        found += _snapshot(f"assets at {name} end", getattr(split, f"asset_snapshot_{name}"), cutoff, "ISIN")
        found += _snapshot(f"prices at {name} end", prices, cutoff, None)
    report = report_of(found)
    return {"ok": report["ok"], "issues": report["errors"], "findings": report["findings"]}


def validate_rolling_split(item: RollingSplit) -> dict:
    name = f"window {item.window}"
    found = _span(f"{name} train", item.train, until=item.cutoff) + _span(f"{name} test", item.test, after=item.cutoff, until=item.test_end)
    for what, df in (("customers", item.customer_snapshot), ("assets", item.asset_snapshot), ("prices", item.prices_upto_t)):
        found += _span(f"{name} {what}", df, until=item.cutoff)
    report = report_of(found)
    return {"ok": report["ok"], "issues": report["errors"], "findings": report["findings"]}
