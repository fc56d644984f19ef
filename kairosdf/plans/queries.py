"""Registered queries: one or more for each operator, on the driver's tables, with SQL to compare.

Orders and lineitems stand for a trading history: a lineitem is a trade by its
order's customer in its part, a returned one a sale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Protocol
from ..functions import scalars as S
from ..operators import asof, cleaning, conflicts, encoding, graph, holdings, interactions, rules, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TRAIN_END = "1999-12-31 23:59:59"
EARLY = "1995-06-30 23:59:59"
PROTOCOL = Protocol(
    train_end=TRAIN_END, validation_start="2000-01-01 00:00:00", validation_end="2000-12-31 23:59:59", test_start="2001-01-01 00:00:00", test_end="2001-12-31 23:59:59",
    rolling_cutoffs=("1998-01-01", "1998-07-01", "1999-01-01", "1999-07-01", "2000-01-01"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades; a key of five parts makes them unique."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    kind = F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy")
    joined = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("customerID"), F.col("l_partkey").cast("string").alias("ISIN"), key.alias("transactionID"), kind.alias("transactionType"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_extendedprice").alias("totalValue"), F.col("l_quantity").alias("units"), F.col("o_orderpriority").alias("channel"), F.col("l_suppkey").cast("string").alias("marketID"),
    )


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's state after each order; orders of one moment are told apart by their key."""
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("customerID"), F.col("o_orderdate").alias("timestamp"), "o_orderkey", "o_orderstatus", "o_orderpriority")


def labelled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with labels as raw as the source's, some predicted, some missing."""
    risk = F.expr("case c_nationkey % 5 when 0 then 'Predicted_Low' when 1 then 'Low' when 2 then 'Predicted_Not_Available' when 3 then 'Not_Available' end")
    capacity = F.expr("case c_nationkey % 4 when 0 then 'Predicted_GT300K' when 1 then 'GT300K' when 2 then 'Predicted_CAP_LT30K' end")
    kind = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customerID"), kind.alias("customerType"), risk.alias("riskLevel"), capacity.alias("investmentCapacity"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("lastQuestionnaireDate"), F.lit("1995-01-01").cast("timestamp_ntz").alias("timestamp"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.max("l_extendedprice").alias("closePrice"))
    return trades.select(F.col("l_partkey").cast("string").alias("ISIN"), F.col("l_shipdate").alias("timestamp"), "closePrice")


def raw_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dated assets, each in two categories at the same time."""
    one = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ISIN"), F.col("p_name").alias("assetName"), F.lit(None).cast("string").alias("assetShortName"), F.col("p_brand").alias("assetCategory"),
        F.col("p_type").alias("assetSubCategory"), F.lit("m").alias("marketID"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("industry"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("timestamp"),
    )
    return one.union(one.where("cast(ISIN as bigint) % 3 = 0").withColumn("assetCategory", F.lit("MTF"))).union(one.where("cast(ISIN as bigint) % 7 = 0"))


def graph_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, encoding.IDMapping | encoding.FittedWhenRead]:
    tx = transactions(spark, sf_dir)
    return tx, encoding.FittedWhenRead(asof.upto(tx, TRAIN_END))


_TX = """tx as (select cast(o_custkey as varchar) as "customerID", cast(l_partkey as varchar) as "ISIN",
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') as "transactionID",
    case when l_returnflag = 'R' then 'Sell' else 'Buy' end as "transactionType", l_shipdate as "timestamp", l_extendedprice as "totalValue",
    l_quantity as units, o_orderpriority as channel, cast(l_suppkey as varchar) as "marketID"
    from lineitem join orders on l_orderkey = o_orderkey)"""
_UPTO = f"""\"timestamp\" <= timestamp '{TRAIN_END}'"""
_HELD = f"""held as (select "customerID", "ISIN", cast(sum(case when "transactionType" = 'Sell' then -units else units end) as double) as net_units
    from tx where {_UPTO} group by all)"""
_IDS = f"""c as (select "customerID", row_number() over (order by "customerID") - 1 as customer_idx from (select distinct "customerID" from tx where {_UPTO})),
a as (select "ISIN", row_number() over (order by "ISIN") - 1 as asset_idx from (select distinct "ISIN" from tx where {_UPTO}))"""
_MONEY = 'cast(sum(cast({} as decimal(18, 2))) as double)'


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- holdings and candidates -------------------------------------------------


@query(f"with {_TX}, {_HELD} select *, net_units > 0 as currently_held from held")
def holdings_asof(spark, sf_dir):
    return holdings.build_holdings_asof(transactions(spark, sf_dir), TRAIN_END)


@query(f"""with {_TX}, {_HELD} select "customerID", "ISIN" from held where net_units > 0""")
def currently_held(spark, sf_dir):
    return holdings.build_point_in_time_state(transactions(spark, sf_dir), TRAIN_END).held()


@query(f"with {_TX}, {_HELD} select *, false as currently_held from held where net_units < 0")
def negative_holdings(spark, sf_dir):
    return holdings.negative_holdings(holdings.build_holdings_asof(transactions(spark, sf_dir), TRAIN_END))


@query(f"""with {_TX} select distinct "ISIN" from tx where {_UPTO}""")
def asset_universe_asof(spark, sf_dir):
    return holdings.asset_universe(transactions(spark, sf_dir), TRAIN_END)


@query(f"""with {_TX}, {_HELD}, u as (select distinct "ISIN" from tx where {_UPTO})
select cast(c_custkey as varchar) as "customerID", u."ISIN" from customer, u where c_nationkey = 7 and not exists
    (select 1 from held h where h."customerID" = cast(c_custkey as varchar) and h."ISIN" = u."ISIN" and h.net_units > 0)""")
def candidates_asof(spark, sf_dir):
    """Candidates of one nation's customers: the question names them, as the answer is theirs times all assets."""
    asking = _read(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").cast("string").alias("customerID"))
    return holdings.build_point_in_time_state(transactions(spark, sf_dir), TRAIN_END).all_candidates(asking)


@query(f"""with {_TX}, {_HELD} select "customerID", string_agg("ISIN", ',' order by "ISIN") as held from held where net_units > 0 group by 1""")
def held_sets(spark, sf_dir):
    sets = holdings.held_sets(holdings.build_holdings_asof(transactions(spark, sf_dir), TRAIN_END))
    return sets.select("customerID", F.array_join("held", ",").alias("held"))


# --- as-of reads -------------------------------------------------------------


@query(f"""select cast(o_custkey as varchar) as "customerID", o_orderdate as "timestamp", o_orderkey, o_orderstatus, o_orderpriority, timestamp '{TRAIN_END}' as snapshot_asof_date from (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderdate <= timestamp '{TRAIN_END}') where rn = 1""")
def customer_snapshot_asof(spark, sf_dir):
    return asof.latest_asof(customer_versions(spark, sf_dir), "customerID", TRAIN_END, order=[F.desc("o_orderkey")])


@query(f"""select cast(l_partkey as varchar) as "ISIN", max(l_shipdate) as "timestamp", arg_max(p, l_shipdate) as "closePrice", timestamp '{TRAIN_END}' as snapshot_asof_date from (
    select l_partkey, l_shipdate, max(l_extendedprice) as p from lineitem where l_shipdate <= timestamp '{TRAIN_END}' group by all) group by l_partkey""")
def asset_snapshot_asof(spark, sf_dir):
    return asof.get_asset_snapshot_asof(prices(spark, sf_dir), TRAIN_END)


@query(f"""select cast(l_partkey as varchar) as "ISIN", l_shipdate as "timestamp", max(l_extendedprice) as "closePrice" from lineitem where l_shipdate <= timestamp '{TRAIN_END}' group by all""")
def prices_asof(spark, sf_dir):
    return asof.get_prices_asof(prices(spark, sf_dir), TRAIN_END)


@query("""select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate > timestamp '1998-01-01 23:59:59' and l_shipdate <= timestamp '1998-07-01 23:59:59'""")
def half_open_interval(spark, sf_dir):
    return asof.after_upto(_read(spark, sf_dir, "lineitem"), "1998-01-01 23:59:59", "1998-07-01 23:59:59", "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate")


# --- duplicates and conflicts ------------------------------------------------


@query("select distinct l_orderkey, l_linenumber, l_returnflag from lineitem")
def exact_dedup(spark, sf_dir):
    return conflicts.drop_exact_duplicates(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("select l_orderkey, l_linenumber, count(*) as n_rows from (select distinct * from lineitem) group by all having count(*) > 1")
def key_conflicts(spark, sf_dir):
    return conflicts.conflicting_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from (
    select *, count(*) over (partition by l_orderkey, l_linenumber) as n from (select distinct * from lineitem)) where n > 1""")
def conflicting_rows(spark, sf_dir):
    return conflicts.conflicting_rows(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("""select cast(p_partkey as varchar) as "ISIN", case when p_partkey % 3 = 0 then 'MTF' else p_brand end as "assetCategory" from part""")
def priority_dedup(spark, sf_dir):
    known = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("ISIN"))
    return cleaning.resolve_dual_assets(raw_assets(spark, sf_dir), known).select("ISIN", "assetCategory")


@query("""select l_orderkey || '-' || l_linenumber as "transactionID", count(*) as n_rows from lineitem group by all having count(*) > 1""")
def reused_ids(spark, sf_dir):
    return conflicts.reused_ids(_read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transactionID")))


@query(f"select c_custkey as custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate <= timestamp '{EARLY}')")
def fk_anti(spark, sf_dir):
    return conflicts.unmatched(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), "custkey", asof.upto(_read(spark, sf_dir, "orders"), EARLY, "o_orderdate").select(F.col("o_custkey").alias("custkey")))


@query("""select cast(l_partkey as varchar) as "ISIN", l_shipdate as "timestamp", max(l_extendedprice) as "closePrice" from lineitem where l_partkey in (select p_partkey from part where p_size <= 10) group by all""")
def orphan_semi(spark, sf_dir):
    small = _read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("ISIN"))
    return conflicts.matched(prices(spark, sf_dir), "ISIN", small)


@query(f"""with {_TX}, k as (select *, lag({{'a': "customerID", 'b': "transactionID"}}) over (order by "transactionID") as before from tx)
    select "transactionID" from k where before > {{'a': "customerID", 'b': "transactionID"}}""")
def order_violations(spark, sf_dir):
    """Trades whose customer sorts before that of the trade just before by id."""
    tx = transactions(spark, sf_dir)
    numbered = encoding.dense_ids(tx, "transactionID", "ordinal").join(tx, "transactionID")
    return conflicts.out_of_order(numbered, "ordinal", ["customerID", "transactionID"]).select("transactionID")


# --- cleaners ----------------------------------------------------------------


@query(f"""with {_TX} select * from tx where units > 0 and "totalValue" >= 0""")
def clean_transactions(spark, sf_dir):
    return cleaning.clean_transactions(transactions(spark, sf_dir))


@query("""select cast(c_custkey as varchar) as "customerID", case when c_mktsegment <> 'BUILDING' then c_mktsegment else 'Unknown' end as "customerType",
    case when c_nationkey % 5 < 2 then 'Low' else 'Unknown' end as "riskLevel",
    case c_nationkey % 4 when 0 then 'CAP_GT300K' when 1 then 'CAP_GT300K' when 2 then 'CAP_LT30K' else 'Unknown' end as "investmentCapacity",
    timestamp '1995-01-01' as "lastQuestionnaireDate", timestamp '1995-01-01' as "timestamp",
    c_nationkey % 5 in (0, 2) as is_risk_predicted, c_nationkey % 4 in (0, 2) as is_capacity_predicted from customer""")
def clean_customers(spark, sf_dir):
    return cleaning.clean_customers(labelled_customers(spark, sf_dir))


@query("""select cast(p_partkey as varchar) as "ISIN", p_name as "assetName", 'Unknown' as "assetShortName", case when p_partkey % 3 = 0 then 'MTF' else p_brand end as "assetCategory", p_type as "assetSubCategory",
    'm' as "marketID", 'Unknown' as sector, 'Unknown' as industry, timestamp '1995-01-01' as "timestamp" from part""")
def clean_assets(spark, sf_dir):
    known = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("ISIN"))
    return cleaning.clean_assets(raw_assets(spark, sf_dir), dual=known)


@query("""select cast(s_suppkey as varchar) as "marketID", case when s_nationkey > 5 then s_name else 'Unknown' end as name from supplier""")
def clean_markets(spark, sf_dir):
    markets = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("marketID"), F.when(F.col("s_nationkey") > 5, F.col("s_name")).alias("name"))
    return cleaning.clean_markets(markets.union(markets))


@query("""select cast(l_partkey as varchar) as "ISIN", l_shipdate as "timestamp", max(l_extendedprice) - 20000 as "closePrice" from lineitem group by all having max(l_extendedprice) - 20000 > 0""")
def clean_close_prices(spark, sf_dir):
    return cleaning.clean_close_prices(prices(spark, sf_dir).withColumn("closePrice", F.col("closePrice") - 20000))


@query("""select * from (select cast(l_partkey as varchar) as "ISIN", min(l_shipdate) as "minDate", min(l_shipdate) + interval 20 day - interval 1 day * cast(l_partkey % 40 as int) as "maxDate",
    min(l_extendedprice) as "priceMinDate", max(l_extendedprice) as "priceMaxDate", cast(null as double) as profitability from lineitem group by l_partkey) where "minDate" <= "maxDate" """)
def clean_limit_prices(spark, sf_dir):
    limits = _read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("minDate"), F.min("l_extendedprice").alias("priceMinDate"), F.max("l_extendedprice").alias("priceMaxDate"))
    until = F.expr("minDate + interval 20 days - interval 1 day * cast(l_partkey % 40 as int)")
    return cleaning.clean_limit_prices(limits.select(F.col("l_partkey").cast("string").alias("ISIN"), "minDate", until.alias("maxDate"), "priceMinDate", "priceMaxDate", F.lit(None).cast("double").alias("profitability")))


# --- ids ---------------------------------------------------------------------


@query(f"""with {_TX}, {_IDS} select "customerID", customer_idx from c""")
def dense_customer_ids(spark, sf_dir):
    return graph_inputs(spark, sf_dir)[1].customers


@query(f"""with {_TX}, {_IDS} select "ISIN", asset_idx from a""")
def dense_asset_ids(spark, sf_dir):
    return graph_inputs(spark, sf_dir)[1].assets


@query(f"""with {_TX}, {_IDS} select tx.*, customer_idx, asset_idx from tx join c using ("customerID") join a using ("ISIN")""")
def encode_all(spark, sf_dir):
    tx, mapping = graph_inputs(spark, sf_dir)
    return encoding.encode_transactions(tx, mapping, drop_unknown=True)


_EARLY_IDS = _IDS.replace(TRAIN_END, EARLY)


@query(f"""with {_TX}, {_EARLY_IDS} select tx.*, customer_idx, asset_idx from tx join c using ("customerID") join a using ("ISIN")""")
def encode_drop_unknown(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return encoding.encode_transactions(tx, encoding.fit_id_mapping(asof.upto(tx, EARLY)), drop_unknown=True)


@query(f"""with {_TX}, {_EARLY_IDS}, x as (select "customerID", "ISIN", customer_idx is null as nc, asset_idx is null as na from tx left join c using ("customerID") left join a using ("ISIN") where "timestamp" > timestamp '{EARLY}')
select count(*) as rows, count_if(nc)::bigint as unknown_customer_rows, count_if(na)::bigint as unknown_asset_rows, count_if(nc or na)::bigint as unknown_any_rows,
    count(distinct case when nc then "customerID" end) as unknown_customers, count(distinct case when na then "ISIN" end) as unknown_assets from x""")
def cold_start_stats(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    later = tx.where(F.col("timestamp") > S.timestamp(EARLY))
    return encoding.cold_start_table(later, encoding.fit_id_mapping(asof.upto(tx, EARLY)))


# --- graph -------------------------------------------------------------------

_EVENTS = f"""{_TX}, {_IDS}, n as (select count(*) as n from c),
e as (select "customerID" || ':' || "transactionID" as event_id, "customerID", "ISIN", "transactionID", customer_idx as src_customer_idx, asset_idx as dst_asset_idx,
    customer_idx as src_node_idx, n + asset_idx as dst_node_idx, "timestamp", cast(floor(epoch("timestamp")) as bigint) as unix_timestamp, "transactionType" as event_type,
    cast("transactionType" = 'Buy' as tinyint) as is_buy, case when "transactionType" = 'Buy' then units else -units end as signed_units, "totalValue" as total_value
    from tx join c using ("customerID") join a using ("ISIN"), n where {_UPTO})"""


def _events(spark, sf_dir) -> graph.TemporalGraphEvents:
    tx, mapping = graph_inputs(spark, sf_dir)
    return graph.build_temporal_graph_events(tx, as_of=TRAIN_END, mapping=mapping)


@query(f"with {_EVENTS} select * from e")
def graph_events(spark, sf_dir):
    return _events(spark, sf_dir).frame


@query(f"""with {_EVENTS} select event_id, is_buy, round(sign(signed_units) * ln(1 + abs(signed_units)), 6) as signed_log_units, round(ln(1 + total_value), 6) as log_total_value from e""")
def graph_messages(spark, sf_dir):
    x = graph.message_features(_events(spark, sf_dir).frame)
    return x.withColumns({c: F.round(c, 6) for c in ("signed_log_units", "log_total_value")})


@query(f"""with {_EVENTS} select src_customer_idx, dst_asset_idx, count(*) as event_count, sum(is_buy)::bigint as buy_count, sum(1 - is_buy)::bigint as sell_count,
    sum(signed_units) as net_units, {_MONEY.format('total_value')} as total_value, max("timestamp") as last_timestamp from e group by 1, 2""")
def interaction_snapshot(spark, sf_dir):
    return graph.edge_snapshot(_events(spark, sf_dir).frame)


@query(f"""with {_TX}, {_IDS} select customer_idx, asset_idx, count(*)::float as weight, {_MONEY.format('"totalValue"')} as total_value, max("timestamp") as last_timestamp
    from tx join c using ("customerID") join a using ("ISIN") where {_UPTO} and "transactionType" = 'Buy' group by 1, 2""")
def baseline_interactions(spark, sf_dir):
    tx, mapping = graph_inputs(spark, sf_dir)
    return interactions.baseline_interactions(asof.upto(tx, TRAIN_END), mapping, value=True).pairs


def _window_query(unit: str, frequency: str) -> None:
    def run(spark, sf_dir):
        return graph.window_counts(_read(spark, sf_dir, "events"), frequency, "ts")

    run.__name__ = f"calendar_windows_{unit}"
    query(f"select cast(date_trunc('{unit}', ts) as timestamp) as window_start, count(*) as n_events from events group by 1")(run)


for _unit, _frequency in (("hour", "h"), ("day", "D"), ("week", "W"), ("month", "ME")):
    _window_query(_unit, _frequency)


@query("select cast(date_trunc('quarter', l_shipdate) as timestamp) as window_start, count(*) as n_events from lineitem group by 1")
def calendar_windows_quarter(spark, sf_dir):
    return graph.window_counts(_read(spark, sf_dir, "lineitem"), "QE", "l_shipdate")


@query("select cast(date_trunc('year', l_shipdate) as timestamp) as window_start, count(*) as n_events from lineitem group by 1")
def calendar_windows_year(spark, sf_dir):
    return graph.window_counts(_read(spark, sf_dir, "lineitem"), "YE", "l_shipdate")


# --- splits ------------------------------------------------------------------

_PART = f"""case when {_UPTO} then 'train' when "timestamp" between timestamp '2000-01-01' and timestamp '2000-12-31 23:59:59' then 'validation'
    when "timestamp" between timestamp '2001-01-01' and timestamp '2001-12-31 23:59:59' then 'test' end"""


def _split_query(part: str) -> None:
    def run(spark, sf_dir):
        return splits.build_primary_split(transactions(spark, sf_dir), protocol=PROTOCOL).parts()[part]

    run.__name__ = f"split_{part}"
    query(f"with {_TX} select * from tx where {_PART} = '{part}'")(run)


for _part in ("train", "validation", "test"):
    _split_query(_part)


@query(f"""with {_TX}, p as (select *, {_PART} as split from tx), t as (select * from p where split = 'train')
select split, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') as start, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') as "end", count(*) as rows, count(distinct "customerID") as customers, count(distinct "ISIN") as assets,
    count(distinct case when "customerID" not in (select "customerID" from t) then "customerID" end) as unseen_customers,
    count(distinct case when "ISIN" not in (select "ISIN" from t) then "ISIN" end) as unseen_assets from p where split is not null group by split""")
def split_summary(spark, sf_dir):
    return splits.split_summary(transactions(spark, sf_dir), PROTOCOL)


_BOUNDS = """b as (select "window", day + interval 1 day - interval 1 second as lo, day + interval 1 day - interval 1 second + interval 6 month as hi from (values
    (1, timestamp '1998-01-01'), (2, timestamp '1998-07-01'), (3, timestamp '1999-01-01'), (4, timestamp '1999-07-01'), (5, timestamp '2000-01-01')) v("window", day))"""


@query(f"""with {_TX}, {_BOUNDS}, x as (select b.*, tx.*, "timestamp" <= lo as old from tx join b on "timestamp" <= hi)
select "window", strftime(lo, '%Y-%m-%d %H:%M:%S') as cutoff, strftime(hi, '%Y-%m-%d %H:%M:%S') as test_end, count_if(old)::bigint as train_rows, count_if(not old)::bigint as test_rows,
    count(distinct case when old then "customerID" end) as train_customers, count(distinct case when not old then "customerID" end) as test_customers,
    count(distinct case when old then "ISIN" end) as train_assets, count(distinct case when not old then "ISIN" end) as test_assets from x group by all""")
def rolling_summary(spark, sf_dir):
    return splits.rolling_summary(transactions(spark, sf_dir), PROTOCOL)


@query(f"""with {_TX}, {_BOUNDS} select "window", tx.* from tx join b on "timestamp" > lo and "timestamp" <= hi""")
def rolling_test_windows(spark, sf_dir):
    parts = [x.test.select(F.lit(x.window).alias("window"), "*") for x in splits.build_rolling_splits(transactions(spark, sf_dir), protocol=PROTOCOL)]
    return reduce(DataFrame.union, parts)


@query(f"""with {_TX}, {_BOUNDS} select "window", count(*) as n_rows, {_MONEY.format('"totalValue"')} as total_value from tx join b on "timestamp" <= lo group by 1""")
def rolling_train_windows(spark, sf_dir):
    parts = [x.train.select(F.lit(x.window).alias("window"), "totalValue") for x in splits.build_rolling_splits(transactions(spark, sf_dir), protocol=PROTOCOL)]
    return reduce(DataFrame.union, parts).groupBy("window").agg(F.count("*").alias("n_rows"), S.exact_sum(F.col("totalValue")).alias("total_value"))


@query(f"""with {_TX}, p as (select *, {_PART} as split from tx) select "customerID", "ISIN", "transactionID" from p where split = 'test' and not exists
    (select 1 from p t where t.split = 'train' and t."customerID" = p."customerID" and t."ISIN" = p."ISIN")""")
def unseen_pairs(spark, sf_dir):
    split = splits.build_primary_split(transactions(spark, sf_dir), protocol=PROTOCOL)
    return splits.new_pairs(split.test, split.train).select("customerID", "ISIN", "transactionID")


@query(f"""with {_TX} select count(*) as clean_transactions, count(p)::bigint as assigned_rows, (count(*) - count(p))::bigint as unassigned_rows, count(*) = count(p) as ok from (select {_PART} as p from tx)""")
def coverage(spark, sf_dir):
    return spark.createDataFrame([splits.coverage(transactions(spark, sf_dir), PROTOCOL)], "clean_transactions long, assigned_rows long, unassigned_rows long, ok boolean")


# --- rules -------------------------------------------------------------------


@query("""with d as (select l_orderkey, case when l_linenumber > 3 then l_linenumber end as line from lineitem)
select count(*) as rows, 2::bigint as columns, count_if(line is null)::bigint as missing_cells, (count(*) - (select count(*) from (select distinct * from d)))::bigint as duplicate_rows from d""")
def table_profile(spark, sf_dir):
    return rules.table_profile(_read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("line")))


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The six tables; markets lack those of one nation, and some customers have no version."""
    text = F.lit("x")
    markets = _read(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(text.alias("exchangeID"), F.col("s_suppkey").cast("string").alias("marketID"), *[text.alias(c) for c in ("name", "description", "country", "tradingDays", "tradingHours", "marketClass")])
    limits = prices(spark, sf_dir).groupBy("ISIN").agg(F.min("timestamp").alias("minDate"), F.max("timestamp").alias("maxDate"), F.min("closePrice").alias("priceMinDate"), F.max("closePrice").alias("priceMaxDate")).withColumn("profitability", F.lit(0.0))
    return {
        "customers": labelled_customers(spark, sf_dir), "assets": raw_assets(spark, sf_dir), "markets": markets, "close_prices": prices(spark, sf_dir),
        "limit_prices": limits, "transactions": transactions(spark, sf_dir),
    }


def _findings(spark, reports: dict[str, dict]) -> DataFrame:
    """The findings of several reports: about, severity, rule, table, columns, n_rows."""
    rows = [(about, x["severity"], x["rule"], x["table"], ",".join(x["columns"]), x["rows"]) for about, r in reports.items() for x in r["findings"]]
    return spark.createDataFrame(rows, "about string, severity string, rule string, `table` string, columns string, n_rows long")


@query("""with bad as (select count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey = 3)),
    dual as (select sum(case when p_partkey % 3 = 0 then 2 else 0 end)::bigint as n from part)
select 'data' as about, 'error' as severity, 'one_version' as rule, 'assets' as "table", 'ISIN,timestamp' as columns, n as n_rows from dual
union all select 'data', 'error', 'known_reference', 'transactions', 'marketID', n from bad where n > 0
union all select 'data', 'warning', 'history_reaches_end', 'transactions', 'timestamp', 0 from lineitem having max(l_shipdate) < timestamp '2001-12-31'""")
def quality_rules(spark, sf_dir):
    return _findings(spark, {"data": rules.validate_dataset(_tables(spark, sf_dir), PROTOCOL)})


@query("select 'primary' as split, true as ok, 0::bigint as issues union all select 'rolling ' || n, true, 0 from range(1, 6) t(n)")
def leakage_rules(spark, sf_dir):
    tx, versions, dated = transactions(spark, sf_dir), labelled_customers(spark, sf_dir), prices(spark, sf_dir)
    inputs = tx, versions, dated, dated
    checks = [("primary", rules.validate_primary_split(splits.build_primary_split(*inputs, PROTOCOL)))]
    checks += [(f"rolling {x.window}", rules.validate_rolling_split(x)) for x in splits.build_rolling_splits(*inputs, PROTOCOL)]
    return spark.createDataFrame([(n, c["ok"], len(c["issues"])) for n, c in checks], "split string, ok boolean, issues long")


# --- scalar functions --------------------------------------------------------


@query("""select c_custkey, c_nationkey % 5 in (0, 2) as predicted, case when c_nationkey % 5 < 2 then 'Low' else 'Unknown' end as label from customer""")
def label_functions(spark, sf_dir):
    raw = F.expr("case c_nationkey % 5 when 0 then 'Predicted_Low' when 1 then 'Low' when 2 then 'Predicted_Not_Available' when 3 then 'Not_Available' end")
    return _read(spark, sf_dir, "customer").select("c_custkey", S.predicted_flag(raw).alias("predicted"), S.plain_label(raw).alias("label"))


@query("""select event_id, cast(floor(epoch(ts)) as bigint) as seconds, cast(date_trunc('day', ts) as timestamp) as midnight,
    cast(date_trunc('day', ts) as timestamp) + interval 1 day - interval 1 second as day_end, ts + interval 6 month as later from events""")
def time_functions(spark, sf_dir):
    ts = F.col("ts")
    return _read(spark, sf_dir, "events").select("event_id", S.epoch_seconds(ts).alias("seconds"), S.midnight(ts).alias("midnight"), S.end_of_day(S.midnight(ts)).alias("day_end"), S.add_months(ts, 6).alias("later"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings_asof(spark, sf_dir)
