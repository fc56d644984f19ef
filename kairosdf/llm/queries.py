"""The registered queries of the corpus operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup_report

    return line_dedup_report(_table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pu_classifier import quality_classifier

    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import brown_scores

    return brown_scores(_table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminations

    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("rid")


@query
def op5_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


@query
def op6_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def mix_settings() -> dict:
    """The mix: domains are groups of sources; half the corpus's words, at most two epochs of a source."""
    return {
        "share": (1, 2),
        "domain": F.translate(F.substring(F.md5("source"), 1, 1), "0123456789abcdef", "aaaabbbbccccdddd"),
        "weights": {
            "domain": F.expr("case domain when 'a' then 4 when 'b' then 3 when 'c' then 2 else 1 end"),
            "lang": F.expr("case lang when 'en' then 4 when 'de' then 3 when 'fr' then 3 else 2 end"),
            "source": F.expr("case when source in ('src0', 'src1') then 3 else 2 end"),
        },
        "max_epochs": 2,
        "seed": 7,
    }


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import select_mix

    return select_mix(_table(spark, sf_dir, "documents"), **mix_settings())


def _fill_sql(name: str, parent: str, key: str) -> str:
    over = f"over (partition by {parent})"
    at = f"over (partition by {parent} order by ratio, {key}"
    return f"""
{name}1 as (select *, (cap::hugeint * 1000000) // weight as ratio from {name}0 where weight > 0 and cap > 0),
{name}2 as (select *, coalesce(sum(cap) {at} rows between unbounded preceding and 1 preceding), 0)::hugeint as above,
    sum(weight) {at} rows between current row and unbounded following)::hugeint as weights from {name}1),
{name}3 as (select *, cap::hugeint * weights <= (total - above) * weight as fits from {name}2),
{name}4 as (select *, min(case when not fits then struct_pack(r := ratio, k := {key}) end) {over} as open from {name}3),
{name}5 as (select *, open is null or struct_pack(r := ratio, k := {key}) < open as filled from {name}4),
{name}6 as (select *, coalesce(sum(case when filled then cap end) {over}, 0)::hugeint as spent,
    coalesce(sum(case when not filled then weight end) {over}, 1)::hugeint as shared from {name}5),
{name} as (select *, case when filled then cap else (((total - spent) * weight) // shared)::bigint end as budget from {name}6)"""


def _place_sql(epoch: str) -> str:
    return f"('0x' || substr(md5('7:' || {epoch} || ':' || coalesce(doc_id::varchar, '')), 1, 8))::bigint"


ORACLE_SQL["op8_source_mixing"] = f"""
with docs as (
    select doc_id, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
        coalesce(translate(substr(md5(source), 1, 1), '0123456789abcdef', 'aaaabbbbccccdddd'), 'unknown') as domain,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
    from documents),
base as (select * from docs where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, 2 * sum(n_tokens)::bigint as cap from base group by all),
d0 as (select domain, sum(cap)::bigint as cap, case domain when 'a' then 4 when 'b' then 3 when 'c' then 2 else 1 end as weight,
    least((select sum(tokens) // 2 from leaves), (select sum(cap) from leaves)) as total from leaves group by domain),
{_fill_sql("d", "0", "domain")},
l0 as (select x.*, d.budget as total from (select domain, lang, sum(cap)::bigint as cap,
    case lang when 'en' then 4 when 'de' then 3 when 'fr' then 3 else 2 end as weight from leaves group by domain, lang) x join d using (domain)),
{_fill_sql("l", "domain", "lang")},
s0 as (select x.*, l.budget as total from (select *, case when source in ('src0', 'src1') then 3 else 2 end as weight from leaves) x join l using (domain, lang)),
{_fill_sql("s", "domain, lang", "source")},
placed as (select b.*, (s.budget // s.tokens)::int as "full", s.budget % s.tokens as rest, {_place_sql('(s.budget // s.tokens)::int')} as place
    from base b join s using (domain, lang, source)),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by place, doc_id nulls first) as upto from placed)
select doc_id, domain, lang, source, n_tokens, ("full" + (upto <= rest)::int)::int as epochs from run where "full" + (upto <= rest)::int > 0
"""


def _day(key: F.Column, salt: str) -> F.Column:
    """A day of the years from 2020, from a hash."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 6), 16, 10).cast("int")
    return F.date_add(F.lit("2020-01-01").cast("date"), digits % 1461)


def _hex(key: F.Column, salt: str) -> F.Column:
    return F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 1)


@query
def op2_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures, fetched on a day drawn from their id; a list drawn from their hosts and
    parent domains, with listings, some of them ended and some of those renewed, and some of paths."""
    from .url_filters import judge_captures, suffixes, url_host, url_path

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(F.explode(suffixes(url_host(F.col("url")))).alias("pattern")).distinct().where("pattern like '%.%'")
    paths = pages.select(F.concat(url_host(F.col("url")), F.regexp_extract(url_path(F.col("url")), "^(/[^/]*)", 1)).alias("pattern")).distinct()
    key = F.col("pattern")
    on = hosts.where(_hex(key, "h") < "8").union(paths.where(_hex(key, "p") < "4")).distinct()
    dates = F.array(
        F.struct(_day(key, "a").alias("at"), F.lit(True).alias("listed")),
        F.struct(F.when(_hex(key, "x") < "c", _day(key, "b")).alias("at"), F.lit(False).alias("listed")),
        F.struct(F.when(_hex(key, "y") < "8", _day(key, "c")).alias("at"), F.lit(True).alias("listed")),
    )
    entries = on.select("pattern", F.explode(dates).alias("x")).select("pattern", "x.at", "x.listed").where("at is not null")
    captures = pages.withColumn("fetched_at", _day(F.col("page_id").cast("string"), "f"))
    return judge_captures(captures, entries, id_col="page_id").withColumn("listed_at", F.col("listed_at").cast("string"))


def _day_sql(key: str, salt: str) -> str:
    return f"(date '2020-01-01' + (('0x' || substr(md5('{salt}' || {key}), 1, 6))::int % 1461))"


ORACLE_SQL["op2_temporal_url_list"] = rf"""
with pg as (select row_number() over () as rid, page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') as host,
    case when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end as path,
    {_day_sql("page_id::varchar", "f")} as t from pages),
suffix as (select rid, t, host, path, array_to_string(labels[k:], '.') as s from (
    select *, unnest(range(1, len(labels) + 1)) as k from (select *, string_split(host, '.') as labels from pg where host is not null))),
patterns as (
    select distinct s as pattern from suffix where s like '%.%' and substr(md5('h' || s), 1, 1) < '8'
    union
    select distinct p from (select host || regexp_extract(path, '^(/[^/]*)', 1) as p from pg) where substr(md5('p' || p), 1, 1) < '4'),
raw as (
    select pattern, {_day_sql("pattern", "a")} as since, true as listed from patterns
    union all select pattern, {_day_sql("pattern", "b")}, false from patterns where substr(md5('x' || pattern), 1, 1) < 'c'
    union all select pattern, {_day_sql("pattern", "c")}, true from patterns where substr(md5('y' || pattern), 1, 1) < '8'),
entries as (select case when ends_with(pattern, '/') and instr(pattern, '/') = length(pattern) then rtrim(pattern, '/') else pattern end as pattern, since, max(listed) as listed from raw group by 1, 2),
turns as (select * from (select *, lag(listed) over (partition by pattern order by since) as was from entries) where was is null or was <> listed),
spans as (select * from (select *, lead(since) over (partition by pattern order by since) as until from turns) where listed),
prefixes as (select rid, t, s, unnest(list_distinct(list_concat(ends, list_transform(ends, lambda e: e || '/')))) as p from (
    select *, list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[1:k], '/')) as ends from (
        select *, string_split(path, '/') as parts from suffix))),
probes as (select rid, t, s as pattern from suffix union select rid, t, s || p from prefixes),
hits as (select rid, count(distinct pattern) as n, min(struct_pack(p := pattern, f := since)) as first
    from probes join spans using (pattern) where t >= since and (until is null or t < until) group by rid)
select page_id, host, coalesce(n, 0) > 0 as blocked, coalesce(n, 0)::bigint as n_matches, first.p as pattern, first.f::varchar as listed_at from pg left join hits using (rid)
"""
