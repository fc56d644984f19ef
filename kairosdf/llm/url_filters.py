"""Temporal URL lists: every capture judged by the list as it stood at fetch time.

A list is a table of dated entries: on that day a pattern was put on the list
or taken off.  Each pattern's entries become validity intervals, half open,
neighbouring ones of the same state joined.  A pattern is a host, meaning it
and all its subdomains, or a host with a path, meaning every URL whose path
begins with it, up to a slash or the end.  A capture probes the list with all the suffixes of its host
and the prefixes of its path with as many slashes as some listed path has, so the join is on
equal keys; the interval that holds the fetch time is then picked.

Intervals are written as a table before the join, both sides of which are
plain exchanges, so a host with a large share of the captures is split among
tasks; nothing is grouped by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Work


def url_host(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and trailing dot; null if it has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """The path of a URL, "/" if it has none; without query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))


def path_prefixes(path: Column, slashes: list[int]) -> Column:
    """The prefixes of a path that end before a slash or where it does, without and with a slash behind them,
    of those with so many slashes; a path of any depth is cut at the deepest."""
    parts = F.slice(F.split(path, "/", max(slashes, default=0) + 2), 1, max(slashes, default=0) + 1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((k - 1).alias("n"), F.array_join(F.slice(parts, 1, k), "/").alias("p")))
    wanted = lambda n: n.isin(*slashes) if slashes else F.lit(False)
    bare = F.transform(F.filter(ends, lambda x: wanted(x["n"])), lambda x: x["p"])
    closed = F.transform(F.filter(ends, lambda x: wanted(x["n"] + 1)), lambda x: F.concat(x["p"], F.lit("/")))
    return F.array_distinct(F.concat(bare, closed))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) during which a pattern is listed; valid_to is null while it still is.

    entries: (pattern, at, listed).  Of entries of one pattern at one time a
    listing wins.  Entries without pattern, time or state are no entries.
    """
    at = Window.partitionBy("pattern").orderBy("at")
    clean = entries.where("pattern is not null and at is not null and listed is not null").groupBy("pattern", "at").agg(F.max("listed").alias("listed"))
    turns = clean.withColumn("was", F.lag("listed").over(at)).where("was is null or was <> listed")
    spans = turns.withColumn("valid_to", F.lead("at").over(at)).where("listed")
    return spans.select("pattern", F.col("at").alias("valid_from"), "valid_to")


def normal_pattern(pattern: Column) -> Column:
    """Host in lower case without trailing dots; the path as it is, a host alone without a slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^([^/]*)", 1)), r"\.+$", "")
    path = F.regexp_extract(pattern, r"^[^/]*(.*)$", 1)
    whole = F.concat(host, F.when(path == "/", "").otherwise(path))
    return F.when(host != "", whole)


def judge_captures(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: its id, host, blocked, n_matches (patterns active at fetch time),
    and the first of them, by pattern, and since when it was listed.

    captures: (id, url, time); entries: (pattern, at, listed).  A capture is a
    row: rows that repeat an id, or have none, are judged and returned each.
    Captures without a host or time match nothing.  URLs of any length are
    read whole.  Only the named columns are read; an empty list blocks
    nothing, and no captures give an empty result.
    """
    work = Work(captures.sparkSession, "urls")
    listed = entries.select(normal_pattern(F.col("pattern")).alias("pattern"), "at", "listed")
    intervals = work.table("intervals", validity_intervals(listed))
    depth = F.size(F.split("pattern", "/")) - 1
    slashes = sorted(r[0] for r in intervals.where("pattern like '%/%'").select(depth).distinct().collect())  # one number for each depth
    base = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(time_col).alias("time"))
    base = work.table("captures", base)  # so that a row keeps its number
    keys = suffixes(F.col("host"))
    if slashes:
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, lambda h: F.transform(path_prefixes(F.col("path"), slashes), lambda p: F.concat(h, p))))))
    probes = base.where("host is not null and time is not null").select("row", "time", F.explode(keys).alias("pattern"))
    hit = (F.col("time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to")))
    hits = probes.join(intervals, "pattern").where(hit).groupBy("row").agg(F.count("*").alias("n_matches"), F.min(F.struct("pattern", "valid_from")).alias("first"))
    out = base.join(hits, "row", "left")
    n = F.coalesce("n_matches", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "host", (n > 0).alias("blocked"), n.alias("n_matches"), F.col("first.pattern").alias("pattern"), F.col("first.valid_from").alias("listed_at"))
