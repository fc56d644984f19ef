"""From raw tables to clean ones, with a report."""

from __future__ import annotations

import argparse
import json
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLEAN_FILES, RAW_FILES, TRANSACTION_KEY
from ..functions.scalars import missing_cells
from ..operators.cleaning import CLEANERS, REFERS_TO, SINK_ORDER, Notes, check_references, drop_orphans
from ..operators.conflicts import keeping_rows, key_counts
from ..sources.files import write_json
from ..sources.tables import LONG, load_raw_tables, side_by_side, write_table


@contextmanager
def kept(tables: dict[str, DataFrame]):
    """Within it, tables are kept, as more than one action reads them."""
    for df in tables.values():
        df.persist()
    try:
        yield
    finally:
        for df in tables.values():
            df.unpersist()


def clean_tables(raw: dict[str, DataFrame], notes: Notes | None = None) -> dict[str, DataFrame]:
    """Clean each table, drop prices of unknown assets, and refuse transactions that refer to nothing.  Of a part of
    the tables, those that they refer to among them, each is cleaned and checked as among all.

    The clean tables are kept, as the checks, the writers and the report read them; unpersist them when done.
    """
    names = [name for name in RAW_FILES if name in raw]
    own = {name: Notes() for name in names}  # tables are cleaned side by side; notes are put in the tables' order
    done = {}

    def clean_one(name):
        with keeping_rows() as rows:
            try:
                done[name] = CLEANERS[name](raw[name], None if notes is None else own[name]).persist()
                done[name].count()  # so that no two checks, side by side, make the rows that they read
            finally:
                for df in rows:
                    if name not in done or not df.sameSemantics(done[name]):
                        df.unpersist()

    clean = {}
    try:
        try:
            side_by_side(clean_one, names)
        finally:
            for name in names if notes is not None else ():
                notes.taken += own[name].taken
        clean = drop_orphans({name: done[name] for name in names}, notes)
        for name in names:
            if clean[name] is not done[name]:
                clean[name].persist().count()
                done[name].unpersist()
        if "transactions" in clean:
            check_references(clean)
    except Exception:
        for df in [*done.values(), *clean.values()]:
            df.unpersist()
        raise
    return clean


def cleaning_report(raw: dict[str, DataFrame], clean: dict[str, DataFrame], notes: Notes | None = None) -> dict:
    def one(name):
        before = raw[name].count()
        after = clean[name].agg(F.count("*").alias("n"), F.coalesce(F.sum(missing_cells(dict(clean[name].dtypes))), F.lit(0)).alias("m")).head()
        return {"input_rows": before, "output_rows": after["n"], "removed_rows": before - after["n"], "missing_cells_after_cleaning": after["m"]}

    of_tx = [lambda: key_counts(clean["transactions"], TRANSACTION_KEY, "transactionID"), lambda: clean["transactions"].agg(F.min("timestamp").cast("string"), F.max("timestamp").cast("string")).head()] if "transactions" in clean else []
    longest = sorted(clean, key=lambda name: name not in LONG)  # they start first
    done = side_by_side(lambda f: f(), [*of_tx, *[partial(one, name) for name in longest]])
    found = dict(zip(longest, done[len(of_tx):], strict=True))
    tables = {name: found[name] for name in clean}
    report = {"ok": True, "transaction_key": TRANSACTION_KEY, "tables": tables, "notes": [dict(zip(("table", "what", "rows"), x, strict=True)) for x in (notes.taken if notes else [])]}
    if not of_tx:
        return report
    counts, span = done[:2]
    return report | {
        "transactions": {
            "unique_composite_keys": counts[0], "globally_reused_transaction_ids": counts[1],
            "min_timestamp": span[0] or "NaT", "max_timestamp": span[1] or "NaT",
        },
    }


def with_references(names: list[str]) -> list[str]:
    """The named tables and those that they refer to, in the order of all."""
    return [x for x in RAW_FILES if x in names or any(x in REFERS_TO.get(name, ()) for name in names)]


def run_cleaning(spark: SparkSession, input_dir: str, output_dir: str, report_path: str | None = None, *, kind: str = "csv", raw_kind: str = "csv", names: list[str] | None = None, compression: str | None = None) -> dict:
    """Nothing is written unless every check passes.  What was dropped is in the report's notes and warned of.
    names: these tables only, with those that they refer to; no others are read, checked or written."""
    raw, notes = load_raw_tables(spark, input_dir, raw_kind, None if names is None else with_references(names)), Notes()
    # raw tables aren't kept: what memory doesn't hold of them would lie on disk beside their files and the clean rows
    clean = clean_tables(raw, notes)
    try:
        file = lambda x: CLEAN_FILES[x] if kind == "csv" else CLEAN_FILES[x].removesuffix(".csv") + ".parquet"
        side_by_side(lambda x: write_table(clean[x], f"{output_dir}/{file(x)}", kind, SINK_ORDER[x], compression), clean)
        report = cleaning_report(raw, clean, notes)
    finally:
        for df in clean.values():
            df.unpersist()
    spark._jvm.System.gc()  # Spark removes shuffle files once the driver has collected the plans that wrote them
    if report_path is not None:
        write_json(spark, report_path, report)
    return report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Clean the six tables")
    parser.add_argument("--input-dir", default="data/raw")
    parser.add_argument("--output-dir", default="data/processed")
    parser.add_argument("--report", default="reports/cleaning_report.json")
    args = parser.parse_args(argv)
    print(json.dumps(run_cleaning(SparkSession.builder.getOrCreate(), args.input_dir, args.output_dir, args.report), indent=2))


if __name__ == "__main__":
    main()
