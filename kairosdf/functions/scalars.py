"""Column functions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNKNOWN

PREDICTED = "Predicted_"
NOT_AVAILABLE = "Not_Available"
SUM_TYPE = "decimal(38,12)"


def timestamp(value) -> Column:
    """A timestamp without time zone from a Column, string, date or datetime."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")


def predicted_flag(label: Column) -> Column:
    """Whether a label begins with the prefix of predicted ones; of a null, false."""
    return F.coalesce(label.startswith(PREDICTED), F.lit(False))


def plain_label(label: Column, renames: dict[str, str] | None = None) -> Column:
    """A label without the prefix, wherever it stands; unavailable and null ones are Unknown."""
    bare = F.replace(label, F.lit(PREDICTED), F.lit(""))
    out = F.when(bare.isNull() | (bare == NOT_AVAILABLE), UNKNOWN)
    for old, new in (renames or {}).items():
        out = out.when(bare == old, new)
    return out.otherwise(bare)


def known(text: Column) -> Column:
    return F.coalesce(text, F.lit(UNKNOWN))


def is_sale(kind: Column) -> Column:
    """Sell, in any case and with blanks around; a null is none."""
    return F.coalesce(F.lower(F.trim(kind)) == "sell", F.lit(False))


def held_units(kind: Column, units: Column) -> Column:
    """Units as a position counts them: sales take away, anything else adds."""
    return F.when(is_sale(kind), -units).otherwise(units)


def is_buy(kind: Column) -> Column:
    return F.coalesce(kind == "Buy", F.lit(False)).cast("tinyint")


def traded_units(kind: Column, units: Column) -> Column:
    """Units as an event carries them: purchases add, anything else takes away."""
    return F.when(kind == "Buy", units.cast("double")).otherwise(-units.cast("double"))


def exact_sum(value: Column) -> Column:
    """Sum without rounding to twelve decimals, in any order the same; of nothing 0.0."""
    return F.coalesce(F.sum(F.nanvl(value.cast("double"), F.lit(None).cast("double")).cast(SUM_TYPE)), F.lit(0).cast(SUM_TYPE)).cast("double")


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, read as UTC whatever the session's."""
    return F.timestamp_diff("SECOND", timestamp("1970-01-01 00:00:00"), at)


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def log_value(value: Column) -> Column:
    return F.log1p(value)


def message(signed_units: Column, total_value: Column, buy: Column) -> Column:
    """The features of an event: whether it buys, and the logs of its units and value, as 32-bit floats."""
    return F.array(buy.cast("float"), signed_log(signed_units).cast("float"), log_value(total_value).cast("float"))


def end_of_day(day: Column) -> Column:
    return day + F.expr("interval 1 day") - F.expr("interval 1 second")


def add_months(at: Column, months: int) -> Column:
    """Months later at the same time of day, on the month's last day if it is shorter."""
    return at + F.expr(f"interval {int(months)} months")


def midnight(at: Column) -> Column:
    return F.date_trunc("day", at).cast("timestamp_ntz")


#: calendar frequencies and their aliases
FREQUENCIES = {"M": "month", "ME": "month", "Q": "quarter", "QE": "quarter", "Y": "year", "YE": "year", "A": "year", "W": "week", "D": "day", "h": "hour", "H": "hour"}


def calendar_bucket(at: Column, frequency: str) -> Column:
    """First moment of the calendar period; weeks begin on Monday."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency {frequency!r}; one of {sorted(FREQUENCIES)}")
    return F.date_trunc(FREQUENCIES[frequency], at).cast("timestamp_ntz")


def missing_cells(columns: dict[str, str]) -> Column:
    """Cells of a row that hold nothing: nulls, and NaN in doubles and floats."""
    total = F.lit(0).cast("long")
    for name, kind in columns.items():
        c = F.col(f"`{name}`")
        total = total + (c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()).cast("long")
    return total
