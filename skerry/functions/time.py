"""Time: epochs in any unit, zones, and date templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry import contracts

ZONE = "Asia/Hong_Kong"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def epoch_seconds(x: Column, unit: str = "s") -> Column:
    """Seconds from a number in s, ms, us or, by the count of its whole digits (9 or 10, 13, 16), auto."""
    contracts.option(unit, ("s", "ms", "us", "auto"), "unit")
    scale = {"s": 1.0, "ms": 1e3, "us": 1e6}
    if unit != "auto":
        return x.cast("double") / scale[unit]
    digits = F.length(F.abs(x).cast("decimal(38,0)").cast("string"))
    return F.when(digits.isin(9, 10), x.cast("double")).when(digits == 13, x.cast("double") / 1e3).when(digits == 16, x.cast("double") / 1e6)


def to_zone(x: Column, zone: str = ZONE, unit: str = "s") -> Column:
    """Wall-clock time in a zone, as a timestamp without zone."""
    us = (epoch_seconds(x, unit) * 1_000_000).cast("long")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))


def from_zone(wall: Column, zone: str = ZONE) -> Column:
    """Epoch seconds of a wall-clock time in a zone."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), utc) / 1e6


def real_date(text: Column, base: Column) -> Column:
    """[DATE], [DATE+n] and [DATE-n] in a text become base, n days later or earlier, as yyyyMMdd."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[DATE(?:[+-][0-9]+)?\])"), 1))

    def put(acc: Column, mark: Column) -> Column:
        shift = F.coalesce(F.expr("try_cast(1 as int)") * F.try_to_number(F.regexp_replace(F.regexp_extract(mark, r"([+-]?[0-9]+)\]$", 1), r"^\+", ""), F.lit("S999999")).cast("int"), F.lit(0))
        return F.replace(acc, mark, F.date_format(F.date_add(base, shift), "yyyyMMdd"))

    return F.aggregate(marks, text, put)
