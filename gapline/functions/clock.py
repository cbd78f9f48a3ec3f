"""Time arithmetic on naive timestamps, as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

second_us = 1_000_000
minute_us = 60 * second_us
hour_us = 60 * minute_us
day_us = 24 * hour_us

# fixed values: the accepted text formats of the source tables
MAIN_FORMAT = "yyyy/MM/dd HH:mm:ss.SSSSSS"
LABEL_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")
SECOND_PREFIX = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
TWO_FORMAT_GATE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def micros(ts) -> Column:
    """Microseconds since 1970 of a naive timestamp (session zone must be UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(_c(us)).cast("timestamp_ntz")


def cell(us, width: int) -> Column:
    """floor(us / width) in exact integer arithmetic, also below zero."""
    us = _c(us)
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def ceil_cell(us, width: int) -> Column:
    return cell(_c(us) + F.lit(width - 1), width)


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(second_us))


def strict_timestamp(text, fmt: str = MAIN_FORMAT) -> Column:
    """One format; a value that does not match raises (ANSI mode)."""
    return F.to_timestamp_ntz(_c(text), F.lit(fmt))


def second_timestamp(value, is_text: bool = True) -> Column:
    """Drop the fraction; text without a `YYYY-MM-DD HH:MM:SS` prefix becomes null."""
    value = _c(value)
    if not is_text:
        return F.date_trunc("second", value).cast("timestamp_ntz")
    prefix = F.regexp_extract(F.trim(value.cast("string")), SECOND_PREFIX, 1)
    return F.when(prefix != "", prefix).try_cast("timestamp_ntz")


def two_format_timestamp(text) -> Column:
    """With or without fraction; another shape gives null, an impossible date raises."""
    text = F.trim(_c(text).cast("string"))
    return F.when(text.rlike(TWO_FORMAT_GATE), text).cast("timestamp_ntz")


def lenient_timestamp(text) -> Column:
    return F.trim(_c(text).cast("string")).try_cast("timestamp_ntz")
