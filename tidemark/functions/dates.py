"""Tolerant times: what cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_instant(text: Column | str) -> Column:
    """A time with or without zone; without one it is UTC (the session's zone)."""
    return F.try_to_timestamp(F.when(F.trim(_col(text)) != "", F.trim(_col(text))))


def compact_instant(number: Column | str) -> Column:
    """YYYYMMDDHHMMSS as a zone-free time."""
    return F.try_to_timestamp(F.lpad(_col(number).cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def acquisition_instant(day: Column | str, hhmm: Column | str) -> Column:
    """A date and a time of day whose leading zeros may be missing."""
    return F.try_to_timestamp(F.concat(_col(day), F.lit(" "), F.lpad(_col(hhmm).cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")


def within_days(a: Column | str, b: Column | str, days: int) -> Column:
    """Whether two date strings lie so near; false if one cannot be read."""
    read = lambda c: F.to_date(F.try_to_timestamp(F.substring(_col(c).cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.abs(F.date_diff(read(a), read(b))) <= days, F.lit(False))


def event_date(*fields: Column | str) -> Column:
    """The first ten characters of the first field that isn't empty."""
    return F.substring(F.coalesce(*[F.when(F.trim(_col(f)) != "", F.trim(_col(f))) for f in fields]), 1, 10)


def anchor(**times: Column) -> tuple[Column, Column]:
    """The first time that is there, in the order given, and which it is."""
    basis = F.lit(None).cast("string")
    for name, value in reversed(times.items()):
        basis = F.when(value.isNotNull(), name).otherwise(basis)
    return F.coalesce(*times.values()), basis


def partition_date(slice_id: Column | str) -> Column:
    text = _col(slice_id).cast("string")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))


def slice_calendar(start: str, end: str) -> Column:
    """All quarter hours from start (floored) to end, both included."""
    floored = F.expr(f"timestampadd(MINUTE, -(minute(timestamp_ntz'{start}') % 15), date_trunc('MINUTE', timestamp_ntz'{start}'))").cast("timestamp_ntz")
    return F.sequence(floored, F.to_timestamp_ntz(F.lit(end)), F.expr("INTERVAL 15 MINUTES"))


def retry_delay(attempts: Column | str) -> Column:
    """Seconds until the next attempt: 60 doubled each time, at most 3600."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), _col(attempts))).cast("long")


def report_stamp(instant: Column | str) -> Column:
    """Day of two digits and month in Roman numerals: 05\u00b7XI."""
    romans = F.array(*[F.lit(r) for r in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")])
    return F.concat(F.date_format(_col(instant), "dd"), F.lit("\u00b7"), F.element_at(romans, F.month(_col(instant))))
