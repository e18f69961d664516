"""Numbers out of text, and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET, KNOTS = 0.3048, 0.514444


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_integer(text: Column | str) -> Column:
    """The first whole number; dots between groups of three digits are taken out."""
    return F.replace(F.regexp_extract(_col(text), r"(\d{1,3}(?:\.\d{3})+|\d+)", 1), F.lit("."), F.lit("")).try_cast("long")


def scaled_decimal(text: Column | str) -> Column:
    """A German decimal number times its Million or Milliarde."""
    text = _col(text)
    number = F.replace(F.replace(F.regexp_extract(text, r"(\d[\d.]*(?:,\d+)?)", 1), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    scale = F.when(text.rlike("(?i)milliarde|mrd"), 1e9).when(text.rlike("(?i)million|mio"), 1e6).otherwise(1.0)
    return number * scale


def years(text: Column | str) -> Column:
    """All four-digit years from 1800 to 2099, in order."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"\b((?:18|19|20)\d{2})\b"), 1), lambda y: y.cast("int"))


def first_year(text: Column | str) -> Column:
    return F.get(years(text), F.lit(0))


def last_year(text: Column | str) -> Column:
    return F.try_element_at(years(text), F.lit(-1))


def feet_to_metres(value: Column | str) -> Column:
    """Null for values that aren't numbers, such as "ground"."""
    return F.round(_col(value).try_cast("double") * FEET, 1)


def knots_to_ms(value: Column | str) -> Column:
    return F.round(_col(value).try_cast("double") * KNOTS, 1)


def hex_number(text: Column | str) -> Column:
    return F.conv(_col(text), 16, 10).cast("decimal(20,0)")


def length_km(text: Column | str) -> Column:
    """"1,234 km" as 1234.0."""
    return F.replace(F.regexp_extract(_col(text), r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
