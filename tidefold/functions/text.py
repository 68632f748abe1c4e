"""Sizes and spans of time as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size unit letters, from 1024 bytes upwards.
SIZE_UNITS = "KMGTPE"
DAY = 86_400


def fixed(value: Column, decimals: int = 1) -> Column:
    """Fixed decimals, rounded on the exact binary value and to even on a tie.

    ``format_string('%.1f')`` rounds the shortest decimal form half up and so
    shows 1280 bytes as 1.3 KB, where 1.2 KB is expected.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def human_size(size: Column) -> Column:
    text = F.when(F.coalesce(size, F.lit(0)) == 0, "-").when(
        size < 1024, F.concat(size.cast("string"), F.lit(" B"))
    )
    for power, unit in enumerate(SIZE_UNITS, start=1):
        shown = F.concat(fixed(size / float(1024**power)), F.lit(f" {unit}B"))
        last = power == len(SIZE_UNITS)
        text = text.otherwise(shown) if last else text.when(size < 1024 ** (power + 1), shown)
    return text


def parse_size(text: Column) -> Column:
    """Bytes (DOUBLE) of a size text; anything unreadable counts as 0."""
    shape = r"\A([\d.]+)\s*([KMGTPE]?)B\z"
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.regexp_extract(text, shape, 2)
    factor = F.when(unit == "", 1.0)
    for power, letter in enumerate(SIZE_UNITS, start=1):
        factor = factor.when(unit == letter, float(1024**power))
    return F.coalesce(number * factor, F.lit(0.0))


def human_duration(seconds: Column) -> Column:
    return (
        F.when(seconds >= 3600, F.concat(fixed(seconds / 3600.0), F.lit("h")))
        .when(seconds >= 60, F.concat(fixed(seconds / 60.0), F.lit("m")))
        .otherwise(F.concat(fixed(seconds.cast("double")), F.lit("s")))
    )


def _whole(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def _counted(number: Column, unit: str) -> Column:
    return F.concat(
        number.cast("string"), F.when(number == 1, f" {unit}").otherwise(f" {unit}s")
    )


def human_age(seconds: Column) -> Column:
    """Whole years, months, days or hours; below that, ``moments``."""
    days = _whole(seconds, DAY)
    return (
        F.when(days > 365, _counted(_whole(days, 365), "year"))
        .when(days > 30, _counted(_whole(days, 30), "month"))
        .when(days > 0, _counted(days, "day"))
        .when(seconds > 3600, _counted(_whole(seconds, 3600), "hour"))
        .otherwise("moments")
    )


def ago_text(seconds: Column) -> Column:
    days = _whole(seconds, DAY)
    hours = _whole(seconds, 3600) % 24
    minutes = _whole(seconds, 60) % 60
    return (
        F.when(days > 0, F.format_string("%d days, %d hours, %d minutes ago", days, hours, minutes))
        .when(hours > 0, F.format_string("%d hours, %d minutes ago", hours, minutes))
        .when(minutes > 0, F.format_string("%d minutes ago", minutes))
        .otherwise("just now")
    )
