"""Scalar expressions: null and NaN handling, guarded parsing, percentages, text for sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# What counts as an ISO date prefix, a date separator and a boolean word.
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE_SEPARATOR_PATTERN = r"[-/.]"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]

# Units of a human-readable size.
SIZE_UNITS = ["B", "KB", "MB", "GB"]


def number(text: Column) -> Column:
    """Parse text as double, NULL when it is not a number.

    The pattern keeps out spellings that a cast takes and a number column should not, such as ``1d``.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den) * 100.0, F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def size_text(size: Column) -> Column:
    """Bytes as ``12.34 KB``; the largest unit is GB."""
    out = None
    for power, unit in enumerate(SIZE_UNITS):
        shown = F.format_string("%.2f " + unit, size.cast("double") / float(1024 ** power))
        if power == len(SIZE_UNITS) - 1:
            return out.otherwise(shown)
        test = size < 1024 ** (power + 1)
        out = F.when(test, shown) if out is None else out.when(test, shown)
    return out


def shorten(text: Column, limit: int = 15) -> Column:
    """Cut display text to ``limit`` characters and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def metric_label(name: Column) -> Column:
    """``missing_values`` -> ``Missing Values``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
