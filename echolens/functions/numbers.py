"""Rates, bands and labels as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100·part/whole rounded half-up; NULL when ``whole`` is 0 or NULL."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def at_least_one(count: Column) -> Column:
    """A denominator that can't be zero: missing or 0 counts as 1."""
    return F.greatest(F.coalesce(count, F.lit(0)), F.lit(1))


def fixed(number: Column, digits: int) -> Column:
    """Text with ``digits`` decimals; a tie in the exact binary value goes to the even digit."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", number.cast("double"), F.lit(pattern))


def round_exact(number: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even."""
    return fixed(number, digits).cast("double")


def score_band(score: Column, high: float = 60, medium: float = 35) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def band_color(score: Column) -> Column:
    return F.when(score >= 60, "red").when(score >= 35, "amber").otherwise("green")


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small constant table as a CASE chain; unknown keys give ``default`` (a value or a Column)."""
    chain = None
    for name, value in table.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    default = default if isinstance(default, Column) else F.lit(default)
    return chain.otherwise(default)


def title_label(name: Column, known: dict) -> Column:
    return lookup(name, known, F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))
