"""Amounts: exact decimals, never floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(38,6)"


def amount(text: Column) -> Column:
    """A decimal text as an exact number; null for what is none."""
    return text.try_cast(AMOUNT)


def whole_units(value: Column) -> Column:
    """Whole currency units, halves away from zero, with a blank between thousands."""
    rounded = F.round(value, 0)
    return F.replace(F.format_number(rounded, 0), F.lit(","), F.lit(" "))


def millions(value: Column) -> Column:
    """Millions with one decimal, halves to the even digit."""
    return F.bround(value / F.lit(1_000_000), 1)


def plain_amount(text: Column) -> Column:
    """A decimal text without idle zeros; any spelling of zero is ``0``.  What is no number stays as it is."""
    number = text.try_cast(AMOUNT)
    trimmed = F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(number == 0, F.lit("0")).when(number.isNull(), text).otherwise(trimmed)


def ratio_percent(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves to the even digit; null where the whole is not above zero."""
    return F.when(whole > 0, F.bround(F.lit(100) * part.cast("double") / whole.cast("double"), 1))
