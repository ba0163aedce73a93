"""Shares of counts, rounded half up to four digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holds any bigint count; a bare ``decimal`` would stop at ten digits.
COUNT_TYPE = "decimal(20,0)"


def quotient(num: Column, den: Column) -> Column:
    """Unrounded decimal ``num / den``; NULL when the denominator is zero."""
    return num.cast(COUNT_TYPE) / F.nullif(den.cast(COUNT_TYPE), F.lit(0).cast(COUNT_TYPE))


def ratio4(num: Column, den: Column) -> Column:
    return F.round(quotient(num, den), 4).cast("double")


def remainder4(num: Column, den: Column) -> Column:
    """What is missing to one, rounded from the unrounded quotient."""
    return F.round(F.lit(1) - quotient(num, den), 4).cast("double")
