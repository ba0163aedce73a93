"""Small column expressions shared by the plans. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_present(*names: str) -> Column:
    """True when every named column is set.

    Spark calls a struct with only NULL fields "not null", so a row-value test
    has to be spelled out field by field.
    """
    return reduce(and_, (F.col(name).isNotNull() for name in names))


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def day_start(ts: Column) -> Column:
    """Midnight of the day. ``date_trunc`` would attach the session time zone."""
    return ts.cast("date").cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as an exact decimal, free of the session time zone."""
    return (end - start).cast("interval second").cast("decimal(18,6)")
