"""Funnel metrics over step tables, and shares of a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stepfall.functions import ratio4, remainder4


def _against(steps: DataFrame, order: str, value: str, base: str, base_value: Column, by: Sequence[str]) -> DataFrame:
    count, reference = F.col(value), F.col(base)
    return (
        steps.withColumn(base, base_value)
        .withColumn("diff", reference - count)
        .withColumn("conversion_rate", ratio4(count, reference))
        .withColumn("dropoff_percent", remainder4(count, reference))
        .orderBy(*[F.col(c).asc_nulls_last() for c in (*by, order)])
    )


def _window(by: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def pct_of_previous(steps: DataFrame, value: str, order: str = "funnel_step", by: Sequence[str] = ()) -> DataFrame:
    """Each step against the one before it, within each combination of ``by``.

    Without ``by`` the frame must be one step table: a few rows, which one task reads.
    """
    return _against(steps, order, value, "lag", F.lag(value, 1).over(_window(by, order)), by)


def pct_of_top(steps: DataFrame, value: str, order: str = "funnel_step", by: Sequence[str] = ()) -> DataFrame:
    """Each step against the first one, within each combination of ``by``; without it, of one step table."""
    return _against(steps, order, value, "first_value", F.first(value).over(_window(by, order)), by)


def segment_share(df: DataFrame, key: str, count: str, total: str, share: str) -> DataFrame:
    """Rows per segment, the grand total, and the segment's share of it.

    The total is a scalar subquery over the grouped counts, so no task has to
    gather all segments.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    whole = counts.agg(F.sum(count)).scalar()
    return counts.select(key, count, whole.alias(total)).withColumn(share, ratio4(F.col(count), F.col(total)))
