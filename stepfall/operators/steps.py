"""Step tables: one row per funnel step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Step(NamedTuple):
    number: int
    name: str
    values: tuple[Column, ...]


def step_rows(
    df: DataFrame, steps: Sequence[Step], values: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Turn the step counts standing side by side on a row into one row per step."""
    cells: list[Column] = []
    for step in steps:
        cells += [F.lit(step.number), F.lit(step.name), *step.values]
    rows = F.stack(F.lit(len(steps)), *cells).alias("funnel_step", "funnel_name", *values)
    return df.select(*keys, rows)


def step_table(
    parts: Sequence[tuple[DataFrame, Sequence[Step]]], values: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Steps from several sources under one another. Step numbers keep them apart,
    so no duplicates can arise and none are looked for."""
    rows = [step_rows(df, steps, values, keys) for df, steps in parts]
    return reduce(DataFrame.unionByName, rows)
