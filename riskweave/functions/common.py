"""Small helpers for building column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def emit(df: DataFrame, keep: list[str], row: Column) -> DataFrame:
    """``keep`` plus the fields of a struct. The struct leaves a Generate, so a
    filter on its fields stays above and its expressions are not copied into it."""
    return df.select(*keep, F.inline(F.array(row)))
