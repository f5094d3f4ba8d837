"""Sort keys with nulls last when ascending and first when descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Sorts by names; one that begins with "-" is descending."""
    return df.orderBy(*((desc(k[1:]) if k.startswith("-") else asc(k)) if isinstance(k, str) else k for k in keys))
