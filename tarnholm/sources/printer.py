"""Results as tab-separated text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.intervals import format_interval, format_months


def cell(value: object, type_name: str = "") -> str:
    if value is None:
        return "[null]"
    if type_name.startswith("interval year") or type_name.startswith("interval month"):
        return format_months(int(value))  # type: ignore[call-overload]
    if isinstance(value, dt.timedelta):
        return format_interval(value)
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def lines(df: DataFrame, most: int | None = None) -> Iterator[str]:
    """A header and a line a row; rows come one partition at a time, not all at once."""
    from pyspark.sql import functions as F

    months = [k.startswith("interval year") or k.startswith("interval month") for _, k in df.dtypes]
    # Python has no type for months: they travel as their number
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    plain = plain.select(*((F.expr(f"CAST(c{i} AS INTERVAL MONTH)").cast("int") if m else F.col(f"c{i}")).alias(f"c{i}") for i, m in enumerate(months)))
    kinds = [k for _, k in df.dtypes]
    yield "\t".join(df.columns)
    for row in (plain if most is None else plain.limit(most)).toLocalIterator():
        yield "\t".join(cell(v, k) for v, k in zip(row, kinds))
