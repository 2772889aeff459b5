"""Aggregates whose value does not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(column: str | Column, where: Column | None = None) -> Column:
    """Average of an integer or decimal column as a double.

    The sum stays exact (long or decimal) and is divided once, so the result
    is the same for every partitioning, which ``avg`` over doubles is not.
    """
    value = F.col(column) if isinstance(column, str) else column
    if where is not None:
        value = F.when(where, value)
    return ratio(F.sum(value), F.count(value))


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as a double; null when there is nothing to divide by."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def row_count() -> Column:
    return F.count(F.lit(1))
