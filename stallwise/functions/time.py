"""Clock and look-back windows on ``timestamp_ntz`` columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: datetime | None) -> Column:
    """``as_of`` as a literal; ``None`` is the wall clock of the query."""
    if as_of is None:
        return F.expr("localtimestamp()")
    return F.expr(f"TIMESTAMP_NTZ '{as_of:%Y-%m-%d %H:%M:%S.%f}'")


def ago(as_of: datetime | None, *, days: int = 0, hours: int = 0, months: int = 0) -> Column:
    """The moment that lies the given span before ``as_of``.

    Both operands are literals, so the optimizer folds the result and the
    comparison against it reaches the Parquet reader.
    """
    start = moment(as_of)
    if months:
        start = start - F.expr(f"INTERVAL '{int(months)}' MONTH")
    if days:
        start = start - F.expr(f"INTERVAL '{int(days)}' DAY")
    if hours:
        start = start - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    return start


def within(column: str, as_of: datetime | None, **span: int) -> Column:
    """True for rows not older than the span and not later than ``as_of``."""
    ts = F.col(column)
    return (ts >= ago(as_of, **span)) & (ts <= moment(as_of))


def month_of(ts: Column) -> Column:
    """``yyyymm`` as an integer: the partition value of a stored table."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")
