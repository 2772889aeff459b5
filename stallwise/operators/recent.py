"""Look-back selection that also cuts month folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.time import ago, moment, month_of, within
from stallwise.sources.schemas import TABLES

MONTH_COLUMNS = {t.month_of: t.month_column for t in TABLES.values() if t.month_of}


def recent(df: DataFrame, as_of: datetime | None, column: str = "scraped_at", **span: int) -> DataFrame:
    """Rows of the last ``span`` (``days``, ``hours``, ``months``) before ``as_of``.

    When the table was read with its month column, the months outside the span
    are excluded by that column as well, so their folders are never opened.
    """
    month = MONTH_COLUMNS.get(column)
    if month in df.columns:
        df = df.where(
            (F.col(month) >= month_of(ago(as_of, **span))) & (F.col(month) <= month_of(moment(as_of)))
        )
    return df.where(within(column, as_of, **span))
