"""Deterministic sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(df: DataFrame, keys: Sequence[Column], columns: Sequence[str] | None = None) -> list[Column]:
    """``keys`` followed by every result column, nulls first.

    Rows that still tie are equal in all result columns, so any of them may be
    kept: a limit on this order always returns the same rows.
    """
    names = list(columns or df.columns)
    unsortable = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    return [*keys, *(F.col(n).asc_nulls_first() for n in names if n not in unsortable)]


def top_rows(
    df: DataFrame,
    keys: Sequence[Column],
    limit: int | None,
    columns: Sequence[str] | None = None,
    offset: int = 0,
) -> DataFrame:
    """First ``limit`` rows after ``offset``; runs as one top-k per partition."""
    out = df.orderBy(*ordered(df, keys, columns))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def at_or_after(df: DataFrame, newest: str, row: Row, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that do not come before ``row`` where ``newest`` descends and all result columns break ties.

    The order is that of ``ordered(df, [newest descending], columns)``: nulls of
    ``newest`` come last, other nulls first. The limit on ``newest`` stands alone
    too, so it reaches the reader.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in columns or df.columns if not isinstance(kinds[n], T.MapType)]

    def value(name: str) -> Column:
        return F.lit(row[name]).cast(kinds[name])

    def step(rest: Column, name: str) -> Column:
        behind = F.col(name).isNotNull() if row[name] is None else F.col(name) > value(name)
        return F.coalesce(behind, F.lit(False)) | (F.col(name).eqNullSafe(value(name)) & rest)

    ties = reduce(step, reversed(names), F.lit(True))
    if row[newest] is None:
        return df.where(F.col(newest).isNull() & ties)
    older = F.col(newest).isNull() | (F.col(newest) <= value(newest))
    return df.where(older & (F.col(newest).isNull() | (F.col(newest) < value(newest)) | ties))
