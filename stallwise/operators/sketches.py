"""Mergeable sketches: quantiles and distinct counts of any span of days from what was stored for each day.

A day's sketches are a few kilobytes for each key, whatever the number of its
rows. Those of many days are merged without reading the rows again: KLL sketches
give quantiles within a bounded error of rank, HLL sketches give distinct counts
within a bounded relative error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import row_count

RANK_ERROR = 0.03
"""Error of rank that KLL sketches of the default size stay far below."""
COUNT_ERROR = 0.08
"""Relative error that HLL sketches of the default size stay far below."""


def daily_sketches(
    rows: DataFrame, keys: Sequence[str] = ("category_name",), value: str = "price", distinct: str = "seller_id",
    time: str = "scraped_at",
) -> DataFrame:
    """One row for each day and key: ``rows``, a sketch of ``value`` and one of the different ``distinct``."""
    return rows.groupBy(*keys, F.to_date(time).alias("day")).agg(
        row_count().alias("rows"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"),
        F.hll_sketch_agg(distinct).alias("kinds"),
    )


def merged_sketches(stored: DataFrame, keys: Sequence[str] = ("category_name",)) -> DataFrame:
    """The sketches of all days of each key in one; merged before they are shuffled."""
    return stored.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("kinds").alias("kinds")
    )


def estimates(merged: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``rows``, the estimated ``quantiles`` at the ``cuts`` and the estimated number of ``kinds``."""
    quantiles = F.array(*(F.kll_sketch_get_quantile_double("values", F.lit(float(cut))) for cut in cuts))
    keys = [c for c in merged.columns if c not in ("rows", "values", "kinds")]
    return merged.select(*keys, "rows", quantiles.alias("quantiles"), F.hll_sketch_estimate("kinds").alias("kinds"))
