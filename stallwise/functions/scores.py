"""Opportunity scores and discounts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exact(value: str) -> Column:
    return F.lit(Decimal(value))


def _number(name: str) -> Column:
    return F.col(name).cast("double")


def margin_capped() -> Column:
    """Weighted score of capped parts, to two places; 0 where it has no basis.

    Up to 10 points for sales (one per 1000), twice the rating, 10 less a
    tenth of the price, and up to 5 points for reviews (one per 100), weighted
    0.3, 0.3, 0.2, 0.2. The parts are exact decimals of at most 18 digits, so
    a score that lies between two results rounds the same way everywhere.
    """
    price, rating = F.col("price"), F.col("average_rating").cast("decimal(3,2)")
    sales, reviews = F.col("total_sales"), F.col("total_reviews")
    volume = F.least(sales, F.lit(10000)).cast("decimal(5,0)") * _exact("0.0003")
    quality = rating * _exact("0.6")
    cheapness = F.greatest(_exact("0"), _exact("2") - price.cast("decimal(10,2)") * _exact("0.02"))
    trust = F.least(reviews, F.lit(500)).cast("decimal(3,0)") * _exact("0.002")
    score = F.round(volume + quality + cheapness + trust, 2).cast("double")
    usable = (price != 0) & (rating != 0) & sales.isNotNull() & reviews.isNotNull()
    return F.when(usable, score).otherwise(F.lit(0.0))


def margin_linear() -> Column:
    """The uncapped variant: every part grows without limit."""
    return (
        _number("average_rating") * 0.3
        + _number("total_sales") / F.lit(1000.0) * 0.3
        + (F.lit(100.0) - _number("price")) * 0.2
        + _number("total_reviews") / F.lit(100.0) * 0.2
    )


def sales_weighted_rating() -> Column:
    """Rating times sales; exact, since both factors are exact."""
    return F.col("average_rating").cast("decimal(3,2)") * F.col("total_sales").cast("decimal(10,0)")


def discount_percent(price: str = "price", original: str = "original_price") -> Column:
    """Whole percent below the original price, cut off; 0 without a real discount."""
    now, before = _number(price), _number(original)
    drop = F.floor(F.try_divide(before - now, before) * F.lit(100.0)).cast("int")
    return F.when((before > 0) & (before > now), drop).otherwise(F.lit(0))
