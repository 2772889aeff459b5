"""Filters, lookups and top-k listings over product observations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.functions.ordering import at_or_after, top_rows
from stallwise.functions.scores import sales_weighted_rating
from stallwise.operators.recent import recent


def browse_products(
    products: DataFrame,
    category_id: str | None = None,
    seller_id: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    limit: int = 100,
    offset: int = 0,
    columns: Sequence[str] | None = None,
    after: Row | None = None,
    seen: int = 1,
) -> DataFrame:
    """Newest observations that pass the given filters.

    ``after`` is the last row of the page before, ``seen`` how many rows equal to
    it that page ended with: the page continues there, whatever its depth, without
    sorting what came before. With ``columns`` the row must have all of them.
    """
    rows = products
    if category_id is not None:
        rows = rows.where(F.col("category_id") == category_id)
    if seller_id is not None:
        rows = rows.where(F.col("seller_id") == seller_id)
    if min_price is not None:
        rows = rows.where(F.col("price") >= exact(min_price))
    if max_price is not None:
        rows = rows.where(F.col("price") <= exact(max_price))
    if after is not None:
        rows, offset = at_or_after(rows, "scraped_at", after, columns), offset + seen
    return top_rows(rows, [F.col("scraped_at").desc()], limit, columns, offset)


def exact(amount: float) -> Column:
    """A limit as a decimal of its own scale: compared exactly, never rounded to the column's scale."""
    return F.lit(Decimal(str(amount)))


RATED = ("product_id", "title", "price", "average_rating", "total_reviews", "seller_name")
RECENT = (
    "product_id", "title", "price", "average_rating", "total_reviews", "total_sales",
    "trend_score", "scraped_at",
)
TRENDING = (
    "product_id", "title", "price", "average_rating", "total_reviews", "total_sales",
    "category_id", "category_name", "seller_name", "scraped_at", "trend_score",
)


def top_rated(products: DataFrame, min_rating: float = 4.5, min_reviews: int = 50, limit: int = 20) -> DataFrame:
    rows = products.where(
        (F.col("average_rating") >= exact(min_rating))
        & (F.col("total_reviews") >= min_reviews)
    )
    return top_rows(rows, [F.desc("average_rating"), F.desc("total_reviews")], limit, RATED)


def rating_per_dollar(products: DataFrame, limit: int = 20) -> DataFrame:
    rows = products.where((F.col("price") > 0) & (F.col("average_rating") > 0)).select(
        "product_id", "title", "price", "average_rating",
        F.try_divide(F.col("average_rating").cast("double"), F.col("price").cast("double")).alias("rating_per_dollar"),
        "seller_name",
    )
    return top_rows(rows, [F.desc("rating_per_dollar")], limit)


def trending_by_score(
    products: DataFrame, as_of: datetime | None = None, days: int = 7, min_score: float = 0.5, limit: int = 20
) -> DataFrame:
    rows = recent(products, as_of, days=days).where(F.col("trend_score") > F.lit(float(min_score)))
    return top_rows(rows, [F.desc("trend_score"), F.desc("total_sales")], limit, RECENT)


def trending_recent(
    products: DataFrame, as_of: datetime | None = None, days: int = 7, limit: int = 20
) -> DataFrame:
    rows = recent(products, as_of, days=days)
    return top_rows(rows, [F.desc("trend_score"), F.desc("total_sales")], limit, RECENT)


def trending_products(
    products: DataFrame, as_of: datetime | None = None, days: int = 7, limit: int = 20
) -> DataFrame:
    """Well-rated recent products by sales times rating, with their rank."""
    rows = recent(products, as_of, days=days).where(
        (F.col("average_rating") >= F.lit("4.0").cast("decimal(3,2)")) & (F.col("total_reviews") >= 5)
    ).select(*TRENDING, sales_weighted_rating().alias("_weight"))
    keys = [F.desc("_weight"), F.desc("total_reviews"), F.desc("trend_score")]
    best = top_rows(rows, keys, limit)
    # At most ``limit`` rows reach the window, so one task is enough for it.
    rank = F.row_number().over(W.orderBy(*keys, *(F.col(c).asc_nulls_first() for c in best.columns)))
    return best.withColumn("trend_rank", rank).drop("_weight")


def big_discounts(
    products: DataFrame, as_of: datetime | None = None, days: int = 30, min_discount: int = 20, limit: int = 20
) -> DataFrame:
    rows = recent(products, as_of, days=days).where(F.col("discount_percentage") > min_discount)
    columns = ("product_id", "title", "price", "original_price", "discount_percentage", "scraped_at")
    return top_rows(rows, [F.desc("discount_percentage")], limit, columns)


def new_arrivals(
    products: DataFrame, as_of: datetime | None = None, days: int = 3, max_reviews: int = 10, limit: int = 20
) -> DataFrame:
    rows = recent(products, as_of, days=days).where(F.col("total_reviews") < max_reviews)
    columns = ("product_id", "title", "price", "average_rating", "seller_name", "scraped_at")
    return top_rows(rows, [F.desc("scraped_at")], limit, columns)


def unscored_reviews(reviews: DataFrame, limit: int | None = 500) -> DataFrame:
    """Reviews without a sentiment score, smallest id first; ``None`` gives all."""
    rows = reviews.where(F.col("sentiment_score").isNull()).select(
        "review_id", "product_id", "review_text", "rating"
    )
    if limit is None:
        return rows
    return top_rows(rows, [F.asc("review_id")], limit)


def product_link(master: DataFrame, product_id: str) -> DataFrame:
    """URL of one product of the work list."""
    return master.where(F.col("product_id") == product_id).select("product_url").limit(1)
