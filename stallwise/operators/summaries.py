"""The maintained summaries as aggregates, split into mergeable parts.

A summary turns rows into partial sums, adds partial sums of the same key,
and finishes them. The batch form does the first and the last step; the
streaming form stores the parts of every micro-batch and adds them on read.
All expressions are Spark SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Summary:
    """Keys, parts as ``name: (aggregate over rows, aggregate that adds parts)``,
    finished columns, and the condition rows must meet."""

    keys: dict[str, str]
    parts: dict[str, tuple[str, str]]
    finish: dict[str, str]
    where: str | None = None

    def partial(self, rows: DataFrame) -> DataFrame:
        if self.where:
            rows = rows.where(self.where)
        keys = [F.expr(e).alias(name) for name, e in self.keys.items()]
        return rows.groupBy(*keys).agg(*(F.expr(rows_).alias(n) for n, (rows_, _) in self.parts.items()))

    def combine(self, parts: DataFrame) -> DataFrame:
        """Partial sums of the same key added up: still partial sums, of the same types."""
        added = (
            F.expr(f"{add}({n})").cast(parts.schema[n].dataType).alias(n) for n, (_, add) in self.parts.items()
        )
        return parts.groupBy(*self.keys).agg(*added)

    def finished(self, parts: DataFrame) -> DataFrame:
        return parts.select(*self.keys, *(F.expr(e).alias(name) for name, e in self.finish.items()))

    def batch(self, rows: DataFrame) -> DataFrame:
        return self.finished(self.partial(rows))

    def merged(self, parts: DataFrame) -> DataFrame:
        return self.finished(self.combine(parts))


SALES = Summary(
    keys={"category_id": "category_id", "seller_id": "seller_id"},
    parts={
        "product_count": ("count(1)", "sum"),
        "total_category_sales": ("sum(total_sales)", "sum"),
        "rating_sum": ("sum(average_rating)", "sum"),
        "rating_n": ("count(average_rating)", "sum"),
        "last_updated": ("max(scraped_at)", "max"),
    },
    finish={
        "product_count": "product_count",
        "total_category_sales": "total_category_sales",
        "avg_category_rating": "try_divide(double(rating_sum), double(rating_n))",
        "last_updated": "last_updated",
    },
)
DAILY_PRICES = Summary(
    keys={"product_id": "product_id", "date": "date(scraped_at)"},
    parts={
        "price_sum": ("sum(price)", "sum"),
        "price_n": ("count(price)", "sum"),
        "min_price": ("min(price)", "min"),
        "max_price": ("max(price)", "max"),
        "price_points": ("count(1)", "sum"),
    },
    finish={
        "avg_price": "try_divide(double(price_sum), double(price_n))",
        "min_price": "min_price",
        "max_price": "max_price",
        "price_points": "price_points",
    },
)
# Scores are decimals in the sums, so the order of addition does not matter.
SENTIMENT = Summary(
    keys={"product_id": "product_id", "date": "date(scraped_at)"},
    parts={
        "review_count": ("count(1)", "sum"),
        "score_sum": ("sum(cast(sentiment_score AS decimal(12,6)))", "sum"),
        "score_n": ("count(sentiment_score)", "sum"),
        "positive_reviews": ("count_if(sentiment_label <=> 'positive')", "sum"),
        "negative_reviews": ("count_if(sentiment_label <=> 'negative')", "sum"),
        "neutral_reviews": ("count_if(sentiment_label <=> 'neutral')", "sum"),
    },
    finish={
        "review_count": "review_count",
        "avg_sentiment": "try_divide(double(score_sum), double(score_n))",
        "positive_reviews": "positive_reviews",
        "negative_reviews": "negative_reviews",
        "neutral_reviews": "neutral_reviews",
    },
)
PENDING_WORK = Summary(
    keys={
        name: name
        for name in (
            "product_id", "product_url", "category_id", "category_name", "scrape_priority", "error_count",
        )
    },
    parts={"occurrences": ("count(1)", "sum"), "last_discovered_at": ("max(discovered_at)", "max")},
    finish={"occurrences": "occurrences", "last_discovered_at": "last_discovered_at"},
    where="scrape_status = 'pending' AND is_active = 1",
)


def top_products_by_sales(products: DataFrame) -> DataFrame:
    return SALES.batch(products)


def daily_price_changes(price_history: DataFrame) -> DataFrame:
    return DAILY_PRICES.batch(price_history)


def sentiment_summary(reviews: DataFrame) -> DataFrame:
    return SENTIMENT.batch(reviews)


def pending_work(discoveries: DataFrame) -> DataFrame:
    """Pending work over the append-only discovery log."""
    return PENDING_WORK.batch(discoveries)
