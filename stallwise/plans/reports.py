"""Market overview, business report and the insights drawn from it.

A report is a dict of DataFrames, one per section, nothing computed yet.
Several sections follow from the same small intermediate tables (``Shared``):
a job persists those once, so the observations are not scanned per section.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.ordering import top_rows
from stallwise.functions.scores import sales_weighted_rating
from stallwise.functions.time import moment
from stallwise.operators.browse import trending_products
from stallwise.operators.market import (
    categories_of,
    market_rollup,
    price_distribution,
    sellers_of,
    stats_of,
)
from stallwise.operators.opportunities import high_margin
from stallwise.operators.seasons import months_of, season_sums, trends_of
from stallwise.operators.trends import price_trend_overall, price_trends

Report = dict[str, DataFrame]


@dataclass(frozen=True)
class Shared:
    """Small tables that more than one section is made of."""

    rollup: DataFrame
    prices: DataFrame
    offers: DataFrame
    seasons: DataFrame

    def persist(self) -> Shared:
        return Shared(*(getattr(self, f.name).persist() for f in fields(self)))

    def unpersist(self) -> None:
        for f in fields(self):
            getattr(self, f.name).unpersist()


def shared_tables(products: DataFrame, as_of: datetime | None = None) -> Shared:
    return Shared(
        rollup=market_rollup(products),
        prices=price_distribution(products),
        offers=high_margin(products),
        seasons=season_sums(products, as_of),
    )


def market_overview(
    products: DataFrame, as_of: datetime | None = None, shared: Shared | None = None
) -> Report:
    shared = shared or shared_tables(products, as_of)
    return {
        "overview": stats_of(shared.rollup),
        "top_categories": categories_of(shared.rollup),
        "top_sellers": sellers_of(shared.rollup),
        "price_distribution": shared.prices,
        "trending_products": trending_products(products, as_of),
    }


def best_offers(offers: DataFrame, limit: int) -> DataFrame:
    """First offers of a high-margin list, in its own order."""
    keys = [F.desc("margin_potential_score"), F.desc(sales_weighted_rating())]
    return top_rows(offers, keys, limit)


def executive_summary(stats: DataFrame) -> DataFrame:
    return stats.select(
        F.col("total_products").alias("total_products_analyzed"),
        "total_categories",
        "total_sellers",
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_market_price"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_market_rating"),
    )


def recommendations(
    spark: SparkSession, top_categories: DataFrame, opportunities: DataFrame, prices: DataFrame,
    title_chars: int | None = None,
) -> DataFrame:
    """Advice in order: top category, top opportunity, median price, fixed lines.

    The first two are left out when there is no category or no opportunity.
    ``title_chars`` cuts the title of the opportunity.
    """
    # The wording of the advice.
    category = top_rows(top_categories, [F.desc("product_count")], 1).select(
        F.lit(1).alias("position"),
        F.format_string(
            "Focus on %s category - highest product count (%d) with average price $%.2f",
            "category_name", "product_count", F.coalesce("avg_price", F.lit(0.0)),
        ).alias("recommendation"),
    )
    title = F.col("title") if title_chars is None else F.concat(F.substring("title", 1, title_chars), F.lit("..."))
    offer = best_offers(opportunities, 1).select(
        F.lit(2).alias("position"),
        F.format_string(
            "Consider dropshipping %s - high margin potential (score: %s) with %.1f★ rating",
            title,
            F.col("margin_potential_score").cast("string"),
            F.col("average_rating").cast("double"),
        ).alias("recommendation"),
    )
    price = prices.select(
        F.lit(3).alias("position"),
        F.format_string(
            "Target products around $%.2f median price point for optimal market positioning",
            F.coalesce("median", F.lit(0.0)),
        ).alias("recommendation"),
    )
    fixed = spark.createDataFrame(
        list(
            enumerate(
                (
                    "Monitor seasonal trends and prepare inventory for upcoming "
                    "holiday seasons (Halloween, Christmas, Summer)",
                    "Focus on products with 4+ star ratings and 10+ reviews for credibility",
                    "Consider free shipping offers to increase conversion rates",
                    "Monitor competitor pricing weekly to maintain competitive advantage",
                    "Use AI sentiment analysis to identify product improvement opportunities",
                ),
                start=4,
            )
        ),
        "position int, recommendation string",
    )
    # End of the fixed values.
    return category.unionByName(offer).unionByName(price).unionByName(fixed).orderBy("position")


def business_report(
    products: DataFrame, as_of: datetime | None = None, shared: Shared | None = None, offers: int = 20
) -> Report:
    """All sections of the weekly report; ``products`` carries ``seasonal_tags``. It lists the ``offers`` best offers."""
    spark = products.sparkSession
    shared = shared or shared_tables(products, as_of)
    overview = market_overview(products, as_of, shared)
    metadata = spark.range(1).select(
        moment(as_of).alias("generated_at"),
        F.lit("comprehensive_business_intelligence").alias("report_type"),
    )
    return {
        "report_metadata": metadata,
        "executive_summary": executive_summary(overview["overview"]),
        **overview,
        "seasonal_trends": trends_of(shared.seasons),
        "seasonal_months": months_of(shared.seasons),
        "high_margin_products": best_offers(shared.offers, offers),
        "price_trends": price_trends(products, as_of),
        "price_trend_overall": price_trend_overall(products, as_of),
        "recommendations": recommendations(
            spark, overview["top_categories"], shared.offers, shared.prices
        ),
    }


def insights(report: Report, offers: int = 10, trending: int = 10, advice: int = 5) -> Report:
    """The short form of a report: its first offers, trending products and lines of advice, as many as asked for."""
    return {
        "market_overview": report["executive_summary"],
        "top_opportunities": best_offers(report["high_margin_products"], offers),
        "trending_products": report["trending_products"].orderBy("trend_rank").limit(trending),
        "recommendations": report["recommendations"].orderBy("position").limit(advice),
    }
