"""Season tags: distribution, prices, months and peaks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.functions.measures import mean, ratio, row_count
from stallwise.functions.ordering import ordered, top_rows
from stallwise.functions.quantiles import exact_quantiles
from stallwise.operators.recent import recent


def by_season(products: DataFrame) -> DataFrame:
    """One row per observation and season; untagged observations give none."""
    return products.where(F.size("seasonal_tags") > 0).withColumn("season", F.explode("seasonal_tags"))


def season_distribution(products: DataFrame) -> DataFrame:
    out = by_season(products).groupBy("season").agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        F.sum("total_sales").alias("total_sales"),
    )
    return out.orderBy(*ordered(out, [F.desc("product_count")]))


def holiday_categories(
    products: DataFrame, seasons: tuple[str, ...] = ("christmas", "halloween"), limit: int = 20
) -> DataFrame:
    tagged = F.arrays_overlap("seasonal_tags", F.array(*(F.lit(s) for s in seasons)))
    out = products.where(tagged).groupBy("category_name").agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        F.sum("total_sales").alias("total_sales"),
    )
    return top_rows(out, [F.desc("total_sales")], limit)


def season_prices(products: DataFrame) -> DataFrame:
    points = {"median_price": 0.5, "q25_price": 0.25, "q75_price": 0.75}
    out = exact_quantiles(by_season(products).select("season", "price"), "price", points, by=["season"])
    out = out.select("season", *points, F.col("row_count").alias("product_count"))
    return out.orderBy(*ordered(out, [F.desc("median_price")]))


def season_sums(
    products: DataFrame, as_of: datetime | None = None, months: int | None = None
) -> DataFrame:
    """Exact sums per season, month and category; ``months`` looks back that far."""
    rows = products if months is None else recent(products, as_of, months=months)
    return by_season(rows).groupBy("season", F.month("scraped_at").alias("month"), "category_name").agg(
        row_count().alias("product_count"),
        F.sum("total_sales").alias("total_sales"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
    )


def trends_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "season", "month", "category_name", "product_count", "total_sales",
        ratio(F.col("price_sum"), F.col("price_n")).alias("avg_price"),
    )


def months_of(sums: DataFrame) -> DataFrame:
    return sums.groupBy("season", "month").agg(
        F.sum("product_count").alias("product_count"),
        F.sum("total_sales").alias("total_sales"),
        ratio(F.sum("price_sum"), F.sum("price_n")).alias("avg_price"),
    )


def seasonal_trends(
    products: DataFrame, as_of: datetime | None = None, months: int | None = None
) -> DataFrame:
    """Count, sales and average price per season, month and category."""
    return trends_of(season_sums(products, as_of, months))


def seasonal_months(
    products: DataFrame, as_of: datetime | None = None, months: int | None = None
) -> DataFrame:
    """The same per season and month, over all categories."""
    return months_of(season_sums(products, as_of, months))


def season_peaks(
    products: DataFrame,
    as_of: datetime | None = None,
    months: int | None = None,
    categories: int = 3,
) -> DataFrame:
    """Month with the most sales of each season and its best categories.

    Both rankings run on sums: at most twelve months per season, and of the
    categories only the best few per task move to the final ranking. Both use
    the same columns of the sums, so the observations are scanned once.
    """
    sums = season_sums(products, as_of, months)
    best = W.partitionBy("season").orderBy(F.desc("total_sales"), F.asc("month"))
    peak = (
        months_of(sums)
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") == 1)
        .drop("_place")
        .withColumnRenamed("season", "_season")
        .withColumnRenamed("month", "_month")
    )
    ranking = W.partitionBy("season").orderBy(F.desc("category_sales"), F.asc_nulls_first("category_name"))
    # Null-safe, so that no not-null filter sets one branch apart from the other.
    inside = F.col("season").eqNullSafe(F.col("_season")) & F.col("month").eqNullSafe(F.col("_month"))
    return (
        sums.select(
            "season", "month", "category_name",
            F.col("product_count").alias("category_products"),
            F.col("total_sales").alias("category_sales"),
            ratio(F.col("price_sum"), F.col("price_n")).alias("category_avg_price"),
        )
        .join(peak, inside)
        .drop("_season", "_month")
        .withColumn("category_rank", F.row_number().over(ranking))
        .where(F.col("category_rank") <= categories)
    )
