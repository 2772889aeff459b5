"""Market overview, categories, sellers and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.functions.measures import mean, ratio, row_count
from stallwise.functions.ordering import ordered, top_rows
from stallwise.functions.quantiles import exact_quantiles
from stallwise.session import scratch_dir

MARKET_KEYS = ("category_id", "category_name", "seller_id", "seller_name")


def market_rollup(products: DataFrame) -> DataFrame:
    """Exact sums and counts per category and seller.

    Everything the overview reports (totals, distinct counts, category and
    seller rankings) follows from this table, so a job scans the observations
    once. Rows are combined before the shuffle, hot categories included.
    """

    def total(name: str, where: Column | None = None) -> Column:
        value = F.col(name) if where is None else F.when(where, F.col(name))
        return F.sum(value)

    def seen(name: str, where: Column | None = None) -> Column:
        value = F.col(name) if where is None else F.when(where, F.col(name))
        return F.count(value)

    priced, rated = F.col("price") > 0, F.col("average_rating") > 0
    return products.groupBy(*MARKET_KEYS).agg(
        row_count().alias("rows"),
        total("price").alias("price_sum"), seen("price").alias("price_n"),
        total("price", priced).alias("priced_sum"), seen("price", priced).alias("priced_n"),
        total("average_rating").alias("rating_sum"), seen("average_rating").alias("rating_n"),
        total("average_rating", rated).alias("rated_sum"), seen("average_rating", rated).alias("rated_n"),
        total("seller_rating").alias("seller_rating_sum"), seen("seller_rating").alias("seller_rating_n"),
        total("total_sales").alias("sales"),
        total("total_reviews").alias("reviews"),
    )


def _share(total: str, count: str) -> Column:
    return ratio(F.sum(total), F.sum(count))


def stats_of(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_products"),
        F.countDistinct("category_id").alias("total_categories"),
        F.countDistinct("seller_id").alias("total_sellers"),
        _share("priced_sum", "priced_n").alias("avg_price"),
        _share("rated_sum", "rated_n").alias("avg_rating"),
        F.sum("reviews").alias("total_reviews"),
    )


def categories_of(rollup: DataFrame, limit: int = 10) -> DataFrame:
    out = rollup.groupBy("category_id", "category_name").agg(
        F.sum("rows").alias("product_count"),
        _share("price_sum", "price_n").alias("avg_price"),
        _share("rating_sum", "rating_n").alias("avg_rating"),
        F.sum("sales").alias("total_sales"),
    )
    return top_rows(out, [F.desc("product_count")], limit)


def sellers_of(rollup: DataFrame, limit: int = 10) -> DataFrame:
    out = rollup.groupBy("seller_id", "seller_name").agg(
        F.sum("rows").alias("product_count"),
        _share("seller_rating_sum", "seller_rating_n").alias("avg_rating"),
        F.sum("sales").alias("total_sales"),
        _share("price_sum", "price_n").alias("avg_price"),
    )
    return top_rows(out, [F.desc("total_sales")], limit)


def product_stats(products: DataFrame) -> DataFrame:
    """One row of overall figures.

    The distinct counts run on the rollup: on the observations they would
    copy every row once per distinct column.
    """
    return stats_of(market_rollup(products))


def total_products(products: DataFrame) -> DataFrame:
    return products.agg(row_count().alias("total_products"))


def by_category(products: DataFrame) -> DataFrame:
    out = products.groupBy("category_name").agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        mean("average_rating").alias("avg_rating"),
    )
    return out.orderBy(*ordered(out, [F.desc("product_count")]))


def top_categories(products: DataFrame, limit: int = 10) -> DataFrame:
    out = products.groupBy("category_id", "category_name").agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        mean("average_rating").alias("avg_rating"),
        F.sum("total_sales").alias("total_sales"),
    )
    return top_rows(out, [F.desc("product_count")], limit)


def top_sellers(products: DataFrame, limit: int = 10) -> DataFrame:
    out = products.groupBy("seller_id", "seller_name").agg(
        row_count().alias("product_count"),
        mean("seller_rating").alias("avg_rating"),
        F.sum("total_sales").alias("total_sales"),
        mean("price").alias("avg_price"),
    )
    return top_rows(out, [F.desc("total_sales")], limit)


PRICE_POINTS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def price_distribution(products: DataFrame, approximate: bool = False) -> DataFrame:
    """Quantiles and range of the positive prices.

    The exact form counts prices and finds the ranks in two bounded steps;
    ``approximate`` trades exactness for a single pass with a small sketch.
    """
    priced = products.where(F.col("price") > 0)
    if approximate:
        cuts = F.percentile_approx("price", list(PRICE_POINTS.values()), 100000)
        row = priced.agg(
            cuts.alias("cuts"),
            F.min("price").cast("double").alias("min_price"),
            F.max("price").cast("double").alias("max_price"),
        )
        picked = [F.col("cuts")[i].cast("double").alias(n) for i, n in enumerate(PRICE_POINTS)]
        return row.select(*picked, "min_price", "max_price")
    points = {**PRICE_POINTS, "min_price": 0.0, "max_price": 1.0}
    return exact_quantiles(priced, "price", points).select(*points)


def price_spread(products: DataFrame) -> DataFrame:
    """Quantiles up to 95 %, range and average of the positive prices."""
    points = {
        "q25_price": 0.25, "median_price": 0.5, "q75_price": 0.75, "q90_price": 0.9,
        "q95_price": 0.95, "min_price": 0.0, "max_price": 1.0,
    }
    out = exact_quantiles(products.where(F.col("price") > 0), "price", points)
    return out.select(*points, F.col("mean_value").alias("avg_price"))


def category_share(products: DataFrame) -> DataFrame:
    """Share of each category in the number of observations."""
    per = products.groupBy("category_name").agg(
        row_count().alias("product_count"),
        F.sum("total_sales").alias("total_sales"),
        mean("price").alias("avg_price"),
    )
    # The window sees one row per category.
    everything = F.sum("product_count").over(W.partitionBy()).cast("double")
    out = per.withColumn("market_share_percent", F.col("product_count") * F.lit(100.0) / everything)
    return out.orderBy(*ordered(out, [F.desc("market_share_percent")]))


def seller_performance(products: DataFrame, min_products: int = 10, limit: int = 20) -> DataFrame:
    out = (
        products.groupBy("seller_name")
        .agg(
            row_count().alias("product_count"),
            mean("seller_rating").alias("avg_seller_rating"),
            F.sum("total_sales").alias("total_sales"),
            mean("price").alias("avg_price"),
            mean("average_rating").alias("avg_product_rating"),
        )
        .where(F.col("product_count") >= min_products)
    )
    return top_rows(out, [F.desc("total_sales")], limit)


def best_selling_categories(products: DataFrame, limit: int = 15) -> DataFrame:
    out = products.groupBy("category_name").agg(
        row_count().alias("product_count"),
        F.sum("total_sales").alias("total_sales"),
        mean("price").alias("avg_price"),
        mean("average_rating").alias("avg_rating"),
        F.sum("total_reviews").alias("total_reviews"),
    )
    return top_rows(out, [F.desc("total_sales")], limit)


def shipping_buckets(products: DataFrame) -> DataFrame:
    cost = F.col("shipping_cost")
    # Bucket names and limits.
    bucket = (
        F.when(F.col("free_shipping") == 1, "Free Shipping")
        .when(cost == 0, "No Shipping Cost")
        .when(cost <= 5, "Low Shipping ($0-5)")
        .when(cost <= 15, "Medium Shipping ($5-15)")
        .otherwise("High Shipping ($15+)")
    )
    out = products.groupBy(bucket.alias("shipping_category")).agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        mean("average_rating").alias("avg_rating"),
    )
    return out.orderBy(*ordered(out, [F.desc("product_count")]))


def price_competitiveness(products: DataFrame, min_products: int = 5, limit: int = 30) -> DataFrame:
    out = (
        products.groupBy("seller_name", "category_name")
        .agg(
            mean("price").alias("avg_price"),
            mean("average_rating").alias("avg_rating"),
            row_count().alias("product_count"),
        )
        .where(F.col("product_count") >= min_products)
        .withColumn(
            "competitiveness_score",
            F.col("avg_rating") * F.lit(0.6) + (F.lit(100.0) - F.col("avg_price")) * F.lit(0.4),
        )
    )
    return top_rows(out, [F.desc("competitiveness_score")], limit)


def seller_position(products: DataFrame, min_products: int = 20, limit: int = 20) -> DataFrame:
    """Sellers with their category coverage.

    Counting per seller and category first keeps the distinct count a plain
    count, and a seller with a third of all rows is combined before it moves.
    """
    per = products.groupBy("seller_name", "category_name").agg(
        row_count().alias("rows"),
        F.sum("seller_rating").alias("seller_rating_sum"), F.count("seller_rating").alias("seller_rating_n"),
        F.sum("total_sales").alias("sales"),
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"),
        F.sum("average_rating").alias("rating_sum"), F.count("average_rating").alias("rating_n"),
    )
    out = (
        per.groupBy("seller_name")
        .agg(
            F.sum("rows").alias("total_products"),
            F.count("category_name").alias("categories_covered"),
            _share("seller_rating_sum", "seller_rating_n").alias("avg_seller_rating"),
            F.sum("sales").alias("total_sales"),
            _share("price_sum", "price_n").alias("avg_price"),
            _share("rating_sum", "rating_n").alias("avg_product_rating"),
        )
        .where(F.col("total_products") >= min_products)
    )
    return top_rows(out, [F.desc("total_sales")], limit)


def competitors(products: DataFrame, category_id: str, limit: int = 20) -> DataFrame:
    """Best-selling sellers of a category; the share is among those returned."""
    out = (
        products.where(F.col("category_id") == category_id)
        .groupBy("seller_id", "seller_name")
        .agg(
            row_count().alias("product_count"),
            mean("price").alias("avg_price"),
            mean("average_rating").alias("avg_rating"),
            F.sum("total_sales").alias("total_sales"),
            mean("seller_rating").alias("seller_rating"),
            F.lit(1).cast("long").alias("categories_count"),  # the rows are of one category
        )
    )
    best = top_rows(out, [F.desc("total_sales")], limit)
    # The window sees at most ``limit`` rows.
    returned = F.sum("total_sales").over(W.partitionBy())
    share = F.when(
        returned > 0, F.col("total_sales").cast("double") / returned.cast("double") * F.lit(100.0)
    ).otherwise(F.lit(0.0))
    return best.withColumn("market_share", share)


def competitor_totals(products: DataFrame, category_id: str, limit: int = 20) -> DataFrame:
    best = competitors(products, category_id, limit)
    return best.agg(
        F.lit(category_id).alias("category_id"),
        row_count().alias("total_competitors"),
        F.coalesce(F.sum("total_sales"), F.lit(0)).alias("total_market_sales"),
    )


def competitor_share(products: DataFrame) -> DataFrame:
    """Share of every seller in the sales of each category.

    The sellers' sums are written to the shared folder and read twice, for the
    rows and for the totals of their categories, so the observations are read
    once: two branches over one aggregate are pruned differently by Spark, which
    would read them for each. The totals are combined before the shuffle and
    joined back; a window over the sellers would bring all sellers of a category
    to one task.
    """
    spark = products.sparkSession
    sums = products.groupBy("category_name", "seller_name").agg(
        row_count().alias("product_count"),
        mean("price").alias("avg_price"),
        mean("average_rating").alias("avg_rating"),
        F.sum("total_sales").alias("total_sales"),
    )
    path = scratch_dir(spark, "sellers")
    sums.write.parquet(path)
    per = spark.read.schema(sums.schema).parquet(path)
    totals = per.groupBy(F.col("category_name").alias("_category")).agg(F.sum("total_sales").alias("_sales"))
    out = per.join(totals, F.col("category_name").eqNullSafe(F.col("_category"))).select(
        *per.columns,
        F.try_divide(
            F.col("total_sales") * F.lit(100.0), F.col("_sales").cast("double")
        ).alias("market_share_percent"),
    )
    return out.orderBy(*ordered(out, [F.asc_nulls_first("category_name"), F.desc("market_share_percent")]))


def health_check(products: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: is there any data, and does the newest-rows listing return some.

    The listing has the newest ``sample`` rows, or all.
    """
    listed = F.col("total_products") if sample is None else F.least(F.col("total_products"), F.lit(sample).cast("long"))
    row = products.agg(row_count().alias("total_products"))
    return row.select(
        "total_products",
        listed.alias("recent_products"),
        (F.col("total_products") > 0).alias("has_products"),
        (listed > 0).alias("has_recent"),
    ).withColumn("healthy", F.col("has_products") & F.col("has_recent"))
