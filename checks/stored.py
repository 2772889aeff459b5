"""Registered queries that write stored tables in the shared folder, run a job and read the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from stallwise.operators import market as M
from stallwise.operators import sketches as K
from stallwise.plans import jobs as J
from stallwise.plans import reports as C
from stallwise.session import scratch_dir
from stallwise.sources import fixtures as X
from stallwise.sources import schemas as S
from stallwise.sources import tables as T

WORK = 300
HOT = 30


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the rows, a daily run, the late and new other half, another run."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    rows = X.products(spark, sf).drop("obs_id")
    for part in ("total_sales % 2 = 0", "total_sales % 2 <> 0"):
        T.write_products(rows.where(part), paths.table(S.PRODUCTS), X.AS_OF)
        J.run_daily(spark, paths)
    return T.read_table(spark, S.PRODUCTS, paths.enriched_products).select(
        "product_id", "seller_id", "price", "scraped_at", "category_id", "category_name",
        F.array_join("seasonal_tags", ",").alias("seasonal_tags"), "trend_score",
    )


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Price points expire from a stored table while others are appended to it.

    Half of the rows are stored; the files with expired rows are listed; the
    other half is appended before those files are replaced. A last run expires
    what came late.
    """
    path, table = scratch_dir(spark, "stored"), S.PRICE_HISTORY
    days = T.RETENTION_DAYS[table.name]
    first = F.xxhash64("product_id", "price", "scraped_at") % 2 == 0
    rows = X.price_history(spark, sf)
    T.write_price_points(rows.where(first), path, X.AS_OF)
    files = T.expired_files(spark, table, path, days, X.AS_OF)
    kept = T.apply_retention(T.read_files(spark, table.schema, path, files), table.month_of, days, X.AS_OF)
    T.write_price_points(rows.where(~first), path, X.AS_OF)
    T.replace_files(kept, table, path, files)
    T.expire_months(spark, table, path, days, X.AS_OF)
    return T.read_table(spark, table, path)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched products whose source and result are merged into few files between two daily runs."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    source, target = paths.table(S.PRODUCTS), paths.enriched_products
    rows = X.products(spark, sf).drop("obs_id")
    for part in ("total_sales % 3 = 0", "total_sales % 3 = 1", "total_sales % 3 = 2"):
        T.write_products(rows.where(part), source, X.AS_OF)
        J.run_daily(spark, paths)
        T.merge_small_files(spark, S.PRODUCTS, source, most=1, ledgers=[paths.ledger(target)])
        T.merge_small_files(spark, S.PRODUCTS, target, most=1)
    J.run_daily(spark, paths)
    return T.read_table(spark, S.PRODUCTS, target).select(
        "product_id", "seller_id", "price", "scraped_at", "category_id", "category_name",
        F.array_join("seasonal_tags", ",").alias("seasonal_tags"), "trend_score",
    )


def keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    """Work-list changes written into the files that hold their products, all columns read again."""
    path = scratch_dir(spark, "stored")
    table = S.MASTER_PRODUCTS
    T.append(X.master_products(spark, sf), table, path, X.AS_OF)
    changes = X.master_products(spark, sf).where("CAST(product_id AS BIGINT) % 9 = 0").select(
        "product_id", F.lit("promo").alias("category_id"), (F.col("scrape_priority") + 1).alias("scrape_priority")
    )
    T.update_stored(spark, table, path, changes, "product_id")
    return T.read_table(spark, table, path)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews appended to a stored table and scored by the daily job."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    T.write_reviews(X.reviews(spark, sf), paths.table(S.REVIEWS), X.AS_OF)
    J.score_stored(spark, paths)
    return T.read_table(spark, S.REVIEWS, paths.scored_reviews).select(
        "review_id", "product_id", "rating", "review_text", "sentiment_score", "sentiment_label", "scraped_at", "helpful_votes"
    )


def maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of a maintenance run over stored tables."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    T.write_products(X.products(spark, sf).drop("obs_id"), paths.table(S.PRODUCTS), X.AS_OF)
    T.write_price_points(X.price_history(spark, sf), paths.table(S.PRICE_HISTORY), X.AS_OF)
    T.write_snapshot(X.master_products(spark, sf), S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS), 0)
    out = J.run_maintenance(spark, paths, X.AS_OF, hot_count=HOT)
    kept = T.read_table(spark, S.PRICE_HISTORY, paths.table(S.PRICE_HISTORY)).agg(F.count("*").alias("price_points_kept"))
    health = out["health"].select("total_products", F.col("healthy").cast("int").alias("healthy"))
    parts = [_long(df) for df in (out["counts"], health, kept)]
    return parts[0].union(parts[1]).union(parts[2])


def _long(row: DataFrame, kind: str = "long") -> DataFrame:
    """The columns of one row as rows ``measure, value``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast(kind).alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("_p")).select("_p.*")


def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Every product page taken over by a full run, and read again."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    J.run_full(spark, paths, I.product_pages(spark, sf), X.AS_OF)
    return T.read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS)).select(
        "product_id", "title", "price", "currency", "seller_id", "seller_name", "category_id", "category_name",
        "product_url", F.array_join("image_urls", ",").alias("image_urls"), "total_reviews", "average_rating",
        "is_available", "scraped_at",
    )


def weekly_trends(spark: SparkSession, sf: str) -> DataFrame:
    """The trend rows that a weekly run writes, read again."""
    paths = J.Paths(scratch_dir(spark, "stored"))
    T.write_products(X.products(spark, sf).drop("obs_id"), paths.table(S.PRODUCTS), X.AS_OF)
    J.run_weekly(spark, paths, X.AS_OF)
    return T.read_table(spark, S.TRENDS, paths.table(S.TRENDS))


def overview(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of the market overview as rows ``section, name, value``."""
    found = C.market_overview(X.seasonal_products(spark, sf), X.AS_OF)
    parts = [
        _long(found["overview"], "double").withColumn("section", F.lit("overview")),
        _long(found["price_distribution"], "double").withColumn("section", F.lit("price_distribution")),
    ]
    for section, name, value in (
        ("top_categories", "category_name", "product_count"), ("top_sellers", "seller_name", "total_sales"),
        ("trending_products", "product_id", "trend_rank"),
    ):
        row = F.col(name).alias("measure"), F.col(value).cast("double").alias("value"), F.lit(section).alias("section")
        parts.append(found[section].select(*row))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("section", F.col("measure").alias("name"), F.round("value", 6).alias("value"))


def best_offers(spark: SparkSession, sf: str) -> DataFrame:
    """The opportunities of the short report."""
    report = C.business_report(X.seasonal_products(spark, sf), X.AS_OF)
    return C.insights(report, offers=10)["top_opportunities"]


def report(spark: SparkSession, sf: str) -> DataFrame:
    """A report section written as JSON and read again."""
    section = C.executive_summary(M.product_stats(X.products(spark, sf)))
    path = T.write_report({"executive_summary": section}, scratch_dir(spark, "stored"), X.AS_OF)
    return spark.read.schema(section.schema).json(f"{path}/executive_summary")


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """The work list after fetched pages of issued work; pages of ids divisible by 3 failed.

    All priorities are turned round between the issue and the arrival, and every
    page arrives twice.
    """
    paths = J.Paths(scratch_dir(spark, "stored"))
    master = X.master_products(spark, sf)
    T.write_snapshot(master, S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS), 0)
    pages = master.select(
        F.col("product_url").alias("url"),
        F.lit('<h1 class="product-title-text">T</h1>').alias("html"),
        F.when(F.col("product_id").cast("long") % 3 == 0, 503).otherwise(200).alias("status_code"),
    )
    J.issue_work(spark, paths, X.AS_OF, limit=WORK)
    turned = master.withColumn("scrape_priority", 11 - F.col("scrape_priority"))
    T.write_snapshot(turned, S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS), 1)
    J.run_updates(spark, paths, pages.union(pages), X.AS_OF)
    return T.read_snapshot(spark, S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS))


CUTS = (0.25, 0.5, 0.95)


def sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and sellers of a category from stored daily sketches, and whether they are within their bounds of the exact ones."""
    path = scratch_dir(spark, "sketches")
    rows = X.products(spark, sf)
    K.daily_sketches(rows).write.parquet(path)
    found = K.estimates(K.merged_sketches(spark.read.parquet(path)), CUTS).withColumnRenamed("category_name", "_name")
    held = rows.select("category_name", "price", "seller_id").join(found, F.col("category_name") == F.col("_name"))
    below = [F.count_if(F.col("price") < F.col("quantiles")[i]) / F.count("*") for i in range(len(CUTS))]
    upto = [F.count_if(F.col("price") <= F.col("quantiles")[i]) / F.count("*") for i in range(len(CUTS))]
    within = [(low <= cut + K.RANK_ERROR) & (high >= cut - K.RANK_ERROR) for cut, low, high in zip(CUTS, below, upto, strict=True)]
    sellers = F.count_distinct("seller_id")
    return held.groupBy("category_name", "rows", "kinds").agg(
        *(w.cast("int").alias(f"q{round(100 * cut)}_within") for cut, w in zip(CUTS, within, strict=True)),
        (F.abs(F.col("kinds") - sellers) <= K.COUNT_ERROR * sellers).cast("int").alias("sellers_within"),
    ).drop("kinds").withColumnRenamed("rows", "price_points")
