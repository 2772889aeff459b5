"""Scheduled jobs. These read stored tables, run operators and write results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.time import moment
from stallwise.operators.browse import trending_products
from stallwise.operators.enrich import Scorer, enrich_products, score_missing
from stallwise.operators.market import health_check
from stallwise.operators.pages import discovered_products, fetched, newest_pages, product_fields, same_fields
from stallwise.operators.trends import trend_rows
from stallwise.operators.worklist import (
    FAILED,
    SCRAPED,
    apply_fetch_results,
    calculate_priorities,
    hot_categories,
    maintenance_counts,
    mark_inactive,
    merge_discovered,
    select_work,
    skip_failed,
)
from stallwise.plans.reports import Report, business_report, insights, shared_tables
from stallwise.sources import schemas as S
from stallwise.sources.catalogue import SITE
from stallwise.sources.files import list_folder, new_run
from stallwise.sources.tables import (
    RETENTION_DAYS,
    append,
    append_new,
    expire_months,
    latest_version,
    read_snapshot,
    read_table,
    write_products,
    write_report,
    write_snapshot,
    write_trends,
)

@dataclass(frozen=True)
class Paths:
    """Where the stored tables, work-list versions and reports live."""

    root: str

    def table(self, table: S.Table) -> str:
        return f"{self.root}/{table.name}"

    @property
    def enriched_products(self) -> str:
        return f"{self.root}/products_enriched"

    @property
    def scored_reviews(self) -> str:
        return f"{self.root}/reviews_scored"

    def ledger(self, derived: str) -> str:
        """Names the files that a derived table was made from."""
        return f"{derived}_made_from"

    @property
    def issued(self) -> str:
        return f"{self.root}/issued_work"

    @property
    def reports(self) -> str:
        return f"{self.root}/reports"


def _next_version(spark: SparkSession, root: str) -> int:
    last = latest_version(spark, root)
    return 0 if last is None else last + 1


def enrich_stored(spark: SparkSession, paths: Paths) -> set[int]:
    """Enrich the files that were appended to the products since the last time; gives their months."""
    source, target = paths.table(S.PRODUCTS), paths.enriched_products
    return append_new(spark, S.PRODUCTS, source, target, paths.ledger(target), lambda rows: enrich_products(rows, tags="tags"))


def score_stored(spark: SparkSession, paths: Paths, load_scorer: Callable[[], Scorer] | None = None) -> set[int]:
    """Score the unscored reviews of the files that were appended since the last time; gives their months."""
    source, target = paths.table(S.REVIEWS), paths.scored_reviews
    return append_new(spark, S.REVIEWS, source, target, paths.ledger(target), lambda rows: score_missing(rows, load_scorer))


def run_daily(
    spark: SparkSession, paths: Paths, load_scorer: Callable[[], Scorer] | None = None
) -> tuple[set[int], set[int]]:
    """Enrich the products, then score the unscored reviews, in the files that are new.

    Late rows count like any other: they are in new files too. Gives the months
    of products and of reviews.
    """
    return enrich_stored(spark, paths), score_stored(spark, paths, load_scorer)


def current_products(spark: SparkSession, paths: Paths) -> DataFrame:
    """All products enriched, rows appended since the last daily run included."""
    enrich_stored(spark, paths)
    return read_table(spark, S.PRODUCTS, paths.enriched_products, keep_month=True)


def run_weekly(spark: SparkSession, paths: Paths, as_of: datetime) -> tuple[str, int]:
    """Write the business report, then the trend rows of the trending products."""
    products = current_products(spark, paths)
    shared = shared_tables(products, as_of).persist()
    written = write_report(business_report(products, as_of, shared), paths.reports, as_of)
    shared.unpersist()
    trending = trending_products(products, as_of, days=7, limit=50)
    return written, write_trends(trend_rows(trending, as_of), paths.table(S.TRENDS), as_of)


def run_maintenance(spark: SparkSession, paths: Paths, as_of: datetime, hot_count: int = 100) -> dict[str, DataFrame]:
    """Health check, retention, inactive and hopeless work, new priorities; categories of more than ``hot_count`` rows are hot."""
    products = read_table(
        spark, S.PRODUCTS, paths.table(S.PRODUCTS), since=as_of - timedelta(days=7)
    )
    health = health_check(read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS)))
    for table in (S.SCRAPING_LOGS, S.PRICE_HISTORY):
        expire_months(spark, table, paths.table(table), RETENTION_DAYS[table.name], as_of)
    root = paths.table(S.MASTER_PRODUCTS)
    before = read_snapshot(spark, S.MASTER_PRODUCTS, root)
    hot = hot_categories(products, as_of, min_count=hot_count).persist()
    after = calculate_priorities(skip_failed(mark_inactive(before, as_of)), products, as_of, hot=hot)
    path = write_snapshot(after, S.MASTER_PRODUCTS, root, _next_version(spark, root))
    hot.unpersist()
    written = read_table(spark, S.MASTER_PRODUCTS, path)
    return {"health": health, "counts": maintenance_counts(before, written, as_of)}


def run_discovery(
    spark: SparkSession, paths: Paths, pages: DataFrame, as_of: datetime, base: str = SITE
) -> str:
    """Merge the links of fetched listing pages into the work list."""
    root = paths.table(S.MASTER_PRODUCTS)
    if latest_version(spark, root) is None:
        master = spark.createDataFrame([], S.MASTER_PRODUCTS.schema)
    else:
        master = read_snapshot(spark, S.MASTER_PRODUCTS, root)
    merged = merge_discovered(master, discovered_products(pages, base), as_of)
    return write_snapshot(merged, S.MASTER_PRODUCTS, root, _next_version(spark, root))


def _write_results(
    spark: SparkSession, paths: Paths, master: DataFrame, work: DataFrame, tried: DataFrame, as_of: datetime
) -> int:
    """Next version of the work list: results of the ``work`` whose URL was tried. Gives their number."""
    good = fetched(tried).select(F.col("url").alias("_good")).distinct()
    seen = tried.select("url").distinct().join(work, F.col("url") == F.col("product_url"))
    status = F.when(F.col("_good").isNotNull(), F.lit(SCRAPED)).otherwise(F.lit(FAILED))
    results = seen.join(good, F.col("url") == F.col("_good"), "left").select(
        "product_id", status.alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("fetched_at")
    )
    counted = results.count()
    root = paths.table(S.MASTER_PRODUCTS)
    write_snapshot(apply_fetch_results(master, results), S.MASTER_PRODUCTS, root, _next_version(spark, root))
    return counted


def issue_work(
    spark: SparkSession,
    paths: Paths,
    as_of: datetime,
    limit: int = 200,
    priority_min: int = 1,
    again_after: timedelta = timedelta(days=1),
) -> DataFrame:
    """Select work for a fetcher and store it as an issued batch; gives the batch.

    Work that was issued less than ``again_after`` ago and has no result yet is
    not issued again.
    """
    master = read_snapshot(spark, S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS))
    waiting = issued_work(spark, paths, as_of - again_after, as_of).select("product_id").distinct()
    work = select_work(master.join(waiting, "product_id", "left_anti"), limit, priority_min)
    batch = new_run()
    work = work.select(F.lit(batch).alias("batch"), "product_id", "product_url", "scrape_priority", moment(as_of).alias("issued_at"))
    append(work, S.ISSUED_WORK, paths.issued, as_of)
    return issued_work(spark, paths, as_of, as_of).where(F.col("batch") == batch)


def issued_work(spark: SparkSession, paths: Paths, since: datetime, until: datetime) -> DataFrame:
    """Work that was issued in a span of time."""
    if not list_folder(spark, paths.issued):
        return spark.createDataFrame([], S.ISSUED_WORK.schema)
    return read_table(spark, S.ISSUED_WORK, paths.issued, since=since, until=until)


def run_updates(
    spark: SparkSession,
    paths: Paths,
    pages: DataFrame,
    as_of: datetime,
    limit: int = 200,
    priority_min: int = 1,
    days: int = 30,
) -> tuple[int, int]:
    """Take over fetched product pages: rows of the products that arrived, results of all that were tried.

    Pages are matched by URL with the work that was issued in the last ``days``,
    whatever has become of its priority or status since, and whichever batch it
    was in. Where nothing has been issued, ``limit`` and ``priority_min`` choose
    a batch now. Of several usable pages of a URL the newest one counts. Work
    without a page stays pending. Gives the rows written and the products tried.
    """
    if not list_folder(spark, paths.issued):
        issue_work(spark, paths, as_of, limit, priority_min)
    master = read_snapshot(spark, S.MASTER_PRODUCTS, paths.table(S.MASTER_PRODUCTS))
    work = issued_work(spark, paths, as_of - timedelta(days=days), as_of).select("product_id", "product_url").distinct()
    tried = pages.join(work, pages["url"] == work["product_url"], "left_semi").persist()
    rows = product_fields(newest_pages(fetched(tried)), as_of)
    arrived = rows.join(work.select(F.col("product_id").alias("_id"), F.col("product_url").alias("_url")), F.col("product_url") == F.col("_url"))
    arrived = arrived.withColumn("product_id", F.col("_id")).drop("_id", "_url").persist()
    written = write_products(arrived, paths.table(S.PRODUCTS), as_of, same_fields(as_of))
    counted = _write_results(spark, paths, master, work, tried, as_of)
    arrived.unpersist()
    tried.unpersist()
    return written, counted


def run_full(
    spark: SparkSession,
    paths: Paths,
    pages: DataFrame,
    as_of: datetime,
) -> tuple[int, Report]:
    """Fetched product pages to rows and work-list results, enrichment, insights.

    Every arrived page becomes a row, whether a work list exists or not. Pages
    are matched by URL with the whole list, whatever a product's status: it
    gives the rows their product ids (a product each where several have one
    URL) and takes over the results.
    """
    rows = product_fields(fetched(pages), as_of)
    root = paths.table(S.MASTER_PRODUCTS)
    if latest_version(spark, root) is None:
        written = write_products(rows, paths.table(S.PRODUCTS), as_of, same_fields(as_of))
    else:
        pages = pages.persist()
        master = read_snapshot(spark, S.MASTER_PRODUCTS, root)
        work = master.select("product_id", "product_url")
        listed = work.select(F.col("product_id").alias("_id"), F.col("product_url").alias("_url"))
        rows = rows.join(listed, F.col("product_url") == F.col("_url"), "left")
        rows = rows.withColumn("product_id", F.coalesce("_id", "product_id")).drop("_id", "_url")
        written = write_products(rows, paths.table(S.PRODUCTS), as_of, same_fields(as_of))
        _write_results(spark, paths, master, work, pages, as_of)
        pages.unpersist()
    return written, insights(business_report(current_products(spark, paths), as_of))
