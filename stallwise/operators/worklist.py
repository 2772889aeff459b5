"""The product work list: selection, merging and upkeep of its snapshots.

Every function takes a snapshot (one row per product) and returns the next
one; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import row_count
from stallwise.functions.ordering import top_rows
from stallwise.functions.time import ago, moment, within
from stallwise.operators.recent import recent

PENDING, SCRAPED, FAILED, SKIPPED = "pending", "scraped", "failed", "skipped"
COLUMNS = (
    "product_id", "product_url", "category_id", "category_name", "discovered_at",
    "last_scraped_at", "scrape_status", "scrape_priority", "error_count", "is_active",
)


def select_work(
    master: DataFrame,
    limit: int = 100,
    priority_min: int = 1,
    status: str = PENDING,
) -> DataFrame:
    """Active products with the status, highest priority and oldest discovery first."""
    rows = master.where(
        (F.col("scrape_status") == status)
        & (F.col("scrape_priority") >= priority_min)
        & (F.col("is_active") == 1)
    )
    columns = ("product_id", "product_url", "category_id", "category_name", "scrape_priority", "error_count")
    return top_rows(rows, [F.desc("scrape_priority"), F.asc("discovered_at")], limit, columns)


def high_priority_work(master: DataFrame, limit: int = 50) -> DataFrame:
    return select_work(master, limit, priority_min=8)


def merge_discovered(master: DataFrame, found: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Add new ids and refresh known ones.

    A known product keeps status, priority, errors and last scrape; it gets
    the new URL, the new category unless that is blank, the new discovery
    time, and becomes active again. Of several links to one product one with
    a category is preferred, then the largest by URL and category.
    """
    links = found.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.max(
            F.struct(
                (F.coalesce("category_id", F.lit("")) != "").alias("known"),
                "product_url", "category_id", "category_name",
            )
        ).alias("_found")
    )
    new = links.select(
        F.col("product_id").alias("_id"),
        F.col("_found.product_url").alias("_url"),
        F.coalesce("_found.category_id", F.lit("")).alias("_category_id"),
        F.coalesce("_found.category_name", F.lit("")).alias("_category_name"),
    )
    both = master.join(new, F.col("product_id") == F.col("_id"), "full_outer")
    seen, added = F.col("_id").isNotNull(), F.col("product_id").isNull()

    def category(name: str) -> Column:
        fresh = F.col(f"_{name}")
        return F.when(added | (seen & (F.col("_category_id") != "")), fresh).otherwise(F.col(name))

    return both.select(
        F.coalesce("product_id", "_id").alias("product_id"),
        F.coalesce("_url", "product_url").alias("product_url"),
        category("category_id").alias("category_id"),
        category("category_name").alias("category_name"),
        F.when(seen, moment(as_of)).otherwise(F.col("discovered_at")).alias("discovered_at"),
        "last_scraped_at",
        F.when(added, F.lit(PENDING)).otherwise(F.col("scrape_status")).alias("scrape_status"),
        F.when(added, F.lit(5)).otherwise(F.col("scrape_priority")).alias("scrape_priority"),
        F.when(added, F.lit(0)).otherwise(F.col("error_count")).alias("error_count"),
        F.when(seen, F.lit(1)).otherwise(F.col("is_active")).alias("is_active"),
    )


def apply_fetch_results(master: DataFrame, results: DataFrame) -> DataFrame:
    """Take over fetch results ``product_id, status, fetched_at``.

    The latest result of a product gives the status, every failure counts as
    an error, and the latest success is the time of the last scrape.
    """
    failed = F.col("status") == FAILED
    per = results.groupBy(F.col("product_id").alias("_id")).agg(
        F.max(F.struct("fetched_at", "status")).alias("_latest"),
        F.sum(F.when(failed, 1).otherwise(0)).cast("int").alias("_failures"),
        F.max(F.when(F.col("status") == SCRAPED, F.col("fetched_at"))).alias("_scraped_at"),
    )
    both = master.join(per, F.col("product_id") == F.col("_id"), "left")
    return both.withColumns(
        {
            "scrape_status": F.coalesce("_latest.status", "scrape_status"),
            "last_scraped_at": F.coalesce("_scraped_at", "last_scraped_at"),
            "error_count": F.col("error_count") + F.coalesce("_failures", F.lit(0)),
        }
    ).select(*master.columns)


def mark_inactive(master: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Active pending products that were not rediscovered for ``days``."""
    stale = (
        (F.col("discovered_at") < ago(as_of, days=days))
        & (F.col("is_active") == 1)
        & (F.col("scrape_status") == PENDING)
    )
    return master.withColumn("is_active", F.when(stale, F.lit(0)).otherwise(F.col("is_active")))


def skip_failed(master: DataFrame, errors: int = 5) -> DataFrame:
    """Failed products with too many errors are not tried again."""
    hopeless = (F.col("error_count") >= errors) & (F.col("scrape_status") == FAILED)
    return master.withColumn("scrape_status", F.when(hopeless, F.lit(SKIPPED)).otherwise(F.col("scrape_status")))


def hot_categories(
    products: DataFrame, as_of: datetime | None = None, days: int = 7, min_count: int = 100
) -> DataFrame:
    """Categories with more than ``min_count`` recent observations."""
    return (
        recent(products, as_of, days=days)
        .where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(row_count().alias("observations"))
        .where(F.col("observations") > min_count)
    )


def work_in_hot_categories(
    master: DataFrame,
    products: DataFrame,
    as_of: datetime | None = None,
    days: int = 7,
    min_count: int = 100,
) -> DataFrame:
    """Pending products of the hot categories."""
    hot = hot_categories(products, as_of, days, min_count)
    return master.where(F.col("scrape_status") == PENDING).join(hot, "category_id", "left_semi")


def calculate_priorities(
    master: DataFrame,
    products: DataFrame,
    as_of: datetime | None = None,
    min_count: int = 100,
    days: int = 7,
    hot: DataFrame | None = None,
) -> DataFrame:
    """New priorities of pending products, in three ordered steps.

    Hot category: +2, at most 10. Three or more errors: -1, at least 1.
    Discovered within a day: at least 8.

    A job that has already measured the hot categories passes them as ``hot``,
    broadcast if they are few; otherwise adaptive execution decides.
    """
    if hot is None:
        hot = hot_categories(products, as_of, days, min_count)
    marks = hot.select(F.col("category_id").alias("_hot"))
    rows = master.join(marks, F.col("category_id") == F.col("_hot"), "left")
    old = F.col("scrape_priority")
    boosted = F.when(F.col("_hot").isNotNull(), F.least(old + 2, F.lit(10))).otherwise(old)
    lowered = F.when(F.col("error_count") >= 3, F.greatest(boosted - 1, F.lit(1))).otherwise(boosted)
    fresh = F.col("discovered_at") >= ago(as_of, days=1)
    final = F.when(fresh & (lowered < 8), F.lit(8)).otherwise(lowered)
    pending = F.col("scrape_status") == PENDING
    return rows.withColumn("scrape_priority", F.when(pending, final).otherwise(old)).select(*master.columns)


def boost_category(master: DataFrame, category_id: str, amount: int = 2) -> DataFrame:
    """Raise the priority of a category's active pending products, at most to 10."""
    chosen = (
        (F.col("category_id") == category_id)
        & (F.col("scrape_status") == PENDING)
        & (F.col("is_active") == 1)
    )
    raised = F.least(F.col("scrape_priority") + amount, F.lit(10))
    return master.withColumn("scrape_priority", F.when(chosen, raised).otherwise(F.col("scrape_priority")))


def maintenance_counts(before: DataFrame, after: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """How many products a maintenance run really changed, in one row."""
    old = before.select(
        F.col("product_id").alias("_id"),
        F.col("is_active").alias("_active"),
        F.col("scrape_status").alias("_status"),
        F.col("scrape_priority").alias("_priority"),
    )
    both = after.join(old, F.col("product_id") == F.col("_id"), "left")
    return both.agg(
        F.count_if((F.col("is_active") == 0) & (F.col("_active") == 1)).alias("marked_inactive"),
        F.count_if((F.col("scrape_status") == SKIPPED) & (F.col("_status") != SKIPPED)).alias("marked_skipped"),
        F.count_if(F.col("scrape_priority") != F.col("_priority")).alias("priority_changed"),
        F.count_if(within("last_scraped_at", as_of, hours=1)).alias("scraped_last_hour"),
    )


def apply_updates(
    base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key has a change row take its values; all others stay.

    ``changes`` is reduced to one row per key first (the largest row wins), so
    a key shared by many base rows meets exactly one partner.
    """
    names = list(columns or [c for c in changes.columns if c != key])
    one = (
        changes.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.struct(*names)).alias("_change"))
    )
    both = base.join(one, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNotNull()
    return both.select(
        *(
            F.when(changed, F.col(f"_change.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in base.columns
        )
    )
