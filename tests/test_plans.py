"""Properties of the physical plans that decide how the queries scale."""

import pytest

from checks.registry import QUERIES
from tests.conftest import SMALL

BATCH = [n for n in QUERIES if not n.endswith("_stream")]
# Nested elements are beyond Spark's functions: these parse each page once, in Arrow batches.
PAGES = ("listing_links", "category_links", "product_fields", "page_meta", "page_fields_alt", "discovery_counts")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_native_and_without_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert node not in plan, node
    assert plan.count("ArrowEvalPython") <= (name in PAGES)


@pytest.mark.parametrize(
    "name", ["top_rated", "high_margin", "browse_products", "select_work", "top_sellers", "trending_products", "new_arrivals"]
)
def test_limits_are_top_k(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", ["trending_recent", "price_trends", "new_arrivals", "apply_retention"])
def test_time_filters_reach_the_reader(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "GreaterThanOrEqual(l_shipdate" in plan


@pytest.mark.parametrize("name", ["product_stats", "top_categories", "competitor_share", "daily_price_changes", "seasonal_trends"])
def test_rows_are_combined_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "partial_" in plan and "SortAggregate" not in plan


def test_season_peaks_scan_once(spark):
    df = QUERIES["season_peaks"](spark, SMALL)
    df.collect()
    assert "ReusedExchange [season" in plan_of(df)


def test_quantiles_count_once(spark):
    df = QUERIES["price_distribution"](spark, SMALL)
    df.collect()
    plan = plan_of(df)
    assert "ReusedExchange [price" in plan


@pytest.mark.parametrize("name", ["listing_links", "enrich_products", "product_fields", "detect_language", "margin_scores"])
def test_row_transforms_do_not_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Only the loader's dealing out of a single-split test file may remain.
    assert all("REPARTITION_BY_NUM" in line or "ENSURE_REQUIREMENTS" not in line for line in exchanges)


def test_shares_read_the_observations_once(spark):
    """What is left of the plan reads the sellers' sums only."""
    plan = plan_of(QUERIES["competitor_share"](spark, SMALL))
    assert "lineitem" not in plan and "sellers-" in plan
