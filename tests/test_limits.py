"""Limits are compared as they are given, not rounded to the column's scale; pages follow one another without gaps."""

from datetime import datetime

from stallwise.operators.browse import browse_products, top_rated
from stallwise.operators.opportunities import high_margin
from tests.conftest import SMALL
from stallwise.sources import fixtures as X


def test_price_limits(spark):
    products = X.products(spark, SMALL)
    all_rows = [r.price for r in products.select("price").collect()]
    for limit in (10.005, 10.0, 9.999, 1e12):
        got = browse_products(products, max_price=limit, limit=10_000)
        assert got.count() == sum(float(p) <= limit for p in all_rows)
        got = browse_products(products, min_price=limit, limit=10_000)
        assert got.count() == sum(float(p) >= limit for p in all_rows)


def test_rating_limits(spark):
    products = X.products(spark, SMALL)
    rows = [(r.average_rating, r.total_reviews) for r in products.select("average_rating", "total_reviews").collect()]
    for limit in (4.554, 4.55, 10):
        assert top_rated(products, min_rating=limit, limit=10_000).count() == sum(float(a) >= limit and n >= 50 for a, n in rows)


def test_margin_without_a_pool(spark):
    products = X.products(spark, SMALL)
    best = high_margin(products, pool=None, limit=10_000)
    pooled = high_margin(products, pool=100, limit=10_000)
    assert pooled.count() == 100 < best.count()


def test_pages_joined_are_the_full_order(spark):
    """Pages that start after the last row of the one before give every row once, ties, repeated rows and nulls included."""
    times = [None, datetime(2000, 1, 1), datetime(2000, 1, 2)]
    values = [(i % 4 and str(i % 4), times[i % 3], i % 2 or None) for i in range(40)]
    rows = spark.createDataFrame([(a or None, t, b) for a, t, b in values], "product_id string, scraped_at timestamp_ntz, n int")
    whole = browse_products(rows, limit=None).collect()
    for size in (1, 3, 7, 40):
        pages, last = [], {}
        while page := browse_products(rows, limit=size, **last).collect():
            pages += page
            seen = sum(r == page[-1] for r in pages)
            last = {"after": page[-1], "seen": seen}
        assert pages == whole
    narrow = browse_products(rows, limit=5, columns=["product_id", "scraped_at"]).collect()
    next_ = browse_products(rows, limit=5, columns=["product_id", "scraped_at"], after=narrow[-1], seen=sum(r == narrow[-1] for r in narrow))
    assert narrow + next_.collect() == browse_products(rows, limit=10, columns=["product_id", "scraped_at"]).collect()


def test_a_page_limit_reaches_the_reader(spark):
    rows = X.products(spark, SMALL)
    last = browse_products(rows, limit=3).collect()[-1]
    plan = browse_products(rows, limit=3, after=last)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan
