"""One key with a third of all rows, with and without broadcast joins, against plain Python."""

from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from stallwise.operators import market as M
from stallwise.operators import worklist as L
from stallwise.operators.trends import price_trends
from tests.conftest import NOW

DDL = ("product_id string, seller_name string, category_name string, category_id string, price decimal(10,2), "
       "average_rating decimal(3,2), seller_rating decimal(3,2), total_sales int, scraped_at timestamp_ntz")
COUNT = 3000


def record(i):
    hot = i % 3 == 0
    key = "hot" if hot else str(i % 97)
    return (key, f"s{'hot' if hot else i % 31}", None if i % 50 == 1 else f"c{'hot' if hot else i % 7}", f"c{i % 7}",
            Decimal(i * 37 % 5000 + 1).scaleb(-2), Decimal(i % 500).scaleb(-2), Decimal("4.00"), i % 1000,
            NOW - timedelta(minutes=i * 7919 % 40000))


DATA = [record(i) for i in range(COUNT)]


@pytest.fixture(params=["10MB", "-1"])
def skewed(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield spark.createDataFrame(DATA, DDL).repartition(6)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_competitor_share(skewed):
    sales, total = defaultdict(int), defaultdict(int)
    for _, seller, category, _, _, _, _, sold, _ in DATA:
        sales[category, seller] += sold
        total[category] += sold
    got = {(r.category_name, r.seller_name): r.market_share_percent for r in M.competitor_share(skewed).collect()}
    assert set(got) == set(sales) and (None, "s1") in got
    for key, share in got.items():
        assert share == pytest.approx(sales[key] * 100 / total[key[0]])


def test_category_share(skewed):
    got = M.category_share(skewed).collect()
    assert sum(r.product_count for r in got) == COUNT
    assert sum(r.market_share_percent for r in got) == pytest.approx(100)
    assert max(r.market_share_percent for r in got) > 30


def test_seller_position(skewed):
    covered = defaultdict(set)
    for _, seller, category, *_ in DATA:
        if category is not None:
            covered[seller].add(category)
    got = M.seller_position(skewed, min_products=1, limit=100).collect()
    assert {r.seller_name: r.categories_covered for r in got} == {s: len(c) for s, c in covered.items()}
    assert sum(r.total_products for r in got) == COUNT


def test_price_trends(skewed):
    seen = defaultdict(list)
    for product, _, _, _, price, _, _, _, when in DATA:
        if when >= NOW - timedelta(days=20):
            seen[product].append((when, price))
    got = {r.product_id: r for r in price_trends(skewed, NOW, days=20).collect()}
    assert set(got) == {p for p, v in seen.items() if len(v) >= 2}
    for product, row in got.items():
        ordered = sorted(seen[product])
        assert (row.initial_price, row.final_price) == (float(ordered[0][1]), float(ordered[-1][1]))
        assert row.data_points == len(ordered)


def test_updates(skewed, rows):
    changes = rows("product_id string, total_sales int", ("hot", -1), ("hot", -2), ("5", -3), ("none", -4))
    got = defaultdict(int)
    for r in L.apply_updates(skewed, changes, "product_id").collect():
        got[r.total_sales] += r.total_sales < 0
    assert (got[-1], got[-2], got[-3]) == (1000, 0, sum(r[0] == "5" for r in DATA))


def test_merge_of_repeated_links(skewed, spark):
    found = skewed.selectExpr("product_id", "concat('u', total_sales) AS product_url", "category_id", "category_id AS category_name")
    empty = spark.createDataFrame([], "product_id string, product_url string, category_id string, category_name string, "
                                      "discovered_at timestamp_ntz, last_scraped_at timestamp_ntz, scrape_status string, "
                                      "scrape_priority int, error_count int, is_active int")
    got = L.merge_discovered(empty, found, NOW).collect()
    assert sorted(r.product_id for r in got) == sorted({r[0] for r in DATA})
    assert {r.discovered_at for r in got} == {datetime(2000, 1, 1)}
