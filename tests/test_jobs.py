"""The jobs end to end on tables written from the small test data."""

import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from stallwise.operators.browse import trending_recent
from stallwise.operators.worklist import select_work
from stallwise.plans import jobs as J
from stallwise.plans import reports as C
from stallwise.sources import fixtures as X
from stallwise.sources import schemas as S
from stallwise.sources import tables as T
from stallwise.sources.catalogue import SITE
from tests.conftest import NOW, SMALL


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    p = J.Paths(str(tmp_path_factory.mktemp("store")))
    T.write_products(
        X.products(spark, SMALL).drop("obs_id").withColumn("tags", F.split("title", " ")), p.table(S.PRODUCTS), NOW
    )
    T.write_reviews(X.reviews(spark, SMALL), p.table(S.REVIEWS), NOW)
    T.write_price_points(X.price_history(spark, SMALL), p.table(S.PRICE_HISTORY), NOW)
    T.append(
        spark.createDataFrame([("1", "t", NOW)], "log_id string, task_id string, scraped_at timestamp_ntz"),
        S.SCRAPING_LOGS, p.table(S.SCRAPING_LOGS), NOW,
    )
    T.write_snapshot(X.master_products(spark, SMALL), S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS), 0)
    return p


def test_daily(spark, paths):
    months, _ = J.run_daily(spark, paths)
    products = T.read_table(spark, S.PRODUCTS, paths.enriched_products)
    assert months == T.stored_months(spark, S.PRODUCTS, paths.enriched_products)
    assert products.count() == 6000
    assert {r.category_id for r in products.select("category_id").distinct().collect()} <= {
        "other", "jewelry", "electronics", "clothing", "home", "beauty", "sports", "automotive", "toys"}
    before = T.read_table(spark, S.REVIEWS, paths.table(S.REVIEWS))
    after = T.read_table(spark, S.REVIEWS, paths.scored_reviews)
    assert before.where("sentiment_score IS NULL").count() > 0
    assert after.count() == before.count() and after.where("sentiment_score IS NULL").count() == 0
    kept = before.where("sentiment_score IS NOT NULL").select("review_id", "sentiment_score", "sentiment_label")
    assert kept.exceptAll(after.select(kept.columns)).count() == 0


def test_daily_does_changed_months_only(spark, paths):
    J.run_daily(spark, paths)
    assert J.run_daily(spark, paths) == (set(), set())
    months = T.stored_months(spark, S.PRODUCTS, paths.enriched_products)
    T.delete_folder(spark, f"{paths.enriched_products}/scrape_month={min(months)}")
    assert J.run_daily(spark, paths) == ({min(months)}, set())
    assert T.read_table(spark, S.PRODUCTS, paths.enriched_products).count() == 6000


def test_late_and_new_rows_are_in_every_job(spark, tmp_path):
    """A late row in an old month and one of a new month: both are enriched, weekly reads them without a daily run."""
    p = J.Paths(str(tmp_path))
    row = "product_id string, title string, price decimal(10,2), tags array<string>, scraped_at timestamp_ntz"
    add = lambda i, t: T.write_products(spark.createDataFrame([(i, "hot ring", 5, [], t)], row.replace("decimal(10,2)", "int")), p.table(S.PRODUCTS), NOW)
    add("old", datetime(1999, 3, 5))
    add("late month", datetime(1999, 9, 5))
    assert J.run_daily(spark, p)[0] == {199903, 199909}
    add("late", datetime(1999, 3, 1))
    add("new", datetime(2000, 1, 1))
    J.run_weekly(spark, p, NOW)
    got = {r.product_id: r.category_id for r in T.read_table(spark, S.PRODUCTS, p.enriched_products).collect()}
    assert got == dict.fromkeys(("old", "late month", "late", "new"), "jewelry")
    assert J.run_daily(spark, p) == (set(), set())


def test_updates(spark, tmp_path):
    """Arrived pages become rows and scraped work, broken ones count as errors, the rest stays pending."""
    p = J.Paths(str(tmp_path))
    master = X.master_products(spark, SMALL).where("is_active = 1")
    T.write_snapshot(master, S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS), 0)
    work = [r.product_id for r in select_work(master, 3).collect()]
    url = lambda i: f"https://shop.example/item/{i}.html"
    page = '<h1 class="product-title-text">T</h1><span class="notranslate">$5</span>'
    pages = spark.createDataFrame([(url(work[0]), page, 200), (url(work[1]), None, 503), ("https://else/item/9.html", page, 200)], "url string, html string, status_code int")
    assert J.run_updates(spark, p, pages, NOW, limit=3) == (1, 2)
    rows = T.read_table(spark, S.PRODUCTS, p.table(S.PRODUCTS)).collect()
    assert [(r.product_id, r.title) for r in rows] == [(work[0], "T")]
    before = {r.product_id: r for r in master.collect()}
    after = {r.product_id: r for r in T.read_snapshot(spark, S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS)).collect()}
    assert after[work[0]].scrape_status == "scraped" and after[work[0]].last_scraped_at == NOW
    assert after[work[1]].scrape_status == "failed" and after[work[1]].error_count == before[work[1]].error_count + 1
    assert {i: r for i, r in after.items() if i not in work[:2]} == {i: r for i, r in before.items() if i not in work[:2]}
    assert T.latest_version(spark, p.table(S.MASTER_PRODUCTS)) == 1
    assert work[2] in [r.product_id for r in select_work(spark.createDataFrame(list(after.values()), master.schema), 1).collect()]


def test_look_back_opens_recent_months_only(spark, paths):
    products = T.read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS), keep_month=True)
    for as_of in (NOW, None):
        df = trending_recent(products, as_of)
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "scrape_month" in filters and ">=" in filters and "<=" in filters
    free = T.read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS))
    assert trending_recent(products, NOW).collect() == trending_recent(free, NOW).collect()


def test_weekly(spark, paths):
    J.run_daily(spark, paths)
    path, trends = J.run_weekly(spark, paths, NOW)
    sections = {d.rsplit("/", 1)[1] for d in glob.glob(path + "/*")}
    assert sections == {
        "report_metadata", "executive_summary", "overview", "top_categories", "top_sellers", "price_distribution",
        "trending_products", "seasonal_trends", "seasonal_months", "high_margin_products", "price_trends",
        "price_trend_overall", "recommendations",
    }
    summary = [json.loads(x) for f in glob.glob(path + "/executive_summary/*.json") for x in open(f)]
    assert len(summary) == 1 and summary[0]["total_products_analyzed"] == 6000
    assert T.read_table(spark, S.TRENDS, paths.table(S.TRENDS)).count() == trends


def test_report_and_insights(spark, paths):
    products = T.read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS))
    shared = C.shared_tables(products, NOW).persist()
    report = C.business_report(products, NOW, shared)
    short = C.insights(report)
    assert {n: df.count() for n, df in short.items() if n != "trending_products"} == {
        "market_overview": 1, "top_opportunities": 10, "recommendations": 5}
    overview = C.market_overview(products, NOW)
    assert overview["top_categories"].collect() == report["top_categories"].collect()
    shared.unpersist()
    first = report["recommendations"].orderBy("position").first().recommendation
    assert first.startswith("Focus on ")


def test_recommendations_without_data(spark):
    empty = spark.createDataFrame([], S.PRODUCTS.schema)
    report = C.business_report(empty, NOW)
    got = [r.position for r in report["recommendations"].collect()]
    assert got == [3, 4, 5, 6, 7, 8]
    assert report["executive_summary"].first().total_products_analyzed == 0


def test_maintenance(spark, paths):
    root = paths.table(S.MASTER_PRODUCTS)
    version = T.latest_version(spark, root)
    out = J.run_maintenance(spark, paths, NOW)
    assert out["health"].first().healthy
    counts = out["counts"].first()
    assert T.latest_version(spark, root) == version + 1
    assert counts.marked_inactive > 0 and counts.marked_skipped > 0 and counts.priority_changed > 0
    oldest = T.read_table(spark, S.PRICE_HISTORY, paths.table(S.PRICE_HISTORY)).agg(F.min("scraped_at")).first()[0]
    assert (NOW - oldest).days <= 90
    assert T.read_table(spark, S.SCRAPING_LOGS, paths.table(S.SCRAPING_LOGS)).count() == 1


def test_discovery(spark, tmp_path):
    p = J.Paths(str(tmp_path))
    pages = I.listing_pages(spark, SMALL)
    J.run_discovery(spark, p, pages, NOW)
    first = T.read_snapshot(spark, S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS))
    assert first.count() == first.select("product_id").distinct().count() == pages.count() + 1
    J.run_discovery(spark, p, pages, NOW)
    assert T.latest_version(spark, p.table(S.MASTER_PRODUCTS)) == 1
    again = T.read_snapshot(spark, S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS))
    assert again.exceptAll(first).count() == 0


def test_full(spark, tmp_path):
    p = J.Paths(str(tmp_path))
    pages = I.product_pages(spark, SMALL).withColumn("status_code", F.lit(200))
    broken = spark.createDataFrame([(f"{SITE}/item/1.html", None, 503)], pages.schema)
    written, short = J.run_full(spark, p, pages.union(broken), NOW)
    assert written == 6000
    assert short["market_overview"].first().total_products_analyzed == 6000
    assert short["recommendations"].count() == 5


def test_full_with_a_work_list(spark, tmp_path):
    """Every arrived page is a row, however many, listed or not; results go to products of any status."""
    p = J.Paths(str(tmp_path))
    kind = "product_id string, product_url string, scrape_status string, scrape_priority int, error_count int, is_active int"
    url = lambda i: f"{SITE}/item/{i}.html"
    listed = [(str(i), url(i), "pending", 5, 0, 1) for i in range(250)]
    listed += [("250", url(250), "scraped", 5, 0, 1), ("251", url(251), "failed", 5, 2, 1), ("252", url(252), "scraped", 5, 1, 1), ("other", f"{SITE}/x", "pending", 5, 0, 1), ("rest", url(999), "pending", 5, 0, 1)]
    T.write_snapshot(spark.createDataFrame(listed, kind), S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS), 0)
    page = '<h1 class="product-title-text">T</h1><span class="notranslate">$5</span>'
    arrived = [*map(url, range(252)), url(0), f"{SITE}/x", url(500)]
    pages = spark.createDataFrame([(u, page, 200) for u in arrived] + [(url(252), None, 503), (url(501), None, 503)], "url string, html string, status_code int")
    written, _ = J.run_full(spark, p, pages, NOW)
    ids = sorted(r.product_id for r in T.read_table(spark, S.PRODUCTS, p.table(S.PRODUCTS)).collect())
    assert written == 255 and ids == sorted([*map(str, range(252)), "0", "other", "500"])
    after = {r.product_id: r for r in T.read_snapshot(spark, S.MASTER_PRODUCTS, p.table(S.MASTER_PRODUCTS)).collect()}
    assert all(after[i].scrape_status == "scraped" and after[i].last_scraped_at == NOW for i in [*map(str, range(252)), "other"])
    assert (after["252"].scrape_status, after["252"].error_count) == ("failed", 2) and after["rest"].scrape_status == "pending"
    assert len(after) == len(listed)


def test_titles_and_samples_are_whole_by_default(spark):
    row = [("c", "t" * 80, 10, 4.5, 0.9, 7)]
    offers = spark.createDataFrame(row, "category_name string, title string, price int, average_rating double, margin_potential_score double, total_sales int")
    categories = spark.createDataFrame([("c", 1, 2.0)], "category_name string, product_count long, avg_price double")
    advice = lambda **cut: {r.position: r.recommendation for r in C.recommendations(spark, categories, offers, spark.createDataFrame([(5.0,)], "median double"), **cut).collect()}[2]
    assert f" {'t' * 80} - high" in advice() and f" {'t' * 50}... - high" in advice(title_chars=50)
    assert (J.health_check(spark.range(25)).first().recent_products, J.health_check(spark.range(25), 10).first().recent_products) == (25, 10)


def test_daily_reads_and_writes_new_files_only(spark, tmp_path):
    """A second run after one small append: its file is all that is read, what was written before keeps name and time."""
    import os

    p = J.Paths(str(tmp_path))
    kind = "product_id string, title string, tags array<string>, scraped_at timestamp_ntz"
    add = lambda ids, day: T.write_products(spark.createDataFrame([(str(i), "gold ring", [], datetime(1999, 12, day)) for i in ids], kind), p.table(S.PRODUCTS), NOW)
    stamps = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(p.enriched_products + "/*=*/part-*")}
    add(range(100), 5)
    J.run_daily(spark, p)
    first, source = stamps(), set(glob.glob(p.table(S.PRODUCTS) + "/*=*/part-*"))
    add(range(100, 103), 6)
    read = []
    keep = T.read_files

    def counted(spark, schema, path, files):
        read.extend(files)
        return keep(spark, schema, path, files)

    T.read_files = counted
    try:
        assert J.run_daily(spark, p) == ({199912}, set())
    finally:
        T.read_files = keep
    appended = set(glob.glob(p.table(S.PRODUCTS) + "/*=*/part-*")) - source
    assert {f.rsplit("/", 1)[1] for f in read} == {f.rsplit("/", 1)[1] for f in appended}
    second = stamps()
    assert {f: t for f, t in second.items() if f in first} == first
    new = [f for f in second if f not in first]
    assert spark.read.parquet(*new).count() == 3
    assert T.read_table(spark, S.PRODUCTS, p.enriched_products).count() == 103


def test_issued_work_is_what_counts(spark, tmp_path):
    """Priorities and states change between issue and arrival: every issued page is taken over, others are not."""
    p = J.Paths(str(tmp_path))
    root = p.table(S.MASTER_PRODUCTS)
    master = X.master_products(spark, SMALL).where("is_active = 1")
    T.write_snapshot(master, S.MASTER_PRODUCTS, root, 0)
    first = J.issue_work(spark, p, NOW, limit=5).collect()
    assert [r.product_id for r in first] and {r.product_id for r in first} == {r.product_id for r in select_work(master, 5).collect()}
    second = J.issue_work(spark, p, NOW, limit=5).collect()
    assert not {r.product_id for r in first} & {r.product_id for r in second}
    lowered = master.withColumn("scrape_priority", F.lit(1)).withColumn("scrape_status", F.lit("skipped"))
    T.write_snapshot(lowered, S.MASTER_PRODUCTS, root, 1)
    page = lambda title: f'<h1 class="product-title-text">{title}</h1>'
    kind = "url string, html string, status_code int, fetched_at timestamp_ntz"
    early, late = datetime(1999, 12, 31), datetime(1999, 12, 31, 1)
    pages = [(r.product_url, page("new"), 200, late) for r in first] + [(r.product_url, page("old"), 200, early) for r in first]
    pages += [(second[0].product_url, None, 503, late), (f"{SITE}/item/none.html", page("x"), 200, late)]
    assert J.run_updates(spark, p, spark.createDataFrame(pages, kind), NOW) == (5, 6)
    rows = T.read_table(spark, S.PRODUCTS, p.table(S.PRODUCTS)).collect()
    assert sorted(r.product_id for r in rows) == sorted(r.product_id for r in first) and {r.title for r in rows} == {"new"}
    after = {r.product_id: r.scrape_status for r in T.read_snapshot(spark, S.MASTER_PRODUCTS, root).collect()}
    assert {after[r.product_id] for r in first} == {"scraped"} and after[second[0].product_id] == "failed"
    assert after[second[1].product_id] == "skipped"


def test_limits_of_reports_are_arguments(spark, paths):
    products = T.read_table(spark, S.PRODUCTS, paths.table(S.PRODUCTS))
    report = C.business_report(products, NOW, offers=3)
    assert report["high_margin_products"].count() == 3
    short = C.insights(report, offers=2, trending=1, advice=7)
    assert (short["top_opportunities"].count(), short["recommendations"].count()) == (2, 7)
