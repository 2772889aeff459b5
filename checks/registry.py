"""One callable per operator: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks import stored, streams
from stallwise.operators import browse as B
from stallwise.operators import enrich as E
from stallwise.operators import market as M
from stallwise.operators import opportunities as O
from stallwise.operators import pages as P
from stallwise.operators import seasons as R
from stallwise.operators import summaries as V
from stallwise.operators import trends as T
from stallwise.operators import worklist as L
from stallwise.plans import reports as C
from stallwise.session import scratch_dir
from stallwise.sources import fixtures as X
from stallwise.sources.catalogue import catalogue
from stallwise.sources.tables import apply_retention
from stallwise.streaming.views import maintain, read_view

Query = Callable[[SparkSession, str], DataFrame]

HOT = 30
PAGE_LINK = r"/([A-Za-z]+)"
PAGE_URL = r"/(?:en|fr|de|es)/(\d+)(?:\.html)?"


def _over(load, operator, **options) -> Query:
    return lambda spark, sf: operator(load(spark, sf), **options)


def _joined(column: str):
    """Array columns as text, so that both engines hash them alike."""
    return F.array_join(column, ",").alias(column)


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def _stream(spark: SparkSession, rows: DataFrame, summary: V.Summary) -> DataFrame:
    path, checkpoint = scratch_dir(spark, "view"), scratch_dir(spark, "view-progress")
    maintain(rows, summary, path, checkpoint).awaitTermination()
    return read_view(spark, summary, path)


def _sales_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.products(spark, sf, lineitem=X.file_stream(spark, sf, "lineitem"))
    return _stream(spark, rows, V.SALES)


def _price_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.price_history(spark, sf, lineitem=X.file_stream(spark, sf, "lineitem"))
    return _stream(spark, rows, V.DAILY_PRICES)


def _sentiment_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.reviews(spark, sf, documents=X.file_stream(spark, sf, "documents"))
    return _stream(spark, rows, V.SENTIMENT)


def _pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    found = X.file_stream(spark, sf, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS _key")
    master = X.master_products(spark, sf)
    rows = found.join(master, F.col("_key") == F.col("product_id")).drop("_key")
    return _stream(spark, rows, V.PENDING_WORK)


def _price_points(spark: SparkSession, sf: str) -> DataFrame:
    # Every third observation loses its original price, every fifth its discount.
    rows = X.products(spark, sf).withColumn(
        "original_price",
        F.when(F.col("total_sales") % 3 == 0, F.lit(None))
        .when(F.col("total_sales") % 5 == 0, F.col("price"))
        .otherwise(F.col("original_price")),
    )
    return E.price_points(rows, X.AS_OF)


def _trend_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.trend_rows(B.trending_products(X.products(spark, sf), X.AS_OF, limit=50), X.AS_OF)


def _margin_scores(spark: SparkSession, sf: str) -> DataFrame:
    return O.margin_scores(X.products(spark, sf)).select(
        "product_id", "obs_id", "seller_id", "price", "margin_potential_score"
    )


def _price_trends(days: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = T.price_trends(X.products(spark, sf), X.AS_OF, days)
        return _round(rows, price_change_percent=6, price_volatility=8)

    return run


def _price_movers(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.price_movers(X.products(spark, sf), X.AS_OF, 720)
    return _round(rows, price_change_percent=6, price_volatility=8)


def _trend_overall(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.price_trend_overall(X.products(spark, sf), X.AS_OF, 720)
    return _round(rows, avg_price=6, median_price=6, price_range=6)


def _product_trends(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.product_trends(X.products(spark, sf))
    return _round(rows, trend_score=9, confidence=9, peak_score=9)


def _quantile_query(operator, *names: str, load=X.products) -> Query:
    return lambda spark, sf: _round(operator(load(spark, sf)), **dict.fromkeys(names, 6))


def _hot_work(spark: SparkSession, sf: str) -> DataFrame:
    master, products = X.master_products(spark, sf), X.products(spark, sf)
    return L.work_in_hot_categories(master, products, X.AS_OF, min_count=HOT)


def _priorities(spark: SparkSession, sf: str) -> DataFrame:
    master, products = X.master_products(spark, sf), X.products(spark, sf)
    return L.calculate_priorities(master, products, X.AS_OF, min_count=HOT)


def _maintenance(spark: SparkSession, sf: str) -> DataFrame:
    master = X.master_products(spark, sf)
    kept = L.skip_failed(L.mark_inactive(master, X.AS_OF))
    after = L.calculate_priorities(kept, X.products(spark, sf), X.AS_OF, min_count=HOT)
    return L.maintenance_counts(master, after, X.AS_OF)


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    return L.merge_discovered(X.master_products(spark, sf), I.found_links(spark, sf), X.AS_OF)


def _fetches(spark: SparkSession, sf: str) -> DataFrame:
    return L.apply_fetch_results(X.master_products(spark, sf), I.fetch_results(spark, sf))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return L.apply_updates(X.products(spark, sf), I.product_changes(spark, sf), "product_id")


def _language(spark: SparkSession, sf: str) -> DataFrame:
    return E.detect_language(X.reviews(spark, sf)).select("review_id", "language")


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    return E.key_phrases(X.reviews(spark, sf), most=5).select("review_id", _joined("key_phrases"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_reviews(X.reviews(spark, sf), most_phrases=5).select(
        "review_id", "sentiment_score", "sentiment_label", "sentiment_confidence",
        _joined("key_phrases"), "language",
    )


def _categorize(spark: SparkSession, sf: str) -> DataFrame:
    tagged = X.products(spark, sf).withColumn("tags", F.split("title", " "))
    return E.categorize(tagged, description="brand", tags="tags").select(
        "product_id", "obs_id", "seller_id", "price",
        "ai_category_id", "ai_category_name", "ai_confidence", _joined("ai_seasonal_tags"),
    )


def _review_categories(spark: SparkSession, sf: str) -> DataFrame:
    return E.categorize(X.reviews(spark, sf), title="review_text").select(
        "review_id", "ai_category_id", "ai_confidence", _joined("ai_seasonal_tags")
    )


def _season_tags(spark: SparkSession, sf: str) -> DataFrame:
    return E.season_tags(X.products(spark, sf)).select(
        "product_id", "obs_id", "seller_id", "price", _joined("seasonal_tags")
    )


def _enrich(spark: SparkSession, sf: str) -> DataFrame:
    return E.enrich_products(X.products(spark, sf)).select(
        "product_id", "obs_id", "seller_id", "price", "category_id", "category_name",
        _joined("seasonal_tags"), "trend_score",
    )


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return P.listing_links(X.spread(spark, sf, "pages"), PAGE_LINK)


def _page_ids(spark: SparkSession, sf: str) -> DataFrame:
    return P.product_id_from_url(X.spread(spark, sf, "pages"), "url", PAGE_URL).select("page_id", "product_id")


def _next_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second hundred of a listing, found from the last row of the first."""
    rows, options = X.products(spark, sf), {"category_id": "economy", "min_price": 10, "max_price": 60, "limit": 100}
    page = B.browse_products(rows, **options).collect()
    seen = sum(row == page[-1] for row in page)
    return B.browse_products(rows, **options, after=page[-1], seen=seen) if page else B.browse_products(rows, **options)


def _link_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.products(spark, sf).select(
        "obs_id", "product_id", "price",
        F.concat(F.lit("//shop.example/"), F.when(F.col("total_sales") % 2 == 0, "store").otherwise("seller"),
                 F.lit("/"), "seller_id", F.lit("?from=page")).alias("seller_link"),
        F.when(F.col("total_sales") % 3 == 0, F.lit("/about"))
        .otherwise(F.concat(F.lit("/category/"), "category_id", F.lit(".html"))).alias("category_link"),
    )
    rows = P.category_id_from_url(P.seller_id_from_url(rows, "seller_link"), "category_link")
    return rows.select("obs_id", "product_id", "price", "seller_id", "category_id")


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.parse_numbers(I.scraped_numbers(spark, sf), "price_text", "count_text", "rating_text")
    return rows.select(
        "obs_id", "product_id", "seller_id", "price", "price_value", "count_value", "rating_value"
    )


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return P.product_fields(I.product_pages(spark, sf), X.AS_OF).select(
        "product_id", "title", "price", "currency", "seller_id", "seller_name", "category_id",
        "category_name", "product_url", _joined("image_urls"), "total_reviews", "average_rating",
        "is_available", "scraped_at",
    )


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_meta(I.alternative_pages(spark, sf)).select(
        "page_id", "og_title", "og_image", "product_id", _joined("state_keys")
    )


def _alternative(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.page_fields_alt(I.alternative_pages(spark, sf), site_names=("Market",))
    return rows.withColumn("image_urls", F.array_join("image_urls", ","))


def _expand(spark: SparkSession, sf: str) -> DataFrame:
    return P.expand_listing_urls(X.spread(spark, sf, "pages").select("page_id", "url"), max_pages=10)


def _search(spark: SparkSession, sf: str) -> DataFrame:
    names = X.raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    return P.expand_listing_urls(P.search_urls(names), max_pages=3).select("id", "page", "page_url")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return P.match_category(I.listing_pages(spark, sf), "url").select("page_id", "category_id", "category_name")


def _discovery(spark: SparkSession, sf: str) -> DataFrame:
    return P.discovery_counts(P.discovered_products(I.listing_pages(spark, sf)), catalogue(spark))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.executive_summary(M.product_stats(X.products(spark, sf)))


def _advice(spark: SparkSession, sf: str) -> DataFrame:
    products = X.products(spark, sf)
    return C.recommendations(
        spark, M.top_categories(products), O.high_margin(products), M.price_distribution(products), title_chars=50
    )


CUTS = ("q25", "median", "q75", "q90", "q95", "q99", "min_price", "max_price")
SPREAD = ("q25_price", "median_price", "q75_price", "q90_price", "q95_price", "min_price", "max_price")

QUERIES: dict[str, Query] = {
    # sources and sinks
    "price_points": _price_points,
    "trend_rows": _trend_rows,
    "apply_retention": lambda s, d: apply_retention(X.price_history(s, d), "scraped_at", 90, X.AS_OF),
    # listings
    "browse_products": lambda s, d: B.browse_products(
        X.products(s, d), category_id="economy", min_price=10, max_price=60, limit=100, offset=50
    ),
    "browse_next": _next_page,
    "select_work": _over(X.master_products, L.select_work),
    "high_priority_work": _over(X.master_products, L.high_priority_work),
    "product_link": _over(X.master_products, B.product_link, product_id="17"),
    "unscored_reviews": _over(X.reviews, B.unscored_reviews),
    "top_rated": _over(X.products, B.top_rated),
    "rating_per_dollar": _over(X.products, B.rating_per_dollar),
    "trending_by_score": _over(X.products, B.trending_by_score, as_of=X.AS_OF),
    "trending_recent": _over(X.products, B.trending_recent, as_of=X.AS_OF),
    "trending_products": _over(X.products, B.trending_products, as_of=X.AS_OF),
    "big_discounts": _over(X.products, B.big_discounts, as_of=X.AS_OF, min_discount=5),
    "new_arrivals": _over(X.products, B.new_arrivals, as_of=X.AS_OF),
    # scores
    "margin_scores": _margin_scores,
    "high_margin": _over(X.products, O.high_margin),
    "margin_linear": _over(X.products, O.margin_linear_top),
    "season_peaks": _over(X.seasonal_products, R.season_peaks),
    "price_movers": _price_movers,
    # aggregates
    "product_stats": _over(X.products, M.product_stats),
    "total_products": _over(X.products, M.total_products),
    "by_category": _over(X.products, M.by_category),
    "top_categories": _over(X.products, M.top_categories),
    "top_sellers": _over(X.products, M.top_sellers),
    "price_distribution": _quantile_query(M.price_distribution, *CUTS),
    "price_spread": _quantile_query(M.price_spread, *SPREAD, "avg_price"),
    "category_share": _over(X.products, M.category_share),
    "seller_performance": _over(X.products, M.seller_performance),
    "best_selling_categories": _over(X.products, M.best_selling_categories),
    "shipping_buckets": _over(X.products, M.shipping_buckets),
    "price_competitiveness": _over(X.products, M.price_competitiveness),
    "price_trends": _price_trends(30),
    "price_trends_long": _price_trends(720),
    "price_trend_overall": _trend_overall,
    "seller_position": _over(X.products, M.seller_position),
    "competitors": _over(X.products, M.competitors, category_id="economy"),
    "competitor_totals": _over(X.products, M.competitor_totals, category_id="economy"),
    "competitor_share": _over(X.products, M.competitor_share),
    "health_check": _over(X.products, lambda products: M.health_check(products, sample=10)),
    "maintenance_counts": _maintenance,
    # joins
    "hot_category_work": _hot_work,
    "match_category": _matched,
    "apply_updates": _updates,
    # seasons
    "season_distribution": _over(X.seasonal_products, R.season_distribution),
    "holiday_categories": _over(X.seasonal_products, R.holiday_categories, seasons=("summer", "winter")),
    "season_prices": _quantile_query(
        R.season_prices, "median_price", "q25_price", "q75_price", load=X.seasonal_products
    ),
    "seasonal_trends": _over(X.seasonal_products, R.seasonal_trends),
    "seasonal_months": _over(X.seasonal_products, R.seasonal_months),
    "seasonal_months_recent": _over(X.seasonal_products, R.seasonal_months, as_of=X.AS_OF, months=12),
    # enrichment
    "detect_language": _language,
    "key_phrases": _phrases,
    "score_reviews": _scores,
    "categorize": _categorize,
    "categorize_reviews": _review_categories,
    "season_tags": _season_tags,
    "enrich_products": _enrich,
    "stored_enrichment": stored.enrichment,
    "stored_retention": stored.retention,
    "stored_report": stored.report,
    "stored_updates": stored.updates,
    "stored_merged": stored.merged,
    "stored_keyed_update": stored.keyed_update,
    "stored_reviews": stored.reviews,
    "stored_maintenance": stored.maintenance,
    "stored_full_run": stored.full_run,
    "stored_trends": stored.weekly_trends,
    "stored_sketches": stored.sketches,
    "insights": stored.best_offers,
    "market_overview": stored.overview,
    "product_trends": _product_trends,
    # pages
    "listing_links": _listing,
    "product_id_from_url": _page_ids,
    "link_ids": _link_ids,
    "parse_numbers": _numbers,
    "product_fields": _fields,
    "page_meta": _meta,
    "page_fields_alt": _alternative,
    "expand_listing_urls": _expand,
    "search_listing_urls": _search,
    "category_links": _over(I.listing_pages, P.category_links),
    # work list
    "merge_discovered": _merge,
    "apply_fetch_results": _fetches,
    "mark_inactive": _over(X.master_products, L.mark_inactive, as_of=X.AS_OF),
    "skip_failed": _over(X.master_products, L.skip_failed),
    "calculate_priorities": _priorities,
    "boost_category": _over(X.master_products, L.boost_category, category_id="promo"),
    "discovery_counts": _discovery,
    # maintained summaries
    "top_products_by_sales": _over(X.products, V.top_products_by_sales),
    "top_products_by_sales_stream": _sales_stream,
    "daily_price_changes": _over(X.price_history, V.daily_price_changes),
    "daily_price_changes_stream": _price_stream,
    "sentiment_summary": _over(X.reviews, V.sentiment_summary),
    "sentiment_summary_stream": _sentiment_stream,
    "pending_work": _over(I.discovery_log, V.pending_work),
    "pending_work_stream": _pending_stream,
    "daily_windows": streams.daily_windows,
    "late_rows": streams.late_rows,
    "sentiment_windows": streams.sentiment_windows,
    "sales_changes": streams.sales_changes,
    "unique_pending": streams.unique_pending,
    # reports
    "executive_summary": _summary,
    "recommendations": _advice,
}
