"""Declared schemas, defaults and layout of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names, types and defaults of the tables. The text form
# is Spark's DDL; flags stay 0/1 integers because the queries compare them so.
_PRODUCTS = """
product_id string, title string, price decimal(10,2), original_price decimal(10,2),
discount_percentage int, currency string, shipping_cost decimal(10,2), free_shipping int,
seller_id string, seller_name string, seller_rating decimal(3,2), seller_followers bigint,
category_id string, category_name string, subcategory_id string, subcategory_name string,
brand string, sku string, product_url string, image_urls array<string>, tags array<string>,
specifications map<string,string>, total_reviews int, average_rating decimal(3,2),
total_sales int, stock_quantity bigint, is_available int, created_at timestamp_ntz,
updated_at timestamp_ntz, scraped_at timestamp_ntz, seasonal_tags array<string>,
trend_score double, margin_potential double
"""
_REVIEWS = """
review_id string, product_id string, user_id string, user_name string, user_country string,
rating int, review_text string, review_date timestamp_ntz, helpful_votes bigint,
verified_purchase int, sentiment_score double, sentiment_label string,
key_phrases array<string>, language string, translated_text string,
created_at timestamp_ntz, scraped_at timestamp_ntz
"""
_CATEGORIES = """
category_id string, category_name string, parent_category_id string, level int, path string,
seasonal_relevance map<string,double>, trend_score double, product_count bigint,
avg_price decimal(10,2), created_at timestamp_ntz, updated_at timestamp_ntz
"""
_SELLERS = """
seller_id string, seller_name string, store_url string, country string,
seller_rating decimal(3,2), total_followers bigint, total_products bigint, years_active int,
response_rate decimal(5,2), response_time string, is_verified int, is_gold_supplier int,
is_trade_assurance int, avg_shipping_time int, total_sales bigint,
created_at timestamp_ntz, updated_at timestamp_ntz
"""
_PRICE_HISTORY = """
product_id string, price decimal(10,2), original_price decimal(10,2), discount_percentage int,
currency string, recorded_at timestamp_ntz, scraped_at timestamp_ntz
"""
_TRENDS = """
trend_id string, product_id string, category_id string, trend_type string, trend_score double,
trend_direction string, confidence_score double, detected_at timestamp_ntz, duration_days int,
peak_score double, created_at timestamp_ntz
"""
_SCRAPING_LOGS = """
log_id string, task_id string, url string, status string, response_time_ms bigint,
data_points_extracted bigint, error_message string, proxy_used string, user_agent string,
scraped_at timestamp_ntz
"""
_MASTER_PRODUCTS = """
product_id string, product_url string, category_id string, category_name string,
discovered_at timestamp_ntz, last_scraped_at timestamp_ntz, scrape_status string,
scrape_priority int, error_count int, is_active int
"""
_FETCHED_PAGES = """
url string, status_code int, content string, headers map<string,string>, response_time double,
proxy_used string, error string
"""
_ISSUED_WORK = """
batch string, product_id string, product_url string, scrape_priority int, issued_at timestamp_ntz
"""

NOW = object()
"""Marks a default that is the writer's clock."""


@dataclass(frozen=True)
class Table:
    """Schema of a table and how it is laid out on storage."""

    name: str
    ddl: str
    defaults: dict = field(default_factory=dict)
    month_of: str | None = None
    month_column: str = "month"
    sort_by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(" ".join(self.ddl.split()))


PRODUCTS = Table(
    "products", _PRODUCTS,
    defaults={
        "currency": "USD", "free_shipping": 0, "seller_followers": 0, "specifications": {},
        "total_reviews": 0, "average_rating": 0, "total_sales": 0, "is_available": 1,
        "created_at": NOW, "updated_at": NOW, "scraped_at": NOW, "seasonal_tags": [],
        "trend_score": 0.0, "margin_potential": 0.0,
    },
    month_of="scraped_at", month_column="scrape_month",
    sort_by=("category_id", "seller_id", "scraped_at"), bloom=("category_id",),
)
REVIEWS = Table(
    "reviews", _REVIEWS,
    defaults={"helpful_votes": 0, "verified_purchase": 0, "created_at": NOW, "scraped_at": NOW},
    month_of="scraped_at", month_column="scrape_month", sort_by=("product_id", "scraped_at"),
)
CATEGORIES = Table(
    "categories", _CATEGORIES,
    defaults={"trend_score": 0.0, "product_count": 0, "created_at": NOW, "updated_at": NOW},
    sort_by=("level", "category_id"),
)
SELLERS = Table(
    "sellers", _SELLERS,
    defaults={
        "is_verified": 0, "is_gold_supplier": 0, "is_trade_assurance": 0,
        "created_at": NOW, "updated_at": NOW,
    },
    sort_by=("seller_id", "created_at"),
)
PRICE_HISTORY = Table(
    "price_history", _PRICE_HISTORY, defaults={"scraped_at": NOW},
    month_of="scraped_at", month_column="scrape_month", sort_by=("product_id", "recorded_at"),
)
TRENDS = Table(
    "trends", _TRENDS, defaults={"created_at": NOW},
    month_of="detected_at", month_column="detect_month", sort_by=("trend_type", "detected_at"),
)
SCRAPING_LOGS = Table(
    "scraping_logs", _SCRAPING_LOGS, defaults={"scraped_at": NOW},
    month_of="scraped_at", month_column="scrape_month", sort_by=("task_id", "scraped_at"),
)
MASTER_PRODUCTS = Table(
    "master_products", _MASTER_PRODUCTS,
    defaults={
        "discovered_at": NOW, "scrape_status": "pending", "scrape_priority": 5,
        "error_count": 0, "is_active": 1,
    },
    month_of="discovered_at", month_column="discover_month",
    sort_by=("category_id", "product_id", "discovered_at"), bloom=("category_id",),
)
FETCHED_PAGES = Table("fetched_pages", _FETCHED_PAGES)
ISSUED_WORK = Table(
    "issued_work", _ISSUED_WORK, month_of="issued_at", month_column="issue_month", sort_by=("product_id",),
)

TABLES = {
    t.name: t
    for t in (
        PRODUCTS, REVIEWS, CATEGORIES, SELLERS, PRICE_HISTORY, TRENDS, SCRAPING_LOGS,
        MASTER_PRODUCTS, FETCHED_PAGES,
    )
}
