"""The built-in category catalogue and the seed rows of the categories table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.sources.schemas import CATEGORIES
from stallwise.sources.tables import conform

SITE = "https://shop.example"

# Id, name, page name, parent id, description, in matching order.
CATALOGUE = (
    ("100003070", "Electronics", "electronics", "", "Consumer electronics, gadgets, and technology"),
    ("5090301", "Mobile & Accessories", "mobile-accessories", "100003070",
     "Phone cases, chargers, headphones, and mobile accessories"),
    ("5090302", "Laptop & Accessories", "laptop-accessories", "100003070",
     "Laptops, bags, mice, keyboards, and laptop accessories"),
    ("7", "Computer & Office", "computer-office", "100003070", "Desktop computers, tablets, office supplies"),
    ("100003109", "Apparel & Accessories", "clothing", "", "Fashion, clothing, and accessories"),
    ("100003116", "Women's Clothing", "womens-clothing", "100003109", "Women's fashion and clothing"),
    ("100003117", "Men's Clothing", "mens-clothing", "100003109", "Men's fashion and clothing"),
    ("15", "Home & Garden", "home-garden", "", "Home improvement, furniture, and garden supplies"),
    ("205950002", "Kitchen & Dining", "kitchen-dining", "15", "Kitchen gadgets, utensils, and dining accessories"),
    ("205950003", "Home Decor", "home-decor", "15", "Decorative items, art, and home accents"),
    ("66", "Beauty & Health", "beauty-health", "", "Beauty products, cosmetics, and health supplies"),
    ("1501", "Makeup", "makeup", "66", "Cosmetics and makeup products"),
    ("1502", "Skincare", "skincare", "66", "Skincare and beauty treatments"),
    ("36", "Sports & Outdoors", "sports-outdoors", "", "Sports equipment, outdoor gear, and fitness"),
    ("50008163", "Fitness & Body Building", "fitness-body-building", "36",
     "Fitness equipment and bodybuilding supplies"),
    ("205950006", "Camping & Hiking", "camping-hiking", "36", "Camping gear and hiking equipment"),
    ("34", "Toys & Hobbies", "toys-hobbies", "", "Toys, games, and hobby supplies"),
    ("26", "Automotive", "automotive", "", "Car accessories and automotive parts"),
    ("1503", "Jewelry & Accessories", "jewelry-accessories", "", "Jewelry, watches, and fashion accessories"),
)
# Id, name, season relevance of the seeded top categories.
SEEDS = (
    ("electronics", "Electronics", {"summer": 0.3, "winter": 0.2}),
    ("clothing", "Clothing", {"summer": 0.8, "winter": 0.9}),
    ("home", "Home & Garden", {"spring": 0.7, "fall": 0.6}),
    ("beauty", "Beauty & Health", {"summer": 0.5, "winter": 0.4}),
    ("sports", "Sports & Outdoors", {"summer": 0.9, "winter": 0.3}),
)
# End of the fixed values.


def category_url(category_id: str, page: str, site: str = SITE) -> str:
    return f"{site}/category/{category_id}/{page}.html"


def catalogue(spark: SparkSession, site: str = SITE) -> DataFrame:
    """``position, category_id, category_name, url, parent_id, description``."""
    rows = [
        (position, cid, name, category_url(cid, page, site), parent, text)
        for position, (cid, name, page, parent, text) in enumerate(CATALOGUE)
    ]
    return spark.createDataFrame(
        rows,
        "position int, category_id string, category_name string, url string, parent_id string, description string",
    )


def category_by_id(categories: DataFrame, category_id: str) -> DataFrame:
    return categories.where(F.col("category_id") == category_id)


def top_level(categories: DataFrame) -> DataFrame:
    return categories.where(F.col("parent_id") == "")


def children_of(categories: DataFrame, parent_id: str) -> DataFrame:
    return categories.where(F.col("parent_id") == parent_id)


def category_urls(categories: DataFrame) -> DataFrame:
    return categories.orderBy("position").select("url")


def subcategories(categories: DataFrame) -> DataFrame:
    """Parent and child of every nested category."""
    parent = categories.select(
        F.col("category_id").alias("parent_id"), F.col("category_name").alias("parent_name")
    )
    child = categories.where(F.col("parent_id") != "").select("parent_id", "category_id", "category_name")
    return child.join(parent, "parent_id").select("parent_id", "parent_name", "category_id", "category_name")


def category_seed(spark: SparkSession, as_of: datetime | None = None) -> DataFrame:
    """The five seed rows in the shape of the categories table."""
    rows = [(cid, name, "", 1, name, seasons) for cid, name, seasons in SEEDS]
    seed = spark.createDataFrame(
        rows,
        "category_id string, category_name string, parent_category_id string, level int, path string, "
        "seasonal_relevance map<string,double>",
    ).withColumn("avg_price", F.lit(0).cast("decimal(10,2)"))
    return conform(seed, CATEGORIES, as_of)
