"""Expected results as DuckDB SQL over the given tables, written independently."""

from __future__ import annotations

# Fixed values, written once more so that a wrong one in the library shows.
REVIEW_KEYWORDS = (
    "quality", "shipping", "fast", "slow", "good", "bad", "excellent", "terrible", "recommend", "worth",
    "price", "cheap", "expensive", "durable", "fragile", "easy", "difficult", "customer service",
)
CATEGORY_KEYWORDS = {
    "electronics": ("phone", "computer", "electronic", "tech", "digital", "wireless", "bluetooth"),
    "clothing": ("shirt", "dress", "pants", "shoes", "jacket", "fashion", "wear"),
    "home": ("furniture", "decoration", "kitchen", "bedroom", "living", "home"),
    "beauty": ("makeup", "skincare", "beauty", "cosmetic", "perfume", "hair"),
    "sports": ("fitness", "sport", "exercise", "gym", "outdoor", "athletic"),
    "automotive": ("car", "auto", "vehicle", "motor", "engine", "automotive"),
    "toys": ("toy", "game", "children", "kids", "play", "educational"),
    "jewelry": ("ring", "necklace", "bracelet", "jewelry", "gold", "silver"),
}
SEASON_KEYWORDS = {
    "halloween": ("halloween", "spooky", "costume", "pumpkin", "ghost", "witch"),
    "christmas": ("christmas", "holiday", "gift", "santa", "tree", "ornament"),
    "summer": ("summer", "beach", "swim", "vacation", "hot", "sunny"),
    "winter": ("winter", "cold", "snow", "warm", "coat", "heater"),
    "spring": ("spring", "flower", "garden", "fresh", "renewal"),
    "fall": ("fall", "autumn", "harvest", "leaves", "cozy"),
}
HAN = "\u4e00-\u9fff"
CYRILLIC = "а-яё"
SPANISH = "áéíóúñ"
FRENCH = "àâäéèêëïîôöùûüÿç"
CATALOGUE = (  # id, name, page, parent
    ("100003070", "Electronics", "electronics", ""),
    ("5090301", "Mobile & Accessories", "mobile-accessories", "100003070"),
    ("5090302", "Laptop & Accessories", "laptop-accessories", "100003070"),
    ("7", "Computer & Office", "computer-office", "100003070"),
    ("100003109", "Apparel & Accessories", "clothing", ""),
    ("100003116", "Women's Clothing", "womens-clothing", "100003109"),
    ("100003117", "Men's Clothing", "mens-clothing", "100003109"),
    ("15", "Home & Garden", "home-garden", ""),
    ("205950002", "Kitchen & Dining", "kitchen-dining", "15"),
    ("205950003", "Home Decor", "home-decor", "15"),
    ("66", "Beauty & Health", "beauty-health", ""),
    ("1501", "Makeup", "makeup", "66"),
    ("1502", "Skincare", "skincare", "66"),
    ("36", "Sports & Outdoors", "sports-outdoors", ""),
    ("50008163", "Fitness & Body Building", "fitness-body-building", "36"),
    ("205950006", "Camping & Hiking", "camping-hiking", "36"),
    ("34", "Toys & Hobbies", "toys-hobbies", ""),
    ("26", "Automotive", "automotive", ""),
    ("1503", "Jewelry & Accessories", "jewelry-accessories", ""),
)
# End of the fixed values.

AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"

_TABLES = {
    "products": """
SELECT product_id, title, price,
  CAST(price * CAST(100 + discount_percentage AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS original_price,
  discount_percentage, 'USD' AS currency, shipping_cost, free_shipping,
  seller_id, seller_name, seller_rating, category_id, category_name, brand,
  total_reviews, average_rating, total_sales, scraped_at, trend_score, obs_id
FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, p_name AS title,
    CAST(CAST(round(l_extendedprice / 10.0) AS BIGINT) * 0.01 AS DECIMAL(10,2)) AS price,
    CAST(round(abs(l_discount) * 100) AS INT) AS discount_percentage,
    CAST(abs(l_tax) * 100 AS DECIMAL(10,2)) AS shipping_cost,
    CASE WHEN abs(l_tax) < 0.005 THEN 1 ELSE 0 END AS free_shipping,
    CAST(l_suppkey AS VARCHAR) AS seller_id, s_name AS seller_name,
    CAST(abs(s_acctbal) / 2000.0 AS DECIMAL(3,2)) AS seller_rating,
    lower(p_type) AS category_id, p_type AS category_name, p_brand AS brand,
    CAST(p_size * l_linenumber AS INT) AS total_reviews,
    CAST(l_quantity / 10.0 AS DECIMAL(3,2)) AS average_rating,
    CAST(l_orderkey % 1000 AS INT) AS total_sales,
    l_shipdate AS scraped_at,
    CAST(round(abs(l_discount) * 1000) AS DOUBLE) / 100.0 AS trend_score,
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS obs_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
) AS obs""",
    "reviews": """
SELECT CAST(d.doc_id AS VARCHAR) AS review_id, CAST(d.doc_id % 200 AS VARCHAR) AS product_id,
  CAST(1 + d.doc_id % 5 AS INT) AS rating, d.text AS review_text,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
       WHEN l.quality = 0 THEN 'neutral' END AS sentiment_label,
  CASE WHEN l.toxic = 1 THEN CAST(-0.5 AS DOUBLE) WHEN l.quality = 1 THEN CAST(0.5 AS DOUBLE)
       WHEN l.quality = 0 THEN CAST(0.0 AS DOUBLE) END AS sentiment_score,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(d.doc_id % 30 AS INT) AS scraped_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "master_products": """
SELECT CAST(p_partkey AS VARCHAR) AS product_id,
  'https://shop.example/item/' || CAST(p_partkey AS VARCHAR) || '.html' AS product_url,
  lower(p_type) AS category_id, p_type AS category_name,
  TIMESTAMP '2000-01-01 00:00:00' - INTERVAL '1' DAY * CAST(p_partkey % 60 AS INT) AS discovered_at,
  CASE WHEN p_partkey % 4 = 1 THEN TIMESTAMP '1999-12-31 12:00:00' END AS last_scraped_at,
  CASE p_partkey % 4 WHEN 1 THEN 'scraped' WHEN 2 THEN 'failed' ELSE 'pending' END AS scrape_status,
  CAST(p_size % 10 + 1 AS INT) AS scrape_priority,
  CAST(p_partkey % 7 AS INT) AS error_count,
  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS is_active
FROM part""",
}


def q(body: str, *tables: str) -> str:
    """A query on derived tables (``products`` unless others are named)."""
    names = tables or ("products",)
    ctes = ",\n".join(f"{n} AS ({_TABLES[n]}\n)" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def mean(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / nullif(count({column}), 0)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def ties(columns: str) -> str:
    return ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in columns.split(","))


def top(columns: str, source: str, order: str, limit: int, offset: int = 0) -> str:
    skip = f" OFFSET {offset}" if offset else ""
    return f"SELECT {columns} FROM {source} ORDER BY {order}, {ties(columns)} LIMIT {limit}{skip}"


def recent(days: int, column: str = "scraped_at") -> str:
    return f"{column} >= {AS_OF} - INTERVAL '{days}' DAY AND {column} <= {AS_OF}"


def seasons_of(text: str) -> str:
    """Season tags of a lower-case text as a list."""
    cases = []
    for season, words in SEASON_KEYWORDS.items():
        test = " OR ".join(f"contains({text}, '{w}')" for w in words)
        cases.append(f"CASE WHEN {test} THEN '{season}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def counts_of(text: str) -> str:
    return ", ".join(
        " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + f" AS n_{name}"
        for name, words in CATEGORY_KEYWORDS.items()
    )


def winner_of() -> str:
    names = [f"n_{n}" for n in CATEGORY_KEYWORDS]
    cases = " ".join(f"WHEN n_{n} = best THEN '{n}'" for n in CATEGORY_KEYWORDS)
    return (
        f"SELECT *, CASE WHEN best = 0 THEN NULL {cases} END AS winner "
        f"FROM (SELECT *, greatest({', '.join(names)}) AS best FROM counted)"
    )


SEASONAL = f"seasonal AS (SELECT *, {seasons_of('lower(title)')} AS seasonal_tags FROM products)"
BY_SEASON = f"{SEASONAL}, tagged AS (SELECT *, unnest(seasonal_tags) AS season FROM seasonal)"
CATEGORY_AGGS = (
    f"count(*) AS product_count, {mean('price')} AS avg_price, {mean('average_rating')} AS avg_rating"
)
CUT = "CAST(price AS DOUBLE)"


def cut(p: float, name: str) -> str:
    return f"round(quantile_cont({CUT}, {p}), 6) AS {name}"


WINDOWED = """WITH w AS (SELECT product_id, price, scraped_at, category_name FROM products WHERE {recent}),
f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at, price, category_name) AS rn,
        row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, price DESC) AS rl,
        count(*) OVER (PARTITION BY product_id) AS n FROM w),
t AS (SELECT product_id, CAST(max(CASE WHEN rn = 1 THEN price END) AS DOUBLE) AS initial_price,
        CAST(max(CASE WHEN rl = 1 THEN price END) AS DOUBLE) AS final_price,
        stddev_pop(CAST(price AS DOUBLE)) / ({mean}) AS volatility,
        count(*) AS data_points, max(CASE WHEN rn = 1 THEN category_name END) AS category
      FROM f WHERE n >= 2 GROUP BY product_id),
r AS (SELECT product_id, initial_price, final_price,
        CASE WHEN initial_price > 0 THEN (final_price - initial_price) / initial_price ELSE 0.0 END * 100.0 AS change,
        volatility, data_points, category FROM t)
"""
TREND_COLUMNS = (
    "product_id, initial_price, final_price, round(change, 6) AS price_change_percent, "
    "round(volatility, 8) AS price_volatility, data_points, category"
)


def windowed(days: int) -> str:
    return WINDOWED.format(recent=recent(days), mean=mean("price"))


PRIORITY = """hot AS (SELECT category_id FROM products WHERE {recent} GROUP BY category_id HAVING count(*) > 30),
p1 AS (SELECT * REPLACE (CASE WHEN scrape_status = 'pending' AND category_id IN (SELECT category_id FROM hot)
    THEN least(scrape_priority + 2, 10) ELSE scrape_priority END AS scrape_priority) FROM {base}),
p2 AS (SELECT * REPLACE (CASE WHEN scrape_status = 'pending' AND error_count >= 3
    THEN greatest(scrape_priority - 1, 1) ELSE scrape_priority END AS scrape_priority) FROM p1),
p3 AS (SELECT * REPLACE (CASE WHEN scrape_status = 'pending' AND discovered_at >= {as_of} - INTERVAL '1' DAY
    AND scrape_priority < 8 THEN 8 ELSE scrape_priority END AS scrape_priority) FROM p2)
"""


def priority(base: str) -> str:
    return PRIORITY.format(recent=recent(7), base=base, as_of=AS_OF)


INACTIVE = f"""SELECT * REPLACE (CASE WHEN discovered_at < {AS_OF} - INTERVAL '30' DAY AND is_active = 1
  AND scrape_status = 'pending' THEN 0 ELSE is_active END AS is_active) FROM master_products"""
SKIPPED = """SELECT * REPLACE (CASE WHEN error_count >= 5 AND scrape_status = 'failed' THEN 'skipped'
  ELSE scrape_status END AS scrape_status) FROM {base}"""
OFFER = (
    "product_id, title, price, original_price, discount_percentage, average_rating, total_reviews, "
    "total_sales, seller_name, category_name"
)
MARGIN = """CASE WHEN price = 0 OR average_rating = 0 THEN 0.0e0 ELSE CAST(round(
  CAST(least(total_sales / 1000, 10) AS DECIMAL(9,4)) * 0.3 + average_rating * 2 * 0.3
  + greatest(CAST(10 AS DECIMAL(9,4)) - CAST(price / 10 AS DECIMAL(9,4)), 0) * 0.2
  + CAST(least(total_reviews / 100, 5) AS DECIMAL(9,4)) * 0.2, 2) AS DOUBLE) END"""
CANDIDATE = "average_rating >= 4.0 AND price <= 100 AND total_reviews >= 10 AND total_sales > 0"
WEIGHT = "CAST(average_rating AS DECIMAL(3,2)) * CAST(total_sales AS DECIMAL(10,0))"

PRICE_VIEW = f"""SELECT product_id, CAST(scraped_at AS DATE) AS date, {mean('price')} AS avg_price,
  min(price) AS min_price, max(price) AS max_price, count(*) AS price_points
FROM products GROUP BY 1, 2"""
SALES_VIEW = f"""SELECT category_id, seller_id, count(*) AS product_count,
  {big('sum(total_sales)')} AS total_category_sales, {mean('average_rating')} AS avg_category_rating,
  max(scraped_at) AS last_updated FROM products GROUP BY 1, 2"""
SENTIMENT_VIEW = """SELECT product_id, CAST(scraped_at AS DATE) AS date, count(*) AS review_count,
  CAST(sum(CAST(sentiment_score AS DECIMAL(12,6))) AS DOUBLE) / nullif(count(sentiment_score), 0) AS avg_sentiment,
  count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_reviews,
  count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_reviews,
  count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_reviews
FROM reviews GROUP BY 1, 2"""
PENDING_VIEW = """SELECT product_id, product_url, category_id, category_name, scrape_priority, error_count,
  count(*) AS occurrences, max(discovered_at) AS last_discovered_at
FROM lineitem JOIN master_products ON CAST(l_partkey AS VARCHAR) = product_id
WHERE scrape_status = 'pending' AND is_active = 1 GROUP BY 1, 2, 3, 4, 5, 6"""

# Line breaks count as spaces in the blank test, as in the review rules.
BLANK = "regexp_full_match(coalesce(review_text, ''), '\\s*')"
LANGUAGE = f"""CASE WHEN {BLANK} THEN 'en'
  WHEN length(review_text) - length(regexp_replace(review_text, '[{HAN}]', '', 'g')) > length(review_text) * 0.3e0 THEN 'zh'
  WHEN regexp_matches(lower(review_text), '[{CYRILLIC}]') THEN 'ru'
  WHEN regexp_matches(lower(review_text), '[{SPANISH}]') THEN 'es'
  WHEN regexp_matches(lower(review_text), '[{FRENCH}]') THEN 'fr' ELSE 'en' END"""
PHRASES = (
    "array_to_string(list_filter(["
    + ", ".join(f"'{k}'" for k in REVIEW_KEYWORDS)
    + "], lambda k: contains(lower(review_text), k))[1:5], ',')"
)

CATALOGUE_CASE = {
    what: "CASE "
    + " ".join(
        f"WHEN contains(url, 'https://shop.example/category/{cid}/{page}.html') THEN '{(cid if what == 'id' else name).replace(chr(39), chr(39) * 2)}'"
        for cid, name, page, _ in CATALOGUE
    )
    + " ELSE '' END"
    for what in ("id", "name")
}
LISTING_URL = """CASE p_partkey % 4 WHEN 0 THEN 'https://shop.example/category/100003070/electronics.html?page=1'
  WHEN 1 THEN 'https://shop.example/category/15/home-garden.html?page=2'
  WHEN 2 THEN 'https://shop.example/category/26/automotive.html'
  ELSE 'https://shop.example/wholesale?SearchText=anvil' END"""
FOUND = """found AS (SELECT CAST(l_partkey * 2 AS VARCHAR) AS product_id,
    'https://shop.example/item/' || CAST(l_partkey * 2 AS VARCHAR) || '.html?s=' || CAST(l_suppkey % 7 AS VARCHAR) AS product_url,
    CASE WHEN l_partkey % 3 = 0 OR l_linenumber % 2 = 0 THEN '' ELSE 'c' || CAST(l_suppkey % 5 AS VARCHAR) END AS category_id,
    CASE WHEN l_partkey % 3 = 0 OR l_linenumber % 2 = 0 THEN '' ELSE 'C' || CAST(l_suppkey % 5 AS VARCHAR) END AS category_name
  FROM lineitem),
one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY product_id
  ORDER BY category_id <> '' DESC, product_url DESC, category_id DESC, category_name DESC) = 1)
"""

ORACLES: dict[str, str] = {
    "price_points": q(f"""SELECT product_id, price, original_price,
  CASE WHEN original_price > 0 AND original_price > price
    THEN CAST(floor((CAST(original_price AS DOUBLE) - CAST(price AS DOUBLE)) / CAST(original_price AS DOUBLE) * 100.0e0) AS INT)
    ELSE 0 END AS discount_percentage, 'USD' AS currency, {AS_OF} AS recorded_at, {AS_OF} AS scraped_at
FROM (SELECT product_id, price, CASE WHEN total_sales % 3 = 0 THEN NULL WHEN total_sales % 5 = 0 THEN price
  ELSE original_price END AS original_price FROM products)"""),
    "trend_rows": q(f"""SELECT 'trend_' || product_id || '_20000101' AS trend_id, product_id,
  coalesce(category_id, 'unknown') AS category_id, 'viral' AS trend_type, trend_score,
  'up' AS trend_direction, least(trend_score * 2, 1.0) AS confidence_score, {AS_OF} AS detected_at,
  7 AS duration_days, trend_score AS peak_score, {AS_OF} AS created_at
FROM products WHERE {recent(7)} AND average_rating >= 4.0 AND total_reviews >= 5
ORDER BY {WEIGHT} DESC, total_reviews DESC, trend_score DESC,
  {ties('product_id, title, price, average_rating, total_reviews, total_sales, category_id, category_name, seller_name, scraped_at, trend_score')}
LIMIT 50"""),
    "apply_retention": q(f"""SELECT product_id, price, original_price, discount_percentage, currency,
  scraped_at AS recorded_at, scraped_at FROM products
WHERE scraped_at >= {AS_OF} - INTERVAL '90' DAY"""),
    "stored_retention": q(f"""SELECT product_id, price, original_price, discount_percentage, currency,
  scraped_at AS recorded_at, scraped_at FROM products
WHERE scraped_at >= {AS_OF} - INTERVAL '90' DAY"""),
    "browse_products": q(top(
        "product_id, title, price, original_price, discount_percentage, currency, shipping_cost, free_shipping, "
        "seller_id, seller_name, seller_rating, category_id, category_name, brand, total_reviews, "
        "average_rating, total_sales, scraped_at, trend_score, obs_id",
        "(SELECT * FROM products WHERE category_id = 'economy' AND price BETWEEN 10 AND 60)",
        "scraped_at DESC", 100, 50)),
    "select_work": q(top(
        "product_id, product_url, category_id, category_name, scrape_priority, error_count",
        "(SELECT * FROM master_products WHERE scrape_status = 'pending' AND scrape_priority >= 1 AND is_active = 1)",
        "scrape_priority DESC, discovered_at ASC", 100), "master_products"),
    "high_priority_work": q(top(
        "product_id, product_url, category_id, category_name, scrape_priority, error_count",
        "(SELECT * FROM master_products WHERE scrape_status = 'pending' AND scrape_priority >= 8 AND is_active = 1)",
        "scrape_priority DESC, discovered_at ASC", 50), "master_products"),
    "product_link": q("SELECT product_url FROM master_products WHERE product_id = '17' LIMIT 1", "master_products"),
    "unscored_reviews": q(
        "SELECT review_id, product_id, review_text, rating FROM reviews WHERE sentiment_score IS NULL "
        "ORDER BY review_id LIMIT 500", "reviews"),
    "top_rated": q(top("product_id, title, price, average_rating, total_reviews, seller_name",
        "(SELECT * FROM products WHERE average_rating >= 4.5 AND total_reviews >= 50)",
        "average_rating DESC, total_reviews DESC", 20)),
    "rating_per_dollar": q(top("product_id, title, price, average_rating, rating_per_dollar, seller_name",
        "(SELECT *, CAST(average_rating AS DOUBLE) / CAST(price AS DOUBLE) AS rating_per_dollar "
        "FROM products WHERE price > 0 AND average_rating > 0)", "rating_per_dollar DESC", 20)),
    "trending_by_score": q(top(
        "product_id, title, price, average_rating, total_reviews, total_sales, trend_score, scraped_at",
        f"(SELECT * FROM products WHERE {recent(7)} AND trend_score > 0.5)",
        "trend_score DESC, total_sales DESC", 20)),
    "trending_recent": q(top(
        "product_id, title, price, average_rating, total_reviews, total_sales, trend_score, scraped_at",
        f"(SELECT * FROM products WHERE {recent(7)})", "trend_score DESC, total_sales DESC", 20)),
    "trending_products": q(f"""WITH c AS (SELECT product_id, title, price, average_rating, total_reviews, total_sales,
  category_id, category_name, seller_name, scraped_at, trend_score, row_number() OVER (ORDER BY {WEIGHT} DESC,
  total_reviews DESC, trend_score DESC,
  {ties('product_id, title, price, average_rating, total_reviews, total_sales, category_id, category_name, seller_name, scraped_at, trend_score')}
  ) AS trend_rank FROM products WHERE {recent(7)} AND average_rating >= 4.0 AND total_reviews >= 5)
SELECT * FROM c WHERE trend_rank <= 20"""),
    "big_discounts": q(top("product_id, title, price, original_price, discount_percentage, scraped_at",
        f"(SELECT * FROM products WHERE {recent(30)} AND discount_percentage > 5)", "discount_percentage DESC", 20)),
    "new_arrivals": q(top("product_id, title, price, average_rating, seller_name, scraped_at",
        f"(SELECT * FROM products WHERE {recent(3)} AND total_reviews < 10)", "scraped_at DESC", 20)),
    "margin_scores": q(f"SELECT product_id, obs_id, seller_id, price, {MARGIN} AS margin_potential_score FROM products"),
    "high_margin": q(f"""WITH pool AS ({top(OFFER + ', shipping_cost, free_shipping',
        f'(SELECT *, {WEIGHT} AS weight FROM products WHERE {CANDIDATE})', 'weight DESC', 100)}),
scored AS (SELECT *, {WEIGHT} AS weight, {MARGIN} AS margin_potential_score FROM pool)
{top(OFFER + ', shipping_cost, free_shipping, margin_potential_score', 'scored', 'margin_potential_score DESC, weight DESC', 50)}"""),
    "margin_linear": q(top(OFFER + ", margin_potential_score", f"""(SELECT *,
  CAST(average_rating AS DOUBLE) * 0.3e0 + CAST(total_sales AS DOUBLE) / 1000.0e0 * 0.3e0
  + (100.0e0 - CAST(price AS DOUBLE)) * 0.2e0 + CAST(total_reviews AS DOUBLE) / 100.0e0 * 0.2e0 AS margin_potential_score
  FROM products WHERE {CANDIDATE})""", "margin_potential_score DESC", 50)),
    "season_peaks": q(f"""WITH {BY_SEASON},
m AS (SELECT season, CAST(month(scraped_at) AS INT) AS month, count(*) AS product_count,
  {big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price FROM tagged GROUP BY 1, 2),
peak AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY season ORDER BY total_sales DESC, month) = 1),
c AS (SELECT t.season, p.month, category_name, count(*) AS category_products,
  {big('sum(t.total_sales)')} AS category_sales, {mean('t.price')} AS category_avg_price FROM tagged t JOIN peak p
  ON t.season = p.season AND month(t.scraped_at) = p.month GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY category_sales DESC, category_name) AS category_rank FROM c)
SELECT r.season, r.month, r.category_name, category_products, category_sales, category_avg_price, product_count, total_sales, avg_price,
  category_rank FROM r JOIN peak ON r.season = peak.season WHERE category_rank <= 3"""),
    "price_movers": q(windowed(720) + f"""SELECT {TREND_COLUMNS} FROM r ORDER BY abs(change) DESC,
  {ties('product_id')} LIMIT 10"""),
    "product_stats": q(f"""SELECT count(*) AS total_products, count(DISTINCT category_id) AS total_categories,
  count(DISTINCT seller_id) AS total_sellers,
  CAST(sum(price) FILTER (WHERE price > 0) AS DOUBLE) / count(*) FILTER (WHERE price > 0) AS avg_price,
  CAST(sum(average_rating) FILTER (WHERE average_rating > 0) AS DOUBLE)
    / count(*) FILTER (WHERE average_rating > 0) AS avg_rating,
  {big('sum(total_reviews)')} AS total_reviews FROM products"""),
    "total_products": q("SELECT count(*) AS total_products FROM products"),
    "by_category": q(f"SELECT category_name, {CATEGORY_AGGS} FROM products GROUP BY 1"),
    "top_categories": q(top("category_id, category_name, product_count, avg_price, avg_rating, total_sales",
        f"(SELECT category_id, category_name, {CATEGORY_AGGS}, {big('sum(total_sales)')} AS total_sales "
        "FROM products GROUP BY 1, 2)", "product_count DESC", 10)),
    "top_sellers": q(top("seller_id, seller_name, product_count, avg_rating, total_sales, avg_price",
        f"(SELECT seller_id, seller_name, count(*) AS product_count, {mean('seller_rating')} AS avg_rating, "
        f"{big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price FROM products GROUP BY 1, 2)",
        "total_sales DESC", 10)),
    "price_distribution": q(f"""SELECT {cut(0.25, 'q25')}, {cut(0.5, 'median')}, {cut(0.75, 'q75')}, {cut(0.9, 'q90')},
  {cut(0.95, 'q95')}, {cut(0.99, 'q99')}, round(CAST(min(price) AS DOUBLE), 6) AS min_price,
  round(CAST(max(price) AS DOUBLE), 6) AS max_price FROM products WHERE price > 0"""),
    "price_spread": q(f"""SELECT {cut(0.25, 'q25_price')}, {cut(0.5, 'median_price')}, {cut(0.75, 'q75_price')},
  {cut(0.9, 'q90_price')}, {cut(0.95, 'q95_price')}, round(CAST(min(price) AS DOUBLE), 6) AS min_price,
  round(CAST(max(price) AS DOUBLE), 6) AS max_price, round({mean('price')}, 6) AS avg_price
FROM products WHERE price > 0"""),
    "category_share": q(f"""SELECT category_name, count(*) AS product_count, {big('sum(total_sales)')} AS total_sales,
  {mean('price')} AS avg_price, count(*) * 100.0e0 / (SELECT count(*) FROM products) AS market_share_percent
FROM products GROUP BY 1"""),
    "seller_performance": q(top(
        "seller_name, product_count, avg_seller_rating, total_sales, avg_price, avg_product_rating",
        f"(SELECT seller_name, count(*) AS product_count, {mean('seller_rating')} AS avg_seller_rating, "
        f"{big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price, "
        f"{mean('average_rating')} AS avg_product_rating FROM products GROUP BY 1 HAVING count(*) >= 10)",
        "total_sales DESC", 20)),
    "best_selling_categories": q(top(
        "category_name, product_count, total_sales, avg_price, avg_rating, total_reviews",
        f"(SELECT category_name, {CATEGORY_AGGS}, {big('sum(total_sales)')} AS total_sales, "
        f"{big('sum(total_reviews)')} AS total_reviews FROM products GROUP BY 1)", "total_sales DESC", 15)),
    "shipping_buckets": q(f"""SELECT CASE WHEN free_shipping = 1 THEN 'Free Shipping'
  WHEN shipping_cost = 0 THEN 'No Shipping Cost' WHEN shipping_cost <= 5 THEN 'Low Shipping ($0-5)'
  WHEN shipping_cost <= 15 THEN 'Medium Shipping ($5-15)' ELSE 'High Shipping ($15+)' END AS shipping_category,
  {CATEGORY_AGGS} FROM products GROUP BY 1"""),
    "price_competitiveness": q(top(
        "seller_name, category_name, avg_price, avg_rating, product_count, competitiveness_score",
        f"(SELECT *, avg_rating * 0.6e0 + (100.0e0 - avg_price) * 0.4e0 AS competitiveness_score FROM "
        f"(SELECT seller_name, category_name, {CATEGORY_AGGS} FROM products GROUP BY 1, 2 HAVING count(*) >= 5))",
        "competitiveness_score DESC", 30)),
    "price_trends": q(windowed(30) + f"SELECT {TREND_COLUMNS} FROM r"),
    "price_trends_long": q(windowed(720) + f"SELECT {TREND_COLUMNS} FROM r"),
    "price_trend_overall": q(f"""SELECT round({mean('price')}, 6) AS avg_price,
  round(median(CAST(price AS DOUBLE)), 6) AS median_price,
  round(CAST(max(price) - min(price) AS DOUBLE), 6) AS price_range,
  (SELECT count(*) FROM (SELECT product_id FROM products WHERE {recent(720)} GROUP BY 1 HAVING count(*) >= 2)) AS total_products_tracked,
  720 AS analysis_period_days FROM products WHERE {recent(720)}"""),
    "seller_position": q(top(
        "seller_name, total_products, categories_covered, avg_seller_rating, total_sales, avg_price, avg_product_rating",
        f"(SELECT seller_name, count(*) AS total_products, count(DISTINCT category_name) AS categories_covered, "
        f"{mean('seller_rating')} AS avg_seller_rating, {big('sum(total_sales)')} AS total_sales, "
        f"{mean('price')} AS avg_price, {mean('average_rating')} AS avg_product_rating "
        "FROM products GROUP BY 1 HAVING count(*) >= 20)", "total_sales DESC", 20)),
    "competitors": q(f"""WITH c AS ({top(
        'seller_id, seller_name, product_count, avg_price, avg_rating, total_sales, seller_rating, categories_count',
        f"(SELECT seller_id, seller_name, {CATEGORY_AGGS}, {big('sum(total_sales)')} AS total_sales, "
        f"{mean('p.seller_rating')} AS seller_rating, count(DISTINCT category_id) AS categories_count "
        "FROM products p WHERE category_id = 'economy' GROUP BY 1, 2)", 'total_sales DESC', 20)})
SELECT *, CAST(total_sales AS DOUBLE) / CAST(sum(total_sales) OVER () AS DOUBLE) * 100.0e0 AS market_share FROM c"""),
    "competitor_totals": q("""SELECT 'economy' AS category_id, count(*) AS total_competitors,
  CAST(sum(total_sales) AS BIGINT) AS total_market_sales FROM (SELECT sum(total_sales) AS total_sales
  FROM products WHERE category_id = 'economy' GROUP BY seller_id, seller_name ORDER BY 1 DESC LIMIT 20)"""),
    "competitor_share": q(f"""SELECT category_name, seller_name, {CATEGORY_AGGS}, {big('sum(total_sales)')} AS total_sales,
  CAST(sum(total_sales) AS BIGINT) * 100.0e0 / sum(sum(total_sales)) OVER (PARTITION BY category_name) AS market_share_percent
FROM products GROUP BY 1, 2"""),
    "health_check": q("""SELECT count(*) AS total_products, least(count(*), 10) AS recent_products,
  count(*) > 0 AS has_products, count(*) > 0 AS has_recent, count(*) > 0 AS healthy FROM products"""),
    "maintenance_counts": q(f"""WITH inactive AS ({INACTIVE}), skipped AS ({SKIPPED.format(base='inactive')}),
{priority('skipped')}
SELECT count(*) FILTER (WHERE a.is_active = 0 AND b.is_active = 1) AS marked_inactive,
  count(*) FILTER (WHERE a.scrape_status = 'skipped' AND b.scrape_status <> 'skipped') AS marked_skipped,
  count(*) FILTER (WHERE a.scrape_priority <> b.scrape_priority) AS priority_changed,
  count(*) FILTER (WHERE a.last_scraped_at >= {AS_OF} - INTERVAL '1' HOUR AND a.last_scraped_at <= {AS_OF}) AS scraped_last_hour
FROM p3 a JOIN master_products b ON a.product_id = b.product_id""", "products", "master_products"),
    "hot_category_work": q(f"""SELECT category_id, product_id, product_url, category_name, discovered_at, last_scraped_at,
  scrape_status, scrape_priority, error_count, is_active FROM master_products WHERE scrape_status = 'pending'
  AND category_id IN (SELECT category_id FROM products WHERE {recent(7)} GROUP BY 1 HAVING count(*) > 30)""",
        "products", "master_products"),
    "match_category": f"""SELECT p_partkey AS page_id, {CATALOGUE_CASE['id']} AS category_id,
  {CATALOGUE_CASE['name']} AS category_name FROM (SELECT p_partkey, {LISTING_URL} AS url FROM part)""",
    "apply_updates": q("""SELECT p.* REPLACE (CASE WHEN c.p_partkey IS NOT NULL THEN 'moved' ELSE category_id END AS category_id,
  CASE WHEN c.p_partkey IS NOT NULL THEN CAST(p_size AS DOUBLE) ELSE trend_score END AS trend_score)
FROM products p LEFT JOIN (SELECT * FROM part WHERE p_size > 25) c ON p.product_id = CAST(c.p_partkey AS VARCHAR)"""),
    "season_distribution": q(f"""WITH {BY_SEASON} SELECT season, count(*) AS product_count, {mean('price')} AS avg_price,
  {big('sum(total_sales)')} AS total_sales FROM tagged GROUP BY 1"""),
    "holiday_categories": q(f"""WITH {SEASONAL} {top('category_name, product_count, avg_price, total_sales',
        f"(SELECT category_name, count(*) AS product_count, {mean('price')} AS avg_price, {big('sum(total_sales)')} AS total_sales "
        "FROM seasonal WHERE list_contains(seasonal_tags, 'summer') OR list_contains(seasonal_tags, 'winter') GROUP BY 1)",
        'total_sales DESC', 20)}"""),
    "season_prices": q(f"""WITH {BY_SEASON} SELECT season, {cut(0.5, 'median_price')}, {cut(0.25, 'q25_price')},
  {cut(0.75, 'q75_price')}, count(*) AS product_count FROM tagged GROUP BY 1"""),
    "seasonal_trends": q(f"""WITH {BY_SEASON} SELECT season, CAST(month(scraped_at) AS INT) AS month, category_name,
  count(*) AS product_count, {big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price FROM tagged GROUP BY 1, 2, 3"""),
    "seasonal_months": q(f"""WITH {BY_SEASON} SELECT season, CAST(month(scraped_at) AS INT) AS month,
  count(*) AS product_count, {big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price FROM tagged GROUP BY 1, 2"""),
    "seasonal_months_recent": q(f"""WITH {BY_SEASON} SELECT season, CAST(month(scraped_at) AS INT) AS month,
  count(*) AS product_count, {big('sum(total_sales)')} AS total_sales, {mean('price')} AS avg_price FROM tagged
WHERE scraped_at >= {AS_OF} - INTERVAL '12' MONTH AND scraped_at <= {AS_OF} GROUP BY 1, 2"""),
    "detect_language": q(f"SELECT review_id, {LANGUAGE} AS language FROM reviews", "reviews"),
    "key_phrases": q(f"SELECT review_id, {PHRASES} AS key_phrases FROM reviews", "reviews"),
    "score_reviews": q(f"""SELECT review_id, CAST(0.0 AS DOUBLE) AS sentiment_score, 'neutral' AS sentiment_label,
  CAST(0.0 AS DOUBLE) AS sentiment_confidence, {PHRASES} AS key_phrases, {LANGUAGE} AS language FROM reviews""", "reviews"),
    "categorize": q(f"""WITH texts AS (SELECT *, lower(title || ' ' || brand || ' ' || title) AS txt FROM products),
counted AS (SELECT *, {counts_of('txt')} FROM texts), won AS ({winner_of()})
SELECT product_id, obs_id, seller_id, price, coalesce(winner, 'other') AS ai_category_id,
  coalesce(winner, 'Other') AS ai_category_name, least(best / 10.0e0, 1.0e0) AS ai_confidence,
  array_to_string({seasons_of('txt')}, ',') AS ai_seasonal_tags FROM won"""),
    "categorize_reviews": q(f"""WITH texts AS (SELECT *, lower(coalesce(review_text, '')) || '  ' AS txt FROM reviews),
counted AS (SELECT *, {counts_of('txt')} FROM texts), won AS ({winner_of()})
SELECT review_id, coalesce(winner, 'other') AS ai_category_id, least(best / 10.0e0, 1.0e0) AS ai_confidence,
  array_to_string({seasons_of('txt')}, ',') AS ai_seasonal_tags FROM won""", "reviews"),
    "season_tags": q(f"""SELECT product_id, obs_id, seller_id, price,
  array_to_string({seasons_of('lower(title)')}, ',') AS seasonal_tags FROM products"""),
    "enrich_products": q(f"""WITH texts AS (SELECT *, lower(title) AS txt FROM products),
counted AS (SELECT *, {counts_of('txt')} FROM texts), won AS ({winner_of()})
SELECT product_id, obs_id, seller_id, price, coalesce(winner, 'other') AS category_id,
  coalesce(winner, 'Other') AS category_name, array_to_string({seasons_of('txt')}, ',') AS seasonal_tags,
  least(best / 10.0e0, 1.0e0) AS trend_score FROM won"""),
    "stored_enrichment": q(f"""WITH texts AS (SELECT *, lower(title) AS txt FROM products),
counted AS (SELECT *, {counts_of('txt')} FROM texts), won AS ({winner_of()})
SELECT product_id, seller_id, price, scraped_at, coalesce(winner, 'other') AS category_id,
  coalesce(winner, 'Other') AS category_name, array_to_string({seasons_of('txt')}, ',') AS seasonal_tags,
  least(best / 10.0e0, 1.0e0) AS trend_score FROM won"""),
    "stored_updates": q(f"""WITH work AS (SELECT product_id FROM master_products
  WHERE scrape_status = 'pending' AND scrape_priority >= 1 AND is_active = 1
  ORDER BY scrape_priority DESC, discovered_at, {ties('product_id, product_url, category_id, category_name, scrape_priority, error_count')} LIMIT 300)
SELECT m.product_id, product_url, category_id, category_name, discovered_at,
  CASE WHEN w.product_id IS NOT NULL AND CAST(m.product_id AS BIGINT) % 3 <> 0 THEN {AS_OF} ELSE last_scraped_at END AS last_scraped_at,
  CASE WHEN w.product_id IS NULL THEN scrape_status WHEN CAST(m.product_id AS BIGINT) % 3 = 0 THEN 'failed' ELSE 'scraped' END AS scrape_status,
  CAST(11 - scrape_priority AS INT) AS scrape_priority,
  CAST(error_count + CASE WHEN w.product_id IS NOT NULL AND CAST(m.product_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS error_count,
  is_active
FROM master_products m LEFT JOIN work w ON m.product_id = w.product_id""", "master_products"),
    "product_trends": q("""WITH o AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS n,
    row_number() OVER (PARTITION BY product_id ORDER BY scraped_at, price, total_sales) AS rf,
    row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, price DESC, total_sales DESC) AS rl,
    row_number() OVER (PARTITION BY product_id ORDER BY scraped_at, price, total_sales, average_rating) AS qf,
    row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, price DESC, total_sales DESC, average_rating DESC) AS ql
  FROM products),
e AS (SELECT product_id,
    CAST(max(price) FILTER (WHERE rf = 1) AS DOUBLE) AS p0, CAST(max(price) FILTER (WHERE rl = 1) AS DOUBLE) AS p1,
    CAST(max(total_sales) FILTER (WHERE rf = 1) AS DOUBLE) AS s0, CAST(max(total_sales) FILTER (WHERE rl = 1) AS DOUBLE) AS s1,
    CAST(max(average_rating) FILTER (WHERE qf = 1) AS DOUBLE) AS r0, CAST(max(average_rating) FILTER (WHERE ql = 1) AS DOUBLE) AS r1
  FROM o WHERE n >= 2 GROUP BY product_id),
s AS (SELECT product_id, (-(p1 - p0) / p0 + (s1 - s0) / greatest(s0, 1.0) + (r1 - r0) / 5.0e0) / 3.0e0 AS score FROM e WHERE p0 <> 0)
SELECT product_id, CASE WHEN abs(score) < 0.1 THEN 'stable' WHEN score > 0.3 THEN 'viral'
    WHEN score < -0.2 THEN 'price_drop' ELSE 'seasonal' END AS trend_type, round(score, 9) AS trend_score,
  CASE WHEN score > 0.1 THEN 'up' WHEN score < -0.1 THEN 'down' ELSE 'stable' END AS trend_direction,
  round(least(abs(score) * 2, 1.0), 9) AS confidence, 30 AS duration_days, round(score, 9) AS peak_score FROM s"""),
    "listing_links": r"""WITH raw AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
l AS (SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS position FROM raw),
i AS (SELECT *, regexp_extract(href, '/([A-Za-z]+)', 1) AS product_id FROM l)
SELECT page_id, product_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://shop.example' || href END AS product_url,
  CAST(position AS INT) AS position FROM i WHERE product_id <> ''
QUALIFY row_number() OVER (PARTITION BY page_id, product_id ORDER BY position) = 1""",
    "product_id_from_url": r"""SELECT page_id, CASE WHEN id = '' THEN 'unknown' ELSE id END AS product_id
FROM (SELECT page_id, regexp_extract(url, '/(?:en|fr|de|es)/(\d+)(?:\.html)?', 1) AS id FROM pages)""",
    "link_ids": q("""SELECT obs_id, product_id, price, seller_id,
  CASE WHEN total_sales % 3 = 0 THEN 'unknown' ELSE category_id END AS category_id FROM products"""),
    "parse_numbers": q("""SELECT obs_id, product_id, seller_id, price,
  CASE WHEN total_sales % 5 = 0 THEN 0.0e0 ELSE CAST('1' || CAST(price AS VARCHAR) AS DOUBLE) END AS price_value,
  CAST(CASE total_sales % 4 WHEN 0 THEN total_sales WHEN 1 THEN trunc(CAST(total_sales AS DOUBLE) / 10.0e0 * 1000.0e0)
    WHEN 2 THEN 1000 + total_sales ELSE 0 END AS BIGINT) AS count_value,
  CASE WHEN total_sales % 3 = 0 THEN NULL ELSE CAST(average_rating AS DOUBLE) END AS rating_value FROM products"""),
    "product_fields": q(f"""SELECT product_id, title, CASE WHEN CAST(product_id AS BIGINT) % 5 = 3 THEN 0 ELSE price END AS price, 'USD' AS currency, seller_id,
  seller_name || ' & Co' AS seller_name, category_id, category_name,
  'https://shop.example/item/' || product_id || '.html' AS product_url,
  '/img/' || product_id || '-1.jpg,/img/' || product_id || '-2.jpg' AS image_urls,
  total_reviews, CASE WHEN CAST(product_id AS BIGINT) % 5 = 3 THEN 0 ELSE average_rating END AS average_rating, 1 AS is_available, {AS_OF} AS scraped_at FROM products"""),
    "page_meta": """SELECT p_partkey AS page_id, p_name || ' "new"' AS og_title,
  '/og/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS og_image, CAST(p_partkey AS VARCHAR) AS product_id,
  'id,title,k' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN ',' || (SELECT string_agg('x' || i, ',' ORDER BY i) FROM range(25) AS r(i)) ELSE '' END AS state_keys FROM part""",
    "page_fields_alt": """SELECT p_partkey AS page_id, p_name AS title,
  CASE WHEN p_partkey % 2 = 0 THEN 'US $' || CAST(p_size AS VARCHAR) ELSE 'US $' || CAST(p_size AS VARCHAR) || '.50' END AS price_text,
  'US $99' AS original_price_text, p_brand AS seller_name,
  'https://cdn.shop.example/' || CAST(p_partkey AS VARCHAR) || '.jpg,https://cdn.shop.example/' || CAST(p_partkey AS VARCHAR) || '-b.jpg' AS image_urls,
  CAST(p_size AS VARCHAR) || ' Reviews' AS review_count_text, '4.5' AS rating_text, CAST(NULL AS VARCHAR) AS sales_text FROM part""",
    "expand_listing_urls": """SELECT page_id, url, CAST(page AS INT) AS page,
  url || CASE WHEN contains(url, '?') THEN '&page=' ELSE '?page=' END || CAST(page AS VARCHAR) AS page_url
FROM pages, range(1, 11) AS r(page)""",
    "search_listing_urls": """SELECT p_partkey AS id, CAST(page AS INT) AS page,
  'https://shop.example/wholesale?SearchText=' || p_name || '&page=' || CAST(page AS VARCHAR) AS page_url
FROM part, range(1, 4) AS r(page)""",
    "category_links": """SELECT p_partkey AS page_id, 0 AS position,
  'https://shop.example/item/' || CAST(p_partkey AS VARCHAR) || '.html' AS product_url FROM part
UNION ALL SELECT p_partkey, 1, 'https://shop.example/item/' || CAST(p_partkey + 1 AS VARCHAR) || '.html' FROM part""",
    "merge_discovered": q(f"""WITH {FOUND}
SELECT coalesce(m.product_id, f.product_id) AS product_id, coalesce(f.product_url, m.product_url) AS product_url,
  CASE WHEN m.product_id IS NULL OR f.category_id <> '' THEN f.category_id ELSE m.category_id END AS category_id,
  CASE WHEN m.product_id IS NULL OR f.category_id <> '' THEN f.category_name ELSE m.category_name END AS category_name,
  CASE WHEN f.product_id IS NOT NULL THEN {AS_OF} ELSE m.discovered_at END AS discovered_at, m.last_scraped_at,
  coalesce(m.scrape_status, 'pending') AS scrape_status, coalesce(m.scrape_priority, 5) AS scrape_priority,
  coalesce(m.error_count, 0) AS error_count,
  CASE WHEN f.product_id IS NOT NULL THEN 1 ELSE m.is_active END AS is_active
FROM master_products m FULL JOIN one f ON m.product_id = f.product_id""", "master_products"),
    "apply_fetch_results": q("""WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'scraped' ELSE 'pending' END AS status, l_shipdate AS fetched_at
  FROM lineitem WHERE l_partkey % 3 <> 0),
last AS (SELECT product_id, status FROM r
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, status DESC) = 1),
sums AS (SELECT product_id, count(*) FILTER (WHERE status = 'failed') AS failures,
  max(fetched_at) FILTER (WHERE status = 'scraped') AS scraped FROM r GROUP BY 1)
SELECT m.product_id, product_url, category_id, category_name, discovered_at,
  coalesce(scraped, last_scraped_at) AS last_scraped_at, coalesce(status, scrape_status) AS scrape_status, scrape_priority,
  CAST(error_count + coalesce(failures, 0) AS INT) AS error_count, is_active
FROM master_products m LEFT JOIN last ON m.product_id = last.product_id LEFT JOIN sums ON m.product_id = sums.product_id""",
        "master_products"),
    "mark_inactive": q(INACTIVE, "master_products"),
    "skip_failed": q(SKIPPED.format(base="master_products"), "master_products"),
    "calculate_priorities": q(f"WITH {priority('master_products')} SELECT * FROM p3", "products", "master_products"),
    "boost_category": q("""SELECT * REPLACE (CASE WHEN category_id = 'promo' AND scrape_status = 'pending' AND is_active = 1
  THEN least(scrape_priority + 2, 10) ELSE scrape_priority END AS scrape_priority) FROM master_products""", "master_products"),
    "discovery_counts": """WITH top(category_id, category_name) AS (VALUES """
    + ", ".join(f"('{c}', '{n}')" for c, n, _, parent in CATALOGUE if parent == "")
    + f"""), f AS (SELECT {CATALOGUE_CASE['id']} AS category_id FROM (SELECT {LISTING_URL} AS url FROM part))
SELECT category_id, category_name, 2 * (SELECT count(*) FROM f WHERE f.category_id = top.category_id) AS discovered FROM top""",
    "top_products_by_sales": q(SALES_VIEW),
    "top_products_by_sales_stream": q(SALES_VIEW),
    "daily_price_changes": q(PRICE_VIEW),
    "daily_price_changes_stream": q(PRICE_VIEW),
    "sentiment_summary": q(SENTIMENT_VIEW, "reviews"),
    "sentiment_summary_stream": q(SENTIMENT_VIEW, "reviews"),
    "pending_work": q(PENDING_VIEW, "master_products"),
    "pending_work_stream": q(PENDING_VIEW, "master_products"),
    "executive_summary": q(f"""SELECT count(*) AS total_products_analyzed, count(DISTINCT category_id) AS total_categories,
  count(DISTINCT seller_id) AS total_sellers,
  CAST(sum(price) FILTER (WHERE price > 0) AS DOUBLE) / count(*) FILTER (WHERE price > 0) AS avg_market_price,
  CAST(sum(average_rating) FILTER (WHERE average_rating > 0) AS DOUBLE)
    / count(*) FILTER (WHERE average_rating > 0) AS avg_market_rating FROM products"""),
    "stored_report": q(f"""SELECT count(*) AS total_products_analyzed, count(DISTINCT category_id) AS total_categories,
  count(DISTINCT seller_id) AS total_sellers,
  CAST(sum(price) FILTER (WHERE price > 0) AS DOUBLE) / count(*) FILTER (WHERE price > 0) AS avg_market_price,
  CAST(sum(average_rating) FILTER (WHERE average_rating > 0) AS DOUBLE)
    / count(*) FILTER (WHERE average_rating > 0) AS avg_market_rating FROM products"""),
    "recommendations": q(f"""WITH c AS ({top('category_id, category_name, product_count, avg_price',
        f'(SELECT category_id, category_name, {CATEGORY_AGGS} FROM products GROUP BY 1, 2)', 'product_count DESC', 1)}),
pool AS ({top(OFFER + ', shipping_cost, free_shipping',
        f'(SELECT *, {WEIGHT} AS weight FROM products WHERE {CANDIDATE})', 'weight DESC', 100)}),
o AS ({top('title, average_rating, score', f'(SELECT *, {WEIGHT} AS weight, {MARGIN} AS score FROM pool)', 'score DESC, weight DESC', 1)})
SELECT 1 AS position, printf('Focus on %s category - highest product count (%d) with average price $%.2f',
  category_name, product_count, avg_price) AS recommendation FROM c
UNION ALL SELECT 2, printf('Consider dropshipping %s... - high margin potential (score: %s) with %.1f★ rating',
  title[1:50], CAST(score AS VARCHAR), CAST(average_rating AS DOUBLE)) FROM o
UNION ALL SELECT 3, printf('Target products around $%.2f median price point for optimal market positioning',
  quantile_cont(CAST(price AS DOUBLE), 0.5)) FROM products WHERE price > 0
UNION ALL SELECT 4, 'Monitor seasonal trends and prepare inventory for upcoming holiday seasons (Halloween, Christmas, Summer)'
UNION ALL SELECT 5, 'Focus on products with 4+ star ratings and 10+ reviews for credibility'
UNION ALL SELECT 6, 'Consider free shipping offers to increase conversion rates'
UNION ALL SELECT 7, 'Monitor competitor pricing weekly to maintain competitive advantage'
UNION ALL SELECT 8, 'Use AI sentiment analysis to identify product improvement opportunities'"""),
}

ENRICHED = f"""texts AS (SELECT *, lower(title) AS txt FROM products),
counted AS (SELECT *, {counts_of('txt')} FROM texts), won AS ({winner_of()}),
enriched AS (SELECT * REPLACE (coalesce(winner, 'other') AS category_id, coalesce(winner, 'Other') AS category_name,
  least(best / 10.0e0, 1.0e0) AS trend_score) FROM won)"""

# Files arrive one by one. The mark that makes a row late is that of the file two before: the one before sets the next mark.
ARRIVED = """arrived AS (SELECT *, CAST(scraped_at AS DATE) AS day, least(greatest(year(scraped_at) - 1995, 0)
  + CASE WHEN CAST(product_id AS BIGINT) % 10 = 0 THEN 1 WHEN CAST(product_id AS BIGINT) % 7 = 0 THEN 2 ELSE 0 END, 6) AS file FROM products),
tops AS (SELECT file, max(day) AS top FROM arrived GROUP BY 1),
marks AS (SELECT t.file, max(b.top) - INTERVAL 60 DAY AS mark FROM tops t LEFT JOIN tops b ON b.file <= t.file - 2 GROUP BY 1),
judged AS (SELECT a.*, coalesce(day <= mark, FALSE) AS late, day > (SELECT max(top) FROM tops) - INTERVAL 60 DAY AS open
  FROM arrived a JOIN marks USING (file))"""

ORACLES |= {
    "stored_merged": ORACLES["stored_enrichment"],
    "stored_keyed_update": q("""SELECT * REPLACE (
  CASE WHEN CAST(product_id AS BIGINT) % 9 = 0 THEN 'promo' ELSE category_id END AS category_id,
  CAST(CASE WHEN CAST(product_id AS BIGINT) % 9 = 0 THEN scrape_priority + 1 ELSE scrape_priority END AS INT) AS scrape_priority)
FROM master_products""", "master_products"),
    "stored_reviews": q("""SELECT review_id, product_id, rating, review_text, coalesce(sentiment_score, 0.0e0) AS sentiment_score,
  CASE WHEN sentiment_score IS NULL THEN 'neutral' ELSE sentiment_label END AS sentiment_label, scraped_at,
  CAST(0 AS BIGINT) AS helpful_votes FROM reviews""", "reviews"),
    "stored_maintenance": f"""SELECT measure, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT *,
  (SELECT count(*) FROM lineitem) AS total_products, CAST(1 AS BIGINT) AS healthy,
  (SELECT count(*) FROM ({ORACLES['apply_retention']})) AS price_points_kept
  FROM ({ORACLES['maintenance_counts']})) ON COLUMNS(*) INTO NAME measure VALUE value)""",
    "stored_full_run": ORACLES["product_fields"],
    "stored_trends": q(f"""WITH {ENRICHED} SELECT 'trend_' || product_id || '_20000101' AS trend_id, product_id,
  coalesce(category_id, 'unknown') AS category_id, 'viral' AS trend_type, trend_score,
  'up' AS trend_direction, least(trend_score * 2, 1.0) AS confidence_score, {AS_OF} AS detected_at,
  7 AS duration_days, trend_score AS peak_score, {AS_OF} AS created_at
FROM enriched WHERE {recent(7)} AND average_rating >= 4.0 AND total_reviews >= 5
ORDER BY {WEIGHT} DESC, total_reviews DESC, trend_score DESC,
  {ties('product_id, title, price, average_rating, total_reviews, total_sales, category_id, category_name, seller_name, scraped_at, trend_score')}
LIMIT 50"""),
    "insights": f"""SELECT * FROM ({ORACLES['high_margin']}) ORDER BY margin_potential_score DESC,
  CAST(average_rating AS DOUBLE) * total_sales DESC, {ties('product_id, title, price, average_rating, total_reviews, total_sales')} LIMIT 10""",
    "daily_windows": q(f"""WITH {ARRIVED} SELECT product_id, day AS date, {mean('price')} AS avg_price, min(price) AS min_price,
  max(price) AS max_price, count(*) AS price_points FROM judged WHERE NOT late AND NOT open GROUP BY 1, 2"""),
    "late_rows": q(f"""WITH {ARRIVED} SELECT count(*) FILTER (WHERE late) AS late_rows,
  count(DISTINCT (product_id, day)) FILTER (WHERE NOT late AND open) AS open_keys FROM judged"""),
    "sentiment_windows": q(f"""SELECT * FROM ({SENTIMENT_VIEW})
WHERE date <= (SELECT CAST(max(scraped_at) AS DATE) FROM reviews) - INTERVAL 3 DAY""", "reviews"),
    "sales_changes": q(SALES_VIEW),
    "unique_pending": q("""SELECT product_id, product_url, category_id, category_name, scrape_priority, error_count,
  count(DISTINCT year(l_shipdate) >= 1998) AS occurrences,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 1 DAY * CASE WHEN bool_or(year(l_shipdate) >= 1998) THEN 1000 ELSE 0 END AS last_discovered_at
FROM lineitem JOIN master_products ON CAST(l_partkey AS VARCHAR) = product_id
WHERE scrape_status = 'pending' AND is_active = 1 GROUP BY 1, 2, 3, 4, 5, 6""", "master_products"),
    "browse_next": ORACLES["browse_products"].replace("LIMIT 100 OFFSET 50", "LIMIT 100 OFFSET 100"),
    "stored_sketches": q("""SELECT category_name, count(*) AS price_points, CAST(1 AS INT) AS q25_within, CAST(1 AS INT) AS q50_within,
  CAST(1 AS INT) AS q95_within, CAST(1 AS INT) AS sellers_within FROM products GROUP BY 1"""),
    "market_overview": f"""SELECT section, name, round(value, 6) AS value FROM (
  SELECT 'overview' AS section, name, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({ORACLES['product_stats']}))
    ON COLUMNS(*) INTO NAME name VALUE value)
  UNION ALL SELECT 'price_distribution', name, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({ORACLES['price_distribution']}))
    ON COLUMNS(*) INTO NAME name VALUE value)
  UNION ALL SELECT 'top_categories', category_name, CAST(product_count AS DOUBLE) FROM ({ORACLES['top_categories']})
  UNION ALL SELECT 'top_sellers', seller_name, CAST(total_sales AS DOUBLE) FROM ({ORACLES['top_sellers']})
  UNION ALL SELECT 'trending_products', product_id, CAST(trend_rank AS DOUBLE) FROM ({ORACLES['trending_products']}))""",
}
