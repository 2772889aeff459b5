import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.functions.text import keyword_counts, present
from stallwise.operators.enrich import (
    categorize, detect_language, enrich_products, key_phrases, score_missing, score_reviews, season_tags,
)
from stallwise.sources.schemas import PRODUCTS
from stallwise.sources.tables import read_table, write_products


def languages(rows, *texts):
    df = rows("i int, review_text string", *enumerate(texts))
    return [r.language for r in detect_language(df).orderBy("i").collect()]


def test_language_rules(rows):
    assert languages(
        rows,
        None, "", "  \n", "plain text", "Привет", "ПРИВЕТ", "más", "très", "naïve é", "ñ Привет",
    ) == ["en", "en", "en", "en", "ru", "ru", "es", "fr", "es", "ru"]


def test_han_share_is_strict(rows):
    han = "中"
    assert languages(rows, han * 3 + "a" * 7, han * 4 + "a" * 6, han * 2 + "é" * 8) == ["en", "zh", "es"]


def test_key_phrases_order_and_limit(rows):
    df = rows(
        "review_text string",
        ("EXPENSIVE but durable, good PRICE, fast shipping and quality; easy",),
        ("Customer Service",),
        (None,),
    )
    got = [r.key_phrases for r in key_phrases(df, most=5).collect()]
    assert [r.key_phrases for r in key_phrases(df).collect()][0] == ["quality", "shipping", "fast", "good", "price", "expensive", "durable", "easy"]
    assert got == [["quality", "shipping", "fast", "good", "price"], ["customer service"], []]


def test_worked_review(rows):
    text = "Great product! Fast shipping and excellent quality. Highly recommended!"
    row = score_reviews(rows("review_text string", (text,)), most_phrases=5).first()
    assert (row.sentiment_label, row.sentiment_score, row.sentiment_confidence, row.language) == ("neutral", 0.0, 0.0, "en")
    assert row.key_phrases == ["quality", "shipping", "fast", "excellent", "recommend"]


def test_scorer_sees_short_text_and_no_blanks(rows):
    def load():
        def scorer(texts):
            assert all(t and t.strip() and len(t) <= 512 for t in texts)
            return [("positive" if "good" in t else "odd" if "odd" in t else "negative", len(t) / 1000) for t in texts]

        return scorer

    df = rows("i int, review_text string", (0, "good"), (1, "x" * 600 + "good"), (2, None), (3, "  "), (4, "odd"))
    got = {r.i: (r.sentiment_label, r.sentiment_score, round(r.sentiment_confidence, 3))
           for r in score_reviews(df, load, max_chars=512).collect()}
    assert got == {
        0: ("positive", 0.5, 0.004), 1: ("negative", -0.5, 0.512), 2: ("neutral", 0.0, 0.0),
        3: ("neutral", 0.0, 0.0), 4: ("neutral", 0.0, 0.003),
    }


@pytest.mark.parametrize(
    "title, category, confidence",
    [
        ("Wireless phone shirt", "electronics", 0.2),
        ("phone shirt", "electronics", 0.1),        # a tie goes to the first category
        ("birthday card", "automotive", 0.1),       # "car" inside "card"
        ("spring bed", "jewelry", 0.1),             # "ring" inside "spring"
        ("xyz", "other", 0.0),
        (None, "other", 0.0),
    ],
)
def test_categories(rows, title, category, confidence):
    row = categorize(rows("title string, description string, tags array<string>", (title, None, None)),
                     description="description", tags="tags").first()
    assert (row.ai_category_id, row.ai_confidence) == (category, confidence)
    assert row.ai_category_name == ("Other" if category == "other" else category)


def test_worked_product(rows):
    df = rows(
        "title string, description string, tags array<string>",
        ("Wireless Bluetooth Headphones", "High-quality wireless headphones with noise cancellation",
         ["electronics", "audio", "wireless"]),
    )
    row = categorize(df, description="description", tags="tags").first()
    # phone, electronic, wireless and bluetooth
    assert (row.ai_category_id, row.ai_confidence) == ("electronics", 0.4)


def test_season_tags_keep_their_order(rows):
    df = rows("title string", ("Warm gift for a HOT Halloween in autumn",), ("nothing",), (None,))
    got = [r.seasonal_tags for r in season_tags(df).collect()]
    assert got == [["halloween", "christmas", "summer", "winter", "fall"], [], []]


def test_enrich_newest_only(rows):
    df = rows("title string, scraped_at timestamp_ntz, category_id string, category_name string, "
              "seasonal_tags array<string>, trend_score double",
              *((t, __import__("datetime").datetime(2000, 1, d), "x", "x", [], 0.0)
                for d, t in enumerate(["toy", "ring", "phone"], start=1)))
    got = enrich_products(df, newest=2).orderBy(F.desc("scraped_at")).collect()
    assert [r.category_id for r in got] == ["electronics", "jewelry"]


def test_whole_text_reaches_the_scorer(rows):
    load = lambda: lambda texts: [("positive", float(len(t))) for t in texts]
    assert score_reviews(rows("review_text string", ("x" * 5000,)), load).first().sentiment_confidence == 5000.0


def test_only_missing_scores_are_filled(rows):
    def load():
        def scorer(texts):
            assert texts == ["unseen fast"]
            return [("negative", 1.0)]

        return scorer

    ddl = ("review_id string, review_text string, sentiment_score double, sentiment_label string, "
           "key_phrases array<string>, language string")
    df = rows(ddl, ("1", "seen good", 0.5, "positive", ["x"], "de"), ("2", "unseen fast", None, None, None, None),
              ("3", None, None, None, None, None))
    for loader, score, label in ((load, -0.5, "negative"), (None, 0.0, "neutral")):
        got = {r.review_id: tuple(r)[2:] for r in score_missing(df, loader).collect()}
        assert got == {"1": (0.5, "positive", ["x"], "de"), "2": (score, label, ["fast"], "en"), "3": (0.0, "neutral", [], "en")}


def test_keyword_tests_can_be_compiled(spark, tmp_path, capsys):
    """The JVM runs generated methods of over 8,000 bytes uncompiled."""
    rows = spark.createDataFrame([("p", "Car toy")], "product_id string, title string")
    write_products(rows, str(tmp_path / "products"), datetime(2000, 1, 1))
    enrich_products(read_table(spark, PRODUCTS, str(tmp_path / "products")), tags="tags").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    found = spark.range(1).select(
        keyword_counts(F.lit("a car toy"), ("car", "toy", "gym")).alias("some"), keyword_counts(F.lit("a"), ()).alias("none"),
        keyword_counts(F.lit(None).cast("string"), ("car",)).alias("unknown"), present(F.lit("toy car"), ("car", "gym", "toy")).alias("words"),
    )
    assert found.first() == (2, 0, None, ["car", "toy"])
