from decimal import Decimal

import pytest

from stallwise.functions.scores import discount_percent, margin_linear
from stallwise.operators.opportunities import high_margin, margin_scores

OFFER = "price decimal(10,2), average_rating decimal(3,2), total_sales int, total_reviews int"


@pytest.mark.parametrize(
    "price, rating, sales, reviews, expected",
    [
        ("0.00", "4.50", 100, 10, 0.0),
        ("10.00", None, 100, 10, 0.0),
        ("10.00", "0.00", 100, 10, 0.0),
        (None, "4.00", 100, 10, 0.0),
        ("10.00", "4.00", None, 10, 0.0),
        ("10.00", "4.00", 100, None, 0.0),
        ("10.00", "5.00", 1000, 100, 0.3 + 3.0 + 1.8 + 0.2),
        ("10.00", "5.00", 20000, 900, 3.0 + 3.0 + 1.8 + 1.0),
        ("150.00", "5.00", 1000, 100, 0.3 + 3.0 + 0.0 + 0.2),
    ],
)
def test_margin_capped(rows, price, rating, sales, reviews, expected):
    number = lambda text: None if text is None else Decimal(text)
    df = rows(OFFER, (number(price), number(rating), sales, reviews))
    assert margin_scores(df).first().margin_potential_score == pytest.approx(round(expected, 2), abs=1e-12)


def test_margin_linear_has_no_caps(rows):
    df = rows(OFFER, (Decimal("150.00"), Decimal("5.00"), 20000, 900))
    got = df.select(margin_linear().alias("s")).first().s
    assert got == pytest.approx(1.5 + 6.0 - 10.0 + 1.8)


@pytest.mark.parametrize(
    "price, original, expected",
    [("8.00", None, 0), ("8.00", "0.00", 0), ("8.00", "8.00", 0), ("8.00", "5.00", 0), ("8.00", "12.00", 33),
     ("0.00", "5.00", 100), ("0.01", "1.00", 99)],
)
def test_discount(rows, price, original, expected):
    df = rows(
        "price decimal(10,2), original_price decimal(10,2)",
        (Decimal(price), None if original is None else Decimal(original)),
    )
    assert df.select(discount_percent().alias("d")).first().d == expected


def test_high_margin_ranks_only_the_pool(rows):
    ddl = (
        "product_id string, title string, price decimal(10,2), original_price decimal(10,2), "
        "discount_percentage int, average_rating decimal(3,2), total_reviews int, total_sales int, "
        "seller_name string, category_name string, shipping_cost decimal(10,2), free_shipping int"
    )

    def offer(name, price, sales):
        return (name, name, Decimal(price), None, 0, Decimal("4.00"), 10, sales, "s", "c", None, 0)

    df = rows(ddl, offer("cheap", "1.00", 1), offer("mid", "50.00", 5), offer("best", "90.00", 9),
              offer("none", "1.00", 0))
    got = [r.product_id for r in high_margin(df, pool=2).collect()]
    assert got == ["mid", "best"]  # "cheap" scores highest but sells too little to enter the pool
