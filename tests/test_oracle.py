"""Every registered query against its SQL on the smallest data."""

import pytest

from checks.compare import connect, differences
from checks.oracles import ORACLES
from checks.registry import QUERIES
from tests.conftest import SMALL

# Nothing is that new in the smallest data.
MAY_BE_EMPTY = {"new_arrivals", "trend_rows", "trending_by_score", "trending_products", "trending_recent",
                "hot_category_work", "price_trends"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    problem, count = differences(spark, duck, SMALL, name)
    assert problem is None, problem
    assert count > 0 or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
