from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stallwise.operators import worklist as L
from stallwise.sources.schemas import MASTER_PRODUCTS
from tests.conftest import NOW

OLD = NOW - timedelta(days=10)


def work(product="p", url="u", category="c", discovered=OLD, scraped=None, status="pending", priority=5, errors=0, active=1):
    return (product, url, category, category.upper(), discovered, scraped, status, priority, errors, active)


def master(spark, *values):
    return spark.createDataFrame(list(values), MASTER_PRODUCTS.schema)


def by_id(df):
    return {r.product_id: r for r in df.collect()}


FOUND = "product_id string, product_url string, category_id string, category_name string"


def test_merge_adds_and_refreshes(spark, rows):
    old = master(
        spark,
        work("known", status="failed", priority=9, errors=4, active=0, scraped=OLD),
        work("blank"),
        work("other"),
    )
    found = rows(FOUND, ("known", "new-url", "d", "D"), ("blank", "u2", "", ""), ("fresh", "f1", "", ""), ("fresh", "f0", "e", "E"))
    got = by_id(L.merge_discovered(old, found, NOW))
    assert set(got) == {"known", "blank", "other", "fresh"}
    known = got["known"]
    assert (known.product_url, known.category_id, known.category_name, known.discovered_at) == ("new-url", "d", "D", NOW)
    assert (known.scrape_status, known.scrape_priority, known.error_count, known.last_scraped_at, known.is_active) == (
        "failed", 9, 4, OLD, 1)
    assert (got["blank"].category_id, got["blank"].product_url) == ("c", "u2")
    assert got["other"] == L.merge_discovered(old, found, NOW).where("product_id = 'other'").first()
    assert got["other"].discovered_at == OLD
    fresh = got["fresh"]  # the link with a category is preferred
    assert (fresh.product_url, fresh.category_id) == ("f0", "e")
    assert (fresh.scrape_status, fresh.scrape_priority, fresh.error_count, fresh.is_active, fresh.last_scraped_at) == (
        "pending", 5, 0, 1, None)


ids = st.sampled_from(["a", "b", "c", "d"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ids, unique=True), st.lists(st.tuples(ids, st.sampled_from(["", "x"])), max_size=8))
def test_merge_is_idempotent(spark, known, links):
    old = master(spark, *(work(k) for k in known))
    found = spark.createDataFrame([(i, f"u-{i}", c, c) for i, c in links], FOUND)
    once = L.merge_discovered(old, found, NOW)
    twice = L.merge_discovered(once, found, NOW)
    assert by_id(once) == by_id(twice)
    assert once.count() == len(set(known) | {i for i, _ in links})


def test_fetch_results(spark, rows):
    old = master(spark, work("a", errors=1), work("b", scraped=OLD), work("c"))
    at = [NOW + timedelta(minutes=m) for m in range(4)]
    results = rows(
        "product_id string, status string, fetched_at timestamp_ntz",
        ("a", "failed", at[0]), ("a", "failed", at[2]), ("a", "scraped", at[1]),
        ("b", "scraped", at[3]), ("x", "failed", at[0]),
    )
    got = by_id(L.apply_fetch_results(old, results))
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].scrape_status, got["a"].error_count, got["a"].last_scraped_at) == ("failed", 3, at[1])
    assert (got["b"].scrape_status, got["b"].error_count, got["b"].last_scraped_at) == ("scraped", 0, at[3])
    assert (got["c"].scrape_status, got["c"].error_count, got["c"].last_scraped_at) == ("pending", 0, None)


def test_upkeep(spark):
    stale, fresh = NOW - timedelta(days=31), NOW - timedelta(days=30)
    old = master(
        spark,
        work("stale", discovered=stale), work("fresh", discovered=fresh), work("done", discovered=stale, status="scraped"),
        work("bad", status="failed", errors=5), work("poor", status="failed", errors=4), work("many", errors=9),
    )
    new = L.skip_failed(L.mark_inactive(old, NOW))
    got = by_id(new)
    assert {k for k, r in got.items() if r.is_active == 0} == {"stale"}
    assert {k for k, r in got.items() if r.scrape_status == "skipped"} == {"bad"}
    counts = L.maintenance_counts(old, new, NOW).first()
    assert (counts.marked_inactive, counts.marked_skipped, counts.priority_changed, counts.scraped_last_hour) == (1, 1, 0, 0)


SEEN = "category_id string, scraped_at timestamp_ntz"


def test_priorities_step_by_step(spark, rows):
    products = rows(SEEN, *([("hot", OLD + timedelta(days=9))] * 3), *([("cold", OLD)] * 9))
    old = master(
        spark,
        work("plain", category="cold"),
        work("hot", category="hot"),
        work("capped", category="hot", priority=9),
        work("errors", category="cold", errors=3),
        work("floor", category="cold", errors=5, priority=1),
        work("both", category="hot", errors=3, priority=10),
        work("new", category="cold", discovered=NOW - timedelta(days=1), priority=2),
        work("newhigh", category="hot", discovered=NOW, priority=9),
        work("done", category="hot", status="scraped"),
    )
    got = {k: r.scrape_priority for k, r in by_id(L.calculate_priorities(old, products, NOW, min_count=2)).items()}
    assert got == {"plain": 5, "hot": 7, "capped": 10, "errors": 4, "floor": 1, "both": 9, "new": 8, "newhigh": 10, "done": 5}
    measured = L.hot_categories(products, NOW, min_count=2)
    again = L.calculate_priorities(old, products, NOW, min_count=2, hot=measured)
    assert {k: r.scrape_priority for k, r in by_id(again).items()} == got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 9), st.integers(0, 3), st.booleans()), min_size=1, max_size=12))
def test_priorities_stay_in_range(spark, items):
    old = master(spark, *(
        work(str(i), category="hot" if hot else "cold", priority=p, errors=e, discovered=NOW - timedelta(days=d))
        for i, (p, e, d, hot) in enumerate(items)))
    products = spark.createDataFrame([("hot", NOW)] * 2, SEEN)
    out = L.boost_category(L.calculate_priorities(old, products, NOW, min_count=1), "hot", 3)
    assert all(1 <= r.scrape_priority <= 10 for r in out.collect())
    assert out.count() == len(items)


def test_boost_and_selection(spark):
    old = master(spark, work("a", priority=9), work("b", active=0), work("c", category="x"), work("d", priority=8, discovered=OLD - timedelta(days=1)))
    boosted = L.boost_category(old, "c")
    assert {k: r.scrape_priority for k, r in by_id(boosted).items()} == {"a": 10, "b": 5, "c": 5, "d": 10}
    assert [r.product_id for r in L.select_work(boosted).collect()] == ["d", "a", "c"]
    assert [r.product_id for r in L.high_priority_work(boosted, limit=1).collect()] == ["d"]


def test_updates_reach_every_row_of_a_key(rows):
    base = rows("k string, a int, b string", ("x", 1, "p"), ("x", 2, "q"), ("y", 3, "r"), (None, 4, "s"))
    changes = rows("k string, b string", ("x", "m"), ("x", "n"), (None, "z"))
    got = sorted(((r.k, r.a, r.b) for r in L.apply_updates(base, changes, "k").collect()), key=lambda r: r[1])
    assert got == [("x", 1, "n"), ("x", 2, "n"), ("y", 3, "r"), (None, 4, "s")]
    cleared = L.apply_updates(base, rows("k string, b string", ("y", None)), "k")
    assert {(r.a, r.b) for r in cleared.collect()} == {(1, "p"), (2, "q"), (3, None), (4, "s")}


def test_time_of_day_counts(spark):
    late = datetime(1999, 12, 2, 0, 0, 1)  # one second inside the 30 days
    assert L.mark_inactive(master(spark, work(discovered=late)), NOW).first().is_active == 1
