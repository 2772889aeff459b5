import random
from datetime import datetime

from stallwise.operators import sketches as K

KIND = "category_name string, price decimal(10,2), seller_id string, scraped_at timestamp_ntz"


def rows_of(spark, count=20_000, days=30):
    dice = random.Random(3)
    values = [
        (dice.choice("abc"), dice.randint(1, 10**6) / 100, f"s{dice.randint(0, 900)}", datetime(2000, 1, 1 + dice.randrange(days), dice.randrange(24)))
        for _ in range(count)
    ]
    return values, spark.createDataFrame(values, "category_name string, price double, seller_id string, scraped_at timestamp_ntz")


def test_merged_sketches_stay_within_their_bounds(spark, tmp_path):
    values, rows = rows_of(spark)
    path = str(tmp_path / "sketches")
    for part in (rows.where("scraped_at < '2000-01-15'"), rows.where("scraped_at >= '2000-01-15'")):
        K.daily_sketches(part).write.mode("append").parquet(path)
    cuts = (0.1, 0.5, 0.9, 0.99)
    found = {r.category_name: r for r in K.estimates(K.merged_sketches(spark.read.parquet(path)), cuts).collect()}
    for name in "abc":
        prices = sorted(v[1] for v in values if v[0] == name)
        sellers = len({v[2] for v in values if v[0] == name})
        assert found[name].rows == len(prices)
        assert abs(found[name].kinds - sellers) <= K.COUNT_ERROR * sellers
        for cut, estimate in zip(cuts, found[name].quantiles, strict=True):
            assert abs(sum(p <= estimate for p in prices) / len(prices) - cut) <= K.RANK_ERROR


def test_a_span_of_days_is_merged_from_its_days_only(spark):
    values, rows = rows_of(spark, 3000)
    stored = K.daily_sketches(rows)
    some = K.estimates(K.merged_sketches(stored.where("day BETWEEN '2000-01-05' AND '2000-01-09'")), (0.5,))
    assert {r.category_name: r.rows for r in some.collect()} == {
        name: sum(v[0] == name and 5 <= v[3].day <= 9 for v in values) for name in "abc"}


def test_nulls_and_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert K.estimates(K.merged_sketches(K.daily_sketches(empty)), (0.5,)).collect() == []
    rows = spark.createDataFrame([("a", None, None, datetime(2000, 1, 1)), (None, None, "s", None)], KIND)
    got = {r.category_name: (r.rows, r.kinds) for r in K.merged_sketches(K.daily_sketches(rows)).selectExpr("category_name", "rows", "hll_sketch_estimate(kinds) AS kinds").collect()}
    assert got == {"a": (1, 0), None: (1, 1)}
