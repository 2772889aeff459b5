import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise.operators import summaries as V
from stallwise.streaming import views as S

PRICES = "product_id string, price decimal(10,2), scraped_at timestamp_ntz"


def batches(spark, tmp_path, count=4):
    """Price files in random time order, and all rows at once."""
    rng = random.Random(5)
    source = str(tmp_path / "in")
    everything = []
    for _ in range(count):
        values = [
            (f"p{rng.randrange(5)}", Decimal(rng.randrange(1, 10**6)).scaleb(-2),
             datetime(2000, 1, 1) + timedelta(hours=rng.randrange(24 * 20)))
            for _ in range(50)
        ]
        everything += values
        spark.createDataFrame(values, PRICES).coalesce(1).write.mode("append").parquet(source)
    return source, spark.createDataFrame(everything, PRICES)


def source_stream(spark, source):
    return spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(source)


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_view_equals_batch_over_many_batches(spark, tmp_path):
    source, everything = batches(spark, tmp_path)
    view, progress = str(tmp_path / "view"), str(tmp_path / "progress")
    S.maintain(source_stream(spark, source), V.DAILY_PRICES, view, progress).awaitTermination()
    assert table(S.read_view(spark, V.DAILY_PRICES, view)) == table(V.daily_price_changes(everything))

    # Very late rows arrive in a second run and count like any other.
    late = [("p0", Decimal("1.00"), datetime(1990, 1, 1)), ("p0", Decimal("3.00"), datetime(2000, 1, 2))]
    spark.createDataFrame(late, PRICES).coalesce(1).write.mode("append").parquet(source)
    S.compact(spark, V.DAILY_PRICES, view)
    S.maintain(source_stream(spark, source), V.DAILY_PRICES, view, progress).awaitTermination()
    expected = table(V.daily_price_changes(everything.union(spark.createDataFrame(late, PRICES))))
    assert table(S.read_view(spark, V.DAILY_PRICES, view)) == expected
    S.compact(spark, V.DAILY_PRICES, view)
    S.drop_covered(spark, view)
    assert table(S.read_view(spark, V.DAILY_PRICES, view)) == expected
    assert [n for n in S.list_folder(spark, view) if "=" in n] == ["upto=4"]


def test_repeated_batch_counts_once(spark, tmp_path):
    source, everything = batches(spark, tmp_path, 2)
    view = str(tmp_path / "view")
    for attempt in range(2):  # the second run has lost its progress and repeats every batch
        S.maintain(source_stream(spark, source), V.DAILY_PRICES, view, str(tmp_path / f"p{attempt}")).awaitTermination()
    assert table(S.read_view(spark, V.DAILY_PRICES, view)) == table(V.daily_price_changes(everything))


def run_windows(spark, frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_daily_windows_complete_equals_batch(spark, tmp_path):
    source, everything = batches(spark, tmp_path)
    frame = S.daily_windows(source_stream(spark, source), V.DAILY_PRICES)
    got = run_windows(spark, frame, "complete", "all_days")
    assert table(got) == table(V.daily_price_changes(everything))


def test_daily_windows_emit_closed_days_once(spark, tmp_path):
    source, everything = batches(spark, tmp_path)
    frame = S.daily_windows(source_stream(spark, source), V.DAILY_PRICES, delay="30 days")
    assert run_windows(spark, frame, "append", "no_days").count() == 0  # every day may still get rows
    end = [("p9", Decimal("1.00"), datetime(2000, 6, 1))]
    spark.createDataFrame(end, PRICES).coalesce(1).write.mode("append").parquet(source)
    frame = S.daily_windows(source_stream(spark, source), V.DAILY_PRICES, delay="30 days")
    assert table(run_windows(spark, frame, "append", "closed_days")) == table(V.daily_price_changes(everything))


@pytest.mark.parametrize("label, expected", [("positive", (1, 0, 0)), (None, (0, 0, 0)), ("odd", (0, 0, 0))])
def test_sentiment_counts_without_labels(rows, label, expected):
    df = rows("product_id string, sentiment_score double, sentiment_label string, scraped_at timestamp_ntz",
              ("p", None, label, datetime(2000, 1, 1)))
    row = V.sentiment_summary(df).first()
    assert (row.positive_reviews, row.negative_reviews, row.neutral_reviews) == expected
    assert (row.review_count, row.avg_sentiment) == (1, None)


def test_view_before_the_first_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    view = str(tmp_path / "view")
    S.maintain(source_stream(spark, str(tmp_path / "in")), V.DAILY_PRICES, view, str(tmp_path / "progress")).awaitTermination()
    empty = S.read_view(spark, V.DAILY_PRICES, view)
    assert empty.count() == 0 and empty.columns == ["product_id", "date", "avg_price", "min_price", "max_price", "price_points"]


def test_view_stays_short(spark, tmp_path):
    source, everything = batches(spark, tmp_path, 9)
    view = str(tmp_path / "view")
    S.maintain(source_stream(spark, source), V.DAILY_PRICES, view, str(tmp_path / "progress"), compact_every=2).awaitTermination()
    assert table(S.read_view(spark, V.DAILY_PRICES, view)) == table(V.daily_price_changes(everything))
    assert sorted(n for n in S.list_folder(spark, view) if "=" in n) == ["batch=6", "batch=7", "batch=8", "upto=5", "upto=7"]


def ordered_files(spark, tmp_path, *days):
    """A file for each list of days in January 2000, in the order given."""
    source = str(tmp_path / "in")
    for number, of_file in enumerate(days):
        rows = [("p", Decimal(number + 1), datetime(2000, 1, day, 5)) for day in of_file]
        spark.createDataFrame(rows, PRICES).coalesce(1).write.mode("append").parquet(source)
    return source


def test_closed_days_and_late_rows(spark, tmp_path):
    """A row is late once its day was closed: the mark is two days before the newest one of the files read by then."""
    source = ordered_files(spark, tmp_path, [1, 2, 2], [3, 4], [2, 6], [1, 8], [9, 3, 12])
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    query = S.close_days(source_stream(spark, source), V.DAILY_PRICES, path, progress)
    query.awaitTermination()
    got = {r.date.day: r.price_points for r in spark.read.parquet(path).collect()}
    assert got == {1: 1, 2: 3, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1}
    assert S.late_rows(spark, query, V.DAILY_PRICES, path, progress, "price_points") == 2
    assert S.open_days(spark, progress).count() == 1  # the 12th

    # A second run goes on where the first one ended: the state and the mark are kept.
    ordered_files(spark, tmp_path, [9, 12, 20], [31])
    S.close_days(source_stream(spark, source), V.DAILY_PRICES, path, progress).awaitTermination()
    got = {r.date.day: r.price_points for r in spark.read.parquet(path).collect()}
    assert got == {1: 1, 2: 3, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, 12: 2, 20: 1}


def test_changes_hold_the_last_state_of_every_key(spark, tmp_path):
    source, everything = batches(spark, tmp_path, 5)
    path, progress = str(tmp_path / "changes"), str(tmp_path / "progress")
    S.maintain_changes(source_stream(spark, source), V.DAILY_PRICES, path, progress).awaitTermination()
    assert table(S.read_changes(spark, V.DAILY_PRICES, path)) == table(V.daily_price_changes(everything))
    sizes = [spark.read.parquet(f"{path}/batch={i}").count() for i in range(5)]
    assert all(0 < n <= 50 for n in sizes)  # no batch stores more keys than it has changed
    late = [("p0", Decimal("7.00"), datetime(1990, 1, 1))]
    spark.createDataFrame(late, PRICES).coalesce(1).write.mode("append").parquet(source)
    S.maintain_changes(source_stream(spark, source), V.DAILY_PRICES, path, progress).awaitTermination()
    expected = table(V.daily_price_changes(everything.union(spark.createDataFrame(late, PRICES))))
    assert table(S.read_changes(spark, V.DAILY_PRICES, path)) == expected


def test_repeated_discoveries_count_once_within_the_delay(spark, tmp_path):
    kind = "product_id string, discovered_at timestamp_ntz"
    source = str(tmp_path / "in")
    at = lambda day, hour=0: datetime(2000, 1, day, hour)
    for rows in ([("a", at(1)), ("a", at(1, 3)), ("b", at(1))], [("a", at(1, 9)), ("c", at(1, 5))], [("x", at(5))], [("x", at(5, 1)), ("b", at(5))], [("a", at(5, 2))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    got = run_windows(spark, S.unique_discoveries(stream), "append", "unique")
    # The second b arrives while its state is still held; the last a does not.
    assert sorted((r.product_id, r.discovered_at.day) for r in got.collect()) == [("a", 1), ("a", 5), ("b", 1), ("c", 1), ("x", 5)]


def test_large_parts_arrive_in_several_files(spark, monkeypatch):
    """The same micro-batches, but no task writes or reads a whole part."""
    from checks import streams
    from tests.conftest import SMALL

    queries = (streams.late_rows, streams.sales_changes, streams.unique_pending)
    expected = [sorted(map(str, query(spark, SMALL).collect())) for query in queries]
    monkeypatch.setattr(streams, "ROWS_A_FILE", 400)
    paths = []
    monkeypatch.setattr(streams, "scratch_dir", lambda s, purpose, old=streams.scratch_dir: paths.append(old(s, purpose)) or paths[-1])
    for query, rows in zip(queries, expected, strict=True):
        paths.clear()
        assert sorted(map(str, query(spark, SMALL).collect())) == rows
        [arrived] = [path for path in paths if "/arriving-" in path]
        sizes = [row.n for row in spark.read.parquet(arrived).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4
