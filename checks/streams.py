"""Registered queries over streams of several files: the given rows arrive in parts, one a micro-batch, some of them late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators import summaries as V
from stallwise.session import scratch_dir
from stallwise.sources import fixtures as X
from stallwise.sources.files import copy_file, list_folder, new_run
from stallwise.streaming import views as W

FILES = 7
DELAY = 60
"""Days."""


ROWS_A_FILE = 1_000_000
"""A larger part arrives as several files, which belong to one micro-batch."""


def _arriving(rows: DataFrame, file: Column, files: int = FILES) -> DataFrame:
    """``rows`` as a stream that brings them in parts of the given numbers, one in each micro-batch.

    A micro-batch takes a fixed number of files, so every part has as many as
    the largest one needs; what it lacks are files without rows.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "arriving")
    dealt = rows.withColumn("_file", file).persist()
    most = max((row["count"] for row in dealt.groupBy("_file").count().collect()), default=0)
    each = most // ROWS_A_FILE + 1
    empty = scratch_dir(spark, "empty")
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(empty)
    [name] = _data(spark, empty)
    for number in range(files):
        dealt.where(F.col("_file") == number).drop("_file").coalesce(each).write.mode("append").parquet(path)
        for _ in range((number + 1) * each - len(_data(spark, path))):
            copy_file(spark, f"{empty}/{name}", f"{path}/part-{new_run()}.parquet")
    dealt.unpersist()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _data(spark: SparkSession, path: str) -> list[str]:
    return [name for name in list_folder(spark, path) if name.startswith("part-")]


def _year(column: str) -> Column:
    """The file of a row's year: 1995 and before is 0, 2001 and later the last."""
    return F.least(F.greatest(F.year(column) - 1995, F.lit(0)), F.lit(FILES - 1))


def _days(spark: SparkSession, sf: str) -> tuple:
    """Closed days of the price history, in files by year; products divisible by 10 arrive a file late, by 7 two files."""
    rows = X.price_history(spark, sf)
    key = F.col("product_id").cast("long")
    late = F.when(key % 10 == 0, 1).when(key % 7 == 0, 2).otherwise(0)
    stream = _arriving(rows, F.least(_year("scraped_at") + late, F.lit(FILES - 1)))
    path, checkpoint = scratch_dir(spark, "days"), scratch_dir(spark, "days-progress")
    query = W.close_days(stream, V.DAILY_PRICES, path, checkpoint, delay=f"{DELAY} days")
    query.awaitTermination()
    return query, path, checkpoint


def daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    _, path, _ = _days(spark, sf)
    return spark.read.parquet(path)


def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows came after their day had been closed, and how many days are open at the end."""
    query, path, checkpoint = _days(spark, sf)
    late = W.late_rows(spark, query, V.DAILY_PRICES, path, checkpoint, "price_points")
    return W.open_days(spark, checkpoint).agg(F.lit(late).cast("long").alias("late_rows"), F.count("*").alias("open_keys"))


def sentiment_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Closed days of the review sentiment; files of six days."""
    rows = X.reviews(spark, sf).select("product_id", "sentiment_score", "sentiment_label", "scraped_at")
    stream = _arriving(rows, F.floor((F.dayofmonth("scraped_at") - 1) / 6).cast("int"), 5)
    path, checkpoint = scratch_dir(spark, "days"), scratch_dir(spark, "days-progress")
    W.close_days(stream, V.SENTIMENT, path, checkpoint, delay="3 days").awaitTermination()
    return spark.read.parquet(path)


def sales_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The last stored state of every key of the running sales summary."""
    rows = X.products(spark, sf).select("category_id", "seller_id", "total_sales", "average_rating", "scraped_at")
    stream = _arriving(rows, _year("scraped_at"))
    path, checkpoint = scratch_dir(spark, "changes"), scratch_dir(spark, "changes-progress")
    W.maintain_changes(stream, V.SALES, path, checkpoint).awaitTermination()
    return W.read_changes(spark, V.SALES, path)


def unique_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Pending work by discoveries, those of one period counted once for each product.

    Each observation of a product is a discovery at the beginning of its period
    (before 1998 and since), in one of two files. Two files with a later event of no product follow
    each period, as time goes on in a stream.
    """
    master = X.master_products(spark, sf)
    period = (F.year("l_shipdate") >= 1998).cast("int")
    seen = X.spread(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("_key"), period.alias("_period"), (F.col("l_linenumber") % 2).alias("_half")
    )
    found = seen.join(master, F.col("_key") == F.col("product_id")).drop("_key")
    begins = F.make_dt_interval(F.col("_period") * 1000)
    found = found.withColumn("discovered_at", F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'") + begins)
    found = found.withColumn("_file", 4 * F.col("_period") + F.col("_half")).drop("_period", "_half")
    time = found.select("discovered_at", "_file").distinct().where(F.col("_file") % 4 == 0)
    ticks = [
        time.select(
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in master.schema if f.name != "discovered_at"),
            (F.col("discovered_at") + F.make_dt_interval(F.lit(10 * n))).alias("discovered_at"),
            (F.col("_file") + 1 + n).alias("_file"),
        )
        for n in (1, 2)
    ]
    rows = found.unionByName(ticks[0]).unionByName(ticks[1]).withColumnRenamed("_file", "_n")
    stream = _arriving(rows, F.col("_n"), 8)
    path, checkpoint = scratch_dir(spark, "view"), scratch_dir(spark, "view-progress")
    W.maintain(W.unique_discoveries(stream.drop("_n")), V.PENDING_WORK, path, checkpoint).awaitTermination()
    return W.read_view(spark, V.PENDING_WORK, path)
