"""Summaries kept up to date from streams.

``maintain`` stores the partial sums of every micro-batch and ``read_view`` adds
them up: there is no state to hold, no watermark, and a late row counts like any
other. Three stateful forms serve other consumers. ``close_days`` emits each day
once, when the watermark says that it is complete. ``maintain_changes`` keeps the
running summary of every key and stores those that a micro-batch has changed.
``unique_discoveries`` lets repeated events through once. Their state is held by
the state store of the session, RocksDB by this library's settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwise.operators.summaries import Summary
from stallwise.sources.tables import delete_folder, list_folder


def maintain(
    rows: DataFrame,
    summary: Summary,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "1 minute",
    compact_every: int = 60,
) -> StreamingQuery:
    """Start keeping ``summary`` of a stream under ``path``.

    A micro-batch that is repeated after a failure overwrites its own folder,
    so every input row counts exactly once. After ``compact_every`` batches
    the stored parts are added up, and what the compaction before covered is
    removed, so a read lists and adds up a bounded number of folders. The view
    starts as an empty one, so it can be read at any time.
    """
    spark = rows.sparkSession
    if not _compactions(spark, path):
        summary.partial(spark.createDataFrame([], rows.schema)).write.mode("overwrite").parquet(f"{path}/upto=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        summary.partial(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            before = max(_compactions(own, path))
            compact(own, summary, path)
            drop_covered(own, path, before)

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    return [
        int(name.split("=", 1)[1])
        for name in list_folder(spark, path)
        if name.startswith(f"{kind}=") and "_SUCCESS" in list_folder(spark, f"{path}/{name}")
    ]


def _compactions(spark: SparkSession, path: str) -> list[int]:
    return _complete(spark, path, "upto")


def _stored(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """Last compacted batch (-1: none yet) and the complete batches after it."""
    upto = max(_compactions(spark, path), default=-1)
    return upto, sorted(i for i in _complete(spark, path, "batch") if i > upto)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    upto, batches = _stored(spark, path)
    return spark.read.parquet(f"{path}/upto={upto}", *(f"{path}/batch={i}" for i in batches))


def read_view(spark: SparkSession, summary: Summary, path: str) -> DataFrame:
    """The summary of everything stored so far."""
    return summary.merged(_parts(spark, path))


def compact(spark: SparkSession, summary: Summary, path: str) -> None:
    """Add up the stored batches in one new folder, to keep reads short.

    Readers switch to it when its write has finished and ignore the batches
    it covers; ``drop_covered`` removes those later.
    """
    _, batches = _stored(spark, path)
    if batches:
        summary.combine(_parts(spark, path)).write.mode("overwrite").parquet(f"{path}/upto={batches[-1]}")


def drop_covered(spark: SparkSession, path: str, upto: int | None = None) -> None:
    """Delete batches and older compactions that the newest compaction, or the one ``upto``, covers."""
    if upto is None:
        upto, _ = _stored(spark, path)
    for name in list_folder(spark, path):
        kind, _, number = name.partition("=")
        if (kind == "batch" and int(number) <= upto) or (kind == "upto" and int(number) < upto):
            delete_folder(spark, f"{path}/{name}")


def daily_windows(rows: DataFrame, summary: Summary, column: str = "scraped_at", delay: str = "2 days") -> DataFrame:
    """Daily summary of a stream as a stateful aggregate with a watermark.

    In append mode a day is emitted once the stream has moved ``delay`` past
    it and its state is dropped. The day itself is the event time, so the
    result does not depend on the session's time zone. The delay must cover
    the lateness of the source: later rows are no longer counted.
    """
    day = F.col(column).cast("date").cast("timestamp")
    timed = rows.withColumn("_day", day).withWatermark("_day", delay)
    keys = [F.expr(e).alias(n) for n, e in summary.keys.items() if n != "date"]
    parts = timed.groupBy(*keys, "_day").agg(*(F.expr(e).alias(n) for n, (e, _) in summary.parts.items()))
    return summary.finished(parts.withColumn("date", F.col("_day").cast("date")))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state_store(spark: SparkSession) -> None:
    """State on local disks instead of the heap; streams that have begun keep the store that they have."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def close_days(
    rows: DataFrame, summary: Summary, path: str, checkpoint: str, column: str = "scraped_at", delay: str = "2 days"
) -> StreamingQuery:
    """Start appending the summary of every day that is complete to ``path``; ends when all that is there was read."""
    _with_state_store(rows.sparkSession)
    writer = daily_windows(rows, summary, column, delay).writeStream.outputMode("append").format("parquet")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Keys and sums of the days that are not complete yet, read from the state of ``close_days``."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", "value.*")


def late_rows(spark: SparkSession, query: StreamingQuery, summary: Summary, path: str, checkpoint: str, count: str) -> int:
    """How many rows of an ended ``close_days`` came after their day was closed.

    They are what was read, but is neither in a closed day nor in an open one.
    ``count`` names the part of the summary that counts rows. Spark remembers
    what the last ``spark.sql.streaming.numRecentProgressUpdates`` batches read.
    """
    read = sum(progress.numInputRows for progress in query.recentProgress)
    closed = spark.read.parquet(path).agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    # The state has the buffers of the aggregates in their order, under names that repeat; those of counts are named so.
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    counts = [at for at, name in enumerate(held.columns) if name.startswith("count")]
    parts = [part for part, (rows, _) in summary.parts.items() if rows.startswith("count(")]
    held = held.toDF(*(f"_{at}" for at in range(len(held.columns))))
    open_ = held.agg(F.coalesce(F.sum(f"_{counts[parts.index(count)]}"), F.lit(0))).first()[0]
    return read - closed - open_


def maintain_changes(rows: DataFrame, summary: Summary, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a running summary in state and store, for each micro-batch, the keys that it has changed."""
    _with_state_store(rows.sparkSession)
    if summary.where:
        rows = rows.where(summary.where)
    keys = [F.expr(e).alias(name) for name, e in summary.keys.items()]
    running = summary.finished(rows.groupBy(*keys).agg(*(F.expr(e).alias(n) for n, (e, _) in summary.parts.items())))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = running.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_changes(spark: SparkSession, summary: Summary, path: str) -> DataFrame:
    """The latest stored row of every key."""
    batches = _complete(spark, path, "batch")
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/batch={i}" for i in batches))
    latest = F.max_by(F.struct(*summary.finish), "batch").alias("_row")
    return rows.groupBy(*summary.keys).agg(latest).select(*summary.keys, "_row.*")


def unique_discoveries(
    rows: DataFrame, keys: Sequence[str] = ("product_id",), column: str = "discovered_at", delay: str = "1 day"
) -> DataFrame:
    """A stream of discoveries without those that repeat one of the same keys within ``delay``.

    Only keys that may still be repeated are held.
    """
    _with_state_store(rows.sparkSession)
    timed = rows.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([*keys]).drop("_at")
