"""What several operators share: saved tables, words as hashes, bounded label samples."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.session import scratch_dir

#: White space that parts words: what ``bytes.split()`` splits at.
WHITE = " \t\n\x0b\x0c\r"
#: Words a worker remembers the hash of, and their most bytes; others are hashed again.
REMEMBERED, SHORT = 400_000, 64


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words; short words are remembered up to a number, so memory is bounded in bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 0)
        if len(word) <= SHORT and len(self) < REMEMBERED:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the positions in an n-gram.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def gram_buckets(hashes: np.ndarray, offsets: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of the n-grams that take the words at ``offsets`` (0, 1: bigram; 0, 2: skip-gram)."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = np.full(n, np.uint64(1 + 2 * sum(3**o for o in offsets)), np.uint64)
    for place, offset in enumerate(offsets):
        mixed += hashes[offset : offset + n] * MIX[place]
        mixed ^= mixed >> np.uint64(29)
    mixed *= MIX[3]
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def label_of_ids(labels: DataFrame, column: str) -> DataFrame:
    """``_label_id, _label`` of every labelled id.

    Rows without id or label are left out; an id that is labelled more than
    once takes its largest label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(column).cast("int").alias("_label"))


def label_sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids with one label each, chosen by hash; small enough to broadcast."""
    return label_of_ids(labels, column).orderBy(F.xxhash64(F.col("_label_id").cast("string")), "_label_id").limit(most)


def with_labels(docs: DataFrame, sample: DataFrame, how: str, bounded: bool = True) -> DataFrame:
    """``docs`` joined with labels, which are broadcast if they are a bounded sample."""
    return docs.join(F.broadcast(sample) if bounded else sample, docs["doc_id"] == sample["_label_id"], how).drop("_label_id")


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, _label``: one text for each id of a bounded label sample, whatever the number of its rows.

    Of several texts of an id the one with the least hash is taken; rows are
    reduced to it before they are shuffled.
    """
    rows = with_labels(docs.select("doc_id", "text"), sample, "inner")
    least = F.min(F.struct(F.xxhash64("text").alias("_hash"), "text")).alias("_least")
    return rows.groupBy("doc_id", "_label").agg(least).select("doc_id", "_least.text", "_label")


def column_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


#: Rows numbered together.
RANKED = 256


def numbered(df: DataFrame, group: list[str], sizes: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the rows of each group numbered from 0, in an order that ``order`` alone decides.

    ``sizes`` has the columns of ``group``, without nulls, and each group's
    number of rows ``n``. Rows go by their hash into ranges of about ``RANKED``
    rows, so that no task sees a whole large group; a range starts where the
    ranges before it end. Equal rows are counted first and go into ranges by
    ``RANKED`` of them, so one row may be repeated any number of times.
    """
    ranges = sizes.select(*group, F.ceil(F.col("n") / RANKED).alias("_ranges"))
    equal = df.join(ranges, group).groupBy(*df.columns, "_ranges").agg(F.count("*").alias("_n"))
    dealt = equal.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(RANKED))))
    dealt = dealt.withColumn("_n", F.least(F.col("_n") - F.col("_copy"), F.lit(RANKED)))
    dealt = dealt.withColumn("_hash", F.xxhash64(*(F.col(c).cast("string") for c in order), "_copy"))
    dealt = dealt.withColumn("_range", F.pmod("_hash", "_ranges")).drop("_ranges")
    starts = dealt.groupBy(*group, "_range").agg(F.sum("_n").alias("_sum"))
    ahead = Window.unboundedPreceding, -1
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(*ahead)
    starts = starts.select(*group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_range").orderBy("_hash", *order, "_copy").rowsBetween(*ahead)
    rows = dealt.repartition(*group, "_range").withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    rows = rows.join(starts, [*group, "_range"])
    copies = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_nth")
    rows = rows.select(*df.columns, "_before", "_first", copies)
    return rows.select(*df.columns, (F.col("_before") + F.col("_first") + F.col("_nth")).alias(name))
