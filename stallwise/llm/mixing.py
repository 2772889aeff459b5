"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget of words. Whole passes over a source come first; what
is left of its budget is a bounded subset-sum over its documents. Documents are
counted by exact length, most of the remaining budget is shared over the lengths
in proportion, a bounded-knapsack dynamic program fits the rest, and a seeded
order picks that many documents of each length.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import column_name, numbered, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: A source, and so a document, is taken this many times at most.
MOST_TIMES = 2
SEED = 11
#: Words of a budget that the dynamic program fits, or twice the longest document if that is more.
FITTED = 1 << 16
#: Copies of one row that a task makes.
REPEATED = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """``sources`` (``source, source_size``, one row each) with its ``target``.

    Sources in code point order, null last, take the weights in turn. With the
    sources in order of the level at which they are full, the level of the
    others is what is left over by their weights; the right one is the first
    whose source is not full at it, and the highest such. The windows see one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("_full", F.col("source_size") * most).withColumn("_level", F.col("_full") / F.col("_w"))
    rising = Window.orderBy("_level", F.col("source").asc_nulls_last())
    table = table.select(
        "*",
        (F.sum("source_size").over(every) * share).alias("_budget"),
        F.coalesce(F.sum("_full").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
        F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_above"),
    )
    table = table.withColumn("_try", (F.col("_budget") - F.col("_below")) / F.col("_above"))
    table = table.withColumn("_shared", F.max(F.when(F.col("_try") <= F.col("_level"), F.col("_try"))).over(every))
    target = F.least(F.col("_full").cast("double"), F.col("_w") * F.coalesce("_shared", F.col("_level")))
    return table.select("source", "source_size", target.alias("target"))


def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size, at most ``counts``, add up to the largest sum within ``budget``.

    The sums within reach are the bits of one number. Counts are split into
    powers of two, and the number before each part tells on the way back
    whether the part was used. Ends early once the whole budget is in reach.
    """
    reach, mask, parts = 1, (1 << (budget + 1)) - 1, []
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        left = min(counts[at], budget // size) if size else 0
        times = 1
        while left and not reach >> budget:
            times = min(times, left)
            parts.append((at, times, reach))
            reach |= (reach << (size * times)) & mask
            left -= times
            times *= 2
    used, total = [0] * len(sizes), reach.bit_length() - 1
    for at, times, before in reversed(parts):
        if not before >> total & 1:
            used[at] += times
            total -= times * sizes[at]
    return used


def fit(sizes: list[int], counts: list[int], target: float, most: int = MOST_TIMES) -> tuple[int, list[int]]:
    """Whole passes over a source, and how many documents of each length come once more."""
    volume = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if not volume:
        return 0, [0] * len(sizes)
    passes = min(most, floor(target / volume))
    if passes == most:
        return passes, [0] * len(sizes)
    budget = floor(target - passes * volume + 1e-6)
    share = budget / volume
    extra = [min(n, floor(n * share)) if s else 0 for s, n in zip(sizes, counts, strict=True)]
    left = budget - sum(s * n for s, n in zip(sizes, extra, strict=True))
    fitted = max(FITTED, 2 * max(sizes))
    # One more of the lengths that rounding down took most of, then of the longest, down to what the program fits.
    for at in sorted(range(len(sizes)), key=lambda i: (extra[i] - counts[i] * share, -sizes[i])):
        if left - sizes[at] >= fitted // 2 and extra[at] < counts[at]:
            extra[at] += 1
            left -= sizes[at]
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if left > fitted and sizes[at]:
            more = min(counts[at] - extra[at], (left - fitted // 2) // sizes[at])
            extra[at] += more
            left -= more * sizes[at]
    while left < 0:  # rounding of the shares
        at = max((i for i in range(len(sizes)) if extra[i]), key=lambda i: sizes[i])
        extra[at] -= 1
        left += sizes[at]
    more = knapsack(sizes, [n - x for n, x in zip(counts, extra, strict=True)], min(left, volume))
    return passes, [x + y for x, y in zip(extra, more, strict=True)]


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows ``doc_id, source, size, row, source_size, target, copies``: how often each row is taken.

    One row per row of ``docs``. A null text has size 0. ``row`` is a hash of
    all columns; equal rows are interchangeable, so reruns agree on the rows
    taken. Only lengths and hashes are kept from the texts.
    """
    row = F.xxhash64(*docs.columns)
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row.alias("row"),
    )
    # A source as a key that is never null.
    sized = saved(sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sized")
    lengths = saved(sized.groupBy("_key", "source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = saved(targets(sources, **options), "targets")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        passes, extra = fit(rows["size"].tolist(), rows["n"].tolist(), float(rows["target"].iloc[0]), options.get("most", MOST_TIMES))
        return rows.assign(passes=passes, extra=np.array(extra, np.int64))

    aimed = lengths.join(aims, lengths["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    schema = "_key string, size long, n long, source_size long, target double, passes int, extra long"
    columns = [c.split()[0] for c in schema.split(", ")]
    planned = saved(
        aimed.select(*columns[:5]).groupBy("_key").applyInPandas(lambda rows: plan(rows)[columns], schema), "plan"
    )
    named = [c for c in ("source_size", "target") if c in planned.columns]
    chosen = sized.join(planned, ["_key", "size"])
    whole = chosen.filter("extra = 0 OR extra = n").withColumn("copies", F.col("passes") + (F.col("extra") > 0).cast("int"))
    partly = planned.filter("extra > 0 AND extra < n")
    seeded = sized.withColumn("_seed", F.lit(SEED))
    ranked = numbered(seeded, ["_key", "size"], partly, ["_seed", "doc_id", "row"]).join(partly, ["_key", "size"])
    ranked = ranked.withColumn("copies", F.col("passes") + (F.col("rank") < F.col("extra")).cast("int"))
    columns = ["doc_id", "source", "size", "row", *named, "copies"]
    return whole.select(*columns).unionAll(ranked.select(*columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged.

    Equal rows share what they are taken: one of them is repeated for all, in
    parts of ``REPEATED`` that are dealt out, as it may be a large share of all.
    """
    row, copies, part = (column_name(docs, name) for name in ("_row", "_copies", "_part"))
    taken = mix(docs, **options).groupBy(F.col("row").alias(row), F.col("doc_id").alias("_id"))
    taken = saved(taken.agg(F.sum("copies").alias(copies), F.count("*").alias("_rows")).filter(F.col(copies) > 0), "taken")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))

    def repeated(of: str, once: bool) -> DataFrame:
        some = taken.filter(of)
        found = marked.join(some, (marked[row] == some[row]) & marked["doc_id"].eqNullSafe(some["_id"])).drop(some[row], "_id", "_rows")
        if once:
            parts = F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(REPEATED)))
            found = found.dropDuplicates(["doc_id", row]).withColumn(part, parts)
            found = found.withColumn(copies, F.least(F.col(copies) - F.col(part), F.lit(REPEATED))).repartition(row, part)
        return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)

    found = repeated("_rows = 1", False)
    return found if taken.filter("_rows > 1").isEmpty() else found.unionAll(repeated("_rows > 1", True))


def report(docs: DataFrame) -> DataFrame:
    """The registered form: words taken of each row of ``docs``."""
    found = mix(docs.select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
