"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``u, root`` for each node that has a smaller node in its component.

    ``links`` has long columns ``u`` and ``v``. Each round is written to the
    shared folder; the minimum of a node is combined before it is shuffled and
    the joins back are plain ones, which adaptive execution splits at a node
    with very many links. Rounds grow with the logarithm of the longest path.
    """
    ordered = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = saved(ordered.distinct(), "links"), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return now.select("u", F.col("v").alias("root"))
        seen = sign
        now = saved(_small_star(_large_star(now)), "stars")
