"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, so two small codebooks make
many cells. A query walks the pairs of centroids by summed distance with a heap
until it has met enough vectors, and only those are compared exactly.

Equal vectors are merged first, down to the smallest ids that a query can ask
for, which loses nothing. Every vector is in the index; the codebooks and the
number of vectors to meet are fitted on bounded samples.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import saved

NEAREST = 10
#: Centroids of each half: half the square root of the number of vectors, between these.
LEAST_CENTROIDS, MOST_CENTROIDS = 64, 256
#: Vectors that the codebooks are fitted on at most, and rounds of fitting.
FITTED = 20_000
ROUNDS = 12
#: Queries compared with all vectors to set the number of vectors to meet, and the share of their neighbours to meet.
MEASURED = 64
RECALL = 0.97
#: Vectors that one task compares at once.
SHARD = 20_000
#: Queries that one task compares them with, by their hash.
ASKED = 20_000
#: Routed queries handed over at once.
ROUTED = 2_000


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the two halves, and how many vectors each pair of them holds."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        i = _gaps(vectors[:, :cut], self.first).argmin(axis=1)
        j = _gaps(vectors[:, cut:], self.second).argmin(axis=1)
        return i * len(self.second) + j

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells that hold vectors, by the summed distance of their two centroids."""
        cut = self.first.shape[1]
        a = _gaps(query[None, :cut], self.first)[0]
        b = _gaps(query[None, cut:], self.second)[0]
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, pushed = [(a[rows[0]] + b[columns[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            if self.counts[rows[i], columns[j]]:
                yield int(rows[i]) * len(columns) + int(columns[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(rows) and y < len(columns) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (a[rows[x]] + b[columns[y]], x, y))


def _gaps(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (vectors**2).sum(1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(1)[None]


def _centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from vectors spread evenly over the sample."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _gaps(vectors, centroids).argmin(axis=1)
        for c in np.unique(near):
            centroids[c] = vectors[near == c].mean(axis=0)
    return centroids


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors as doubles, without null, zero and partly null or non-finite ones."""
    v = F.col(vector).cast("array<double>")
    found = table.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fit = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.filter(F.col("v").isNotNull() & fit & F.exists("v", lambda x: x != 0))


def merged(vectors: DataFrame, nearest: int) -> DataFrame:
    """Of equal vectors the ``nearest + 1`` smallest ids: enough for any query, its own id included."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("_n", place).filter(F.col("_n") <= nearest + 1).drop("_n")


def _nearest(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the nearest, ties to smaller ids; the query's own id is left out.

    A distance beyond the range of doubles is infinite and comes last.
    """
    others = np.flatnonzero(ids != own)
    with np.errstate(over="ignore"):
        gaps = np.sqrt(((vectors[others] - query) ** 2).sum(axis=1))
    if len(gaps) > nearest:
        limit = np.partition(gaps, nearest - 1)[nearest - 1]
        some = np.flatnonzero(gaps <= limit)
    else:
        some = np.arange(len(gaps))
    some = some[np.lexsort((ids[others[some]], gaps[some]))][:nearest]
    return ids[others[some]], gaps[some]


def _best(found: DataFrame, nearest: int) -> DataFrame:
    """The nearest over all shards."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)


def fitted(vectors: DataFrame, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves from at most ``sample`` vectors, chosen by hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    data = _matrix(rows["v"])
    cut = data.shape[1] // 2
    return _centroids(data[:, :cut], k), _centroids(data[:, cut:], k)


def to_meet(vectors: DataFrame, queries: DataFrame, books: Codebooks, nearest: int, recall: float) -> int:
    """Vectors that a query must meet so that the share ``recall`` of neighbours is met.

    A bounded number of queries is compared with every vector, in blocks; for
    each true neighbour the walk tells how many vectors are met with its cell.
    """
    rows = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toPandas()
    asked = list(zip(rows["vec_id"].tolist(), _matrix(rows["v"]), strict=True))
    held = vectors.sparkSession.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, data = batch["vec_id"].to_numpy(), _matrix(batch["v"])
            if len(ids):
                cells = dict(zip(ids.tolist(), batch["cell"].tolist(), strict=True))
                for own, query in held.value:
                    near, gaps = _nearest(ids, data, own, query, nearest)
                    yield pd.DataFrame({"query_id": own, "vec_id": near, "score": gaps, "cell": [cells[i] for i in near.tolist()]})

    found = _best(vectors.mapInPandas(compare, "query_id long, vec_id long, score double, cell long"), nearest).toPandas()
    met = []
    flat = books.counts.reshape(-1)
    for own, query in asked:
        walked = np.array(list(books.walk(query)), np.int64)
        upto = dict(zip(walked.tolist(), np.cumsum(flat[walked]).tolist(), strict=True))
        met += [upto[c] for c in found.loc[found["query_id"] == own, "cell"].tolist()]
    return int(np.quantile(met, recall, method="higher")) if met else 0


def centroids_for(vectors: int) -> int:
    return min(MOST_CENTROIDS, max(LEAST_CENTROIDS, int(vectors**0.5) // 2))


def of_one_length(vectors: DataFrame) -> int | None:
    """The length that most of the vectors have, the largest of several."""
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    most = lengths.agg(F.max(F.struct("rows", "n")).alias("most")).first()["most"]
    return most["n"] if most else None


def search(
    table: DataFrame, queries: DataFrame, nearest: int = NEAREST, k: int | None = None,
    sample: int = FITTED, recall: float = RECALL, vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for each query, by Euclidean distance.

    ``queries`` has the columns of ``table``. Unusable vectors neither ask nor
    answer, nor do vectors of another length than most have; a table without
    usable vectors gives no rows. Repeated rows of one id and vector count once.
    """
    spark = table.sparkSession
    every = usable(table, vector)
    length = of_one_length(every)
    fits = F.size("v") == F.lit(length)
    asked = saved(usable(queries, vector).filter(fits).distinct(), "queries")
    every = saved(merged(every.filter(fits).distinct(), nearest), "vectors")
    shape = "query_id long, rank int, vec_id long, score double"
    if every.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], shape)
    first, second = fitted(every, k or centroids_for(every.count()), sample)
    books = spark.sparkContext.broadcast((first, second, np.zeros((0, 0))))

    @F.pandas_udf("long")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(Codebooks(*books.value).cells(_matrix(vectors)) if len(vectors) else [], dtype="int64")

    index = saved(every.withColumn("cell", cell("v")), "index")
    # At most k * k rows.
    counts = np.zeros(len(first) * len(second), np.int64)
    for row in index.groupBy("cell").count().toLocalIterator():
        counts[row["cell"]] = row["count"]
    full = Codebooks(first, second, counts.reshape(len(first), len(second)))
    enough = to_meet(index, asked, full, nearest, recall)
    walked = spark.sparkContext.broadcast((full.first, full.second, full.counts))
    # A shard is a block of the vectors of one centroid of the first half, or of a few small ones.
    of_first = full.counts.sum(axis=1)
    blocks = np.maximum(1, -(-of_first // SHARD))
    bundle = np.cumsum(of_first) // SHARD
    wide = int(blocks.max())
    layout = spark.sparkContext.broadcast((blocks, bundle, wide, len(second)))

    def shard_of(cells: np.ndarray, block: np.ndarray) -> np.ndarray:
        blocks, bundle, wide, columns = layout.value
        at = cells // columns
        return np.where(blocks[at] > 1, (len(blocks) + at) * wide + block % blocks[at], -1 - bundle[at])

    @F.pandas_udf("long")
    def shard(cells: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(shard_of(cells.to_numpy(), ids.to_numpy()))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, (blocks, _, _, columns) = Codebooks(*walked.value), layout.value
        flat, names = books.counts.reshape(-1), ["shard", "part", "query_id", "q", "cells"]
        rows = []
        for batch in batches:
            for own, part, query in zip(batch["vec_id"], batch["part"], _matrix(batch["v"]), strict=True):
                met, cells = 0, []
                for c in books.walk(query):
                    cells.append(c)
                    met += flat[c]
                    if met >= max(enough, nearest + 1):
                        break
                cells = np.array(cells)
                times = blocks[cells // columns]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells = np.repeat(cells, times)
                shards = shard_of(cells, block)
                order = np.argsort(shards, kind="stable")
                found, starts = np.unique(shards[order], return_index=True)
                for s, some in zip(found.tolist(), np.split(cells[order], starts[1:]), strict=True):
                    rows.append((s, part, own, query, some))
                    if len(rows) == ROUTED:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    def rerank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if entries.empty or asked.empty:
            return none
        entries = entries.sort_values("cell", kind="stable")
        cells, ids, data = entries["cell"].to_numpy(), entries["vec_id"].to_numpy(), _matrix(entries["v"])
        found = []
        for own, query, met in zip(asked["query_id"], asked["q"], asked["cells"], strict=True):
            met = np.asarray(met)
            starts, ends = np.searchsorted(cells, met), np.searchsorted(cells, met, side="right")
            some = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
            near, gaps = _nearest(ids[some], data[some], own, np.asarray(query), nearest)
            found.append((np.full(len(near), own), near, gaps))
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    # Entries are repeated for each part of the queries, so a task sees a bounded number of both.
    parts = max(1, -(-asked.count() // ASKED))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)))
    routed = dealt.mapInPandas(route, "shard long, part long, query_id long, q array<double>, cells array<long>")
    entries = index.withColumn("shard", shard("cell", "vec_id")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    pairs = entries.groupBy("shard", "part").cogroup(routed.groupBy("shard", "part"))
    met = pairs.applyInPandas(rerank, "query_id long, vec_id long, score double")
    return _best(met, nearest).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def report(table: DataFrame) -> DataFrame:
    """The registered form: rows whose id is divisible by 100 ask all others."""
    return search(table, table.filter(F.col("vec_id") % 100 == 0))
