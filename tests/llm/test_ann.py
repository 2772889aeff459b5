import random

import numpy as np
from pyspark.sql import functions as F

from stallwise.llm import ann

TABLE = "vec_id long, embedding array<float>, label int"


def table(spark, n, size=8, seed=1):
    dice = np.random.default_rng(seed)
    return spark.createDataFrame([(i, dice.normal(size=size).astype("float32").tolist(), 0) for i in range(n)], TABLE)


def slow(rows, asked, nearest=10):
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]}
    good = {k: v for k, v in good.items() if np.isfinite(v).all() and v.any()}
    found = {}
    for q in sorted(k for k in good if asked(k)):
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), k) for k, v in good.items() if k != q)[:nearest]
        found[q] = [k for _, k in near]
    return found


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    vectors = table(spark, 1500)
    asked = vectors.filter("vec_id % 10 = 0")
    found = ann.search(vectors, asked, k=12)
    got, want = lists(found), slow(vectors.collect(), lambda k: k % 10 == 0)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.93 * 10 * len(want)
    rows = found.collect()
    assert all(r["rank"] >= 1 and r["score"] > 0 for r in rows)


def test_walk_is_in_order():
    dice = np.random.default_rng(3)
    books = ann.Codebooks(dice.normal(size=(7, 3)), dice.normal(size=(5, 3)), np.ones((7, 5), int))
    query = dice.normal(size=6)
    walked = list(books.walk(query))
    gaps = [((query[:3] - books.first[c // 5]) ** 2).sum() + ((query[3:] - books.second[c % 5]) ** 2).sum() for c in walked]
    assert sorted(walked) == list(range(35)) and gaps == sorted(gaps)


def test_awkward_rows(spark):
    dice = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(dice.randint(0, 2)) for _ in range(4)], 1) for i in range(0, 60)]
    rows += [(100, None, 0), (200, [0.0] * 4, 0), (300, [1.0, None, 2.0, 3.0], 0), (400, [nan, 1.0, 1.0, 1.0], 0), (500, [inf, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0)]
    rows += [(1000 + i, [7.0, 7.0, 7.0, 7.5], 0) for i in range(60)]  # equal vectors
    vectors = spark.createDataFrame(rows + rows[:3], TABLE).withColumns({"cell": F.lit("x"), "v": F.lit(1), "shard": F.lit(2)})
    found = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=5, recall=1.0)
    assert lists(found) == slow(vectors.collect(), lambda k: k % 20 == 0)
    few = vectors.filter("vec_id < 4")
    assert lists(ann.search(few, few.filter("vec_id = 0"))) == slow(few.collect(), lambda k: k == 0)
    assert ann.report(vectors.limit(0)).count() == 0
    assert ann.report(vectors.filter("vec_id IN (100, 200)")).count() == 0


def test_a_task_sees_a_bounded_number_of_queries(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    sizes = []

    def spied(ops, f, schema, old=PandasCogroupedOps.applyInPandas):
        for side in (ops._gd1._df, ops._gd2._df):
            sizes.append(max(r["count"] for r in side.groupBy([c for c in ("shard", "part") if c in side.columns]).count().collect()))
        return old(ops, f, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", spied)
    monkeypatch.setattr(ann, "SHARD", 300)
    vectors = table(spark, 1200)
    whole = ann.search(vectors, vectors, k=6).collect()
    monkeypatch.setattr(ann, "ASKED", 100, raising=False)
    monkeypatch.setattr(ann, "ROUTED", 7, raising=False)
    again = ann.search(vectors, vectors, k=6).collect()
    assert sorted(again) == sorted(whole) and len(whole) == 12_000
    assert sizes[2] == sizes[0] <= 600 and sizes[1] > 600 and sizes[3] <= 150


def test_lengths_and_overflow(spark):
    """Vectors of another length than most take no part; a distance beyond doubles is infinite and comes last."""
    vectors = [[1.0, 2.0], [1.0, 3.0], [1e300, -1e300], [1.0], [1.0, 2.0, 3.0], [4.0, 4.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = ann.search(table, table.filter("vec_id IN (0, 3, 4)"), k=2, recall=1.0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 5), (0, 3, 2)]
    assert max(r["score"] for r in found) == float("inf")


def test_centroids_grow_with_the_table():
    assert [ann.centroids_for(n) for n in (0, 1000, 16_384, 40_000, 10**6, 10**9)] == [64, 64, 64, 100, 256, 256]
