import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stallwise.llm import mixing
from tests.llm.helpers import awkward, docs, words


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.integers(0, 3), max_size=5), st.integers(0, 50))
def test_knapsack_is_exact(counts, budget):
    sizes, held = list(counts), list(counts.values())
    used = mixing.knapsack(sizes, held, budget)
    assert all(u <= n for u, n in zip(used, held))
    sums = [sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*(range(n + 1) for n in held))]
    assert sum(s * u for s, u in zip(sizes, used)) == max(x for x in sums if x <= budget)


def test_fit_is_near(monkeypatch):
    monkeypatch.setattr(mixing, "FITTED", 64)
    dice = random.Random(1)
    for _ in range(50):
        sizes = dice.sample(range(0, 300), 40)
        counts = [dice.randint(1, 30) for _ in sizes]
        volume = sum(s * n for s, n in zip(sizes, counts))
        target = dice.uniform(0, 2) * volume
        passes, extra = mixing.fit(sizes, counts, target)
        taken = passes * volume + sum(s * x for s, x in zip(sizes, extra))
        assert all(0 <= x <= n for x, n in zip(extra, counts)) and 0 <= target - taken < 2


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return full | {s: weight[s] * level for s in open_}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
        open_ -= over


def test_targets_match_resharing(spark):
    dice = random.Random(2)
    for sizes in ({"b": 10, "a": 900, None: 50, "é": 0, "Z": 300}, {f"s{i}": dice.randint(0, 1000) for i in range(30)}, {"a": 0}, {None: 7}):
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        assert got == pytest.approx(slow_targets(sizes))


def test_mix(spark):
    table = docs(spark, *(" ".join(words(n % 17, n)) for n in range(200)), "a b " * 40)
    first, again = mixing.report(table), mixing.report(table.repartition(7))
    rows = first.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect())) and len(rows) == 201
    sizes = {"a": 0, "b": 0, None: 0}
    for r in table.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    aims, taken = slow_targets(sizes), {}
    for r in rows:
        source = ("a", "b", None)[r["doc_id"] % 3]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(aims[source]) and r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(0 <= aims[s] - taken[s] < 20 for s in aims)


def test_awkward_rows(spark):
    rows = awkward(spark).withColumns({"row": F.lit(1), "copies": F.lit(2), "rank": F.lit(3), "_key": F.lit(4), "_copies": F.lit(5)})
    assert mixing.report(rows).count() == rows.count()
    mixed = mixing.mixed(rows)
    assert mixed.columns == rows.columns
    taken = mixing.report(rows).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0").collect()
    count = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(count).alias("n")).filter("n > 0").collect()}
    assert got == pytest.approx({r["doc_id"]: r["n"] for r in taken}, abs=12)
    assert mixing.report(rows.limit(0)).count() == 0 and mixing.mixed(rows.limit(0)).count() == 0


def test_one_row_may_be_a_third_of_all(spark):
    """Ranges hold few rows even if most rows are equal; numbers have no gap and reruns give equal rows the same ones."""
    from stallwise.llm.common import RANKED, numbered

    rows = spark.createDataFrame([("g", 7, "same")] * 3000 + [("g", i, "other") for i in range(1500)] + [("h", None, None)] * 700, "k string, id long, t string")
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n")
    found = numbered(rows, ["k"], sizes, ["id", "t"]).persist()
    for key, n in (("g", 4500), ("h", 700)):
        assert sorted(r["rank"] for r in found.filter(found.k == key).collect()) == list(range(n))
    again = numbered(rows.repartition(7), ["k"], sizes, ["id", "t"])
    ranks = lambda df: sorted(map(tuple, df.select("k", "id", "t", "rank").collect()), key=str)
    assert ranks(found) == ranks(again)
    same = sorted(r["rank"] for r in found.filter("t = 'same'").collect())
    assert max(b - a for a, b in zip(same, same[1:])) > 1 and RANKED < 3000  # spread over the ranges
    found.unpersist()


def test_copies_of_a_repeated_row_are_dealt_out(spark):
    from stallwise.llm import mixing

    texts = ["one two three"] * 2500 + [f"w{i} x" for i in range(50)]
    given = spark.createDataFrame([(1 if i < 2500 else i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed(given)
    size = sum(len(t.split()) for t in texts)
    assert abs(sum(len(r["text"].split()) for r in out.select("text").collect()) - 1.5 * size) <= 3
    assert out.columns == given.columns
