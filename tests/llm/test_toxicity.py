import random
import zlib

from pyspark.sql import functions as F

from stallwise.llm import toxicity
from tests.llm.helpers import DOCS, LABELS, awkward, docs, words

BAD = ["grumpf", "blarg", "snirk"]


def corpus(spark, n=400):
    dice, texts, labels = random.Random(4), [], []
    common = words(300, 9)
    for i in range(n):
        text, toxic = dice.choices(common, k=dice.randint(5, 60)), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text.insert(dice.randrange(len(text)), dice.choice(BAD))
        texts.append(" ".join(text))
        labels.append((i, 1, toxic))
    return docs(spark, *texts), spark.createDataFrame(labels, LABELS)


def test_learns_and_keeps_the_fold_apart(spark):
    table, labels = corpus(spark)
    rows = toxicity.report(table, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, toxicity.report(table, changed).collect()))
    kept = toxicity.reject_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(not r["predicted"] for r in rows)


def test_weights_are_sparse():
    common = words(200, 1)
    dice = random.Random(2)
    texts = [" ".join(dice.choices(common, k=30) + (["blarg"] if i % 2 else [])) for i in range(300)]
    at, weight, _ = toxicity.learn(texts, [i % 2 for i in range(300)])
    assert 0 < len(at) < 400 and weight.max() > 0


def test_sample_is_bounded(spark):
    table, labels = corpus(spark, 60)
    repeated = labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None)], LABELS))
    assert toxicity.label_sample(repeated, "toxic", 10).count() == 10
    assert toxicity.label_sample(repeated, "toxic", 1000).count() == 60


def test_awkward_rows(spark):
    _, labels = corpus(spark, 40)
    rows = awkward(spark).withColumns({"_label": F.lit("x"), "score": F.lit(1), "toxic": F.lit(9), "predicted": F.lit(0)})
    found = toxicity.report(rows, labels).collect()
    assert len(found) == rows.count() and all(0 <= r["score"] <= 1 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False, False]
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.report(rows.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.report(rows, labels.limit(0)).collect()} == {0.5}
    assert toxicity.reject_toxic(spark.createDataFrame([], DOCS), labels).count() == 0


def test_repeated_rows_of_an_id_are_learned_from_once(spark):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(8)], LABELS)
    texts = [f"{('calm', 'vile')[i % 2]} words number {i}" for i in range(8)]
    once = docs(spark, *texts)
    again = once.union(spark.createDataFrame([(1, texts[1], "en", "a", 5)] * 50, once.schema))
    pairs = lambda rows: sorted(map(tuple, toxicity.train(rows, labels).to_numpy().tolist()))
    assert pairs(again) == pairs(once) and len(pairs(once)) > 1


def plain_ftrl(texts, marks, how):
    """FTRL-proximal coordinate by coordinate, as it is published."""
    from math import exp, sqrt

    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        limit = 0.0 if i == bias else how.l1
        pull = z.get(i, 0.0)
        if abs(pull) <= limit:
            return 0.0
        return ((1 if pull > 0 else -1) * limit - pull) / ((how.beta + sqrt(n.get(i, 0.0))) / how.alpha + how.l2)

    for _ in range(how.passes):
        for text, mark in zip(texts, marks):
            at = [*toxicity.Features().of(text).tolist(), bias]
            w = [weight(i) for i in at]
            g = 1 / (1 + exp(-max(-35.0, min(35.0, sum(w))))) - mark
            for i, old in zip(at, w):
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (sqrt(before + g * g) - sqrt(before)) / how.alpha * old
                n[i] = before + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_weights_equal_plain_ftrl():
    dice, common = random.Random(6), words(60, 3)
    texts = [" ".join(dice.choices(common, k=12) + (["blarg"] * (i % 3 == 0))) for i in range(120)] + [None, "", "x" * 500]
    marks = [int(i % 3 == 0) for i in range(120)] + [0, 1, 0]
    for how in (toxicity.Ftrl(), toxicity.Ftrl(alpha=0.3, beta=0.5, l1=0.2, l2=1.0, passes=2)):
        at, weight, bias = toxicity.learn(texts, marks, how)
        want, want_bias = plain_ftrl(texts, marks, how)
        got = dict(zip(at.tolist(), weight.tolist()))
        assert got.keys() == want.keys() and want
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want) and abs(bias - want_bias) < 1e-9
