import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stallwise.llm import simhash
from stallwise.llm.components import components
from tests.llm.helpers import DOCS, awkward, docs, words


def slow_fingerprint(text, k=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, most=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = {}
    for i, own in enumerate(ids):
        groups.setdefault(find(i), []).append(own)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprint():
    for text in ("", None, "a", "A b", "a b c", " x\x0by\tz w ", "É é ".join(words(50)), "the the the the", "a b c d a b c d"):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [1, 4096])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_lose_no_pair(spark, crowd, most):
    dice, prints = random.Random(3), set()
    for _ in range(40):
        at = dice.getrandbits(64)
        for _ in range(8):
            prints.add(at)
            for _ in range(dice.randint(0, 3)):
                at ^= 1 << dice.randrange(64)
    prints = sorted(prints)
    signed = [(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    found = {r["u"]: r["root"] for r in components(simhash.links(table, most, crowd)).collect()}
    got = [found.get(s, s) for (s,) in signed]
    want = classes(list(range(len(prints))), prints, most)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    found = {r["u"]: r["root"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(links.limit(0)).count() == 0


def test_awkward_rows(spark):
    rows = awkward(spark).withColumns({"fp": F.lit(1), "component_id": F.lit(2), "key": F.lit(3)})
    found = simhash.report(rows).collect()
    assert len(found) == rows.count()
    ids, texts = zip(*((r["doc_id"], r["text"]) for r in rows.collect()))
    want = classes(ids, [slow_fingerprint(t) for t in texts])
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    expected = sorted(((i, f"{slow_fingerprint(t):016x}", c) for i, t, c in zip(ids, texts, want)), key=key)
    assert sorted(map(tuple, found), key=key) == expected
    assert simhash.report(rows.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(awkward(spark)).select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(ids) == [0, 3, 5, 6]  # wordless 0, 1, 2 and the null ids; long 3, 4; equal 6, 7 and the repeated 7
    nameless = docs(spark, extra=[(None, "a b c d", "en", "a", 1)] * 3 + [(4, "q w e r t y", "en", "a", 1)] * 3)
    assert sorted(r["text"] for r in simhash.keep_one(nameless).collect()) == ["a b c d", "q w e r t y"]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0
