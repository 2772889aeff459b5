import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stallwise.llm import alignment as A
from tests.llm.helpers import DOCS, awkward, docs, words


@pytest.fixture(scope="module")
def tokenizers():
    return A.Tokenizers()


def spans(ids, sizes):
    ends = np.cumsum(sizes[np.array(ids, np.int64)]) if ids else []
    return [(int(e - sizes[i]), int(e), i) for e, i in zip(ends, ids, strict=True)]


def plain(tokenizers, texts):
    """Every pair of tokens compared by its byte range, groups cut at every common end."""
    rows, holders = [], Counter()
    for text in texts:
        a, b = tokenizers.both(text)
        a, b = spans(a, tokenizers.a_sizes), spans(b, tokenizers.b_sizes)
        links = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e]
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        side = lambda part, low, high: ",".join(str(i) for _, e, i in part if low < e <= high)
        groups = ";".join(f"{side(a, low, high)}|{side(b, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False))
        holders.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if cuts else ""))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, g, len(ls), sum(holders[p] == most[p[0]] for p in ls), sum(holders[p] for p in ls), h) for n_a, n_b, g, ls, h in rows]


def got(df):
    return sorted(tuple(row)[1:] for row in df.collect())


TEXTS = ["The quick brown fox, 12345 jumps", "the quick  brown\n\nfox", " leading and trailing ", "<|endoftext|> <s> <0x41> are text",
         "naïve café – ünïcödé 漢字かな 🙂🙂", "a▁b", "tabs\tand\r\nreturns", "x" * 3000, "\u0000 zero", "é" * 50]


def test_equals_brute_force(spark, tokenizers):
    texts = TEXTS + [" ".join(words(40, seed)) for seed in range(6)] + TEXTS[:2]
    found = A.report(docs(spark, *texts))
    assert got(found) == sorted(plain(tokenizers, texts))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk, work", [(1, 1), (60, 3), (1 << 20, 7), (1 << 20, 1 << 16)])
def test_pieces_and_chunks_change_nothing(spark, chunk, work):
    whole = docs(spark, *TEXTS, *(" ".join(words(30, seed)) for seed in range(5)))
    rows = lambda *cut: sorted(map(tuple, A.encoded(whole, A.BYTE_LEVEL, A.PIECES, *cut).filter("starts IS NULL").select("doc_id", "n_links", "groups").collect()))
    assert rows(chunk, work) == rows(A.CHUNK, A.WORK)


@pytest.mark.parametrize("seed", range(5))
def test_diagonals_cut_the_merge_evenly(seed):
    dice = random.Random(seed)
    a, b = (np.array(sorted(dice.sample(range(1, 400), dice.randint(1, 120))) + [400]) for _ in range(2))
    for work in (1, 2, 5, 64, 1000):
        cuts = A.diagonals(a, b, work)
        sizes = np.diff(cuts.sum(axis=1))
        assert tuple(cuts[-1]) == (len(a), len(b)) and (sizes[:-1] == work).all() and sizes[-1] <= work
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        assert all(sum(side == 0 for _, side in merged[:n]) == i for (i, _), n in zip(cuts, cuts.sum(axis=1), strict=True))
        for one, other in zip(A.overlaps(a, b, work), A.overlaps(a, b, 1 << 16), strict=True):
            assert (one == other).all()


def test_awkward_rows(spark, tokenizers):
    """Nulls and empty texts have no tokens, repeated rows count as documents of their own, a very long text is whole."""
    given = awkward(spark)
    texts = [row.text for row in given.collect()]
    found = A.report(given).collect()
    assert len(found) == len(texts)
    assert {tuple(r)[1:] for r in found if r.doc_id in (0, 1, None)} == {(0, 0, 0, 0, 0, 0, "")}
    twice = [r for r in found if r.doc_id == 7]
    assert len(twice) == 3 and len({*twice}) == 2
    for row in found:
        if row.doc_id == 3:
            a, b = tokenizers.both(texts[3])
            assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_links >= max(len(a), len(b))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert A.report(empty).collect() == []
    clash = docs(spark, "one two", None)
    for name in ("chunk", "n", "own", "groups"):
        clash = clash.withColumnRenamed({"chunk": "lang", "n": "source", "own": "n_chars"}.get(name, name), name)
    assert got(A.report(clash)) == got(A.report(docs(spark, "one two", None)))


def test_bytes_that_do_not_come_back(tokenizers):
    """The piece vocabulary reads U+2581 as a space."""
    assert tokenizers.both("a▁b") == ([], []) and tokenizers.both("a b") != ([], [])


def test_real_output(spark, tokenizers):
    row = A.aligned(docs(spark, "hello")).first()
    a, b = tokenizers.both("hello")
    assert row.groups == f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def test_memory_of_a_chunk(tokenizers):
    """A chunk takes a bounded number of bytes for each byte of its texts."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(words(400, seed)) for seed in range(800)]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [field.split() for field in (A.GROUPS + A.PAIRS + ", doc_id long").split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    A.Chunk(tokenizers, texts[:2]).batch(0, pa.array([0, 1]), schema)
    tracemalloc.start()
    rows = A.Chunk(tokenizers, texts).batch(0, pa.array(range(len(texts))), schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, texts))
    print(f"{size} bytes of text, peak {peak}, {peak / size:.1f} a byte")
    assert rows.num_rows == len(texts) + 1 and peak < 60 * size
