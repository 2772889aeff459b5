import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallwise.llm import packing
from tests.llm.helpers import awkward, docs, words


def reference(text):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokens.encode(text or "", add_special_tokens=False).ids, packing.END]


TOKENS = packing.Tokens()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_reference(text):
    assert TOKENS.of(text).tolist() == TOKENS.reference(text).tolist()


def test_ids_of_odd_texts():
    for text in ("a<|endoftext|>b", " " * 5000, "x" * 5000, "\n" * 3000 + "é", "don't they'LL"):
        assert [*TOKENS.of(text).tolist(), packing.END] == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_pack_uses_every_item_once(counts):
    packed, used = packing.pack(counts, 30), Counter()
    for times, filling in packed:
        assert sum(filling) <= 30 and times > 0
        for size in filling:
            used[size] += times
    assert used == Counter(counts)
    bins = sum(times for times, _ in packed)
    assert packing.least_bins(counts, 30) <= bins <= sum(t for t, _ in packing.best_fit(counts, 30))


def test_search_beats_best_fit():
    better = 0
    for seed in range(60):
        dice = random.Random(seed)
        counts = Counter(dice.randint(20, 70) for _ in range(60))
        better += sum(t for t, _ in packing.pack(counts, 100)) < sum(t for t, _ in packing.best_fit(counts, 100))
    assert better > 5


def fewest(items, capacity):
    """The least number of sequences, by trying every place for every item."""
    best = len(items)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[at]}.values():
            place(at + 1, [*rooms[:i], rooms[i] - items[at], *rooms[i + 1 :]])
        place(at + 1, [*rooms, capacity - items[at]])

    place(0, [])
    return best


def test_small_instances_reach_the_optimum():
    for seed in range(150):
        dice = random.Random(seed)
        items = sorted((dice.randint(3, 22) for _ in range(dice.randint(1, 11))), reverse=True)
        assert sum(t for t, _ in packing.pack(Counter(items), 30)) == fewest(items, 30)


def test_fillings_are_the_fullest_and_of_any_number_of_items():
    for seed in range(200):
        dice = random.Random(seed)
        counts = Counter(dice.randint(1, 12) for _ in range(dice.randint(1, 9)))
        room = dice.randint(0, 40)
        sums = {0}
        for item in counts.elements():
            sums |= {x + item for x in sums if x + item <= room}
        for small_first in (False, True):
            found = packing.fillings(room, counts, small_first)
            assert sum(found[0]) == max(sums)
            assert all(not Counter(f) - counts and sum(f) <= room for f in found)


def test_short_documents_are_packed_to_the_bound():
    """Uniform lengths of 6,000 documents: many short ones in a sequence, where best fit alone wastes."""
    for low, high, most in ((50, 150, 0), (20, 200, 0), (100, 400, 6), (150, 700, 12)):
        dice = random.Random(0)
        counts = Counter(dice.randint(low, high) for _ in range(6000))
        bins = sum(t for t, _ in packing.pack(counts))
        assert bins <= packing.least_bins(counts, 1024) + most < sum(t for t, _ in packing.best_fit(counts, 1024))


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pieces_fill_sequences(spark):
    table = docs(spark, *(" ".join(words(n * 7 % 400, n)) for n in range(120)), " ".join(words(3000, 1)))
    table = table.unionAll(awkward(spark).filter("length(text) < 100 OR text IS NULL")).withColumns({"length": F.lit(1), "piece": F.lit("x"), "rank": F.lit(0)})
    rows = packing.pack_documents(table, 256).collect()
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(reference(text), "<u4")
        for piece, (start, length) in enumerate(packing.cuts(len(ids), 256)):
            want[doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.02 * packing.least_bins(Counter(r["length"] for r in rows), 256) + 1
    assert packing.pack_documents(table.limit(0)).count() == 0
