"""Best-fit packing by bin completion branch-and-bound.

Texts become token ids; what is longer than a sequence is cut into full ones and
a shorter first piece. Only the number of pieces of each length decides how well
they pack, so the search works on that count table, which has at most
``capacity`` rows whatever the input, and uses a filling for as many sequences
as the counts allow. Pieces then find their place by their rank in their length.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm.common import numbered, saved

CAPACITY = 1024
#: Appended to every document.
END = 2
VOCABULARY = "byte_bpe_50k"
#: Fillings tried at a node, of so many fullest sums; nodes of the search, and more of them for each distinct length; nodes from one best-fit incumbent to the next.
BRANCHES = 3
SUMS = 4
NODES = 400
NODES_A_LENGTH = 5
BEST_FIT_EVERY = 64

Filling = tuple[int, ...]
Packed = list[tuple[int, Filling]]


class Tokens:
    """Ids of a byte-level BPE vocabulary.

    The fast encoder has no special tokens and gives up on some extreme texts;
    texts that name a special token, and those, go to the reference encoder.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.load = lambda: Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.whole = None

    def reference(self, text: str) -> np.ndarray:
        self.whole = self.whole or self.load()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def of(self, text: str) -> np.ndarray:
        if "<|" in text:
            return self.reference(text)
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except Exception:  # the fast encoder's pattern engine has a limit on backtracking
            return self.reference(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than the others."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``; a null text counts as empty."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(vocabulary)
        for rows in batches:
            found = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = np.append(tokens.of(text or ""), np.uint32(END)).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    found.append((doc_id, piece, start, length, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(found, columns=names).astype({"doc_id": "string"})

    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by volume, and by items that cannot share with the large ones."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for cut in {0, *(s for s in counts if 2 * s <= capacity)}:
        alone = sum(n for s, n in counts.items() if s > capacity - cut)
        large = [(s, n) for s, n in counts.items() if capacity - cut >= s and 2 * s > capacity]
        room = sum(n * (capacity - s) for s, n in large)
        small = sum(s * n for s, n in counts.items() if cut <= s and 2 * s <= capacity)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Packed:
    """Best-fit decreasing over counts: equal items enter equal sequences together."""
    open_bins: dict[int, list[tuple[int, Filling]]] = {}  # by free room

    def put(times: int, filling: Filling) -> None:
        if times:
            open_bins.setdefault(capacity - sum(filling), []).append((times, filling))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                put(left // each, (size,) * each)
                put(1 if left % each else 0, (size,) * (left % each))
                break
            times, filling = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            each = min(room // size, left)
            used = min(times, left // each)
            put(times - used, filling)
            put(used, filling + (size,) * each)
            left -= used * each
    return [x for group in open_bins.values() for x in group]


def dominates(one: Filling, other: Filling) -> bool:
    """Whether ``one`` can stand wherever ``other`` does and leave the smaller items over."""
    if not other or (one and sum(other) <= one[0]):
        return True
    return len(one) >= len(other) and all(a >= b for a, b in zip(one, other, strict=False))


def _sums(room: int, counts: dict[int, int], sizes: list[int]) -> list[int]:
    """For each number of the smallest sizes the sums up to ``room`` that their items can have, as the bits of a number."""
    mask = (1 << room + 1) - 1
    reach = [1]
    for size in sizes:
        now, left, step = reach[-1], min(counts[size], room // size), 1
        while left:  # any number of copies up to the count, by doubling
            step = min(step, left)
            now |= now << step * size & mask
            left -= step
            step *= 2
        reach.append(now)
    return reach


def _exactly(total: int, counts: dict[int, int], sizes: list[int], reach: list[int]) -> Filling:
    """The filling of exactly ``total`` that takes as many as it can of the last sizes, in the order of ``reach``."""
    filling: list[int] = []
    for at in range(len(sizes) - 1, -1, -1):
        if not total:
            break
        size = sizes[at]
        copies = min(counts[size], total // size)
        while not reach[at] >> total - copies * size & 1:
            copies -= 1
        filling += [size] * copies
        total -= copies * size
    return tuple(sorted(filling, reverse=True))


def fillings(room: int, counts: dict[int, int], small_first: bool = False) -> list[Filling]:
    """Undominated fillings of ``room`` by any number of the items left, least waste first.

    They have one of the ``SUMS`` fullest sums, made of the largest items or of
    the smallest ones; ``small_first`` says which come first. An item that fills
    the room alone dominates all else; where small items come first it is one
    filling among others, as the first dive packs better so.
    """
    if counts.get(room) and not small_first:
        return [(room,)]
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    if not sizes:
        return [()]
    orders = [sizes[::-1], sizes] if small_first else [sizes, sizes[::-1]]
    tables = [_sums(room, counts, order) for order in orders]
    sums, kept = tables[0][-1], []
    for _ in range(SUMS):
        total = sums.bit_length() - 1
        if not total or len(kept) >= BRANCHES:
            break
        sums ^= 1 << total
        for order, reach in zip(orders, tables, strict=True):
            filling = _exactly(total, counts, order, reach)
            if not any(dominates(k, filling) for k in kept):
                kept.append(filling)
    return kept


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> Packed:
    """``(times, filling)`` of the fewest sequences found.

    Depth first: the largest item left takes each undominated filling, best
    first, as often as the counts allow, so a dive to a whole solution takes one
    or two nodes for each length, whatever the counts. A branch ends when its
    waste exceeds what a better solution may waste. Incumbents are best-fit
    packings, at the root and of what is left at every ``BEST_FIT_EVERY``-th
    node, and the whole solutions found. Half of the ``nodes`` go to a search
    that takes fillings of large items first, half to one that takes small ones
    (by default ``NODES``, and ``NODES_A_LENGTH`` for each length, together). Ends
    early at the lower bound.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    volume, least = sum(s * n for s, n in counts.items()), least_bins(counts, capacity)
    bins = lambda packed: sum(times for times, _ in packed)
    best = best_fit(counts, capacity)
    budget = NODES + NODES_A_LENGTH * len(counts) if nodes is None else nodes
    for small_first in (False, True):
        best = _search(best, counts, capacity, budget // 2, small_first, volume, least, bins)
    return best


def _search(best, counts, capacity, nodes, small_first, volume, least, bins) -> Packed:
    fewest, visited = bins(best), 0
    # One entry for each open node: what is packed (a chain from the last step back), its number, what is left, the waste so far.
    stack: list[tuple[tuple | None, int, dict[int, int], int]] = [(None, 0, counts, 0)]
    while stack and fewest > least and visited < nodes:
        chain, done, left, waste = stack.pop()
        if waste > (fewest - 1) * capacity - volume:
            continue
        visited += 1
        rest = best_fit(left, capacity) if left and visited % BEST_FIT_EVERY == 0 else []
        if (rest or not left) and done + bins(rest) < fewest:
            best, fewest = [*_steps(chain), *rest], done + bins(rest)
        if not left:
            continue
        largest = max(left)
        others = left | {largest: left[largest] - 1}
        for filling in reversed(fillings(capacity - largest, others, small_first)):
            need = Counter((largest, *filling))
            times = min(left[s] // n for s, n in need.items())
            after = dict(left)
            for size, n in need.items():
                after[size] -= times * n
                if not after[size]:
                    del after[size]
            lost = waste + times * (capacity - largest - sum(filling))
            stack.append(((chain, (times, (largest, *filling))), done + times, after, lost))
    return best


def _steps(chain: tuple | None) -> Packed:
    steps = []
    while chain:
        chain, step = chain
        steps.append(step)
    return steps[::-1]


def places(packed: Packed) -> pd.DataFrame:
    """For each length the ranks that go to a filling: ``length, rank, each, sequence, offset``."""
    rows, taken, sequence = [], Counter(), 0
    for times, filling in packed:
        offset = 0
        for size, each in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken[size], each, sequence, offset))
            taken[size] += times * each
            offset += size * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"])


def placed(spark: SparkSession, table: pd.DataFrame):
    """A struct of ``sequence_id`` and ``offset`` from a piece's length and rank."""
    held = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    wide = np.int64(1) << 44

    @F.pandas_udf("sequence_id long, offset long")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = held.value
        keys = t["length"] * wide + t["rank"]
        for length, rank in batches:
            at = np.searchsorted(keys, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
            nth = rank.to_numpy() - t["rank"][at]
            yield pd.DataFrame({
                "sequence_id": t["sequence"][at] + nth // t["each"][at],
                "offset": t["offset"][at] + nth % t["each"][at] * length.to_numpy(),
            })

    return udf(F.col("length"), F.col("rank"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Repeated rows are packed each for itself. An empty table gives no rows; an
    empty or null text is the end token alone.
    """
    found = saved(pieces(docs, capacity, vocabulary), "pieces")
    sizes = saved(found.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = {row["length"]: row["n"] for row in sizes.collect()}
    where = placed(docs.sparkSession, places(pack(counts, capacity)))
    rows = numbered(found, ["length"], sizes, ["doc_id", "piece", "ids_crc32", "start"]).withColumn("_at", where)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
