"""Spelling variants by blocked Gram matrices of letter counts.

Words with one inserted, deleted or replaced letter between them differ little in
their letter counts: the squared distance of the two count vectors is at most
two. Products of count matrices give these distances for a block of words against
the blocks of equal and next length; the few pairs at most two apart are verified
by their common beginning and end.

Products over a whole vocabulary would be quadratic, so words meet in blocks
first. The letters are dealt into four groups by their frequency. One edit
touches at most two of them, so two near words have equal counts in two groups at
least: each word goes to six blocks, one for each pair of groups, named by its
counts in them. A pair is kept in the first block that it shares. A block of more
than ``TILE`` words is split, and each two of its parts meet in a task of their
own, so no task holds more than two parts.

Texts that are null have no words. Rows that repeat an id count like any other;
a null id counts as empty text. An empty table, or one without long words, gives
no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.llm.common import saved

#: Letters of a run; ``×`` and ``÷`` lie in the range too.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many loses a letter.
DAMAGE = 31
#: How many times more frequent a form is.
RATIO = 10
TILE = 2048
#: Words of many blocks compared together, and blocks that are padded to one size and multiplied at once.
TOGETHER = 16_384
PADDED = (4, 8, 16, 32, 64)
CELLS = 1 << 21
GROUPS = 4
PAIRS = [*itertools.combinations(range(GROUPS), 2)]


def _damaged(doc_id: Column, run: Column) -> Column:
    """The run without one letter, if its hash with the id is a multiple of ``DAMAGE``."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % DAMAGE == 0, without).otherwise(run)


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the distinct long words with their number of occurrences."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    plain = F.octet_length("_run") == F.char_length("_run")
    rows = rows.withColumn("_run", F.when(plain, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)))
    found = rows.select(_damaged(F.col("_id"), F.col("_run")).alias("word")).filter(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def dealt_letters(vocabulary: DataFrame) -> np.ndarray:
    """The group of each Latin-1 code: letters in order of frequency, dealt in turn. A row for each letter comes to the driver."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    groups = np.zeros(256, np.int64)
    ranked = sorted((row for row in letters.collect() if row["letter"]), key=lambda row: (-row["count"], row["letter"]))
    for rank, row in enumerate(ranked):
        groups[ord(row["letter"])] = rank % GROUPS
    return groups


#: A 64-bit number for each letter; the sum over a word's letters names their counts.
LETTER_HASH = np.array([xxhash.xxh64_intdigest(bytes([code]), 7) for code in range(256)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words as flat letter codes."""

    def __init__(self, column: pa.Array) -> None:
        texts = column.to_pylist()
        self.sizes = np.array([*map(len, texts)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.codes = np.frombuffer("".join(texts).encode("latin-1") + b"\0", np.uint8)

    def names(self, groups: np.ndarray) -> np.ndarray:
        """For each word and group of letters a number that its counts in the group decide."""
        flat = np.zeros((len(self.codes), GROUPS), np.uint64)
        at = np.arange(len(self.codes) - 1)
        flat[at, groups[self.codes[:-1]]] = LETTER_HASH[self.codes[:-1]]
        return np.add.reduceat(flat, self.starts, axis=0)

    def counts(self) -> np.ndarray:
        """Count vectors over the letters that occur; one more word of none at the end."""
        used, letter = np.unique(self.codes[:-1], return_inverse=True)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        flat = np.bincount(row * len(used) + letter, minlength=(len(self.sizes) + 1) * len(used))
        exact = np.float32 if self.sizes.max() < 2000 else np.float64  # squares up to 2^24 are exact in single precision
        return flat.reshape(-1, len(used)).astype(exact)

    def one_edit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether exactly one letter is inserted, deleted or replaced between words ``x`` and ``y``."""
        good = np.zeros(len(x), bool)
        longest = np.maximum(self.sizes[x], self.sizes[y])
        order = np.argsort(longest, kind="stable")
        at = 0
        while at < len(order):
            upto = min(len(order), at + max(1, CELLS // int(longest[order[at]] + 1)))
            while upto > at + 1 and (upto - at) * int(longest[order[upto - 1]]) > 2 * CELLS:
                upto = (at + upto) // 2
            rows = order[at:upto]
            width = int(longest[rows[-1]]) + 1
            ahead = self._equal(x[rows], y[rows], width, forward=True)
            behind = self._equal(x[rows], y[rows], width, forward=False)
            near = np.abs(self.sizes[x[rows]] - self.sizes[y[rows]]) <= 1
            good[rows] = near & (ahead < longest[rows]) & (ahead + behind >= longest[rows] - 1)
            at = upto
        return good

    def _equal(self, x: np.ndarray, y: np.ndarray, width: int, forward: bool) -> np.ndarray:
        """Letters that two words share from their beginning or their end."""

        def letters(of: np.ndarray) -> np.ndarray:
            step = np.arange(width)
            start, size = self.starts[of][:, None], self.sizes[of][:, None]
            place = start + step if forward else start + size - 1 - step
            return np.where(step < size, self.codes[np.clip(place, 0, len(self.codes) - 1)], 0)

        same = letters(x) == letters(y)
        return np.where(same.all(axis=1), width, same.argmin(axis=1))


def _within(counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words of ``x`` and ``y`` have count vectors at most two apart, by one matrix product for each leading index."""
    a, b = counts[x], counts[y]
    squares = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :]
    return squares - 2 * (a @ np.swapaxes(b, -1, -2)) <= 2


def _small(counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of blocks that are padded to one size."""
    for least, size in zip((1, *PADDED), PADDED, strict=False):
        chosen = np.flatnonzero((sizes > least) & (sizes <= size))
        step = max(1, CELLS // (size * max(size, counts.shape[1])))
        upper = np.triu(np.ones((size, size), bool), 1)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            place = starts[part][:, None] + np.arange(size)
            real = np.arange(size) < sizes[part][:, None]
            place[~real] = len(counts) - 1
            block, i, j = np.nonzero(_within(counts, place, place) & upper & real[:, :, None] & real[:, None, :])
            yield place[block, i], place[block, j]


def _large(counts: np.ndarray, lengths: np.ndarray, start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one block whose words are in order of length: each length against itself and the next."""
    own = lengths[start : start + size]
    for length in np.unique(own):
        x0, x1, y1 = start + np.searchsorted(own, [length, length + 1, length + 2])
        for x in range(x0, x1, 1024):
            for y in range(x, y1, 1024):
                rows, columns = np.arange(x, min(x + 1024, x1)), np.arange(y, min(y + 1024, y1))
                i, j = np.nonzero(_within(counts, rows, columns))
                later = columns[j] > rows[i]
                yield rows[i[later]], columns[j[later]]


def near_pairs(found: Words, cell: np.ndarray, pair: np.ndarray, side: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of some blocks, each unordered pair once over all blocks.

    ``cell`` numbers the block of a word, blocks one after another and by length
    inside; ``pair`` is its pair of groups; ``side`` is 0, or 1 and 2 for the two
    parts that meet.
    """
    counts = found.counts()
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    candidates = [*_small(counts, starts, sizes)]
    for start, size in zip(starts[sizes > PADDED[-1]], sizes[sizes > PADDED[-1]], strict=True):
        candidates += _large(counts, found.sizes, int(start), int(size))
    x, y = (np.concatenate([np.empty(0, np.int64), *(c[k] for c in candidates)]) for k in (0, 1))
    apart = (side[x] == 0) | (side[x] != side[y])
    x, y = x[apart], y[apart]
    near = found.one_edit(x, y)
    x, y = x[near], y[near]
    names = found.names(groups)
    equal = names[x] == names[y]
    shared = np.stack([equal[:, g] & equal[:, h] for g, h in PAIRS], axis=1) if len(x) else np.zeros((0, len(PAIRS)), bool)
    first = shared.argmax(axis=1) == pair[x]
    return x[first], y[first]


def _in_blocks(vocabulary: DataFrame, groups: np.ndarray) -> DataFrame:
    """``key, pair, word, n``: each word in its six blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            names = Words(rows["word"]).names(groups)
            for pair, (g, h) in enumerate(PAIRS):
                key = (names[:, g] * SPREAD + names[:, h]) * SPREAD + np.uint64(pair)
                pairs = pa.array(np.full(len(key), pair, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pairs, rows["word"], rows["n"]], ["key", "pair", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "key long, pair int, word string, n long")


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, near, near_n``: the near words of each word, in both directions."""
    groups = dealt_letters(vocabulary)
    blocked = _in_blocks(vocabulary, groups)
    large = blocked.groupBy("key").agg(F.count("*").alias("_size")).filter(F.col("_size") > tile)
    large = large.select("key", F.ceil(F.col("_size") / tile).cast("int").alias("_parts"))
    rows = blocked.join(large, "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    rows = rows.select("key", "pair", "word", "n", part.alias("_part"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
    side = F.when(low == high, 0).when(F.col("_part") == low, 1).otherwise(2)
    rows = rows.select("key", low.alias("low"), high.alias("high"), "pair", side.alias("side"), "word", "n")
    cells = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", F.char_length("word"))

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key, low, high, pair, side = (rows[c].to_numpy() for c in ("key", "low", "high", "pair", "side"))
        new = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        x, y = near_pairs(Words(rows["word"].combine_chunks()), np.append(0, np.cumsum(new)), pair, side, groups)
        both, other = np.concatenate([x, y]), np.concatenate([y, x])
        columns = [rows["word"].take(both), rows["word"].take(other), rows["n"].take(other)]
        return pa.table(columns, ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < TOGETHER:
                continue
            ends = [held[c].to_numpy() for c in ("key", "low", "high")]
            last = np.flatnonzero(np.any([e[1:] != e[:-1] for e in ends], axis=0))
            if len(last):  # the last block may go on in the next batch
                yield from compared(held.slice(0, last[-1] + 1)).to_batches()
                held = held.slice(last[-1] + 1)
        if held is not None:
            yield from compared(held).to_batches()

    return cells.mapInArrow(run, "word string, near string, near_n long")


def followed(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` from ``word, form``: the last form of chains of at most ``steps`` steps, by doubling."""
    now = saved(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        far = now.join(ahead, F.col("root") == F.col("_word"), "left")
        now = saved(far.select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each long word of the texts.

    A step from a word to its form multiplies its occurrences by ``ratio`` at
    least, which bounds the steps to a root.
    """
    vocabulary = saved(words(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("_best")
    near = near_words(vocabulary, tile).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = vocabulary.join(near, "word", "left")
    good = F.col("_best.form").isNotNull() & (-F.col("_best.rank") >= ratio * F.col("n"))
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("_best.form")).alias("form"), F.when(good, -F.col("_best.rank")).alias("form_n"),
    )
    rows = saved(rows, "near-words")
    most = rows.agg(F.max("n")).first()[0] or 1
    roots = followed(rows.filter("form IS NOT NULL"), 1 + int(math.log(most, ratio)))
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The rows of ``op12_variants``."""
    return variants(docs)
