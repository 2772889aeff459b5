"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row of the pivot table holds its Hamming distances to many
reference fingerprints. By the triangle inequality two fingerprints within
``most`` bits differ by at most ``most`` in every column, so a pair with a
larger difference anywhere is discarded, and only survivors are compared.

Pivots alone leave a constant share of all pairs. So that no task sees all
fingerprints, equal fingerprints are merged first and the rest is dealt out by
equal parts: with ``most`` differing bits, at least two of ``most + 2`` parts of
the 64 bits agree. A part pair that too many fingerprints share is dealt again
by parts of its other bits. Neither step loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import column_name, saved
from stallwise.llm.components import components

WORDS = 3
MOST_BITS = 2
SEED = 42
#: Fingerprints that may share a part pair before it is dealt again.
CROWD = 4096
#: Reference fingerprints, derived from their number.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(24)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(parts)) - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "fp") -> DataFrame:
    """``docs`` with a long column ``name``; only the text goes through Python."""

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, udf(F.col(text).cast("string")))


def _cuts(first: int, last: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` bit ranges (start, width) from bit ``first`` up to ``last``."""
    at = [first + (last - first) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _bits(at: int, width: int):
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def _dealt(fps: DataFrame, most: int, crowd: int) -> DataFrame:
    """Rows ``part, key, sub_part, sub, fp``: fingerprints within ``most`` bits share one of them at least."""
    cuts = _cuts(0, 64, most + 2)
    pairs = list(combinations(range(len(cuts)), 2))
    keys = F.array(*(
        F.struct(F.lit(n).alias("part"), F.shiftleft(_bits(*cuts[a]), cuts[b][1]).bitwiseOR(_bits(*cuts[b])).alias("key"))
        for n, (a, b) in enumerate(pairs)
    ))
    keyed = fps.select("fp", F.inline(keys))
    met = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(met, ["part", "key"])
    few = shared.filter(F.col("n") <= crowd).select("part", "key", F.lit(0).alias("sub_part"), F.lit(0).cast("long").alias("sub"), "fp")
    again = []
    for n, (a, b) in enumerate(pairs):
        finer = -(-(most + 2) // most)  # so that most + 2 parts of the other bits are left
        rest = [c for i, (at, width) in enumerate(cuts) if i not in (a, b) for c in _cuts(at, at + width, finer)]
        for m, (c, d) in enumerate(combinations(rest, 2)):
            again.append((n, F.struct(F.lit(m).alias("sub_part"), F.shiftleft(_bits(*c), d[1]).bitwiseOR(_bits(*d)).alias("sub"))))
    choice = F.lit(None)
    for n in range(len(pairs)):
        choice = F.when(F.col("part") == n, F.array(*(s for k, s in again if k == n))).otherwise(choice)
    many = shared.filter(F.col("n") > crowd).select("part", "key", "fp", F.inline(choice))
    return few.unionAll(many.select("part", "key", "sub_part", "sub", "fp"))


def pivot_links(fps: np.ndarray, groups: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a group within ``most`` bits.

    ``groups`` is ascending and fingerprints of a group are in order of their
    distance to the first pivot, so a run of partners ends at the first one
    that this pivot discards.
    """
    rows = np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS]).astype(np.int8)
    left, right = [], []
    at, step = np.arange(len(fps)), 0
    while True:
        step += 1
        at = at[at + step < len(fps)]
        at = at[(groups[at] == groups[at + step]) & (rows[0][at + step] - rows[0][at] <= most)]
        if not len(at):
            break
        kept = at
        for row in rows[1:]:
            kept = kept[np.abs(row[kept] - row[kept + step]) <= most]
        kept = kept[np.bitwise_count(fps[kept] ^ fps[kept + step]) <= most]
        left.append(kept)
        right.append(kept + step)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each position is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The links of whole groups, as one link to the first member of each local component."""
    rows = rows.assign(d=np.bitwise_count(rows["fp"].to_numpy().view(np.uint64) ^ PIVOTS[0]))
    rows = rows.sort_values(["part", "key", "sub_part", "sub", "d"], kind="stable")
    names = rows[["part", "key", "sub_part", "sub"]].to_numpy()
    groups = np.cumsum(np.r_[0, (names[1:] != names[:-1]).any(axis=1)]) if len(rows) else np.empty(0, int)
    fps = rows["fp"].to_numpy()
    root = _roots(len(fps), *pivot_links(fps.view(np.uint64), groups, most))
    linked = root != np.arange(len(fps))
    return pd.DataFrame({"u": fps[linked], "v": fps[root[linked]]})


def links(fps: DataFrame, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Rows ``u, v`` that connect all distinct fingerprints within ``most`` bits of each other."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            names = rows[["part", "key", "sub_part", "sub"]].to_numpy()
            cut = np.flatnonzero((names != names[-1]).any(axis=1))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield _forest(rows[:cut], most)
            rest = rows[cut:]
        if rest is not None and len(rest):
            yield _forest(rest, most)

    name = ["part", "key", "sub_part", "sub"]
    dealt = _dealt(fps, most, crowd).repartition(*name).sortWithinPartitions(*name)
    return dealt.mapInPandas(walk, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    Null, empty and wordless texts have fingerprint 0. Repeated rows come back
    repeated. A null id is never the smallest; a component of null ids only
    has a null ``component_id``.
    """
    found = saved(fingerprints(docs.select("doc_id", "text"), words=words).select("doc_id", "fp"), "fingerprints")
    firsts = saved(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), most, crowd))
    rooted = firsts.join(roots, firsts["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(roots.select(F.col("root")).unionAll(roots.select("u")).distinct().withColumnRenamed("root", "fp"), "fp", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id stays.

    Of rows that repeat an id one stays. Rows without an id stay only for a
    group that has no id at all, one for each fingerprint.
    """
    classes = saved(near_duplicates(docs, **options), "classes")
    named = saved(classes.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows")), "named")

    def rows(of: str) -> DataFrame:
        return docs.join(named.filter(of).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)

    kept = rows("_rows = 1")
    if not named.filter("_rows > 1").isEmpty():
        kept = kept.unionAll(rows("_rows > 1").dropDuplicates(["doc_id"]))
    fp = column_name(docs, "_fp")
    alone = classes.filter("component_id IS NULL").select(F.col("fp").alias(fp)).distinct()
    if not alone.isEmpty():
        nameless = fingerprints(docs.filter("doc_id IS NULL"), name=fp).dropDuplicates([fp])
        kept = kept.unionAll(nameless.join(alone, fp, "left_semi").select(*docs.columns))
    return kept


def report(docs: DataFrame) -> DataFrame:
    """The registered form: fingerprints in hexadecimal digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
