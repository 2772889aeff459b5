"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed words and word pairs are estimated, one from all
documents and one from trusted ones. A document's score is the log-likelihood
ratio of its n-grams divided by their number. One threshold, fitted on all labelled
documents, decides for every document alike; simple base rules come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.llm.common import WHITE, WordHashes, column_name, gram_buckets, label_of_ids, label_sample, with_labels

BITS = 16
GRAMS = ((0,), (0, 1))
#: Cells of scores for each 1 that the threshold is found among: the driver sees counts of cells, whatever the number of labels.
CELLS = 1 << 18
#: Added to each bucket's count, in the raw corpus and, scaled alike, in the target.
SMOOTHING = 20.0
#: Labelled ids (some 32 bytes each) that are broadcast, so that no text is shuffled; more are joined as adaptive execution sees fit.
BROADCAST_IDS = 2_000_000
WINDOW = 8
LEAST_WORDS = 20
#: Share of trusted documents that the threshold may lose at most, and how many kept bad ones weigh as much as one lost.
LOST = 0.002
REGRET = 5

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for at in range(window):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)] if "\n" in text else []
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
    )


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([gram_buckets(hashes, g, BITS) for g in GRAMS])


def counts(docs: DataFrame, known: DataFrame, bounded: bool = False) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all documents and over those that ``known`` gives label 1.

    Each task adds its documents up, so at most 2^BITS rows a task are shuffled.
    """
    marked = with_labels(docs.select("doc_id", F.col("text").cast("string").alias("text")), known, "left", bounded)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, raw, target = WordHashes(), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def flush() -> None:
            for trusted, parts in held.items():
                if parts:
                    n = np.bincount(np.concatenate(parts), minlength=1 << BITS)
                    raw[:] += n
                    target[:] += n * trusted
                    parts.clear()

        for rows in batches:
            size = 0
            for text, label in zip(rows["text"], rows["_label"], strict=True):
                if text:
                    found = _buckets(words.of(text.encode().split()))
                    held[label == 1].append(found)
                    size += len(found)
                    if size > 1 << 20:
                        flush()
                        size = 0
            flush()
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    parts = marked.select("text", "_label").mapInPandas(add, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(found: pd.DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket; 0 everywhere without target documents."""
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[found["bucket"].to_numpy(np.int64)] = found["raw"]
    target[found["bucket"].to_numpy(np.int64)] = found["target"]
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    # The raw shares are the target's prior, so a bucket without evidence says nothing.
    q = (target + SMOOTHING * len(raw) * p) / (target.sum() + SMOOTHING * len(raw))
    return np.log(q / p).astype(np.float32)


def judged(spark: SparkSession, ratios: np.ndarray, text: str = "text") -> Column:
    """A struct of the base counts and ``score``, the mean log ratio of the n-grams (0 without any)."""
    weights = spark.sparkContext.broadcast(ratios)

    @F.pandas_udf(f"{BASE}, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, known = weights.value, WordHashes()
        for texts in batches:
            rows = []
            for value in texts:
                value = value or ""
                words = value.encode().split()
                hashes = known.of(words)
                at = _buckets(hashes)
                rows.append((*base_counts(value, words, hashes), float(w[at].mean(dtype=np.float64)) if len(at) else 0.0))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return udf(F.col(text).cast("string"))


def base_failed(j: Column) -> Column:
    return (j["n_words"] < LEAST_WORDS) | (100 * j["n_repeat_words"] > 30 * j["n_words"])


def threshold(scores: np.ndarray, labels: np.ndarray, lost: float = LOST) -> float:
    """The cut with the least weighted errors that rejects at most the share ``lost`` of label 1.

    ``labels`` has a label for each score, or two numbers: how many documents of
    label 1 and how many others have it. The cut lies midway between two scores.
    Without both labels nothing is rejected.
    """
    held = labels if labels.ndim == 2 else np.stack([labels == 1, labels != 1], axis=1)
    good, bad = held.sum(0, dtype=np.int64)
    if not good or not bad:
        return float("-inf")
    cuts, at = np.unique(scores, return_inverse=True)
    below = np.zeros((len(cuts) + 1, 2), np.int64)
    np.add.at(below, at + 1, held.astype(np.int64))
    below = below.cumsum(0)[:-1]
    cuts = np.concatenate(([-np.inf], (cuts[1:] + cuts[:-1]) / 2))
    fitting = below[:, 0] <= lost * good
    errors = REGRET * below[fitting, 0] + bad - below[fitting, 1]
    return float(cuts[fitting][np.argmin(errors)])


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None) -> tuple[np.ndarray, float]:
    """Log ratios and threshold from all documents and all labels (or ``most`` of them, chosen by hash), one text an id.

    A labelled document is judged where it stands; of several texts of an id
    the one with the least hash counts. Its score is rounded to a cell, and the
    driver gets how many documents of each label a cell has.
    """
    known = label_of_ids(labels, "quality") if most is None else label_sample(labels, "quality", most)
    bounded = known.count() <= BROADCAST_IDS
    ratios = log_ratios(counts(docs, known, bounded).toPandas())
    rows = with_labels(docs.select("doc_id", "text"), known, "inner", bounded)
    j = judged(docs.sparkSession, ratios)
    seen = rows.select("doc_id", "_label", F.xxhash64("text").alias("hash"), j.alias("j"))
    # The base rules as a column, not a filter: a filter would go below the join and judge every document.
    least = F.min(F.struct("hash", base_failed(F.col("j")).alias("failed"), "j.score")).alias("_least")
    seen = seen.groupBy("doc_id", "_label").agg(least).filter("NOT _least.failed")
    cell = F.floor(F.col("_least.score") * CELLS + 0.5) / CELLS
    cells = seen.groupBy(cell.alias("cell")).agg(F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") != 1).alias("bad"))
    cells = cells.toPandas()
    return ratios, threshold(cells["cell"].to_numpy(float), cells[["good", "bad"]].to_numpy(np.int64))


def judge(docs: DataFrame, labels: DataFrame, name: str = "_quality", **options) -> DataFrame:
    """``docs`` with a struct ``name``: base counts, ``score``, ``base_failed`` and ``kept``.

    A null text counts as empty and fails for want of words.
    """
    ratios, cut = fit(docs, labels, **options)
    j = F.col(name)
    found = docs.withColumn(name, judged(docs.sparkSession, ratios))
    return found.withColumn(
        name, j.withField("base_failed", base_failed(j)).withField("kept", ~base_failed(j) & (j["score"] >= F.lit(cut)))
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the base rules and the likelihood ratio keep."""
    name = column_name(docs, "_quality")
    return judge(docs, labels, name, **options).filter(F.col(name)["kept"]).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered form: one row per row of ``docs``."""
    return judge(docs.select("doc_id", "text"), labels).select("doc_id", "_quality.*")
