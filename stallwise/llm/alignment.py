"""Alignment of two tokenizers by merge-path partitioning.

The byte offsets where the tokens of A and of B end are two sorted lists over the
same bytes. Merging them gives everything: each distinct end closes one overlap
of an A token with a B token, and an end that both have closes a group. Binary
searches along evenly spaced diagonals of the merge grid cut it into pieces of
equal work that need nothing from each other; a piece emits its overlaps and
counts the groups that it closes, and the groups that span pieces are stitched
by a running sum of those counts.

Texts are encoded and merged in chunks of some megabytes. Ends run on through a
chunk, so a long text is cut into several pieces and short texts share one; a
text's last end is common, so no group spans texts. Pieces are merged by the
task that encoded them: encoding takes many times longer than merging, and its
tokens are larger than the text.

How many documents hold a linked pair of ids is counted over all chunks: a chunk
states its distinct pairs with its own number of documents, the sums are
shuffled back to the chunks that hold a pair, and each chunk adds them up for
its documents from their distinct groups. What a task holds is bounded by the
chunk, or by one text that is longer.

Texts that are null, empty or not reproduced by both tokenizers have no tokens:
zeros and an empty string of groups. Every row is a document of its own, rows
that repeat an id included; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.llm.common import saved

BYTE_LEVEL, PIECES = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of text encoded together, and ends merged as one piece.
CHUNK = 4 << 20
WORK = 1 << 16
#: Groups whose strings are objects at the same time.
GROUPS_AT_ONCE = 1 << 15

GROUPS = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, own array<int>, times array<int>, "
PAIRS = "pair_a array<int>, pair_b array<int>, pair_docs array<int>, starts array<int>, group_pairs array<int>"


class Tokenizers:
    """Ids and token bytes of a byte-level vocabulary (A) and a piece vocabulary with byte fallback (B)."""

    def __init__(self, a: str = BYTE_LEVEL, b: str = PIECES) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{a}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.load = lambda: Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.whole = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        self.a_bytes = [b""] * (max(ranks.values()) + 2)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        names = ((i, self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size()))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]
        self.a_sizes = np.array([*map(len, self.a_bytes)], np.int64)
        self.b_sizes = np.array([*map(len, self.b_bytes)], np.int64)

    def a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except Exception:  # the fast encoder's pattern engine has a limit on backtracking
            if not self.whole:
                self.whole = self.load()
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids

    def both(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B; none if the bytes of either are not those of the text after a space."""
        if not text:
            return [], []
        raw = f" {text}".encode()
        a, b = self.a(f" {text}"), self.pieces.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """How many ends of A and of B come before each ``work``-th place of their merged order (A first on ties)."""
    n = len(a) + len(b)
    at = np.append(np.arange(0, n, work), n)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = open_.copy()
        first[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return np.stack([low, at - low], axis=1)


def merge_piece(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Overlaps of one piece as token places in A and B, each with the groups closed before it in the piece; groups closed."""
    (i0, j0), (i1, j1) = start, end
    ia, jb = np.arange(i0, i1), np.arange(j0, j1)
    ja = j0 + np.searchsorted(b[j0:j1], a[i0:i1], "left")  # the B token that is open where this A token ends
    ib = i0 + np.searchsorted(a[i0:i1], b[j0:j1], "right")
    common = np.zeros(len(jb), bool)
    has = ib > 0
    common[has] = a[ib[has] - 1] == b[jb[has]]
    where = np.empty((3, i1 - i0 + j1 - j0), np.int64)
    where[:, ia + ja - i0 - j0] = ia, ja, np.zeros(len(ia))
    where[:, ib + jb - i0 - j0] = ib, jb, common
    closed = np.cumsum(where[2])
    keep = where[2] == 0
    return where[0, keep].astype(np.int32), where[1, keep].astype(np.int32), closed[keep], int(common.sum())


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps in byte order: places of the A and the B token, and their group."""
    cuts = diagonals(a, b, work)
    found = [merge_piece(a, b, start, end) for start, end in zip(cuts[:-1], cuts[1:], strict=True)]
    if not found:
        return (np.empty(0, np.int32),) * 3
    before = np.cumsum([0, *(closed for *_, closed in found)])  # groups that the pieces before have closed
    groups = [(group + done).astype(np.int32) for (_, _, group, _), done in zip(found, before, strict=False)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate(groups)


class Numbers(dict):
    """Numbers from 0 by first appearance."""

    def __missing__(self, key: bytes) -> int:
        self[key] = value = len(self)
        return value


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one after another."""
    sizes = ends - starts
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts`` (the last is the end), empty runs included."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


class Chunk:
    """The tokens of some texts, merged.

    Places and ids are 32-bit numbers, as a text has less than 2 GB. Lists of
    Python numbers and strings are only made for one text or ``GROUPS_AT_ONCE``.
    """

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None], work: int = WORK) -> None:
        encoded = [[np.array(ids, np.int32) for ids in tokenizers.both(text)] for text in texts]
        self.n_a = np.array([len(a) for a, _ in encoded], np.int64)
        self.n_b = np.array([len(b) for _, b in encoded], np.int64)
        self.ids_a = np.concatenate([a for a, _ in encoded])
        self.ids_b = np.concatenate([b for _, b in encoded])
        del encoded
        ends = np.cumsum(tokenizers.a_sizes[self.ids_a]), np.cumsum(tokenizers.b_sizes[self.ids_b])
        self.at_a, self.at_b, self.group = overlaps(*ends, work)
        del ends
        self.group_a, self.group_b = np.zeros(len(self.ids_a), np.int32), np.zeros(len(self.ids_b), np.int32)
        self.group_a[self.at_a], self.group_b[self.at_b] = self.group, self.group
        count = int(self.group[-1]) + 1 if len(self.group) else 0
        self.links = _starts(np.bincount(self.group, minlength=count))
        last = np.cumsum(self.n_a) - 1  # of a text's A tokens
        closed = np.where(last >= 0, self.group_a[last] + 1, 0) if count else np.zeros(len(texts), np.int64)
        self.groups = np.concatenate([[0], np.maximum.accumulate(closed)]).astype(np.int64)

    def strings(self) -> Iterator[list[bytes]]:
        """Each group as ``a1,a2|b1``, ``GROUPS_AT_ONCE`` together."""
        count = len(self.links) - 1
        before_a, before_b = _starts(np.bincount(self.group_a, minlength=count)), _starts(np.bincount(self.group_b, minlength=count))
        signs = np.empty(len(self.ids_a) + len(self.ids_b), np.int32)
        place = np.arange(len(self.ids_a)) + before_b[self.group_a]
        signs[place] = 3 * self.ids_a
        signs[place[before_a[1:] - 1]] += 1
        place = np.arange(len(self.ids_b)) + before_a[self.group_b + 1]
        signs[place] = 3 * self.ids_b
        signs[place[before_b[1:] - 1]] += 2
        before = before_a + before_b
        del before_a, before_b, place
        for first in range(0, count, GROUPS_AT_ONCE):
            some = signs[before[first] : before[min(first + GROUPS_AT_ONCE, count)]]
            yield b"".join(map(SIGNS.__getitem__, some.tolist())).split(b";")[:-1]

    def named(self) -> tuple[np.ndarray, int, list[str]]:
        """The groups numbered by their strings, how many numbers there are, and each text's groups."""
        number, of, sizes, joined = Numbers(), [], [], []
        for strings in self.strings():
            of.append(np.fromiter(map(number.__getitem__, strings), np.int64, len(strings)))
            sizes.append(np.fromiter(map(len, strings), np.int64, len(strings)))
            joined.append(b";".join(strings))
        whole = b";".join(joined)
        ends = _starts(np.concatenate([np.empty(0, np.int64), *sizes]) + 1)[self.groups]  # behind a text's last ``;``
        texts = [whole[start : max(start, end - 1)].decode() for start, end in zip(ends[:-1], ends[1:], strict=True)]
        return np.concatenate([np.empty(0, np.int64), *of]), len(number), texts

    def batch(self, chunk: int, ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each text, and one for the chunk's distinct pairs and groups."""
        n = len(ids)
        of, kinds, whole = self.named()
        whole = pa.array(whole, pa.string())
        # The links of a group's first appearance stand for all.
        first = np.unique(of, return_index=True)[1]
        taken = _ranges(self.links[first], self.links[first + 1])
        starts = _starts(np.diff(self.links)[first])
        pairs, group_pairs = np.unique(self.ids_a[self.at_a[taken]].astype(np.int64) << 32 | self.ids_b[self.at_b[taken]], return_inverse=True)
        text = np.repeat(np.arange(n), np.diff(self.groups))
        held, times = np.unique(text * max(kinds, 1) + of, return_counts=True)
        held_text, held_kind = held // max(kinds, 1), held % max(kinds, 1)
        spread = _ranges(starts[held_kind], starts[held_kind + 1])
        by_text = np.repeat(held_text, starts[held_kind + 1] - starts[held_kind]) * max(len(pairs), 1) + group_pairs[spread]
        docs = np.bincount(np.unique(by_text) % max(len(pairs), 1), minlength=len(pairs))
        own = _starts(np.bincount(held_text, minlength=n))
        longs = [chunk + np.zeros(n, np.int64), self.n_a, self.n_b, np.diff(self.groups), np.diff(self.links[self.groups])]
        of_texts = [*map(pa.array, longs), whole, _lists(own, held_kind), _lists(own, times)]
        listed = [pairs >> 32, pairs & 0xFFFFFFFF, docs, starts, group_pairs]
        of_chunk = [pa.array([chunk]), *[pa.nulls(1, f.type) for f in schema][1:8], *[_lists(np.array([0, len(x)]), x) for x in listed], pa.nulls(1, ids.type)]
        columns = [*of_texts, *[pa.nulls(n, f.type) for f in schema][8:13], ids]
        columns = [pa.concat_arrays([x.cast(f.type), y.cast(f.type)]) for x, y, f in zip(columns, of_chunk, schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


#: An id with the sign after it: within a side, between the sides, between groups.
SIGNS = [f"{i}{sign}".encode() for i in range(1 << 16) for sign in ",|;"]


def encoded(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, chunk: int = CHUNK, work: int = WORK) -> DataFrame:
    """A row for each document, and one for each chunk (``starts`` is not null), with what later steps need."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(T._parse_datatype_string(GROUPS + PAIRS).fields).add("doc_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tokenizers, arrow, number = Tokenizers(a, b), to_arrow_schema(schema), 0
        first = TaskContext.get().partitionId() << 32
        for rows in batches:
            texts = rows.column(1)
            sizes = np.cumsum([t.as_buffer().size if t.is_valid else 0 for t in texts])
            at = 0
            while at < len(texts):
                done = sizes[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, done + chunk, "right")))
                ids, part = rows.column(0).slice(at, upto - at), texts.slice(at, upto - at).to_pylist()
                yield Chunk(tokenizers, part, work).batch(first + number, ids, arrow)
                at, number = upto, number + 1

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def aligned(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups`` for each document; a group is ``a1,a2|b1``, groups are parted by ``;``."""
    return encoded(docs, a, b).filter("starts IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a, b, n, best``: documents that hold the pair linked, and whether no other pair of ``a`` is held by more."""
    pairs = _pairs(chunks).groupBy("a", "b").agg(F.sum("docs").alias("n"))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _pairs(chunks: DataFrame) -> DataFrame:
    listed = chunks.filter("starts IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("at", "_pair"))
    return listed.select("chunk", "at", F.col("_pair.pair_a").alias("a"), F.col("_pair.pair_b").alias("b"), F.col("_pair.pair_docs").cast("long").alias("docs"))


def _added_up(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk."""
    rows = chunk.combine_chunks()
    is_chunk = rows["starts"].is_valid()
    texts, listed = rows.filter(pa.compute.invert(is_chunk)).combine_chunks(), rows.filter(is_chunk).combine_chunks()
    n, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    place = counts["at"].to_numpy()
    n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    starts, of = (np.array(listed[c][0].values, np.int64) for c in ("starts", "group_pairs"))
    own = texts["own"].chunk(0) if texts.num_rows else pa.array([], pa.list_(pa.int32()))
    times = texts["times"].chunk(0).flatten().to_numpy() if texts.num_rows else np.empty(0, np.int64)
    kinds, bounds = own.flatten().to_numpy(), _starts(np.asarray(own.value_lengths()))
    sums = [pa.array(_sums(_sums(x[of], starts)[kinds] * times, bounds)) for x in (best, n)]
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1]).append_column("groups_sha256", texts["groups_sha256"])


def alignments(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """One row per document with the sums over its links and a digest of its groups."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    chunks = saved(encoded(docs, a, b).withColumn("groups_sha256", digest).drop("groups"), "alignments")
    counts = _pairs(chunks).join(saved(pair_counts(chunks), "pair-counts"), ["a", "b"]).select(F.col("chunk").alias("of"), "at", "n", "best")
    needed = chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own", "times", "starts", "group_pairs")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    return needed.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(_added_up, schema)


def report(docs: DataFrame) -> DataFrame:
    """The rows of ``op11_alignment``."""
    return alignments(docs)
