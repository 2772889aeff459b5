"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and telephone
numbers that fixed patterns find. A term may give an entity away even where the
entity itself is masked: the corpus tells how strongly. With N documents, an
entity c in n(c) of them has ``IC(c) = log2(N / n(c))`` bits. A term t that
stands near c in n(c, t) documents, and anywhere in n(t), discloses
``PMI(c; t) = log2(N n(c, t) / (n(c) n(t)))`` of them. Terms that disclose at
least ``GENERALISE`` of an entity's bits are replaced by their kind, those that
disclose at least ``REMOVE`` are removed, wherever they stand in the corpus.

A term counts as evidence for an entity if it stands among the ``WINDOW`` terms
before or after it, in at least ``SUPPORT`` different surroundings, so copies of
one text prove nothing. Entities of fewer than ``LEAST_BITS`` bits, such as the
address in a footer of very many pages, have little to disclose and are only
masked themselves.

Three passes over the texts, none of which shuffles them: mentions with their
terms; the number of documents of the terms that have support; spans. The second
and third look words up in a Bloom filter of fixed size, which is all that is
broadcast; what passes by mistake is dropped by a join.

A null text counts as empty. Every row is a document of its own, rows that repeat
an id included, so each row gives one row. An empty table gives none. Terms are
words of letters and digits, without regard to case.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
SUPPORT = 5
LEAST_BITS = 6.0
GENERALISE, REMOVE = 0.9, 0.98
#: Positions of the Bloom filter (a power of two).
POSITIONS = 1 << 23
#: Words a worker remembers the test of, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64

# Fixed patterns of the task.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT, NO_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")
TERM = re.compile(r"[^\W_]{3,}")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Matches of the address pattern, found from their ``@`` so that no run of letters is scanned twice."""
    found, done = [], 0
    for match in AT_DOMAIN.finditer(text):
        start = match.start()
        step = 64
        while start > done:  # back over the part before the @, not into the match before
            part = text[max(done, start - step) : start]
            rest = len(part.rstrip(LOCAL))
            start -= len(part) - rest
            if rest:
                break
            step *= 2
        if start < match.start():
            found.append((start, match.end()))
            done = match.end()
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def addresses(text: str) -> list[Span]:
    """Each four numbers of a dotted run, of which all are at most 255."""
    found = []
    for match in DOTTED.finditer(text):
        parts, at = match[0].split("."), match.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for match in CARD.finditer(text):
        digits = NO_DIGIT.sub("", match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(match.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each of ``KINDS``, in order."""
    if not DIGIT.search(text):
        return [emails(text) if "@" in text else [], [], [], []]
    return [emails(text), addresses(text), cards(text), phones(text)]


def _value(kind: int, text: str) -> str:
    """An entity's name: case and signs between digits do not matter."""
    return f"{KINDS[kind]}:{text.lower() if kind < 2 else NO_DIGIT.sub('', text)}"


def _free_terms(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """Terms of the text that touch no span, with their places."""
    covered, merged = sorted(spans), []
    for start, end in covered:
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    ends = [end for _, end in merged]
    found = []
    for match in TERM.finditer(text):
        at = bisect_left(ends, match.start() + 1)
        if at == len(merged) or merged[at][0] >= match.end():
            found.append((match.start(), match.end(), match[0].lower()))
    return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _by_batch(read: Callable[[Iterator[str]], list[tuple]], names: list[str], kinds: list[pa.DataType]):
    """A function for ``mapInArrow`` that gives the rows ``read`` makes of the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = read(t.as_py() for t in rows["text"])
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def mentions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``entity, document, surroundings, terms``: a row for each mention; ``document`` numbers the rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40

        def read(texts: Iterator[str]) -> list[tuple]:
            nonlocal place
            found = []
            for text in texts:
                place += 1
                spans = base_spans(text)
                if not any(spans):
                    continue
                free = _free_terms(text, [s for kind in spans for s in kind])
                starts = [start for start, _, _ in free]
                for kind, of_kind in enumerate(spans):
                    for start, end in of_kind:
                        at = bisect_left(starts, start)
                        near = [term for _, _, term in free[max(0, at - window) : at + window]]
                        around = xxhash.xxh64_intdigest(" ".join(near)) - (1 << 63)
                        found.append((_value(kind, text[start:end]), place, around, sorted({*near})))
            return found

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield from _by_batch(read, ["entity", "document", "surroundings", "terms"], kinds)(batches)

    return _texts(docs).mapInArrow(run, "entity string, document long, surroundings long, terms array<string>")


def supported(found: DataFrame, documents: int, support: int = SUPPORT, least_bits: float = LEAST_BITS) -> DataFrame:
    """``term, together, bits``: terms in enough surroundings of an entity that has enough bits."""
    entities = found.groupBy("entity").agg(F.count_distinct("document").alias("of_entity"))
    entities = entities.withColumn("bits", F.log2(F.lit(float(documents)) / F.col("of_entity"))).filter(F.col("bits") >= least_bits)
    pairs = found.select("entity", "document", "surroundings", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(
        F.count_distinct("surroundings").alias("support"), F.count_distinct("document").alias("together")
    )
    return pairs.filter(F.col("support") >= support).join(entities, "entity").select("term", "together", "bits")


def bloom(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of ``POSITIONS`` bits over the column ``term``; its size is fixed, so is what comes to the driver."""
    h = F.xxhash64("term")
    at = F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("at")
    words = terms.select(at).select(F.pmod("at", F.lit(POSITIONS)).alias("at"))
    words = words.groupBy(F.shiftright("at", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    bits = np.zeros(POSITIONS // 64, np.int64)
    for row in words.collect():
        bits[row["word"]] = row["bits"]
    return bits


class Terms(dict):
    """Whether a term may be in a Bloom filter; tests of short terms are remembered up to a bound."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: str) -> bool:
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        found = all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in (h % POSITIONS, (h >> 32) % POSITIONS))
        if len(term) <= LONGEST and len(self) < REMEMBERED:
            self[term] = found
        return found

    def of(self, text: str) -> set[str]:
        return {t for t in {*TERM.findall(text.lower())} if self[t]}


def documents_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, documents``: in how many rows of ``docs`` the distinct ``terms`` stand."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(held.value)

        def read(texts: Iterator[str]) -> list[tuple]:
            counts: Counter[str] = Counter()
            for text in texts:
                counts.update(known.of(text))
            return list(counts.items())

        yield from _by_batch(read, ["term", "n"], [pa.string(), pa.int64()])(batches)

    counted = _texts(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("documents"))
    return counted.join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, **options) -> DataFrame:
    """``term, action``: terms that disclose too much of an entity, to be made ``general`` or ``removed``."""
    documents = docs.count()
    found = saved(mentions(docs, options.pop("window", WINDOW)), "mentions")
    pairs = saved(supported(found, documents, **options), "supported")
    counts = documents_of(docs, pairs.select("term").distinct())
    # PMI / IC = 1 + log2(n(c, t) / n(t)) / IC
    share = F.max(1 + F.log2(F.col("together") / F.col("documents")) / F.col("bits")).alias("share")
    rows = pairs.join(counts, "term").groupBy("term").agg(share).filter(F.col("share") >= generalise)
    return saved(rows.select("term", F.when(F.col("share") >= remove, "removed").otherwise("general").alias("action")), "disclosing")


def found_spans(docs: DataFrame, terms: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each document: ``doc_id``, counts of each kind, ``base`` spans as text, ``spans`` of the given terms.

    ``terms`` has ``term, action``; ``spans`` is a list of action, start and end,
    ordered.
    """
    kind = docs.schema["doc_id"].dataType
    held = docs.sparkSession.sparkContext.broadcast(bloom(terms))
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType(T._parse_datatype_string(
        f"place long, {', '.join(f'{c} long' for c in counts)}, base string, terms array<struct<term:string,start:int,end:int>>, text string"
    ).fields).add("doc_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, any_term = Terms(held.value), bool(held.value.any())
        place = TaskContext.get().partitionId() << 40
        listed = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64()] * (1 + len(counts)) + [pa.string(), listed, pa.string()]

        def read(texts: Iterator[str]) -> list[tuple]:
            nonlocal place
            rows = []
            for text in texts:
                place += 1
                spans = base_spans(text)
                base = ",".join(f"{k}:{s}:{e}" for k, of_kind in zip(KINDS, spans, strict=True) for s, e in of_kind)
                own = []
                if any_term and (wanted := known.of(text)):
                    free = _free_terms(text, [s for of_kind in spans for s in of_kind])
                    own = [{"term": t, "start": s, "end": e} for s, e, t in free if t in wanted]
                rows.append((place, *map(len, spans), base, own, text if with_text else None))
            return rows

        for rows in batches:
            for made in _by_batch(read, schema.names[:-1], kinds)([rows]):
                yield pa.RecordBatch.from_arrays([*made.columns, rows["doc_id"]], schema.names)

    found = saved(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema), "spans")
    exact = found.select("place", F.explode("terms").alias("_t")).select("place", "_t.*").join(terms, "term")
    exact = exact.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("action", "start", "end"))).alias("spans"))
    return found.drop("terms").join(exact, "place", "left").drop("place")


def _kind_of(word: str) -> str:
    if word.isdigit():
        return "number"
    return "name" if word[0].isupper() else "word" if word.isalpha() else "code"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with base spans replaced by their kind, general terms by theirs, removed ones left out."""
    out, done = [], 0
    for start, end, kind in sorted((start, end, kind) for kind, start, end in spans):
        if start >= done:
            out.append(text[done:start])
            out.append("" if kind == "removed" else f"[{_kind_of(text[start:end]) if kind == 'general' else kind}]")
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text, spans``: the texts without what identifies; spans as ``kind:start:end`` of the text as it was."""
    found = _joined(found_spans(docs, disclosing(docs, **options), with_text=True))

    @F.pandas_udf("string")
    def clean(texts, spans):
        split = [[(k, int(s), int(e)) for k, s, e in (x.split(":") for x in of.split(",") if x)] for of in spans]
        return texts.combine(type(texts)(split, index=texts.index), masked)

    return found.select("doc_id", clean("text", "spans").alias("text"), "spans")


def _joined(found: DataFrame) -> DataFrame:
    more = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["action"], s["start"], s["end"])), ",")
    return found.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), more))


def report(docs: DataFrame) -> DataFrame:
    """The rows of ``op13_privacy``."""
    found = _joined(found_spans(docs, disclosing(docs)))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
