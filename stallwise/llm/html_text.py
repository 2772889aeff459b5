"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text that no block-level
tag interrupts. Each block has features of its ancestors' tags and names and of
its text; neighbouring labels depend on each other. The model is fitted on
labelled pages and a page's labels are decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.llm.labelled_pages import pages as labelled_pages

#: Labelled pages that the model is fitted on, rounds of fitting, step and pull to zero.
PAGES = 700
ROUNDS = 150
STEP = 0.3
PULL = 1e-4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown as such. Formulas and the text for missing media stand in paragraphs and are left to the model.
HIDDEN = frozenset("head title script style noscript template svg textarea select option button iframe".split())
#: Start tags that may stand in a head; any other one, and any text, ends it.
IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: Tags whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset(
    "html body article section main nav header footer aside address div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody"
    " tfoot tr td th blockquote pre figure figcaption form fieldset legend details summary hr center dialog menu hgroup search".split()
)
#: Open elements that a start tag ends, and where the search for them stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
#: An attribute: a quote opens a value right after the equals sign only, anywhere else it is a plain character.
ATTRIBUTE = r"""(?P<name>=?[^\s/>=]+|=)(?:\s*=\s*(?:"(?P<double>[^"]*)(?:"|$)|'(?P<single>[^']*)(?:'|$)|(?P<bare>[^\s>"'][^\s>]*)|(?=>)|$))?"""
ATTRIBUTES = re.compile(ATTRIBUTE)
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|" + re.sub(r"\?P<\w+>", "?:", ATTRIBUTE) + ")*+)(?:>|$)",
    re.S,
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = tuple(f"h{n}" for n in range(1, 7))

#: Elements that part a page into areas.
AREAS = frozenset(f"in:{t}" for t in "body section article main nav header footer aside div form td dialog".split())


class Path:
    """The open elements at a block, as a chain of nodes that blocks share.

    A node has what its element adds: ``fresh`` features that no element around
    it has, and ``names``, the new names of its innermost area. ``area`` is that
    area's tag, ``named`` whether it has names, ``begins`` whether it begins
    here; ``closed`` says that names of elements inside do not belong to it;
    ``size`` counts the features of all open elements.
    """

    __slots__ = ("outer", "fresh", "area", "names", "named", "begins", "closed", "size")

    def __init__(self, outer: Path | None, own: tuple[str, ...], fresh: tuple[str, ...], seen: set[str]) -> None:
        self.outer, self.fresh = outer, fresh
        self.area, self.named, self.closed = (outer.area, outer.named, outer.closed) if outer else (None, False, False)
        self.size = (outer.size if outer else 0) + len(own)
        self.begins, names = False, []
        for feature in own:
            if feature in AREAS:
                self.area, self.named, self.closed, self.begins, names = feature, False, False, True, []
            elif feature.startswith("in:"):
                self.closed = True
            elif self.area and not self.closed:
                self.named = True
                if feature not in (names if self.begins else seen):
                    names.append(feature)
        self.names = tuple(names)


Block = tuple[str, Path | None, int]


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a whole page: text, open elements, and characters inside links.

    White space is one space, references are decoded, ``br`` is white space.
    Unclosed elements end with the element around them; an end tag without its
    start is left out; a page that breaks off is read to its end. The work is
    linear in the page, however deep its elements are nested.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    paths: list[Path] = []
    areas: list[set[str]] = [set()]  # names of each open area
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    levels: list[int] = []  # where in the stack a block-level element is open
    counts: Counter[str] = Counter()  # features of open elements
    pieces: list[tuple[str, bool]] = []
    hidden = links = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                found.append((text, paths[-1] if paths else None, sum(len(p) for p, linked in pieces if linked)))
            pieces.clear()

    def push(tag: str, own: tuple[str, ...]) -> None:
        nonlocal hidden, links
        fresh = tuple(dict.fromkeys(f for f in own if not counts[f]))
        path = Path(paths[-1] if paths else None, own, fresh, areas[-1])
        counts.update(own)
        if path.begins:
            areas.append(set())
        areas[-1].update(path.names)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            levels.append(len(stack))
        stack.append((tag, own))
        paths.append(path)
        hidden += tag in HIDDEN
        links += tag == "a"

    def pop() -> None:
        nonlocal hidden, links
        if stack[-1][0] in BLOCKS:
            flush()
            levels.pop()
        tag, own = stack.pop()
        path = paths.pop()
        if path.begins:
            areas.pop()
        else:
            areas[-1].difference_update(path.names)
        for feature in own:
            counts[feature] -= 1
            if not counts[feature]:
                del counts[feature]
        places[tag].pop()
        hidden -= tag in HIDDEN
        links -= tag == "a"

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            pop()

    at = 0
    while at < len(page):
        hit = TAG.search(page, at)
        text = page[at : hit.start() if hit else len(page)]
        if stack and stack[-1][0] == "head" and text.strip():
            pop()
        if text and not hidden:
            pieces.append((html.unescape(text), links > 0))
        if not hit:
            break
        at = hit.end()
        if not hit[2]:
            continue
        tag = hit[2].lower()
        if hit[1]:
            depth = innermost((tag,))
            if depth < 0 and tag in HEADINGS:  # any heading's end tag ends a heading
                depth = innermost(HEADINGS)
            if depth >= 0:
                pop_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag not in IN_HEAD and stack and stack[-1][0] == "head":
            pop()
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif tag in ("br", "img") and not hidden:
                pieces.append((" ", False))
            continue
        if tag == "body" and hidden:  # a part of the head that is never closed
            while stack and hidden:
                pop()
        if tag in BLOCKS:
            flush()
            while levels and stack[levels[-1]][0] == "p":  # only inline elements are open inside it
                pop_to(levels[-1])
        if tag in ENDS:
            ended, stop = ENDS[tag]
            depth = innermost(ended)
            if depth > innermost(stop):
                pop_to(depth)
        if hit[3].endswith("/") and tag not in BLOCKS:
            continue
        push(tag, _names(tag, hit[3]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return found


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its tag if it is a block, and the parts of its class, id and role."""
    own = [f"in:{tag}"] if tag in BLOCKS or tag in ("a", "b", "span") else []
    if attributes:
        for hit in ATTRIBUTES.finditer(attributes):
            if hit["name"].lower() in ("class", "id", "role"):
                value = hit["double"] or hit["single"] or hit["bare"] or ""
                own += [f"named:{w.lower()}" for w in PART.findall(value)]
                own += [f"name:{w.lower()}" for w in value.split()]
    return tuple(own)


def path_features(path: Path | None) -> list[str]:
    """Features of all open elements, each once, and the innermost area with its names."""
    fresh, names, node, inside = [], [], path, True
    while node:
        fresh.append(node.fresh)
        if inside and node.area:
            names.append(node.names)
            inside = not node.begins
        node = node.outer
    own = [f for part in reversed(fresh) for f in part]
    if path is None or path.area is None:
        return own
    own.append(f"own {path.area}{' named' * path.named}")
    return own + [f"own {f}" for part in reversed(names) for f in part]


def _step(value: float, *limits: float) -> int:
    return sum(value >= limit for limit in limits)


def text_features(block: Block) -> tuple[str, ...]:
    text, path, linked = block
    words = text.count(" ") + 1
    return (
        f"words:{_step(words, 2, 4, 8, 15, 30, 60)}",
        f"linked:{_step(linked / len(text), 0.01, 0.3, 0.6, 0.95)}",
        f"ends:{'stop' if text[-1] in '.!?:;\"' else 'open'}",
        f"sign:{'mark' if '©' in text or '·' in text else 'none'}",
        f"deep:{_step(path.size if path else 0, 3, 5, 8)}",
    )


def chain(found: list[Block]) -> list[tuple[str, ...]]:
    """Features of each block of a page."""
    last = len(found) - 1
    rows = []
    for at, block in enumerate(found):
        ends = (("place:first",) if at == 0 else ()) + (("place:last",) if at == last else ())
        rows.append((*path_features(block[1]), *text_features(block), *ends, "always"))
    return rows


class Model:
    """Weights of the features for label 1 against 0, and of label pairs (from, to)."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]], starts: list[float]) -> None:
        self.weights, self.pairs, self.starts = weights, pairs, starts

    def path_weight(self, path: Path | None, known: dict[Path | None, tuple[float, float]]) -> float:
        """Weight of the features of a path; ``known`` has the sums of the nodes met before on this page."""
        get, new, node = self.weights.get, [], path
        while node not in known:
            new.append(node)
            node = node.outer
        every, names = known[node]
        for node in reversed(new):
            every += sum(get(f, 0.0) for f in node.fresh)
            names = (0.0 if node.begins else names) + sum(get(f"own {f}", 0.0) for f in node.names)
            known[node] = every, names
        if path is None or path.area is None:
            return every
        return every + names + get(f"own {path.area}{' named' * path.named}", 0.0)

    def labels(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not found:
            return []
        get, last, (same0, to1), (to0, same1) = self.weights.get, len(found) - 1, *self.pairs
        back, zero, one = [], 0.0, 0.0
        known: dict[Path | None, tuple[float, float]] = {None: (0.0, 0.0)}
        for at, block in enumerate(found):
            gain = get("always", 0.0) + self.path_weight(block[1], known) + sum(get(f, 0.0) for f in text_features(block))
            gain += get("place:first", 0.0) * (at == 0) + get("place:last", 0.0) * (at == last)
            if at == 0:
                zero, one = self.starts[0], self.starts[1] + gain
                continue
            from0, from1 = (zero + same0, one + to0), (zero + to1, one + same1)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            zero, one = max(from0), max(from1) + gain
        label = int(one > zero)
        labels = [label]
        for choice in reversed(back):
            label = int(choice[label])
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b[0] for b, label in zip(found, self.labels(found), strict=True) if label)


def _labelled(parts: list[tuple[str, int | None]]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page and their labels: those that its text begins with them."""
    found, labels, at = blocks("".join(p for p, _ in parts)), [], 0
    marks = [label for part, label in parts if label is not None for _ in blocks(part)]
    return (found, marks) if len(marks) == len(found) else ([], labels[at:])


def fit(examples: list[list[tuple[str, int | None]]], rounds: int = ROUNDS) -> Model:
    """Weights by gradient ascent on the labels' likelihood; all pages step together, block by block."""
    chains = [(chain(f), y) for f, y in map(_labelled, examples) if f]
    names = {n: i for i, n in enumerate(dict.fromkeys(n for rows, _ in chains for row in rows for n in row))}
    longest = max(len(y) for _, y in chains)
    here = np.zeros((len(chains), longest), bool)
    truth = np.zeros((len(chains), longest), int)
    page, place, feature = [], [], []
    for i, (rows, y) in enumerate(chains):
        here[i, : len(y)] = True
        truth[i, : len(y)] = y
        for t, row in enumerate(rows):
            page += [i] * len(row)
            place += [t] * len(row)
            feature += [names[n] for n in row]
    page, place, feature = map(np.array, (page, place, feature))
    w, pairs, starts = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full(x.shape, 1e-6) for x in (w, pairs, starts)]
    both = here[:, 1:] & here[:, :-1]
    for _ in range(rounds):
        gain = np.zeros(here.shape)
        np.add.at(gain, (page, place), w[feature])
        local = np.stack([np.zeros(here.shape), gain], axis=2)
        ahead, behind = np.zeros(local.shape), np.zeros(local.shape)
        ahead[:, 0] = starts + local[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + pairs[0], ahead[:, t - 1, 1, None] + pairs[1]) + local[:, t]
            ahead[:, t] = np.where(here[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = local[:, t + 1] + behind[:, t + 1]
            step = np.logaddexp(on[:, 0, None] + pairs[:, 0], on[:, 1, None] + pairs[:, 1])
            behind[:, t] = np.where(here[:, t + 1, None], step, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], -50, 0)) * here
        slope = np.bincount(feature, (truth - one)[page, place], len(names)) - PULL * len(chains) * w
        expected = ahead[:, :-1, :, None] + pairs + (local + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(np.clip(expected, -50, 0)) * both[:, :, None, None]
        real = np.zeros((2, 2))
        np.add.at(real, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        start = np.bincount(truth[:, 0], minlength=2) - np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()])
        for x, g, s in zip((w, pairs, starts), (slope, real - expected.sum((0, 1)), start), squares, strict=True):
            s += g * g
            x += STEP * g / np.sqrt(s)
    return Model({n: float(w[i]) for n, i in names.items()}, pairs.tolist(), starts.tolist())


def extract(spark: SparkSession, model: Model, column: str = "html") -> Column:
    """The main text of a whole page as a column; empty for a null page or one without any."""
    held = spark.sparkContext.broadcast((model.weights, model.pairs, model.starts))

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*held.value)
        for some in batches:
            yield pd.Series([own.text(page) for page in some], dtype="string")

    return udf(F.col(column).cast("string"))


def report(pages: DataFrame, training: int = PAGES) -> DataFrame:
    """The registered form: ``page_id, url, text, n_chars`` of every page."""
    model = fit(labelled_pages(training))
    found = pages.select("page_id", "url", extract(pages.sparkSession, model).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
