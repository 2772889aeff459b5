"""Chat formatting by minimum-cost role repair.

Legal conversations may open with one system turn and then alternate user and
assistant, assistant last. For each conversation the cheapest way there is
found: a turn keeps its role, takes another one, or joins the turn before, and
empty turns are inserted. Costs of a stretch of turns form a small matrix from
the state before it to the state after it, and such matrices combine, so long
conversations are repaired in blocks of turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stallwise.llm.common import saved

STATES = ("start", "system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LAST = "assistant"
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
RELABEL, UNKNOWN, MERGE, INSERT = 4, 1, 3, 5
#: Turns in one block.
BLOCK = 512
#: Stretches of a conversation that one task combines into a longer one.
FAN = 512
#: Characters of a text that ranges of turns are told apart by.
PREFIX = 1000
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n"

KEEP, RELABELLED, MERGED, BOTH = "keep", "relabel", "merge", "merge and relabel"


def _inserted(state: str, role: str) -> tuple[str, ...] | None:
    """The fewest empty turns between a state and a role."""
    paths = [()]
    for _ in STATES:
        for path in paths:
            if role in LEGAL[path[-1] if path else state]:
                return path
        paths = [(*p, r) for p in paths for r in LEGAL[p[-1] if p else state]]
    return None


def step(role: str | None, state: str, after: str) -> tuple[float, str, tuple[str, ...]]:
    """Cheapest cost, action and inserted roles that take a turn from ``state`` to ``after``."""
    if after == "start":
        return np.inf, KEEP, ()
    change = 0 if role == after else UNKNOWN if role is None else RELABEL
    between = _inserted(state, after)
    options = []
    if between is not None:
        options.append((INSERT * len(between) + change, RELABELLED if change else KEEP, between))
    if state == after:
        options.append((MERGE + change, BOTH if change else MERGED, ()))
    return min(options, key=lambda o: o[0], default=(np.inf, KEEP, ()))


def ending(state: str) -> tuple[str, ...]:
    """Empty turns that complete a conversation."""
    return () if state == LAST else (*(_inserted(state, LAST) or ()), LAST)


ROLES = (*STATES[1:], None)
STEPS = {role: [[step(role, s, q) for q in STATES] for s in STATES] for role in ROLES}
COSTS = {role: np.array([[x[0] for x in row] for row in STEPS[role]]) for role in ROLES}
ENDS = np.array([INSERT * len(ending(s)) for s in STATES], float)


def known_role(role: str | None) -> str | None:
    name = role.strip().lower() if isinstance(role, str) else ""
    name = ALIASES.get(name, name)
    return name if name in STATES[1:] else None


def combine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Costs over two stretches."""
    return (first[:, :, None] + then[None]).min(axis=1)


def block_costs(roles: list[str | None]) -> np.ndarray:
    found = np.where(np.eye(len(STATES), dtype=bool), 0.0, np.inf)
    for role in roles:
        found = combine(found, COSTS[role])
    return found


def best_path(costs: list[np.ndarray], entry: np.ndarray, leave: np.ndarray) -> list[int]:
    """States before, between and after stretches, at the least cost; ties go to the state named first."""
    ahead = [entry]
    for cost in costs:
        ahead.append((ahead[-1][:, None] + cost).min(axis=0))
    path = [int((ahead[-1] + leave).argmin())]
    for cost, before in zip(reversed(costs), reversed(ahead[:-1]), strict=True):
        path.append(int((before + cost[:, path[-1]]).argmin()))
    return path[::-1]


def _only(state: int) -> np.ndarray:
    return np.where(np.arange(len(STATES)) == state, 0.0, np.inf)


def repair(roles: list[str | None], entry: int = 0, leave: int | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """New role, action and roles inserted before, for each turn of a stretch."""
    path = best_path([COSTS[r] for r in roles], _only(entry), ENDS if leave is None else _only(leave))
    return [(STATES[q], *STEPS[r][s][q][1:]) for r, s, q in zip(roles, path, path[1:], strict=False)]


def rendered(text: str, change: tuple[str, str, tuple[str, ...]], first: bool, last: bool) -> str:
    """A turn's part of the conversation's text; the parts in order are the whole of it."""
    role, action, before = change
    empty = lambda roles: "".join(OPEN.format(r) + CLOSE for r in roles)
    merged = action in (MERGED, BOTH)
    head = JOIN if merged else ("" if first else CLOSE) + empty(before) + OPEN.format(role)
    return head + text + (CLOSE + empty(ending(role)) if last else "")


def _groups(batches: Iterator[pd.DataFrame], columns: list[str], keys: int) -> Iterator[list[tuple]]:
    """Rows of whole groups, where the rows of a group follow each other; the first columns are the keys."""
    rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[:keys]):
        yield list(group)


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 2000) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, numbered within their key from its first row in this task."""
    last, place = None, 0
    for batch in batches:
        places = []
        for key in batch["key"]:
            last, place = key, place + 1 if key == last else 0
            places.append(place)
        yield batch.assign(place=np.array(places, np.int64))


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ["key", "block", "role"], 2):
            roles = [known_role(r) for _, _, r in group]
            yield *group[0][:2], block_costs(roles).ravel().tolist(), " ".join(r or "" for r in roles)

    return _frames(rows(), ["key", "block", "cost", "roles"])


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The costs over the stretches of each group."""
    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ["key", "group", "cost"], 2):
            costs = [np.array(c).reshape(len(STATES), -1) for *_, c in group]
            yield *group[0][:2], reduce(combine, costs).ravel().tolist()

    return _frames(rows(), ["key", "block", "cost"])


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states between the stretches of each group, at the least cost from its entry to its leave (null: any end)."""
    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ["key", "group", "block", "cost", "from", "to", "begins", "ends"], 2):
            *_, entry, leave, begins, ends = group[0]
            path = best_path([np.array(row[3]).reshape(len(STATES), -1) for row in group], _only(int(entry)), ENDS if leave != leave or leave is None else _only(int(leave)))
            for at, (key, _, block, *_) in enumerate(group):
                yield key, block, path[at], path[at + 1], bool(begins) and at == 0, bool(ends) and at == len(group) - 1

    return _frames(rows(), ["key", "block", "entry", "leave", "first", "last"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns of blocks, one at a time; a row of the block's known roles and states comes before its turns."""
    columns = ["place", "entry", "leave", "first", "last", "conv_id", "turn", "role", "text"]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for place, *block, conv_id, turn, role, text in zip(*(batch[c].tolist() for c in columns), strict=True):
                if place < 0:
                    entry, leave, first, last = block
                    changes = repair([r or None for r in role.split(" ")], int(entry), int(leave))
                    at = 0
                    continue
                change, text = changes[at], text if isinstance(text, str) else ""
                piece = rendered(text, change, first and at == 0, last and at == len(changes) - 1)
                at += 1
                yield conv_id, turn, role, change[0], change[1], " ".join(change[2]), piece

    return _frames(rows(), ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"])


def in_blocks(turns: DataFrame) -> DataFrame:
    """``key, block, place, conv_id, turn, role, text``: turns by their place in the conversation, ``BLOCK`` to a block.

    All turns are dealt out in order by ranges, so that a conversation of any
    share of the rows is spread, and numbered in each range; a conversation
    that goes on in a range starts where the ranges before it end. Equal rows
    are told apart by a running number. Texts that differ only after ``PREFIX``
    characters stay in one range, so that the sampled bounds are small.
    """
    text = F.col("text").cast("string")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"), F.col("turn").alias("at"),
        F.coalesce(F.length(text) > PREFIX, F.lit(False)).alias("long"), F.monotonically_increasing_id().alias("salt"),
    )
    start = ["key", F.col("at").asc_nulls_last(), "role"]
    dealt = rows.repartitionByRange(*start, F.substring("text", 1, PREFIX), "long", F.when(~F.col("long"), F.col("salt")))
    dealt = dealt.sortWithinPartitions(*start, "text").select("key", F.spark_partition_id().alias("range"), "conv_id", "turn", "role", "text")
    schema = "key string, range int, conv_id string, turn string, role string, text string, place long"
    dealt = saved(dealt.mapInPandas(_places, schema), "chat-turns")
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("_n"))
    # At most one conversation goes on in a range.
    starts = counts.select("key", "range", before.alias("_before")).filter(F.col("_before").isNotNull())
    placed = dealt.join(F.broadcast(starts), ["key", "range"], "left")
    placed = placed.withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0)))
    return placed.select("key", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "place", "conv_id", "turn", "role", "text")


def block_states(blocks: DataFrame) -> DataFrame:
    """``key, block, entry, leave, first, last`` of each stretch ``key, block, cost``: the states around it in the cheapest repair.

    Stretches are combined ``FAN`` at a time until a conversation has no more
    than that; states are then handed down again, each group on its own.
    """
    shape = "key string, block long, entry int, leave int, first boolean, last boolean"
    levels = [blocks]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= FAN:
        grouped = levels[-1].withColumn("group", F.floor(F.col("block") / FAN).cast("long"))
        grouped = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "block").select("key", "group", "cost")
        levels.append(saved(grouped.mapInPandas(_combined, "key string, block long, cost array<double>"), "chat-costs"))
    top = levels.pop().select(
        "key", F.lit(0).cast("long").alias("group"), "block", "cost", F.lit(0).alias("from"), F.lit(None).cast("int").alias("to"),
        F.lit(True).alias("begins"), F.lit(True).alias("ends"),
    )
    found = saved(top.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_states, shape), "chat-states")
    for level in reversed(levels):
        around = found.select(
            "key", F.col("block").alias("group"), F.col("entry").alias("from"), F.col("leave").alias("to"),
            F.col("first").alias("begins"), F.col("last").alias("ends"),
        )
        inner = level.withColumn("group", F.floor(F.col("block") / FAN).cast("long")).join(around, ["key", "group"])
        inner = inner.repartition("key", "group").sortWithinPartitions("key", "group", "block")
        found = saved(inner.mapInPandas(_states, shape), "chat-states")
    return found


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, new_role, action, inserted, rendered``.

    The ``rendered`` parts of a conversation, by turn, are its repaired text.
    Turns are in order of number (null last), role and text; turns of null
    ``conv_id`` form one conversation. A null or unknown role takes whichever
    role is cheapest; a null text is empty. Turns are read one at a time; the
    blocks of a conversation, a small matrix each, are combined in levels.
    """
    id_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows = in_blocks(turns)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("key", "block").sortWithinPartitions("key", "block", "place")

    costs = in_order(rows.select("key", "block", "place", "role")).select("key", "block", "role")
    blocks = saved(costs.mapInPandas(_costs, "key string, block long, cost array<double>, roles string"), "chat-costs")
    states = block_states(blocks.select("key", "block", "cost"))
    heads = states.join(blocks.select("key", "block", F.col("roles").alias("role")), ["key", "block"]).withColumn("place", F.lit(-1).cast("long"))
    met = in_order(rows.unionByName(heads, allowMissingColumns=True))
    schema = "conv_id string, turn string, role string, new_role string, action string, inserted string, rendered string"
    return met.mapInPandas(_pieces, schema).withColumns({"conv_id": F.col("conv_id").cast(id_kind), "turn": F.col("turn").cast(turn_kind)})
