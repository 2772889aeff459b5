import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from stallwise.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def slow_cost(roles):
    """The least cost over all ways: each turn a role or a merge, empty turns anywhere."""
    best = None
    for plan in product(("system", "user", "assistant", "merge"), repeat=len(roles)):
        state, cost = "start", 0
        for role, new in zip(roles, plan):
            if new == "merge":
                cost += chat.MERGE + (0 if role == state else chat.UNKNOWN if role is None else chat.RELABEL)
                if state == "start":
                    break
                continue
            cost += 0 if role == new else chat.UNKNOWN if role is None else chat.RELABEL
            seen, front = {state: 0}, [state]
            while front:  # breadth first over empty turns
                at = front.pop(0)
                for after in chat.LEGAL[at]:
                    if after not in seen:
                        seen[after] = seen[at] + 1
                        front.append(after)
            direct = [seen[s] for s in seen if new in chat.LEGAL[s]]
            if not direct:
                break
            cost += chat.INSERT * min(direct)
            state = new
        else:
            cost += {"start": 2, "system": 2, "user": 1, "assistant": 0}[state] * chat.INSERT
            best = cost if best is None else min(best, cost)
    return best


def cost_of(roles, changes):
    cost, state = 0, "start"
    for role, (new, action, before) in zip(roles, changes):
        change = 0 if role == new else chat.UNKNOWN if role is None else chat.RELABEL
        merged = action in (chat.MERGED, chat.BOTH)
        for r in before:
            assert r in chat.LEGAL[state]
            state = r
        assert state == new if merged else new in chat.LEGAL[state]
        cost += change + chat.MERGE * merged + chat.INSERT * len(before)
        state = new
    return cost + chat.INSERT * len(chat.ending(state))


def test_repair_is_cheapest():
    dice = random.Random(6)
    for _ in range(150):
        roles = dice.choices(["system", "user", "assistant", None], k=dice.randint(1, 6))
        assert cost_of(roles, chat.repair(roles)) == slow_cost(roles)


def parse(text):
    """Roles and contents of a rendered conversation."""
    found = [part.split("\n", 1) for part in text.split("<|im_start|>")[1:]]
    return [(role, body.removesuffix("<|im_end|>\n")) for role, body in found]


def legal(roles):
    state = "start"
    for role in roles:
        assert role in chat.LEGAL[state]
        state = role
    assert state == chat.LAST


@pytest.mark.parametrize("block", [2, 512])
def test_blocks_cost_as_little_as_the_whole(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    dice, rows, roles = random.Random(7), [], {}
    for conv in range(30):
        roles[conv] = dice.choices(["system", "user", "assistant", "human", "tool", None], k=dice.randint(1, 25))
        rows += [(conv, t, r, f"text {conv} {t}") for t, r in enumerate(roles[conv])]
    dice.shuffle(rows)
    found = {}
    for r in chat.repair_conversations(spark.createDataFrame(rows, TURNS)).collect():
        found.setdefault(r["conv_id"], []).append(r)
    assert found.keys() == roles.keys()
    for conv, changed in found.items():
        changed.sort(key=lambda r: r["turn"])
        known = [chat.known_role(r) for r in roles[conv]]
        changes = [(r["new_role"], r["action"], tuple(r["inserted"].split())) for r in changed]
        assert cost_of(known, changes) == cost_of(known, chat.repair(known))
        turns = parse("".join(r["rendered"] for r in changed))
        legal([role for role, _ in turns])
        assert [line for _, body in turns for line in body.split("\n") if line] == [f"text {conv} {t}" for t in range(len(known))]


def test_awkward_rows(spark):
    long = "word " * 100_000
    rows = [(None, None, None, None), (None, 1, "user", long), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, -3, " System ", ""), (2, 5, "", None), (3, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "block": F.lit("b"), "first": F.lit(2), "new_role": F.lit(3)})
    found = chat.repair_conversations(turns).collect()
    assert len(found) == len(rows) and chat.repair_conversations(turns.limit(0)).count() == 0
    for conv in (None, 1, 2, 3):
        parts = sorted((r for r in found if r["conv_id"] == conv), key=lambda r: (r["turn"] is None, r["turn"], r["action"] != "keep"))
        legal([role for role, _ in parse("".join(r["rendered"] for r in parts))])


def test_no_block_holds_more_than_its_turns(spark, monkeypatch):
    """Turns without an id, of equal numbers, of null numbers and of equal rows are cut into blocks by place."""
    monkeypatch.setattr(chat, "BLOCK", 16)
    kept, roles, texts = {}, ["user", "assistant", "tool", None], ["x", "y" * 2000 + "a", "y" * 2000 + "b"]
    monkeypatch.setattr(chat, "saved", lambda df, purpose, old=chat.saved: kept.setdefault(purpose, old(df, purpose)))
    rows = [(None, i % 8, roles[i % 3], f"{i:03}") for i in range(400)] + [(1, None, roles[i % 4], texts[i % 3]) for i in range(300)]
    rows += [(2, 5, "user", "same")] * 200 + [(3, t, "user", "z") for t in range(3)]
    found = chat.repair_conversations(spark.createDataFrame(rows, TURNS)).collect()
    blocks = {r["key"]: r["count"] for r in kept["chat-costs"].groupBy("key").count().collect()}
    assert blocks == {"": 25, "=1": 19, "=2": 13, "=3": 1} and len(found) == len(rows)
    for conv in (None, 1, 2, 3):
        order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
        parts = [r for r in found if r["conv_id"] == conv]
        assert sorted(map(str, (tuple(r)[:3] for r in parts))) == sorted(str(r[:3]) for r in order)
        known = [chat.known_role(r[2]) for r in order]
        actions = [chat.MERGE * (r["action"] in (chat.MERGED, chat.BOTH)) + chat.INSERT * len(r["inserted"].split()) for r in parts]
        relabels = [0 if (k := chat.known_role(r["role"])) == r["new_role"] else chat.UNKNOWN if k is None else chat.RELABEL for r in parts]
        ends = sum(r["rendered"].count(chat.CLOSE) for r in parts) - sum(r["rendered"].count(chat.OPEN.format(o)) for r in parts for o in chat.STATES[1:])
        left = chat.INSERT * len(chat.ending(chat.repair(known)[-1][0]))
        assert ends == 0 and sum(actions) + sum(relabels) + left == cost_of(known, chat.repair(known))
    # The places are the documented order.
    for conv in ("", "=1", "=2", "=3"):
        placed = chat.in_blocks(spark.createDataFrame(rows, TURNS)).filter(F.col("key") == conv).orderBy("place").collect()
        want = sorted((r for r in rows if ("" if r[0] is None else f"={r[0]}") == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
        assert [(r["place"], r["role"], r["text"]) for r in placed] == [(at, r[2], r[3]) for at, r in enumerate(want)]


def test_blocks_are_combined_in_levels(spark, monkeypatch):
    """Groups of few blocks, three levels deep: a path as cheap as over all turns at once, legal from end to end."""
    import random

    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "FAN", 2)
    dice = random.Random(8)
    roles = {c: [dice.choice(["user", "assistant", "system", "odd", None]) for _ in range(n)] for c, n in (("a", 40), ("b", 7), ("c", 1), (None, 26))}
    rows = [(c, t, r, f"t{t}") for c, of in roles.items() for t, r in enumerate(of)]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = {}
    for r in sorted(chat.repair_conversations(table).collect(), key=lambda r: r["turn"]):
        found.setdefault(r["conv_id"], []).append(r)
    for conv, of in roles.items():
        known = [chat.known_role(r) for r in of]
        best = (chat.block_costs(known)[0] + chat.ENDS).min()
        states = [chat.STATES.index(r["new_role"]) for r in found[conv]]
        cost = sum(chat.COSTS[k][s][q] for k, s, q in zip(known, [0, *states], states)) + chat.ENDS[states[-1]]
        assert cost == best and len(states) == len(of)
        assert "".join(r["rendered"] for r in found[conv]).endswith(chat.CLOSE)
