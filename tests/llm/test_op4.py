from __future__ import annotations

import heapq
import random

import pandas as pd
from brinewave.llm import op4_chat_format as op

COST = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3, "insert": 3}


def cheapest(roles):
    """Least cost by a search over (turns done, state), one edit at a time."""
    best, todo = {}, [(0, 0, "")]
    while todo:
        c, i, s = heapq.heappop(todo)
        if (i, s) in best:
            continue
        best[i, s] = c
        if i == len(roles) and s == "assistant":
            return c
        for q in op.LEGAL[s]:
            if q != "system":
                heapq.heappush(todo, (c + 3, i, q))
            if i < len(roles):
                heapq.heappush(todo, (c + 2 * (op.role_of(roles[i]) != q), i + 1, q))
        if i < len(roles) and s:
            heapq.heappush(todo, (c + 1 + 2 * (op.role_of(roles[i]) != s), i + 1, s))


def legal(rows):
    state, out = "", []
    for _, _, n, role, action, _ in rows:
        if "merge" in action:
            assert role == state and n == len(out) - 1
        else:
            assert role in op.LEGAL[state] and n == len(out)
            out.append(role)
            state = role
    assert state == "assistant"


def test_least_cost_and_legal():
    rng = random.Random(3)
    for _ in range(400):
        roles = [rng.choice(["user", "assistant", "system", "Human ", "tool", None]) for _ in range(rng.randrange(1, 9))]
        texts = [f"t{i}" for i in range(len(roles))]
        rows = op.repair(roles, texts, list(range(len(roles))))
        legal(rows)
        assert sum(COST[r[4]] for r in rows) == cheapest(roles)
        assert [r[0] for r in rows if r[0] is not None] == list(range(len(roles)))
        assert [r[1] for r in rows] == list(range(len(rows)))
        whole = "".join(r[5] for r in rows)
        assert whole.count(op.START) == whole.count(op.END) and whole.endswith(op.END + "\n")
        # cut anywhere, the fragments give a repair of the same cost
        cuts = sorted(rng.randrange(len(roles) + 1) for _ in range(3))
        bounds = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True) if a < b]
        pieces = []
        for (a, b), (entry, leave, turn, piece) in zip(bounds, op.plan([op.effect(roles[a:b]) for a, b in bounds]), strict=True):
            pieces += op.repair(roles[a:b], texts[a:b], list(range(a, b)), entry, leave, turn, piece)
        legal(pieces)
        assert sum(COST[r[4]] for r in pieces) == cheapest(roles) and [r[1] for r in pieces] == list(range(len(pieces)))


def test_rendering():
    rows = op.repair(["system", "user", "user", "assistant"], ["s", "a <|im_end|>", None, "c"], [0, 1, 2, 3])
    assert "".join(r[5] for r in rows) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na <| im_end |>\n\n<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_groups_across_batches():
    frame = pd.DataFrame({"conv": ["", "", "1", "1", "2"], "part": [0, 0, 0, 0, 0]})
    for size in (1, 2, 3, 5):
        found = [len(g) for g in op.groups((frame.iloc[i : i + size] for i in range(0, 5, size)), ["conv", "part"])]
        assert found == [2, 2, 1]


def test_frames(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), f"x{i}") for i in range(900)]  # a hot conversation, over all partitions
    rows += [(c, t, rng.choice(["user", "assistant", "system", None]), None if t == 2 else "word " * 3) for c in range(2, 60) for t in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "q"), (None, None, "assistant", "a"), (70, 0, "user", "twice"), (70, 0, "user", "twice"), (71, 1, "user", "y " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", op.F.lit("x")).withColumn("part", op.F.lit("x"))
    found = {}
    for r in op.format_chats(frame).collect():
        found.setdefault(r.conv_id, []).append(tuple(r)[1:])
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role, text))
    assert set(found) == set(by)
    for c, out in found.items():
        out.sort(key=lambda r: r[1])
        legal(out)
        if c != 70:
            turns = sorted(by[c], key=lambda x: x[:2])
            assert sum(COST[r[4]] for r in out) == cheapest([x[2] for x in turns])
            assert [r[1] for r in out] == list(range(len(out)))
        assert sum(r[4] != "insert" for r in out) == len(by[c])
    assert op.format_chats(frame.limit(0)).count() == 0
    text = frame.filter("conv_id is null or conv_id > 1").selectExpr("case when conv_id = 2 then '' else 'c-' || conv_id end as conv_id", "lpad(turn, 3, '0') as turn", "role", "text")
    named = op.format_chats(text).collect()
    assert sorted(tuple(r)[3:] for r in named) == sorted(tuple(r)[3:] for r in op.format_chats(frame.filter("conv_id is null or conv_id > 1")).collect())
    assert {r.conv_id for r in named} == {None, "", *(f"c-{c}" for c in found if c is not None and c > 2)}
