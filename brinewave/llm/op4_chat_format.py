"""Chat formatting: minimum-cost role repair, then rendering.

Legal sequences of turns are those of an automaton: at most one system turn, at
the start; then user and assistant in alternation, a user first and an
assistant last. Dynamic programming over the automaton's states chooses, for
every turn, to keep it, to relabel it, to merge it into the turn before it, and
where to insert empty turns, at the least total cost (``COSTS``).

A conversation is not gathered into one task. Rows are range-partitioned by
conversation and turn; a conversation that lies in several partitions is cut
into a fragment for each. The effect of a fragment on the automaton is a
min-plus matrix of 4 x 4 costs, so the fragments' entry and exit states follow
from their matrices, of which there are at most two for each partition, and all
fragments are then repaired on their own.

The result has a row for each input turn and each inserted one; the pieces of a
conversation, in order of ``piece_no``, are its rendered text.

Defined results: a null or unknown role costs a relabelling; a null text is
empty; a null conversation id is one conversation; ids and numbers can be of any
type that sorts and reads back from its text; turns are ordered by number (nulls first), repeated numbers by a hash of role and text, and equal rows are
interchangeable; the delimiters are broken up where a text contains them; an
empty table gives an empty result. Of repairs that cost the same the first by
(state before, merge before new turn) is taken, from the conversation's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
COSTS = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
START, END = "<|im_start|>", "<|im_end|>"
JOIN = "\n\n"

#: States: nothing yet, or the role of the last turn.
STATES = ("", SYSTEM, USER, ASSISTANT)
LEGAL = {"": (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INF = 1 << 40


def _insertions() -> dict[tuple[str, str], tuple[str, ...]]:
    """The fewest empty turns that lead from a state to another."""
    found: dict[tuple[str, str], tuple[str, ...]] = {(s, s): () for s in STATES}
    for _ in STATES:
        for (s, t), path in list(found.items()):
            for q in LEGAL[t]:
                if q != SYSTEM and ((s, q) not in found or len(path) + 1 < len(found[s, q])):
                    found[s, q] = (*path, q)
    return found


INSERTIONS = _insertions()


def _options() -> dict[str, list[list[tuple[int, int, tuple[str, ...], bool]]]]:
    """role -> state after -> (state before, cost, roles inserted first, merged)."""
    out = {}
    for role in (*STATES[1:], "other"):
        out[role] = [[] for _ in STATES]
        for k, after in enumerate(STATES[1:], 1):
            label = 0 if role == after else COSTS["relabel"]
            for j, before in enumerate(STATES):
                if before == after:
                    out[role][k].append((j, COSTS["merge"] + label, (), True))
                ways = [INSERTIONS[before, p] for p in STATES if (before, p) in INSERTIONS and after in LEGAL[p]]
                if ways:
                    path = min(ways, key=len)
                    out[role][k].append((j, len(path) * COSTS["insert"] + label, path, False))
    return out


OPTIONS = _options()
#: From a state to the end, an assistant's turn: the roles inserted.
CLOSING = [INSERTIONS[s, ASSISTANT] for s in STATES]


def role_of(role: object) -> str:
    return ALIASES.get(role.strip().lower(), "other") if isinstance(role, str) else "other"


def forward(roles: list[str], entry: int) -> tuple[list[int], list[list[int]]]:
    """Costs of the states after the turns, from ``entry``, and for each turn
    and state the option taken."""
    cost = [INF] * 4
    cost[entry] = 0
    taken = []
    for role in roles:
        new, how = [INF] * 4, [-1] * 4
        for k, options in enumerate(OPTIONS[role]):
            for i, (j, c, _, _) in enumerate(options):
                if cost[j] + c < new[k]:
                    new[k], how[k] = cost[j] + c, i
        taken.append(how)
        cost = new
    return cost, taken


def backward(roles: list[str], taken: list[list[int]], state: int) -> list[tuple[int, tuple[str, ...], bool]]:
    """(state after, roles inserted before, merged) of each turn, ending in ``state``."""
    out = []
    for role, how in zip(reversed(roles), reversed(taken), strict=True):
        before, _, path, merged = OPTIONS[role][state][how[state]]
        out.append((state, path, merged))
        state = before
    return out[::-1]


def last_state(cost: list[int]) -> int:
    return min(range(1, 4), key=lambda k: (cost[k] + len(CLOSING[k]) * COSTS["insert"], k))


def safe(text: object) -> str:
    text = text if isinstance(text, str) else ""
    return text.replace(START, "<| im_start |>").replace(END, "<| im_end |>")


def repair(roles: list[object], texts: list[object], turns: list[object], entry: int = 0, leave: int | None = None, out_turn: int = 0, piece: int = 0) -> list[tuple]:
    """(turn, piece_no, out_turn, role, action, piece) of a fragment; ``leave``
    is its exit state, or None at the conversation's end."""
    named = [role_of(r) for r in roles]
    cost, taken = forward(named, entry)
    steps = backward(named, taken, last_state(cost) if leave is None else leave)
    out: list[tuple] = []

    def emit(turn: object, role: str, action: str, text: str) -> None:
        nonlocal out_turn, piece
        head = f"{END}\n" * (out_turn > 0) + f"{START}{role}\n"
        out.append((turn, piece, out_turn, role, action, head + text))
        out_turn, piece = out_turn + 1, piece + 1

    for (state, path, merged), role, text, turn in zip(steps, named, texts, turns, strict=True):
        for extra in path:
            emit(None, extra, "insert", "")
        if merged:
            out.append((turn, piece, out_turn - 1, STATES[state], "merge" if role == STATES[state] else "relabel+merge", JOIN + safe(text)))
            piece += 1
        else:
            emit(turn, STATES[state], "keep" if role == STATES[state] else "relabel", safe(text))
    if leave is None:
        for extra in CLOSING[steps[-1][0]] if steps else ():
            emit(None, extra, "insert", "")
        if out:
            out[-1] = (*out[-1][:5], out[-1][5] + f"{END}\n")
    return out


def effect(roles: list[object]) -> list[tuple[int, int, int, int, int]]:
    """(entry, exit, cost, turns put out, pieces) of a fragment."""
    named = [role_of(r) for r in roles]
    out = []
    for entry in range(4):
        cost, taken = forward(named, entry)
        for leave in range(4):
            if cost[leave] < INF:
                steps = backward(named, taken, leave)
                inserted = sum(len(path) for _, path, _ in steps)
                out.append((entry, leave, cost[leave], inserted + sum(not m for *_, m in steps), inserted + len(steps)))
    return out


def plan(fragments: list[list[tuple[int, int, int, int, int]]]) -> list[tuple[int, int | None, int, int]]:
    """(entry, exit, first turn, first piece) of each fragment of a conversation."""
    costs, back = [[0, INF, INF, INF]], []
    for rows in fragments:
        new, how = [INF] * 4, [(-1, 0, 0)] * 4
        for entry, leave, c, n, p in sorted(rows):
            if costs[-1][entry] + c < new[leave]:
                new[leave], how[leave] = costs[-1][entry] + c, (entry, n, p)
        costs.append(new)
        back.append(how)
    state, chosen = last_state(costs[-1]), []
    for how in reversed(back):
        entry, n, p = how[state]
        chosen.append((entry, state, n, p))
        state = entry
    out, turn, piece = [], 0, 0
    for k, (entry, leave, n, p) in enumerate(reversed(chosen)):
        out.append((entry, None if k == len(chosen) - 1 else leave, turn, piece))
        turn, piece = turn + n, piece + p
    return out


def groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of a sorted stream, across its batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = list(zip(*(frame[c] for c in by), strict=True))
        change = np.fromiter((x != y for x, y in zip(keys, keys[1:], strict=False)), bool, len(keys) - 1)
        cuts = np.flatnonzero(change) + 1
        parts = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True)]
        if held and any(held[-1][c].iloc[-1] != parts[0][c].iloc[0] for c in by):
            yield pd.concat(held)
            held = []
        held.append(parts[0])
        for part in parts[1:]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


OUT = "conv string, turn_text string, piece_no long, out_turn long, role string, action string, piece string"


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    spark = turns.sparkSession
    # ids travel as text, as a nullable integer of pandas would be a float
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv")
    rows = turns.select(name, F.col(turn).alias("turn"), F.col(turn).cast("string").alias("turn_text"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv", "turn", "h", "nth"]
    ranged = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = stash(ranged.withColumn("part", F.spark_partition_id()), "op4-placed")
    # a boundary between partitions cuts one conversation, so these are few
    cut = placed.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select(F.col("conv").alias("c"))
    dealt = placed.repartition("part", "conv")

    def effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, ["conv", "part"]):
            yield pd.DataFrame([(group.conv.iloc[0], group.part.iloc[0], *x) for x in effect(group.role.tolist())], columns=["conv", "part", "entry", "exit", "cost", "n", "pieces"])

    broken = dealt.join(F.broadcast(cut), dealt["conv"] == F.col("c")).drop("c", "text").sortWithinPartitions("conv", "part", "turn", "h", "nth")
    found: dict[object, dict[int, list]] = {}
    for r in broken.mapInPandas(effects, "conv string, part int, entry int, exit int, cost long, n long, pieces long").collect():
        found.setdefault(r["conv"], {}).setdefault(r["part"], []).append((r["entry"], r["exit"], r["cost"], r["n"], r["pieces"]))
    plans = {}
    for c, parts in found.items():
        for part, how in zip(sorted(parts), plan([parts[k] for k in sorted(parts)]), strict=True):
            plans[c, part] = how
    shared = spark.sparkContext.broadcast(plans)  # two for each partition at most

    def repairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in groups(frames, ["conv", "part"]):
            c = group.conv.iloc[0]
            entry, leave, first, piece = shared.value.get((c, int(group.part.iloc[0])), (0, None, 0, 0))
            out += [(c, *x) for x in repair(group.role.tolist(), group.text.tolist(), group.turn_text.tolist(), entry, leave, first, piece)]
            if len(out) > 5000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    done = dealt.sortWithinPartitions("conv", "part", "turn", "h", "nth").mapInPandas(repairs, OUT)
    key = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(turns.schema[conv].dataType))
    return done.select(key.alias(conv), F.col("turn_text").cast(turns.schema[turn].dataType).alias("turn"), "piece_no", "out_turn", "role", "action", "piece")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "turn_text", "piece_no", "out_turn", "role", "action", "piece"])


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
