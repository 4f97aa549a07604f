"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant messages in turn, the assistant's last.
For every turn a dynamic program over the automaton of last roles chooses to keep it, to merge it into the message
before (same role), to give it another role, or to put an empty message before it, at least total cost; empty
messages may also end the conversation. The repaired sequence is rendered turn by turn: joining the fragments of a
conversation in (seq, part) order gives its text.

A conversation of any length is repaired without gathering it: turns get global row numbers and are cut into blocks
of ``BLOCK`` turns from the conversation's start. Each block of a long conversation is first reduced to the 4 x 4
table of least costs between last roles; the tables of a conversation (one row per block) are folded in order, which
gives the role each block starts from and ends in; then all blocks are repaired at the same time.

Defined cases: an unknown or null role costs ``UNKNOWN`` whatever it becomes; a null text is an empty message;
template marks inside a text are broken by a backslash; turns are ordered by (turn, role, text), nulls first, and
repeated rows are turns of their own; a null conversation id is a conversation of its own; an empty table gives an
empty result. Among repairs of equal cost the order keep, merge, insert before, and user, assistant, system decides
at each turn from the end backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import in_order
from docwarden.session import settle

BLOCK = 4096
RELABEL, MERGE, INSERT, UNKNOWN = 3, 1, 2, 1
#: Last role of what has been written; 0: nothing yet.
ROLES = ("", "user", "assistant", "system")
KNOWN = {"user": 1, "human": 1, "assistant": 2, "gpt": 2, "bot": 2, "system": 3}
NEXT = {0: (3, 1), 3: (1,), 1: (2,), 2: (1,)}
FAR = 1 << 40


def _moves() -> list[list[tuple[int, int, str, tuple[int, ...]]]]:
    """For each role given to a turn: (state before, cost, action, roles put in before), cheapest first."""
    out: list[list] = [[] for _ in ROLES]
    for role in (1, 2, 3):
        for state in range(len(ROLES)):
            if role in NEXT[state]:
                out[role].append((state, 0, "keep", ()))
            elif role == state:
                out[role].append((state, MERGE, "merge", ()))
            for between in NEXT[state]:
                if role in NEXT[between]:
                    out[role].append((state, INSERT, "insert", (between,)))
    return out


MOVES = _moves()
#: Empty messages that end a conversation from a state.
CLOSING = {0: (), 1: (2,), 2: (), 3: (1, 2)}


def _role_cost(given: int, role: int) -> int:
    return 0 if given == role else (UNKNOWN if given == 0 else RELABEL)


def given_role(role: str | None) -> int:
    return KNOWN.get((role or "").strip().lower(), 0)


def step(costs: np.ndarray, given: int) -> tuple[np.ndarray, list]:
    """Least costs (starts x states) after one more turn, and for each start and state the move that gives them."""
    out = np.full_like(costs, FAR)
    back = [[None] * len(ROLES) for _ in range(len(costs))]
    for role in (1, 2, 3):
        label = _role_cost(given, role)
        for state, cost, action, between in MOVES[role]:
            for s in range(len(costs)):
                total = costs[s, state] + cost + label
                if total < out[s, role]:
                    out[s, role] = total
                    back[s][role] = (state, action, between)
    return out, back


def table_of(roles: list[int]) -> np.ndarray:
    """Least cost from every state before to every state after some turns."""
    costs = np.full((len(ROLES), len(ROLES)), FAR, np.int64)
    np.fill_diagonal(costs, 0)
    for given in roles:
        costs = np.minimum(step(costs, given)[0], FAR)
    return costs


def path(roles: list[int], start: int, end: int | None) -> tuple[list[tuple[int, str, tuple[int, ...]]], int]:
    """(role, action, roles put in before) of each turn on a least-cost way, and the state it ends in.

    Without ``end`` the way ends where closing it is cheapest.
    """
    costs = np.full((1, len(ROLES)), FAR, np.int64)
    costs[0, start] = 0
    backs = []
    for given in roles:
        costs, back = step(costs, given)
        backs.append(back[0])
    if end is None:
        end = best_end(costs[0])
    chosen, state = [], end
    for back in reversed(backs):
        before, action, between = back[state]
        chosen.append((state, action, between))
        state = before
    return chosen[::-1], end


def best_end(costs: np.ndarray) -> int:
    closed = [(int(costs[s]) + INSERT * len(CLOSING[s]), i) for i, s in enumerate((2, 1, 3, 0))]
    return (2, 1, 3, 0)[min(closed)[1]]


def fold(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """(start, end) states of each block of a conversation from the blocks' tables in order."""
    costs = np.full(len(ROLES), FAR, np.int64)
    costs[0] = 0
    reached = []
    for t in tables:
        total = costs[:, None] + t
        reached.append(total.argmin(axis=0))
        costs = np.minimum(total.min(axis=0), FAR)
    end, out = best_end(costs), []
    for before in reversed(reached):
        out.append((int(before[end]), end))
        end = int(before[end])
    return out[::-1]


def _clean(text: str | None) -> str:
    return "" if text is None else text.replace("<|im_start|>", "<\\|im_start|>").replace("<|im_end|>", "<\\|im_end|>")


def _open(role: int, first: bool) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n"


OUTPUT = "conv_id string, turn string, seq long, part int, action string, given string, role string, cost int, fragment string"


def _repaired(block: pd.DataFrame) -> Iterator[tuple]:
    """Output rows of one block; ``start`` and ``end`` are set in the blocks of long conversations."""
    given = [given_role(r) for r in block["role"]]
    head, last = block.iloc[0], block["seq"].iloc[-1] + 1 == block["turns"].iloc[-1]
    known = not pd.isna(head["start"])
    start = int(head["start"]) if known else 0
    moves, end = path(given, start, int(head["end"]) if known else None)
    conv = head["conv_id"]
    state = start
    for (role, action, between), was, turn, seq, name, text in zip(
        moves, given, block["turn"], block["seq"], block["role"], block["text"], strict=True
    ):
        seq = int(seq)
        for put in between:
            yield conv, None, seq, 0, "insert", None, ROLES[put], INSERT, _open(put, state == 0)
            state = put
        relabelled = _role_cost(was, role)
        shown = "relabel" if relabelled else "keep"
        if action == "merge":
            shown, opening = "merge" if not relabelled else "relabel and merge", "\n\n"
        else:
            opening = _open(role, state == 0)
        cost = relabelled + (MERGE if action == "merge" else 0)
        yield conv, turn, seq, 1, shown, name, ROLES[role], cost, opening + _clean(text)
        state = role
    if last:
        for i, put in enumerate(CLOSING[end]):
            yield conv, None, seq, 2 + i, "insert", None, ROLES[put], INSERT, _open(put, False)
        yield conv, None, seq, 9, "end", None, None, 0, "<|im_end|>\n"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks out of batches sorted by (group, row number); at most one block is held over."""
    held = pd.DataFrame()
    for batch in batches:
        rows = pd.concat([held, batch], ignore_index=True) if len(held) else batch
        cut = np.flatnonzero(np.concatenate(([True], rows["group"].to_numpy()[1:] != rows["group"].to_numpy()[:-1])))
        for a, b in zip(cut, cut[1:], strict=False):
            yield rows.iloc[a:b]
        held = rows.iloc[cut[-1] :] if len(rows) else rows
    if len(held):
        yield held


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per turn, empty message and end mark, with the rendered fragment."""
    rows, _ = in_order(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), ["conv_id", "turn", "role", "text"])
    rows = settle(rows)
    sizes = settle(rows.groupBy("conv_id").agg(F.min("row_no").alias("first"), F.count("*").alias("turns"))).withColumnRenamed("conv_id", "c")
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("seq", F.col("row_no") - F.col("first"))
    # the number of a block's first row is a name for it
    rows = rows.withColumn("group", F.col("first") + F.floor(F.col("seq") / block) * block).drop("c")
    long_ones = rows.filter(F.col("turns") > block).select("first", "group", "row_no", "role")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(batches):
            table = table_of([given_role(r) for r in part["role"]])
            yield pd.DataFrame({"first": [part["first"].iloc[0]], "group": [part["group"].iloc[0]], "costs": [table.ravel().tolist()]})

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("group")
        ways = fold([np.asarray(c, np.int64).reshape(len(ROLES), len(ROLES)) for c in part["costs"]])
        return pd.DataFrame({"group": part["group"], "start": [a for a, _ in ways], "end": [b for _, b in ways]})

    reduced = long_ones.repartition("group").sortWithinPartitions("group", "row_no").mapInPandas(tables, "first long, group long, costs array<long>")
    states = settle(reduced.groupBy("first").applyInPandas(folded, "group long, start int, end int"))

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        out: list[tuple] = []
        for part in _blocks(batches):
            out.extend(_repaired(part))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return (
        rows.join(states, "group", "left")
        # numbers with nulls would become floating-point numbers on the way
        .select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "seq", "turns", "group", "row_no", "start", "end")
        .repartition("group")
        .sortWithinPartitions("group", "row_no")
        .mapInPandas(repaired, OUTPUT)
        .withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    )
