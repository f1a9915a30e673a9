"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with
the assistant.  Every recorded turn is kept, relabelled, or merged into the turn before it, and
empty turns may be inserted; each repair has a cost, and dynamic programming over the automaton
of legal turns finds the cheapest repair.

One step of that programme is a matrix of costs from state to state, and matrices combine in
the (min, +) algebra in any grouping.  So a long conversation is cut into segments: every
segment yields its matrix, the few matrices of a conversation are chained, and each segment is
then repaired alone between the states it was given.  No conversation has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.storage import stored

ROLES = ("system", "user", "assistant")
# Other names for the roles: fixed values.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow a state, and the state a conversation must end in.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = ASSISTANT
#: Template of a rendered turn.
TEMPLATE = "<|{role}|>\n{text}\n"


@dataclass(frozen=True)
class Costs:
    """Costs of repairs; a turn without a known role takes any role for ``name``."""

    merge: int = 1
    insert: int = 3
    relabel: int = 4
    name: int = 0
    to_system: int = 8


def fillers(costs: Costs) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """Cost and inserted roles of the cheapest way from a state to another role's turn (or, to
    state ``START``, to the end).  Inserted turns are user or assistant."""
    best = {}
    for state in range(4):
        for goal in (SYSTEM, USER, ASSISTANT, START):
            paths = [((), state)]
            for inserted, at in paths:
                if (goal == START and at == END) or goal in LEGAL[at]:
                    best[state, goal] = (costs.insert * len(inserted), inserted)
                    break
                if len(inserted) < 3:
                    paths += [((*inserted, r), r) for r in LEGAL[at] if r != SYSTEM]
    return best


def choices(role: int | None, state: int, costs: Costs, fill: dict) -> list[tuple[int, int, tuple[int, ...], str]]:
    """Ways to take a turn: cost, role, roles inserted before it, action.  In order of preference."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        named = role is None
        change = (costs.name if to != SYSTEM else costs.to_system) if named else 0 if to == role else (costs.to_system if to == SYSTEM else costs.relabel)
        action = "keep" if to == role else "relabel"
        if to == state:
            out.append((change + costs.merge, to, (), "merge"))
        if (state, to) in fill:
            extra, inserted = fill[state, to]
            out.append((change + extra, to, inserted, action))
    return sorted(out, key=lambda c: (c[0], {"keep": 0, "merge": 1, "relabel": 2}[c[3]], len(c[2]), c[1]))


class Repair:
    """Automaton steps for every role code (-1: unknown), made once."""

    def __init__(self, costs: Costs = Costs()):
        self.fill = fillers(costs)
        self.ways = {(role, s): choices(None if role < 0 else role, s, costs, self.fill) for role in (-1, SYSTEM, USER, ASSISTANT) for s in range(4)}
        self.steps = {role: self._matrix(role) for role in (-1, SYSTEM, USER, ASSISTANT)}
        self.ends = np.array([self.fill[s, START][0] if (s, START) in self.fill else np.inf for s in range(4)])

    def _matrix(self, role: int) -> np.ndarray:
        m = np.full((4, 4), np.inf)
        for s in range(4):
            for cost, to, _, _ in self.ways[role, s]:
                m[s, to] = min(m[s, to], cost)
        return m

    def matrix(self, roles: list[int]) -> np.ndarray:
        """Costs from the state before a segment to the state after it."""
        m = np.full((4, 4), np.inf)
        np.fill_diagonal(m, 0)
        for role in roles:
            m = (m[:, :, None] + self.steps[role][None, :, :]).min(axis=1)
        return m

    def path(self, roles: list[int], first: int, last: int) -> list[tuple[int, tuple[int, ...], str]]:
        """Cheapest (role, inserted, action) of each turn between two states."""
        ahead = [np.where(np.arange(4) == last, 0.0, np.inf)]
        for role in reversed(roles):
            ahead.append((self.steps[role] + ahead[-1][None, :]).min(axis=1))
        ahead.reverse()
        out, state = [], first
        for i, role in enumerate(roles):
            cost, to, inserted, action = min(self.ways[role, state], key=lambda c: c[0] + ahead[i + 1][c[1]])
            out.append((to, inserted, action))
            state = to
        return out


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else -1


#: Stand for a NULL conversation and a NULL turn inside the jobs; sorted first and last.
NO_CONVERSATION, NO_TURN = -(1 << 63), (1 << 63) - 1
OUTPUT = "conv_id long, turn long, place long, part int, role string, action string, rendered string"
BATCH_ROWS = 8192


def _segments(turns: DataFrame) -> DataFrame:
    """Turns in order over range partitions; a segment is what a conversation has in one."""
    conv, turn = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("segment", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())


def _in_segments(rows: DataFrame) -> DataFrame:
    """Segments whole and in order again after a read or a join."""
    return rows.repartition("segment").sortWithinPartitions("segment", "at")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, list]]:
    """The turns of one conversation in one segment, as lists by column."""
    rest: pd.DataFrame | None = None
    for frame in chain(frames, [None]):
        if frame is not None:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if rest is None or not len(rest):
            continue
        conv, segment = rest["conv_id"].to_numpy(), rest["segment"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((conv[1:] != conv[:-1]) | (segment[1:] != segment[:-1])) + 1, [len(rest)]])
        whole = cut if frame is None else cut[:-1]  # the last run may go on in the next batch
        columns = {c: rest[c].tolist() for c in rest.columns}
        for lo, hi in zip(whole[:-1], whole[1:], strict=True):
            yield {c: v[lo:hi] for c, v in columns.items()}
        rest = rest.iloc[whole[-1] :].reset_index(drop=True)


def _state_rows(machine: Repair, steps: list[np.ndarray]) -> list[tuple[int, int, bool]]:
    """Cheapest states before and behind each segment of a whole conversation."""
    ahead = [machine.ends]
    for m in reversed(steps):
        ahead.append((m + ahead[-1][None, :]).min(axis=1))
    ahead.reverse()
    state, out = START, []
    for i, m in enumerate(steps):
        then = int(np.argmin(m[state] + ahead[i + 1]))
        out.append((state, then, i == len(steps) - 1))
        state = then
    return out


def segment_states(turns: DataFrame, machine: Repair) -> DataFrame:
    """``conv_id``, ``segment``, ``first``, ``last`` (states around it), ``final``, ``before`` (rows
    of the conversation in earlier segments).

    Only the first and the last conversation of a segment can go on in another one, so at most
    two rows per partition are chained; all others are settled where they lie."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list] = []
        for run in _runs(frames):
            m = machine.matrix([role_code(r) for r in run["role"]])
            edge = not out or out[-1][1] != run["segment"][0]
            if edge and out:
                out[-1][5] = True
            (first, last, final), = _state_rows(machine, [m])
            out.append([run["conv_id"][0], run["segment"][0], first, last, final, edge, m.ravel().tolist(), len(run["role"])])
            if len(out) > BATCH_ROWS:
                yield _frame(out[:-1])
                out = out[-1:]
        if out:
            out[-1][5] = True
        yield _frame(out)

    def _frame(rows: list[list]) -> pd.DataFrame:
        rows = [[*r[:5], 0, r[5], r[6] if r[5] else None, r[7]] for r in rows]
        return pd.DataFrame(rows, columns=["conv_id", "segment", "first", "last", "final", "before", "edge", "costs", "rows"])

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment", ignore_index=True)
        states = _state_rows(machine, [np.array(c).reshape(4, 4) for c in rows["costs"]])
        told = rows[["conv_id", "segment"]].assign(**dict(zip(("first", "last", "final"), zip(*states, strict=True), strict=True)))
        return told.assign(before=rows["rows"].cumsum() - rows["rows"])

    shape = "conv_id long, segment int, first int, last int, final boolean, before long"
    each = stored(_in_segments(turns.drop("text")).mapInPandas(summed, f"{shape}, edge boolean, costs array<double>, rows long"), "matrices")
    edges = each.filter("edge").groupBy("conv_id").applyInPandas(chained, shape)
    return each.filter("not edge").drop("edge", "costs", "rows").unionByName(edges)


def repaired_turns(conversations: DataFrame, costs: Costs = Costs(), template: str = TEMPLATE) -> DataFrame:
    """Repaired and rendered turns of all conversations (``conv_id``, ``turn``, ``role``, ``text``).

    One row per recorded turn and one per inserted turn: ``conv_id``, ``turn`` (of the record; an
    inserted turn has that of the turn it stands before, or of the last turn), ``place`` (number
    of that recorded row in its whole conversation, from 0), ``part`` (rises within a place),
    ``role``, ``action`` (``keep``, ``relabel``, ``merge``, ``insert``)
    and ``rendered``, the text of the row in the template.  The rendered rows of a conversation,
    put together in order of ``place`` and ``part``, which name a row, are its legal sequence: a
    merged row goes on inside the turn before it.  ``place`` runs through however many tasks a
    conversation is cut into, so turns of equal number have one order too.

    A NULL or unknown role is free to take user or assistant; a NULL text is empty; a NULL turn
    comes last; rows with a NULL ``conv_id`` form one conversation; turns of equal number go by
    role and text, and rows that repeat stay.  An empty table gives no rows.
    """
    machine = Repair(costs)
    turns = stored(_segments(conversations), "turns")
    states = segment_states(turns, machine)

    def rendered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        names = ["conv_id", "turn", "place", "part", "role", "action", "rendered"]
        before: tuple | None = None
        for run in _runs(frames):
            conv = run["conv_id"][0]
            path = machine.path([role_code(r) for r in run["role"]], run["first"][0], run["last"][0])
            empty = lambda role: template.format(role=ROLES[role - 1], text="")
            part = 0
            for place, (turn, text, (to, inserted, action)) in enumerate(zip(run["turn"], run["text"], path, strict=True), run["before"][0]):
                # Rows that share a turn number are numbered through, in every segment from its own start.
                part = part if before == (conv, turn) else 0
                before = (conv, turn)
                for role in inserted:
                    out.append((conv, turn, place, part, ROLES[role - 1], "insert", empty(role)))
                    part += 1
                text = text or ""
                out.append((conv, turn, place, part, ROLES[to - 1], action, f"{text}\n" if action == "merge" else template.format(role=ROLES[to - 1], text=text)))
                part += 1
            if run["final"][0]:
                for role in machine.fill[run["last"][0], START][1]:
                    out.append((conv, turn, place, part, ROLES[role - 1], "insert", empty(role)))
                    part += 1
            if len(out) > BATCH_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    told = _in_segments(turns.join(states, ["conv_id", "segment"])).mapInPandas(rendered, OUTPUT)
    return told.withColumn("conv_id", F.nullif("conv_id", F.lit(NO_CONVERSATION))).withColumn("turn", F.nullif("turn", F.lit(NO_TURN)))
