"""Repair and render chat transcripts by dynamic programming over a legal-turn automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import written

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: States: before the first turn, and behind a turn of each role. A turn may follow where NEXT says so.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
#: Rows of a segment: a long conversation is repaired in segments, by different tasks.
SEGMENT = 1024
FAR = 10**9


def _steps() -> dict[int, list[list[tuple[int, int, str]]]]:
    """For each observed role (0: unknown) and state, the moves (cost, new state, what) in order of preference."""
    out: dict[int, list[list[tuple[int, int, str]]]] = {}
    for seen in range(4):
        table = []
        for state in range(4):
            moves: list[tuple[int, int, str]] = []
            for role in (SYSTEM, USER, ASSISTANT):
                price = 0 if role == seen else RELABEL
                if role in NEXT[state]:
                    moves.append((price, role, "append"))
                if role == state:
                    moves.append((price + MERGE, role, "merge"))
                for between in NEXT[state]:
                    if role in NEXT[between]:
                        moves.append((price + INSERT, role, f"insert {between}"))
            table.append(sorted(moves, key=lambda m: (m[0], ("append", "merge").index(m[2]) if " " not in m[2] else 2, m[1])))
        out[seen] = table
    return out


MOVES = _steps()
#: What is missing behind each state at the end of a conversation, which ends with an assistant turn.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def transfer(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each state over a run of turns; runs are joined by :func:`joined`."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        new = np.full((4, 4), FAR, np.int64)
        for state in range(4):
            for cost, to, _ in MOVES[role][state]:
                new[:, to] = np.minimum(new[:, to], out[:, state] + cost)
        out = np.minimum(new, FAR)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-cost transfer over both runs: a product of matrices with minimum and plus, so runs may be joined in any grouping."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def end_cost(state: int) -> int:
    return INSERT * len(ENDING[state])


@dataclass
class Repair:
    cost: int
    moves: list[tuple[int, str]]  # role and what was done, for each turn
    state: int


def repair(roles: list[int], entry: int = START, goal: int | None = None) -> Repair:
    """The least-cost moves from ``entry`` to ``goal`` (None: to the end of the conversation). Ties: earlier turns as in ``MOVES``."""
    cost = [FAR] * 4
    for state in range(4):
        cost[state] = (end_cost(state) if goal is None else (0 if state == goal else FAR))
    back: list[list[tuple[int, int, str] | None]] = []
    for role in reversed(roles):
        new, pick = [FAR] * 4, [None] * 4
        for state in range(4):
            for price, to, what in MOVES[role][state]:
                if price + cost[to] < new[state]:
                    new[state], pick[state] = price + cost[to], (price, to, what)
        cost = new
        back.append(pick)
    total, state, moves = cost[entry], entry, []
    for pick in reversed(back):
        _, state, what = pick[state]
        moves.append((state, what))
    return Repair(total, moves, state)


def shielded(text: str) -> str:
    """Text in which nothing looks like one of the tags of :func:`render`."""
    return text.replace("<|", "< |")


def render(moves: list[tuple[int, str]], texts: list[str], entry: int, last: bool, state: int) -> str:
    """The turns behind ``entry``; the last stays open unless the conversation ends, so segments' texts can be put together."""
    out: list[str] = []
    is_open = entry != START

    def opened(role: int) -> None:
        nonlocal is_open
        out.append(("<|end|>\n" if is_open else "") + f"<|{ROLES[role - 1]}|>\n")
        is_open = True

    for (role, what), text in zip(moves, texts, strict=True):
        if what == "merge":
            out.append("\n\n")
        else:
            if what.startswith("insert"):
                opened(int(what.split()[1]))
            opened(role)
        out.append(shielded(text))
    if last:
        for role in ENDING[state]:
            opened(role)
        out.append("<|end|>\n" if is_open else "")
    return "".join(out)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    names = ("conv_id", "lone", "segment")[:width]
    for key, own in groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, list(own)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(*key, transfer([r["seen"] for r in own]).ravel().tolist()) for key, own in _groups(batches, 3)]
    if rows:
        conv, lone, segment, costs = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(lone, pa.int64()), pa.array(segment, pa.int64()), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "lone", "segment", "costs"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation the states at its borders on a path of least cost."""
    for key, own in _groups(batches, 2):
        steps = [np.array(r["costs"]).reshape(4, 4) for r in own]
        rest = np.array([end_cost(s) for s in range(4)])
        ahead = [rest]
        for m in reversed(steps):
            rest = np.minimum((m + rest[None, :]).min(1), FAR)
            ahead.append(rest)
        ahead.reverse()
        state, entry, goal = START, [], []
        for m, after in zip(steps, ahead[1:], strict=True):
            entry.append(state)
            state = int((m[state] + after).argmin())
            goal.append(state)
        n = len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([r["segment"] for r in own], pa.int64()), pa.array(range(n), pa.int64()), pa.array(entry, pa.int32()), pa.array(goal, pa.int32()), pa.array([k == n - 1 for k in range(n)])],
            ["conv_id", "lone", "segment", "part", "entry", "goal", "last"],
        )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "part", "turns_in", "turns_out", "merges", "relabels", "insertions", "cost", "text"]
    kinds = [pa.int64()] * 8 + [pa.string()]
    rows: list[tuple] = []
    size = 0
    for key, own in _groups(batches, 3):
        roles, first = [r["seen"] for r in own], own[0]
        last = first["last"]
        done = repair(roles, first["entry"], None if last else first["goal"])
        text = render(done.moves, [r["text"] or "" for r in own], first["entry"], last, done.state)
        merges = sum(what == "merge" for _, what in done.moves)
        inserts = sum(what.startswith("insert") for _, what in done.moves) + (len(ENDING[done.state]) if last else 0)
        relabels = sum(role != seen for (role, _), seen in zip(done.moves, roles, strict=True))
        rows.append((key[0], first["part"], len(own), len(own) - merges + inserts, merges, relabels, inserts, done.cost, text))
        size += len(text)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repair every conversation at least cost and render it.

    Legal is: a system turn at most, and first; then user and assistant turns in turn, the last by the
    assistant. A merge with the turn before costs 1, another role 2, an empty inserted turn 3; roles are trimmed
    and lower-cased, ``ALIASES`` hold, and an unknown or null role always costs a relabel. Turns are ordered by ``turn``
    (null last), then by a hash of role and text; null text is empty. Tags in texts are broken up.

    A conversation of more than ``segment`` rows is dealt by range and cut into segments of so many rows, by prefix counts;
    each gives its matrix of least costs between states, these few numbers are joined to find the states at
    the borders, and each segment is then repaired between its own; so no conversation needs one task, whatever
    its turn numbers. Each row with a null conversation is a conversation of its own, of one turn. Rows that repeat are turns of their own. An empty table gives no rows.

    Returns a row for each segment: ``conv_id, part`` (from 0), ``turns_in, turns_out, merges, relabels, insertions,
    cost, text``; the texts of a conversation's parts in order are its rendering.
    """
    role = F.lower(F.trim("role"))
    known = F.create_map(*(x for name, to in ({r: r for r in ROLES} | ALIASES).items() for x in (F.lit(name), F.lit(ROLES.index(to) + 1))))
    order = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(known[F.coalesce(role, F.lit(""))], F.lit(0)).alias("seen"), "text", order.alias("h"))
    rows = rows.withColumn("late", F.col("turn").isNull())
    # a number of its own keeps each row without a conversation apart, and rows that are alike in a range of their own
    rows = rows.withColumn("own", F.monotonically_increasing_id())
    sort = ["late", "turn", "h"]
    key = ["conv_id", "lone", "segment"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def together(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys, *more)

    # a conversation above one segment: its rows are dealt by range, so no task has to hold it, and numbered by prefix counts
    long = written(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("conv_id").isNotNull() & (F.col("n") > segment)).select("conv_id"))
    dealt = written(rows.join(long, "conv_id", "left_semi").repartitionByRange(parts, "conv_id", *sort, "own").withColumn("dealt", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "dealt").agg(F.count("*").alias("n")).select("conv_id", "dealt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "dealt").orderBy(*sort, "own")) - 1
    placed = dealt.withColumn("nth", nth).join(totals, ["conv_id", "dealt"]).withColumn("segment", F.floor((F.col("before") + F.col("nth")) / segment))
    placed = written(placed.select("conv_id", F.lit(0).cast("long").alias("lone"), "segment", *sort, "seen", "text"))

    costs = together(placed.select(*key, *sort, "seen"), key, *sort).mapInArrow(_transfers, "conv_id long, lone long, segment long, costs array<long>")
    borders = together(costs, ["conv_id", "lone"], "segment").mapInArrow(_borders, "conv_id long, lone long, segment long, part long, entry int, goal int, last boolean")
    large = placed.join(borders.drop("lone"), ["conv_id", "segment"]).select(*key, *sort, "seen", "text", "part", "entry", "goal", "last")
    lone = F.when(F.col("conv_id").isNull(), F.col("own")).otherwise(F.lit(-1).cast("long"))
    small = rows.alias("r").join(long.alias("l"), F.col("r.conv_id") == F.col("l.conv_id"), "left_anti").select(
        "conv_id", lone.alias("lone"), F.lit(0).cast("long").alias("segment"), *sort, "seen", "text", F.lit(0).cast("long").alias("part"), F.lit(START).alias("entry"), F.lit(-1).alias("goal"), F.lit(True).alias("last")
    )
    schema = "conv_id long, part long, turns_in long, turns_out long, merges long, relabels long, insertions long, cost long, text string"
    return together(small.unionByName(large), key, *sort).mapInArrow(_repaired, schema)
