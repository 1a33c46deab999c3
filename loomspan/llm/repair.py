"""Repair the structure of conversations: a Viterbi pass per conversation over the states of a turn grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import written

#: States of the grammar ``(s?(ua)+)?``: before the first turn, and behind a turn of each kind.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> initial of a role that may follow -> state behind it.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state that an inserted turn, or one of another role, leads to, and its role.
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
#: Rows of a segment: a longer conversation is repaired in segments, by different tasks.
SEGMENT = 1024
FAR = (1 << 60, "")
#: Costs to come behind the last turn, in each state.
TO_END = (0, 2 * INSERT, INSERT, 0)

Layer = list[tuple[int, str]]


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` where one row in five is damaged, by the CRC-32 of ``conv_id:turn`` modulo 20.

    Nulls are one space (but conv_id and turn stay null beside the key). 0 drops the row (kept here with null role and text), 1
    empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") != 0, role).alias("role"), F.when(F.col("h") != 0, text).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def faults(text: Column) -> Column:
    """``b`` for a blank text, ``t`` for one whose last character (but for white space) is not of ``.!?``, else empty."""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")


def closed(layer: Layer) -> Layer:
    """The layer with turns inserted behind it; two at most, as a third would lead to a state that one turn reaches."""
    for _ in range(2):
        layer = [min([layer[s], *((layer[p][0] + INSERT, layer[p][1] + "I") for p, to in FORCED.items() if to == s and layer[p] != FAR)]) for s in range(4)]
    return layer


def step(layer: Layer, initial: str, fault: str) -> Layer:
    """The layer behind a row: kept, of another role, or deleted (as blank and repeated rows must be)."""
    out = [(cost + DELETE, audit + "D") if (cost, audit) != FAR else FAR for cost, audit in layer]
    if fault in ("b", "d"):
        return out
    extra = TRUNCATED if fault == "t" else 0
    for state, (cost, audit) in enumerate(layer):
        if (cost, audit) == FAR:
            continue
        if initial in NEXT[state]:
            to = NEXT[state][initial]
            out[to] = min(out[to], (cost + extra, audit + "K"))
        to = FORCED[state]
        out[to] = min(out[to], (cost + REROLE + extra, audit + "R"))
    return out


def viterbi(rows: list[tuple[str, str]], entry: int) -> Layer:
    """For each state behind the rows (initial, fault) the least (cost, audit) from ``entry``: turns are inserted before each row, none behind the last.

    Of equal costs the smaller audit is kept. Two audits that reach a state over the same rows at one cost differ
    before either ends, as each further insertion costs, so what follows can't change their order.
    """
    layer = [FAR] * 4
    layer[entry] = (0, "")
    for initial, fault in rows:
        layer = step(closed(layer), initial, fault)
    return layer


def best(layer: Layer, ahead: tuple[int, ...] | list[int]) -> tuple[int, int, str]:
    """State, cost and audit of the least total with the costs ``ahead``, the smaller audit at equal totals."""
    cost, audit, state = min((layer[s][0] + ahead[s], layer[s][1], s) for s in range(4) if layer[s] != FAR)
    return state, cost - ahead[state], audit


def ending(state: int) -> str:
    """The insertions behind the last turn."""
    return "I" * (TO_END[state] // INSERT)


def apply(audit: str, rows: list[tuple[str, str]], entry: int) -> Iterator[tuple[str, str, str]]:
    """The edits of an audit as (edit, role, text) over rows (role, text); deleted rows come with their own role and text."""
    state, at = entry, 0
    for edit in audit:
        if edit == "I":
            state = FORCED[state]
            yield edit, NAMES[state], ""
            continue
        role, text = rows[at]
        at += 1
        if edit == "R":
            state = FORCED[state]
            role = NAMES[state]
        elif edit == "K":
            state = NEXT[state][role[:1]]
        yield edit, role, text


def repair(rows: list[tuple[str, str]], marks: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and repaired (role, text) of one conversation's rows with their faults."""
    state, cost, audit = best(viterbi([(role[:1], mark) for (role, _), mark in zip(rows, marks, strict=True)], START), TO_END)
    audit += ending(state)
    return cost + TO_END[state], audit, [(role, text) for edit, role, text in apply(audit, rows, START) if edit != "D"]


class Counts:
    """Counts over a run of a conversation's rows in order, each (turn, initial, fault)."""

    def __init__(self) -> None:
        self.low: int | None = None
        self.high: int | None = None
        self.turns = self.illegal = 0
        self.marks = {"b": 0, "d": 0, "t": 0, "": 0}
        self.first: str | None = None
        self.last: str | None = None

    def add(self, turn: int | None, initial: str, mark: str) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL_PAIRS
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.marks[mark] += 1
        self.last = initial

    @property
    def gaps(self) -> int:
        return 0 if self.low is None or self.high is None else self.high - self.low + 1 - self.turns


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}


def _batched(rows: Iterator[tuple], schema: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a DDL schema in batches of about ``size`` characters."""
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, str))
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))


def _mapped(df: DataFrame, keys: list[str], order: list, each: Callable[[tuple, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``each`` makes of the rows of a key in ``order``; it gets them one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        groups = groupby(rows, key=lambda r: tuple(r[k] for k in keys))
        return _batched((out for key, own in groups for out in each(key, own)), schema)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Nulls first; rows of one turn by role and digest of the text.
ORDER = ["turn", "role", "digest"]
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, segment long, nth long, edit string, cost long, role string, text string"


def _marked(own: Iterator[dict]) -> list[dict]:
    """The rows that aren't dropped, repeated ones marked."""
    seen: set[tuple[str, str]] = set()
    rows = []
    for row in own:
        if row["role"] is not None:
            key = (row["role"], row["digest"])
            row["mark"] = "d" if row["mark"] != "b" and key in seen else row["mark"]
            seen.add(key)
            rows.append(row)
    return rows


def _summary(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    counts, rows = Counts(), _marked(own)
    for r in rows:
        counts.add(r["turn"], r["role"][:1], r["mark"])
    cost, audit, turns = repair([(r["role"], r["text"]) for r in rows], [r["mark"] for r in rows])
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()
    yield *key, counts.gaps, counts.marks["b"], counts.marks["d"], counts.marks["t"], counts.illegal, cost, audit, digest


def _costs(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """Of a segment the least costs from each state to each, and its counts."""
    counts, rows = Counts(), []
    for r in own:
        counts.add(r["turn"], r["initial"], r["mark"])
        rows.append((r["initial"], r["mark"]))
    costs = [cost for entry in range(4) for cost, _ in viterbi(rows, entry)]
    m = counts.marks
    yield *key, costs, counts.first, counts.last, counts.low, counts.high, counts.turns, counts.illegal, m["b"], m["d"], m["t"]


def _ahead(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """For a conversation's segments, the last first, the least costs behind them from each state."""
    ahead, last = list(TO_END), True
    for r in own:
        yield *key, r["segment"], ahead, last
        ahead, last = [min(r["costs"][4 * s + t] + ahead[t] for t in range(4)) for s in range(4)], False


def _exits(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """Of a segment, for each state at its begin, the state at its end on the best way to the conversation's end."""
    rows = list(own)
    pairs = [(r["initial"], r["mark"]) for r in rows]
    yield *key, [best(viterbi(pairs, entry), rows[0]["ahead"])[0] for entry in range(4)]


def _entries(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """For a conversation's segments in order the states at their borders, and what counts there beside their own counts."""
    state, last, high = START, None, None
    for r in own:
        illegal = last is not None and last + r["first"] not in LEGAL_PAIRS
        again = high is not None and r["low"] == high
        yield *key, r["segment"], state, r["exits"][state], r["illegal"] + illegal, r["turns"] - again, r["low"], r["high"], r["blank"], r["duplicate"], r["truncated"]
        state, last = r["exits"][state], r["last"]
        high = r["high"] if r["high"] is not None else high


def _edits(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """A segment's edits in order between its states, each with its cost."""
    rows = list(own)
    head = rows[0]
    layer = viterbi([(r["role"][:1], r["mark"]) for r in rows], head["entry"])
    audit = layer[head["goal"]][1] + (ending(head["goal"]) if head["at_end"] else "")
    left = iter(rows)
    for nth, (edit, role, text) in enumerate(apply(audit, [(r["role"], r["text"]) for r in rows], head["entry"])):
        cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I" and next(left)["mark"] == "t" and edit != "D":
            cost += TRUNCATED
        yield *key, nth, edit, cost, role, text


def _whole_edits(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """The edits of a short conversation."""
    rows = _marked(own)
    if rows:
        goal, _, _ = best(viterbi([(r["role"][:1], r["mark"]) for r in rows], START), TO_END)
        yield from _edits((*key, 0), iter([r | {"entry": START, "goal": goal, "at_end": True} for r in rows]))


def _digest(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
    """Cost, audit and hash of a conversation from its edits, which pass by one by one."""
    total, audit, digest, begun = 0, [], hashlib.sha256(), False
    for r in own:
        total += r["cost"]
        audit.append(r["edit"])
        if r["edit"] != "D":
            digest.update(("\n" * begun + f"{r['role']}:{r['text']}").encode())
            begun = True
    yield *key, total, "".join(audit), digest.hexdigest()


class Repair:
    """Conversations of at most ``segment`` rows, and the segments of longer ones with the states at their borders.

    A long conversation's rows are dealt by range and numbered by prefix counts, and cut into segments of ``segment`` rows. Each segment gives its least
    costs from state to state; folded from the end they give the costs ahead of each border; with these a segment tells, for each state at its begin, the
    state at its end; folded from the start, that fixes the states. No fold holds more than one segment's few numbers, and no task the rows of a conversation.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT) -> None:
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.sha2("text", 256).alias("digest"), faults(F.col("text")).alias("mark"))
        rows = rows.withColumn("own", F.monotonically_increasing_id())
        sizes = rows.groupBy("conv_id").agg(F.count("role").alias("n")).where(F.col("n") > segment)
        long = written(sizes.select(F.col("conv_id").alias("long_id"), F.lit(1).alias("one")))
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        self.short = rows.join(long, same, "left_anti").select("conv_id", *ORDER, "text", "mark")
        dealt = rows.where("role is not null").join(long, same, "left_semi")
        dealt = written(dealt.repartitionByRange(parts, "conv_id", *ORDER, "own").withColumn("dealt", F.spark_partition_id()))
        before = Window.partitionBy("conv_id").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
        totals = dealt.groupBy("conv_id", "dealt").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("dealt").alias("d"), F.coalesce(F.sum("n").over(before.partitionBy("conv_id")), F.lit(0)).alias("before"))
        nth = F.row_number().over(Window.partitionBy("conv_id", "dealt").orderBy(*ORDER, "own")) - 1
        placed = dealt.withColumn("nth", nth).join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("dealt") == F.col("d")))
        placed = written(placed.select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "turn", "role", "digest", "text", "mark"))
        # a row is repeated if its role and text have an earlier one; the earliest are found by partial aggregates
        first = placed.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("t"), "first")
        met = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("t")))
        mark = F.when((F.col("mark") != "b") & (F.col("pos") > F.col("first")), "d").otherwise(F.col("mark"))
        self.rows = written(met.select("conv_id", F.floor(F.col("pos") / segment).alias("segment"), "pos", "turn", "role", F.left("role", F.lit(1)).alias("initial"), "text", mark.alias("mark")))
        light = self.rows.select("conv_id", "segment", "pos", "turn", "initial", "mark")
        key = ["conv_id", "segment"]
        schema = "conv_id long, segment long, costs array<long>, first string, last string, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long"
        costs = written(_mapped(light, key, ["pos"], _costs, schema))
        ahead = written(_mapped(costs.select(*key, "costs"), ["conv_id"], [F.desc("segment")], _ahead, "conv_id long, segment long, ahead array<long>, at_end boolean"))
        exits = _mapped(self._with(light, ahead), key, ["pos"], _exits, "conv_id long, segment long, exits array<int>")
        schema = "conv_id long, segment long, entry int, goal int, illegal long, turns long, low long, high long, blank long, duplicate long, truncated long"
        entries = _mapped(self._with(costs.drop("costs"), exits), ["conv_id"], ["segment"], _entries, schema)
        self.borders = written(self._with(entries, ahead.drop("ahead")))

    @staticmethod
    def _with(a: DataFrame, b: DataFrame) -> DataFrame:
        """Joined on conversation (null meets null) and segment."""
        b = b.withColumnsRenamed({"conv_id": "c", "segment": "s"})
        return a.join(b, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")

    def _long_edits(self) -> DataFrame:
        rows = self._with(self.rows.select("conv_id", "segment", "pos", "role", "text", "mark"), self.borders.select("conv_id", "segment", "entry", "goal", "at_end"))
        return _mapped(rows, ["conv_id", "segment"], ["pos"], _edits, EDITS)

    def edits(self) -> DataFrame:
        short = _mapped(self.short, ["conv_id"], ORDER, _whole_edits, EDITS)
        return short.unionByName(self._long_edits())

    def summaries(self) -> DataFrame:
        short = _mapped(self.short, ["conv_id"], ORDER, _summary, SUMMARY)
        ends = _mapped(self._long_edits(), ["conv_id"], ["segment", "nth"], _digest, "conv_id long, cost long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "c")
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
        counts = self.borders.groupBy("conv_id").agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *sums)
        long = counts.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        return short.unionByName(long.select(*short.columns))


def repaired_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The edits that make conversations legal at least cost, as rows ``conv_id, segment, nth, edit, cost, role, text``.

    Legal is ``(s?(ua)+)?`` in the initials of the roles. Rows are taken by turn (null first), those of one turn by role and text digest.
    Edits: K(eep) costs 0, R(erole) to user or assistant 3, D(elete) 4, I(nsert) of an empty turn 3; a kept or reroled text that
    ends in none of ``.!?`` costs 3 more; blank texts and repeats of an earlier role and text must go. Of the cheapest the one whose
    initials are least is taken. The rows but for the deleted ones, by segment and nth, are the repaired conversation. Null role and text are one
    space; rows without a conversation are one conversation; an empty table gives no rows, and other columns aren't read.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return Repair(rows, segment).edits()


def damaged_and_repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation of ``turns`` after :func:`damage`: its faults, and cost, audit and hash of its repair (see :func:`repaired_turns`).

    The hash is of the repaired ``role:text``, joined by newlines, as they pass by: SHA-256 reads its input in order, so one task reads a
    conversation's repaired turns, but never holds them. A conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing.
    """
    return Repair(damage(turns), segment).summaries()
