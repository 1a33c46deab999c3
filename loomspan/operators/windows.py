"""Adaptive evidence windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.lineage import cut

KINDS = ("document", "mention", "edge")
DEFAULTS = {"document": 80, "mention": 120, "edge": 30}


class OpenWindow:
    """The window of one scope while its events arrive in order; used by the batch and the streaming operator."""

    __slots__ = ("counts", "index", "start")

    def __init__(self, index: int = 0) -> None:
        self.index, self.start, self.counts = index, None, dict.fromkeys(KINDS, 0)

    def add(self, day: int, kind: str, least: dict[str, int], shortest: int, longest: int) -> tuple[int, str | None]:
        """Take an event; the window's number, and why it closes with this event (None: it stays open)."""
        if self.start is None:
            self.start = day
        self.counts[kind] += 1
        number, days = self.index, day - self.start
        full = [k for k in ("edge", "mention", "document") if self.counts[k] >= least[k]]
        if days < longest and not (full and days >= shortest):
            return number, None
        self.index, self.start, self.counts = number + 1, None, dict.fromkeys(KINDS, 0)
        return number, full[0] if full and days >= shortest else "max_duration"


#: Events of a segment: the events of a longer scope are folded in segments, by different tasks.
SEGMENT = 65_536
OUT = "scope string, event_id long, day date, window_index int, closed_by string"
State = tuple[int | None, tuple[int, ...]]  # the open window's first day and its events of each kind; no day: none is open


class Summary:
    """What a segment makes of any state that it is entered with, in as many numbers as it has days and as a window calls for events.

    Where the open window of an entry closes follows from the segment's days and from the places of its first events of each kind. Behind that place a
    window starts anew, and what comes of it doesn't depend on the entry: for each such place the summary has the number of windows
    that close and the state at the segment's end. Equal ends are kept once.
    """

    def __init__(self, days: np.ndarray, kinds: np.ndarray, least: dict[str, int], shortest: int, longest: int) -> None:
        n = len(days)
        places = [np.flatnonzero(kinds == k) for k in KINDS]
        seen = [np.concatenate(([0], np.cumsum(kinds == k))) for k in KINDS]
        # where a window closes that starts at each event: n if not in this segment
        last = np.searchsorted(days, days + longest)
        enough = np.searchsorted(days, days + shortest)
        close = last
        for k, own, before in zip(KINDS, places, seen, strict=True):
            nth = before[:-1] + max(least[k], 1) - 1
            at = np.where(nth < len(own), own[np.minimum(nth, len(own) - 1)], n) if len(own) else np.full(n, n)
            close = np.minimum(close, np.maximum(at, enough))
        end, closed = np.full(n + 1, -1), np.zeros(n + 1, np.int64)  # -1: no window is open
        for i in range(n - 1, -1, -1):
            if close[i] >= n:
                end[i] = i
            else:
                end[i], closed[i] = end[close[i] + 1], closed[close[i] + 1] + 1
        self.days, self.firsts = np.unique(days, return_index=True)
        self.places = [own[: max(least[k], 1)] for k, own in zip(KINDS, places, strict=True)]
        self.totals = [int(x[-1]) for x in seen]
        self.starts = np.unique(np.concatenate(([0], self.firsts + 1, *(p + 1 for p in self.places))))
        self.closed = closed[self.starts]
        ends, self.end = np.unique(end[self.starts], return_inverse=True)
        self.ends: list[State] = [(None, (0, 0, 0)) if e < 0 else (int(days[e]), tuple(int(x[-1] - x[e]) for x in seen)) for e in ends]
        self.n, self.least, self.shortest, self.longest = n, least, shortest, longest

    def leave(self, entry: State) -> tuple[State, int]:
        """The state at the end, and how many windows have closed."""
        day, counts = entry
        if day is None:
            return self.ends[self.end[0]], int(self.closed[0])
        first = lambda d: int(self.firsts[i]) if (i := int(np.searchsorted(self.days, d))) < len(self.days) else self.n
        place, enough = first(day + self.longest), first(day + self.shortest)
        for k, own, have in zip(KINDS, self.places, counts, strict=True):
            lack = self.least[k] - have
            at = 0 if lack <= 0 else int(own[lack - 1]) if lack <= len(own) else self.n
            place = min(place, max(at, enough))
        if place >= self.n:
            return (day, tuple(c + t for c, t in zip(counts, self.totals, strict=True))), 0
        i = int(np.searchsorted(self.starts, place + 1))
        return self.ends[self.end[i]], int(self.closed[i]) + 1


def adaptive_windows(events: DataFrame, least: dict[str, int] | None = None, shortest: int = 30, longest: int = 1095, segment: int = SEGMENT) -> DataFrame:
    """(scope, event_id, day, window_index, closed_by) of each event (WIN01).

    Events (scope, event_id, day, kind) of a scope are taken by (day, event_id, kind). A window closes with the event at which it lasts
    ``longest`` days, or lasts ``shortest`` days and has enough events of a kind; the last one stays open. Undated events, and those without scope or of another kind, are left out.

    A frame that depends on its data can't be written as a SQL window. Scopes of at most ``segment`` events are folded whole. The events
    of longer ones are dealt by range, numbered by prefix counts and cut into segments; each gives a :class:`Summary`, these are chained from the first, which tells
    the state that each segment is entered with, and each is then folded from there. So no task reads the events of a long scope.
    """
    least = DEFAULTS | (least or {})
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["day", "event_id", "kind"]
    rows = events.where("day is not null and scope is not null").where(F.col("kind").isin(*KINDS)).select("scope", "event_id", "day", F.datediff("day", F.lit("1970-01-01")).alias("n"), "kind")
    long = cut(rows.groupBy("scope").agg(F.count("*").alias("events")).where(F.col("events") > segment).select("scope"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, state = None, OpenWindow()
        for batch in batches:
            found, cols = [], batch.to_pydict()
            for own, day, kind in zip(cols["scope"], cols["n"], cols["kind"], strict=True):
                if own != scope:
                    scope, state = own, OpenWindow()
                found.append(state.add(day, kind, least, shortest, longest))
            numbers, reasons = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(numbers, pa.int32()), pa.array(reasons, pa.string())], ["scope", "event_id", "day", "window_index", "closed_by"])

    short = rows.join(long, "scope", "left_anti").repartition(parts, "scope").sortWithinPartitions("scope", *order).mapInArrow(whole, OUT)
    dealt = cut(rows.join(long, "scope", "left_semi").repartitionByRange(parts, "scope", *order).withColumn("dealt", F.spark_partition_id()))
    before = Window.partitionBy("scope").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("scope", "dealt").agg(F.count("*").alias("c")).select("scope", "dealt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("scope", "dealt").orderBy(*order)) - 1
    # numbered once: rows that are alike must not change places between the passes
    placed = cut(dealt.withColumn("nth", nth).join(totals, ["scope", "dealt"]).select("scope", F.floor((F.col("before") + F.col("nth")) / segment).alias("segment"), "event_id", "day", "n", "kind", (F.col("before") + F.col("nth")).alias("pos")))

    def summarise(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        made = Summary(frame["n"].to_numpy(np.int64), frame["kind"].to_numpy(object), least, shortest, longest)
        return pd.DataFrame({"scope": [key[0]], "segment": [key[1]], "summary": [pickle.dumps(made)]})

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, state, index = None, (None, (0, 0, 0)), 0
        for batch in batches:
            cols, out = batch.to_pydict(), []
            for own, made in zip(cols["scope"], cols["summary"], strict=True):
                if own != scope:
                    scope, state, index = own, (None, (0, 0, 0)), 0
                out.append((index, state[0], list(state[1])))
                state, closed = pickle.loads(made).leave(state)
                index += closed
            index_, start, counts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index_, pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], ["scope", "segment", "index", "start", "counts"])

    summaries = placed.groupBy("scope", "segment").applyInPandas(summarise, "scope string, segment long, summary binary")
    entries = summaries.repartition(parts, "scope").sortWithinPartitions("scope", "segment").mapInArrow(chained, "scope string, segment long, index long, start long, counts array<long>")

    def replayed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        head = frame.iloc[0]
        state = OpenWindow(int(head["index"]))
        if not pd.isna(head["start"]):
            state.start, state.counts = int(head["start"]), dict(zip(KINDS, map(int, head["counts"]), strict=True))
        found = [state.add(day, kind, least, shortest, longest) for day, kind in zip(frame["n"].tolist(), frame["kind"].tolist(), strict=True)]
        out = frame[["scope", "event_id", "day"]].copy()
        out["window_index"], out["closed_by"] = [x for x, _ in found], [x for _, x in found]
        return out

    segments = placed.join(entries, ["scope", "segment"]).groupBy("scope", "segment").applyInPandas(replayed, OUT)
    return short.unionByName(segments)


def window_rows(assigned: DataFrame) -> DataFrame:
    """One row for each window: id, first and last day, duration, events, why it closed (WIN02)."""
    rows = assigned.groupBy("scope", "window_index").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("events"), F.max("closed_by").alias("closed_by"))
    name = F.format_string("%s__w%04d", F.col("scope"), F.col("window_index") + 1)
    return rows.select(name.alias("window_id"), "scope", "start", "end", F.datediff("end", "start").alias("days"), "events", F.coalesce("closed_by", F.lit("open")).alias("trigger"))


def window_summary(windows: DataFrame) -> DataFrame:
    """Windows and mean duration by trigger (AGG30)."""
    return windows.groupBy("trigger").agg(F.count("*").alias("windows"), F.round(F.avg("days"), 3).alias("mean_days"), F.max("events").alias("most_events"))


__all__ = ["OpenWindow", "Summary", "adaptive_windows", "window_rows", "window_summary"]
