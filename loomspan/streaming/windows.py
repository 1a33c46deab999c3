"""Adaptive windows and resumable processing on streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.windows import DEFAULTS, KINDS, OpenWindow

STATE = "window_index int, start int, document int, mention int, edge int, held string"
OUTPUT = "scope string, event_id long, window_index int, closed_by string"
DAY_MS = 86_400_000


def streaming_windows(events: DataFrame, least: dict[str, int] | None = None, shortest: int = 30, longest: int = 1095, late: str = "7 days") -> DataFrame:
    """(scope, event_id, window_index, closed_by) of a stream of events (STM02).

    As :func:`loomspan.operators.windows.adaptive_windows`, whatever the order of arrival: events are held in the state until the watermark
    (``late`` behind the latest ``ts``) has passed their day, and are then taken by (day, event_id). An event that arrives
    when the watermark has passed its day is dropped, as its place is taken. The state has the events of the watermark's delay and five numbers a scope.
    """
    least = DEFAULTS | (least or {})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, held = OpenWindow(), []
        if state.exists:
            own.index, own.start, *counts, waiting = state.get
            own.start = None if own.start is None or own.start < -(10**8) else own.start
            own.counts = dict(zip(KINDS, counts, strict=True))
            held = [tuple(x) for x in json.loads(waiting)]
        passed = state.getCurrentWatermarkMs() // DAY_MS  # days before this one are complete
        if not state.hasTimedOut:
            for batch in frames:
                held += [(int(n), int(i), k) for n, i, k in zip(batch["n"], batch["event_id"], batch["kind"]) if n >= passed]
        ready = sorted(x for x in held if x[0] < passed)
        held = sorted(x for x in held if x[0] >= passed)
        found = [own.add(day, kind, least, shortest, longest) for day, _, kind in ready]
        state.update((own.index, -(10**9) if own.start is None else int(own.start), *(int(own.counts[k]) for k in KINDS), json.dumps(held)))
        if held:
            state.setTimeoutTimestamp((max(held[0][0], passed) + 1) * DAY_MS)
        yield pd.DataFrame({"scope": [key[0]] * len(ready), "event_id": [i for _, i, _ in ready], "window_index": [n for n, _ in found], "closed_by": [r for _, r in found]})

    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("scope", "event_id", "kind", day.alias("n"), "ts")
    return rows.groupBy("scope").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def resume_into(stream: DataFrame, table: str, key: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """Start a query that applies ``work`` to new rows and appends the results to ``table`` (STM01, JOI16).

    Rows whose key the table has already are skipped by an anti-join, so a batch that is replayed after a failure adds nothing twice;
    rows with status ``failed`` in the table are tried again.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df
        if spark.catalog.tableExists(table):
            spark.catalog.refreshTable(table)  # another session may have appended
            done = spark.read.table(table).where("status <> 'failed'").select(key).distinct()
            new = df.join(done, key, "left_anti")
        work(new).write.mode("append").saveAsTable(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
