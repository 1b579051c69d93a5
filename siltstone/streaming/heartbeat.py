"""Signs of life of long runs: a message whenever a run has gone on for another period without an end.

Runs report events in any order; those later than the watermark allows do not count. A run begins with its
first event, ends with one of an ending kind, and is given up after a time without events; what it reports
after that is a run of its own. The stream keeps a small state a run: events that the watermark has not passed
wait there, so the messages are the same however events are split into batches, and the same as of
:func:`beats` over all of them. A timer wakes a run when its next message, event or end is due, and a run
that has ended leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions import text as X

ENDS = ("done", "error")
STATE = "start long, last long, beat long, times array<long>, ends array<boolean>"


def message(seconds):
    return F.concat(F.lit("still running after "), X.elapsed(seconds))


def millis():
    """``at`` in milliseconds, to the nearest one, halves away from 1970 (``unix_millis`` takes the one below)."""
    return F.expr("(unix_micros(at) + if(unix_micros(at) < 0, -500, 500)) div 1000")


def beats(events: DataFrame, every_s: int = 30, silence_s: int = 3600, ends: tuple[str, ...] = ENDS) -> DataFrame:
    """run, start, at, message of ``events(run, at, kind)``: all messages of a table of events."""
    order = Window.partitionBy("run").orderBy("at", "ended")
    ms = millis().alias("at")
    e = events.where("run IS NOT NULL AND at IS NOT NULL").select("run", ms, F.coalesce(F.col("kind").isin(*ends), F.lit(False)).alias("ended"))
    e = e.withColumn("gap", F.col("at") - F.lag("at").over(order)).withColumn("after_end", F.lag("ended").over(order))
    fresh = F.col("gap").isNull() | (F.col("gap") >= 1000 * silence_s) | F.col("after_end")
    e = e.withColumn("life", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lives = e.groupBy("run", "life").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.max("ended").alias("ended"))
    stop = F.when(F.col("ended"), F.col("last")).otherwise(F.col("last") + 1000 * silence_s) - 1
    n = F.floor((stop - F.col("start")) / (1000 * every_s))
    rows = lives.where(n >= 1).select("run", "start", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("k"))
    return _shown(rows.select("run", "start", (F.col("start") + F.col("k").cast("long") * 1000 * every_s).alias("at")))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("run", F.timestamp_millis("start").alias("start"), F.timestamp_millis("at").alias("at"), message(F.floor((F.col("at") - F.col("start")) / 1000)).alias("message"))


def advance(state: tuple | None, now: int, every: int, silence: int) -> tuple[tuple | None, list[tuple[int, int]], int]:
    """(state, messages (start, at), next time) of one run when the watermark is at ``now``; all in milliseconds. Without a
    run and without waiting events there is no state."""
    start, last, beat, times, ended = state
    waiting, out = sorted(zip(times, ended)), []

    def until(stop: int) -> None:
        """Messages due before ``stop``."""
        nonlocal beat
        while beat < stop:
            out.append((start, beat))
            beat += every

    while True:
        if start >= 0 and last + silence <= now and not (waiting and waiting[0][0] < last + silence):
            until(last + silence)
            start = last = beat = -1  # given up
        elif waiting and waiting[0][0] <= now:
            at, end = waiting.pop(0)
            if start < 0:
                start, beat = at, at + every
            until(at)
            last = at
            if end:
                start = last = beat = -1
        else:
            break
    if start >= 0:
        until(min(now + 1, last + silence))
    if start < 0 and not waiting:
        return None, out, 0
    due = [t for t in (waiting[0][0] if waiting else None, beat if start >= 0 else None, last + silence if start >= 0 else None) if t is not None]
    return (start, last, beat, [t for t, _ in waiting], [e for _, e in waiting]), out, min(due)


def heartbeats(events: DataFrame, every_s: int = 30, silence_s: int = 3600, late: str = "1 minute", ends: tuple[str, ...] = ENDS) -> DataFrame:
    """The messages of a stream of ``events(run, at, kind)``, for append mode: each as soon as the watermark has passed it."""
    every, silence = 1000 * every_s, 1000 * silence_s

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        start, last, beat, times, ended = state.get if state.exists else (-1, -1, -1, [], [])
        times, ended = list(times), list(ended)
        for pdf in frames:
            times += pdf["ms"].tolist()
            ended += pdf["ended"].tolist()
        new, out, due = advance((start, last, beat, times, ended), now, every, silence)
        if new is None:
            if state.exists:
                state.remove()
        else:
            state.update(new)
            state.setTimeoutTimestamp(max(due, now + 1))
        if out:
            yield pd.DataFrame({"run": key[0], "start": [s for s, _ in out], "at": [a for _, a in out]})

    rows = events.where("run IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = rows.select("run", "at", millis().alias("ms"), F.coalesce(F.col("kind").isin(*ends), F.lit(False)).alias("ended"))
    found = rows.groupBy("run").applyInPandasWithState(step, "run string, start long, at long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _shown(found)
