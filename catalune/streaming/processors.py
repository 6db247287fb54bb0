"""Stateful processors: position fusion, route progress and token buckets.

The state of a key is a few scalars, kept under a TTL, so it is bounded by the
keys that were active lately. Events of a batch are applied in event-time
order; the batch folds are the reference for results, as a stream can see late
events out of order. ``applyInPandasWithState`` runs the same step functions
as the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import position as ps

IDLE_MS = 600_000


def _rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(parts)
    return pd.concat(frames).sort_values(["at", "event_id"], kind="stable") if frames else pd.DataFrame()


def positions(stream: DataFrame, decay_ms: int = ps.DECAY_MS, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, event_id, level, gallery) of a stream (key, event_id, at, source, usable, gallery, floor, site)."""
    key = stream.schema["key"].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a = ps.Anchor(*(ps._none(x) for x in state.get)) if state.exists else ps.Anchor()
        out = []
        for r in _rows(parts).itertuples(index=False):
            a = ps.fold(a, ps.Input(int(r.at), r.source, bool(r.usable), ps._none(r.gallery), ps._none(r.floor), ps._none(r.site)), decay_ms)
            shown = "none" if a.kind == "none" else "room" if a.kind == "room" and r.at - a.at < decay_ms else "area"
            out.append((k[0], r.event_id, shown, a.gallery))
        state.update((a.kind, a.gallery, a.floor, a.site, a.assumed_floor, a.at))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "event_id", "level", "gallery"])

    return stream.groupBy("key").applyInPandasWithState(run, f"key {key}, event_id long, level string, gallery string", "kind string, gallery string, floor double, site string, assumed_floor double, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress(stream: DataFrame, route: list[str], idle_ms: int = 86_400_000) -> DataFrame:
    """(key, event_id, step, outcome) of a stream (key, event_id, at, gallery) along one route."""
    key = stream.schema["key"].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = ps.Progress(state.get[0], ps._none(state.get[1])) if state.exists else ps.Progress()
        out = []
        for r in _rows(parts).itertuples(index=False):
            p, what = ps.follow(route, p, ps._none(r.gallery))
            out.append((k[0], r.event_id, p.step, what))
        state.update((p.step, p.off))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "event_id", "step", "outcome"])

    return stream.groupBy("key").applyInPandasWithState(run, f"key {key}, event_id long, step int, outcome string", "step int, off string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def buckets(stream: DataFrame, per_minute: float, burst: float, idle_ms: int = IDLE_MS) -> DataFrame:
    """(key, event_id, admitted, retry_after) of a stream (key, event_id, at); idle buckets are dropped, as a full one is like none."""
    key = stream.schema["key"].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for r in _rows(parts).itertuples(index=False):
            tokens, ok, wait = ps.take_token(tokens, last, int(r.at), per_minute, burst)
            last = int(r.at)
            out.append((k[0], r.event_id, ok, wait))
        state.update((float(tokens), last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "event_id", "admitted", "retry_after"])

    return stream.groupBy("key").applyInPandasWithState(run, f"key {key}, event_id long, admitted boolean, retry_after int", "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type (an extension); the watermark bounds the state of a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows of a user (an extension)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
