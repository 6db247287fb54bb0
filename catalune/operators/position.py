"""Position fusion, route progress, rate limits and caches as ordered folds.

The step functions are plain and shared by the batch form (grouped, sorted by
event time) and the streaming processors in ``catalune.streaming``.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY_MS = 240_000
MAX_CONFIDENCE = 0.4
MAX_ACCURACY, MAX_DISTANCE = 300.0, 350.0
VENUE_ACCURACY = 1000.0


def usable_fix(accuracy: Column, distance: Column) -> Column:
    """Whether a fix may name an area."""
    return (accuracy <= MAX_ACCURACY) & (distance <= MAX_DISTANCE)


def area_confidence(accuracy: Column) -> Column:
    return MAX_CONFIDENCE * F.least(F.lit(1.0), 65.0 / F.greatest(accuracy, F.lit(1.0)))


def usable_venue(accuracy: Column, distance: Column) -> Column:
    """The looser test for naming a venue."""
    return (accuracy <= VENUE_ACCURACY) & (distance <= MAX_DISTANCE + F.greatest(accuracy, F.lit(0.0)))


def level(kind: Column, age_ms: Column, decay_ms: int = DECAY_MS) -> Column:
    """room while younger than the decay, area afterwards and for areas."""
    return F.when(kind.isNull(), "none").when((kind == "room") & (age_ms < decay_ms), "room").otherwise("area")


@dataclass(frozen=True)
class Anchor:
    """What is known of a session's place."""

    kind: str = "none"
    gallery: str | None = None
    floor: float | None = None
    site: str | None = None
    assumed_floor: float | None = None
    at: int = 0


@dataclass(frozen=True)
class Input:
    at: int
    source: str  # room, gps or venue
    usable: bool = True
    gallery: str | None = None
    floor: float | None = None
    site: str | None = None
    manual: bool = False


def fold(anchor: Anchor, e: Input, decay_ms: int = DECAY_MS) -> Anchor:
    """One event: a room replaces all; a usable fix is ignored while the room is fresh and supersedes it afterwards.

    The superseded room's floor is assumed on the same site only, and carried
    on through later fixes.
    """
    if e.source == "room":
        return Anchor("room", e.gallery, e.floor, e.site, None, e.at)
    if e.source != "gps" or not e.usable:
        return anchor
    if anchor.kind == "room":
        if e.at - anchor.at < decay_ms:
            return anchor
        floor = anchor.floor if anchor.site == e.site else None
    else:
        floor = anchor.assumed_floor if anchor.site == e.site else None
    return Anchor("area", None, None, e.site, floor, e.at)


@dataclass(frozen=True)
class Fused:
    """Anchor and venue; the anchor's site is always the venue."""

    anchor: Anchor = Anchor()
    venue: str | None = None
    pinned: bool = False


def fold_fused(state: Fused, e: Input, decay_ms: int = DECAY_MS) -> tuple[Fused, str | None]:
    """One event with venues; returns the new state and the venue switched to, if any. A manual pin beats fixes."""
    if e.source == "room":
        new = Fused(fold(state.anchor, e, decay_ms), e.site, state.pinned and state.venue == e.site)
    elif e.source == "venue":
        keep = state.anchor if state.anchor.site == e.site else Anchor()
        if not e.manual and state.pinned:
            return state, None
        new = Fused(keep, e.site, e.manual)
    elif e.usable and not (state.pinned and e.site != state.venue):
        anchor = fold(state.anchor, e, decay_ms)
        if anchor is state.anchor:
            return state, None
        new = replace(state, anchor=anchor, venue=e.site)
    else:
        return state, None
    return new, e.site if new.venue != state.venue else None


@dataclass(frozen=True)
class Progress:
    """Place on a route: index of the step reached and the room in which a reroute was last asked for.

    A room known before the route opened is given as ``off``: it is no new fix and asks for nothing.
    """

    step: int = 0
    off: str | None = None


def follow(route: list[str], p: Progress, gallery: str | None) -> tuple[Progress, str]:
    """One room-level anchor against a route: advance, reroute or none.

    A room further on than the step reached advances, by its first place on the
    route. A room that is not on the route asks for a reroute, unless it did so
    last. Any room on the route re-arms that; areas (None) change nothing.
    """
    if gallery is None:
        return p, "none"
    if gallery not in route:
        return replace(p, off=gallery), "none" if p.off == gallery else "reroute"
    at = route.index(gallery)
    return (Progress(at), "advance") if at > p.step else (Progress(p.step), "none")


def take_token(tokens: float, last: int | None, now: int, per_minute: float, burst: float) -> tuple[float, bool, int]:
    """(tokens left, admitted, retry after seconds) of a bucket that refills in proportion to time."""
    have = burst if last is None else min(burst, tokens + (now - last) / 60000 * per_minute)
    if have >= 1:
        return have - 1, True, 0
    return have, False, max(1, math.ceil((1 - have) / per_minute * 60))


def _grouped(df: DataFrame, key: str, order: list[str], schema: str, step: Callable[[list], list]) -> DataFrame:
    """An ordered fold a key: rows of one session, sorted, through a step function."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        rows = step(list(p.itertuples(index=False)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy(key).applyInPandas(run, schema)


def _none(x: object) -> object:
    return None if x is None or x != x else x


def fold_positions(events: DataFrame, decay_ms: int = DECAY_MS) -> DataFrame:
    """The trace of each session: (key, event_id, level, gallery, assumed_floor). events: (key, event_id, at, source, usable, gallery, floor, site)."""

    def step(rows: list) -> list:
        a, out = Anchor(), []
        for r in rows:
            a = fold(a, Input(int(r.at), r.source, bool(r.usable), _none(r.gallery), _none(r.floor), _none(r.site)), decay_ms)
            shown = "none" if a.kind == "none" else "room" if a.kind == "room" and r.at - a.at < decay_ms else "area"
            out.append((r.key, r.event_id, shown, a.gallery, a.floor if shown == "area" and a.kind == "room" else a.assumed_floor))
        return out

    key = events.schema["key"].dataType.simpleString()
    return _grouped(events, "key", ["at", "event_id"], f"key {key}, event_id long, level string, gallery string, assumed_floor double", step)


def fold_positions_window(events: DataFrame, decay_ms: int = DECAY_MS) -> DataFrame:
    """The same levels for sessions of one site, as running maxima: no Python, no per-session state.

    With R and G the times of the latest room and usable fix: room while
    G - R < decay or there is no later fix, else area. The age of the room at
    the present event counts as well, as a stale room shows as area.
    """
    w = Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = F.max(F.when(F.col("source") == "room", F.struct("at", "event_id"))).over(w)
    g = F.max(F.when((F.col("source") == "gps") & F.col("usable"), F.struct("at", "event_id"))).over(w)
    out = events.withColumns({"_r": r, "_g": g})
    fresh = F.col("_g").isNull() | (F.col("_g") < F.col("_r")) | (F.col("_g.at") - F.col("_r.at") < decay_ms)
    shown = F.when(F.col("_r").isNull() & F.col("_g").isNull(), "none").when(F.col("_r").isNull() | ~fresh, "area").when(F.col("at") - F.col("_r.at") < decay_ms, "room").otherwise("area")
    return out.select("key", "event_id", shown.alias("level"))


def fold_venues(events: DataFrame, decay_ms: int = DECAY_MS) -> DataFrame:
    """(key, event_id, venue, level, switched) with venues and manual pins; events as above with manual."""

    def step(rows: list) -> list:
        s, out = Fused(), []
        for r in rows:
            s, switched = fold_fused(s, Input(int(r.at), r.source, bool(r.usable), _none(r.gallery), _none(r.floor), _none(r.site), bool(r.manual)), decay_ms)
            out.append((r.key, r.event_id, s.venue, s.anchor.kind, switched))
        return out

    return _grouped(events, "key", ["at", "event_id"], f"key {events.schema['key'].dataType.simpleString()}, event_id long, venue string, level string, switched string", step)


def route_progress(events: DataFrame, route: list[str], known: str | None = None) -> DataFrame:
    """(key, event_id, step, outcome) of sessions that follow one route; events: (key, event_id, at, gallery).

    ``follow`` as windows: the step is the running maximum of places on the
    route, and the room that asked for a reroute last is the session's previous
    room if that one is not on the route. ``known``: the room known before.
    """
    w = Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.array_position(F.array(*map(F.lit, route)), F.col("gallery")).cast("int") - 1
    before = F.greatest(F.coalesce(F.max(at).over(w), F.lit(0)), F.lit(0))
    previous = F.coalesce(F.last("gallery", ignorenulls=True).over(w), F.lit(known))
    out = events.select("key", "event_id", "gallery", at.alias("_at"), before.alias("_before"), previous.alias("_previous"))
    outcome = F.when(F.col("_at") > F.col("_before"), "advance").when((F.col("_at") < 0) & ~F.col("_previous").eqNullSafe(F.col("gallery")), "reroute").otherwise("none")
    return out.select("key", "event_id", F.greatest("_before", F.coalesce("_at", F.lit(0))).alias("step"), outcome.alias("outcome"))


def rate_limited(requests: DataFrame, per_minute: float, burst: float) -> DataFrame:
    """(key, event_id, admitted, retry_after) by a token bucket a key; requests: (key, event_id, at in ms)."""

    def step(rows: list) -> list:
        tokens, last, out = burst, None, []
        for r in rows:
            tokens, ok, wait = take_token(tokens, last, int(r.at), per_minute, burst)
            last = int(r.at)
            out.append((r.key, r.event_id, ok, wait))
        return out

    return _grouped(requests, "key", ["at", "event_id"], f"key {requests.schema['key'].dataType.simpleString()}, event_id long, admitted boolean, retry_after int", step)


def daily_budget(admitted: DataFrame, budget: int) -> DataFrame:
    """admitted (event_id, at in ms) with within_budget: the first ``budget`` of each UTC day, by time."""
    day = F.floor(F.col("at") / 86_400_000)
    w = Window.partitionBy("day").orderBy("at", "event_id")
    return admitted.withColumn("day", day).withColumn("within_budget", F.row_number().over(w) <= budget)


def cache_outcomes(requests: DataFrame, capacity: int, ttl_ms: int) -> DataFrame:
    """(key, event_id, hit) of an LRU cache with expiry, one cache a key; a hit refreshes its place. requests: (key, event_id, at, item)."""

    def step(rows: list) -> list:
        held: OrderedDict[str, int] = OrderedDict()
        out = []
        for r in rows:
            at = int(r.at)
            hit = r.item in held and at - held[r.item] < ttl_ms
            if hit:
                held.move_to_end(r.item)
            else:
                held.pop(r.item, None)
                held[r.item] = at
                if len(held) > capacity:
                    held.popitem(last=False)
            out.append((r.key, r.event_id, hit))
        return out

    return _grouped(requests, "key", ["at", "event_id"], f"key {requests.schema['key'].dataType.simpleString()}, event_id long, hit boolean", step)
