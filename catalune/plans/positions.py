"""Position, rate-limit and event-time queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import position as ps
from ..registry import query, table
from ..streaming import processors

DAY = 86_400_000
_EV = "ev AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS tm, CASE WHEN event_type IN ('signup', 'purchase') THEN 'room' ELSE 'gps' END AS source, event_type <> 'error' AND value <= 60 AS usable, CAST(json_extract(props, '$.k') AS VARCHAR) AS gallery FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    room = F.col("event_type").isin("signup", "purchase")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("user_id").alias("key"),
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(room, "room").otherwise("gps").alias("source"),
        ((F.col("event_type") != "error") & (F.col("value") <= 60)).alias("usable"),
        F.when(room, k).alias("gallery"),
        F.when(room, k.cast("double") % 4).alias("floor"),
        F.lit("home").alias("site"),
    )


@query("SELECT event_id, round(0.4 * least(1.0, 65.0 / greatest(value * 5, 1)), 6) AS confidence FROM events WHERE value * 5 <= 300 AND user_id * 10 <= 350")
def area_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes good enough for an area, with confidence."""
    e = table(spark, sf_dir, "events")
    return e.where(ps.usable_fix(F.col("value") * 5, F.col("user_id") * 10)).select("event_id", F.round(ps.area_confidence(F.col("value") * 5), 6).alias("confidence"))


@query("SELECT event_id FROM events WHERE value * 20 <= 1000 AND user_id * 20 <= 350 + greatest(value * 20, 0)")
def venue_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes good enough for a venue."""
    e = table(spark, sf_dir, "events")
    return e.where(ps.usable_venue(F.col("value") * 20, F.col("user_id") * 20)).select("event_id")


_LEVELS = f"""WITH {_EV}, m AS (SELECT key, event_id, tm,
    max((tm, event_id)) FILTER (source = 'room') OVER w AS r, max((tm, event_id)) FILTER (source = 'gps' AND usable) OVER w AS g
    FROM ev WINDOW w AS (PARTITION BY key ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING))
    SELECT key, event_id, CASE WHEN r IS NULL AND g IS NULL THEN 'none' WHEN r IS NULL OR NOT (g IS NULL OR g < r OR g[1] - r[1] < {DAY}) THEN 'area' WHEN tm - r[1] < {DAY} THEN 'room' ELSE 'area' END AS level FROM m"""


@query(_LEVELS)
def anchor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the fold, as running maxima."""
    return ps.fold_positions_window(_events(spark, sf_dir), DAY)


@query(_LEVELS)
def anchor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same levels by the ordered fold itself."""
    return ps.fold_positions(_events(spark, sf_dir), DAY).select("key", "event_id", "level")


@query()
def venue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues, pins and switches (path-dependent: no SQL twin)."""
    e = _events(spark, sf_dir)
    site = F.concat(F.lit("site"), (F.floor(F.col("event_id") / 40) % 3).cast("string"))
    e = e.withColumns({"site": site, "manual": F.col("event_id") % 50 == 0, "source": F.when(F.col("event_id") % 25 == 0, "venue").otherwise(F.col("source"))})
    return ps.fold_venues(e, DAY)


@query(
    f"""WITH {_EV}, g AS (SELECT key, event_id, tm, CASE WHEN source = 'room' THEN gallery END AS gallery FROM ev),
    p AS (SELECT *, CASE WHEN gallery IS NULL THEN NULL WHEN CAST(gallery AS INT) % 5 = 0 AND CAST(gallery AS INT) < 100 THEN CAST(gallery AS INT) // 5 ELSE -1 END AS pos FROM g),
    q AS (SELECT *, greatest(coalesce(max(pos) OVER w, 0), 0) AS before, last_value(gallery IGNORE NULLS) OVER w AS previous FROM p WINDOW w AS (PARTITION BY key ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT key, event_id, greatest(before, coalesce(pos, 0)) AS step, CASE WHEN pos > before THEN 'advance' WHEN pos < 0 AND previous IS DISTINCT FROM gallery THEN 'reroute' ELSE 'none' END AS outcome FROM q"""
)
def route_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress along a route of galleries."""
    route = [str(k) for k in range(0, 100, 5)]
    return ps.route_progress(_events(spark, sf_dir).select("key", "event_id", "at", "gallery"), route)


@query(
    f"""WITH RECURSIVE {_EV}, e AS (SELECT key, event_id, tm, row_number() OVER (PARTITION BY key ORDER BY tm, event_id) AS i FROM ev),
    r(key, i, event_id, tm, have) AS (SELECT key, i, event_id, tm, 3.0::DOUBLE FROM e WHERE i = 1
      UNION ALL SELECT e.key, e.i, e.event_id, e.tm, least(3.0::DOUBLE, CASE WHEN have >= 1 THEN have - 1 ELSE have END + (e.tm - r.tm) / 60000.0::DOUBLE * (1 / 1440.0::DOUBLE)) FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
    SELECT key, event_id, have >= 1 AS admitted, CAST(CASE WHEN have >= 1 THEN 0 ELSE greatest(1, ceil((1 - have) / (1 / 1440.0::DOUBLE) * 60)) END AS INTEGER) AS retry_after FROM r"""
)
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted requests at one a day with bursts of three."""
    e = _events(spark, sf_dir).select("key", "event_id", "at")
    return ps.rate_limited(e, per_minute=1 / 1440, burst=3)


@query(f"WITH {_EV} SELECT event_id, row_number() OVER (PARTITION BY tm // {DAY} ORDER BY tm, event_id) <= 100 AS within_budget FROM ev")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of each UTC day."""
    return ps.daily_budget(_events(spark, sf_dir).select("event_id", "at"), 100).select("event_id", "within_budget")


@query()
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an LRU cache with expiry (path-dependent: no SQL twin)."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.get_json_object("props", "$.k").alias("item"))
    return ps.cache_outcomes(e, 40, DAY)


@query("SELECT epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: six-hour windows."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return processors.windowed_counts(e, "6 hours").select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT epoch_ms(b - INTERVAL (3 * i) HOUR) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM events), range(2) r(i) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: six-hour windows every three hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return processors.windowed_counts(e, "6 hours", "3 hours").select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 28800000000 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 8 HOUR) // 1000 AS end_ms, count(*) AS n FROM y GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions with a gap of eight hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return processors.sessions(e, "8 hours").select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")
