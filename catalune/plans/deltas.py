"""Delta and publication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..registry import query, table

_K = "k AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS room FROM part WHERE p_partkey % 3 <> 0), v AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 <> 0), c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 0)"


def _parts(spark: SparkSession, sf_dir: str, where: str = "true", room: str = "cast(p_size as string)") -> DataFrame:
    return table(spark, sf_dir, "part").where(where).select(F.col("p_partkey").alias("id"), F.expr(room).alias("room"))


@query(
    f"""WITH {_K}, j AS (SELECT p_partkey AS id, p_partkey IN (SELECT id FROM k) AS k, p_partkey IN (SELECT id FROM v) AS v, p_partkey IN (SELECT id FROM c) AS c FROM part)
    SELECT * FROM (SELECT id, CASE WHEN (v AND NOT k) OR (c AND (v OR k)) THEN CASE WHEN v THEN 'hydrate' ELSE 'tombstone' END WHEN k AND NOT v THEN 'tombstone' WHEN k THEN 'keep' END AS action FROM j) WHERE action IS NOT NULL"""
)
def delta_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrate, keep or tombstone."""
    return delta.upsert_actions(_parts(spark, sf_dir, "p_partkey % 3 <> 0"), _parts(spark, sf_dir, "p_partkey % 5 <> 0"), _parts(spark, sf_dir, "p_partkey % 4 = 0"))


@query(
    f"""WITH {_K}, j AS (SELECT p_partkey AS id, p_size, p_partkey IN (SELECT id FROM k) AS k, p_partkey IN (SELECT id FROM v) AS v, p_partkey IN (SELECT id FROM c) AS c FROM part),
    a AS (SELECT id, p_size, CASE WHEN (v AND NOT k) OR (c AND (v OR k)) THEN CASE WHEN v THEN 'hydrate' ELSE 'tombstone' END WHEN k AND NOT v THEN 'tombstone' WHEN k THEN 'keep' END AS action FROM j)
    SELECT id, CAST(p_size AS VARCHAR) AS room FROM a WHERE action = 'keep' UNION ALL SELECT id, 'r' || p_size FROM a WHERE action = 'hydrate' AND p_size % 13 <> 0"""
)
def applied_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot; hydrated rows without a room drop out."""
    known = _parts(spark, sf_dir, "p_partkey % 3 <> 0")
    actions = delta.upsert_actions(known, _parts(spark, sf_dir, "p_partkey % 5 <> 0"), _parts(spark, sf_dir, "p_partkey % 4 = 0"))
    fresh = _parts(spark, sf_dir, room="case when p_size % 13 = 0 then '' else concat('r', p_size) end")
    return delta.apply_delta(known, fresh, actions)


@query("WITH k AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS room FROM part WHERE p_partkey % 3 <> 0), m AS (SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS room FROM part WHERE p_partkey % 5 <> 0) SELECT coalesce(k.id, m.id) AS id, coalesce(m.room, k.room) AS room, CASE WHEN k.id IS NULL THEN 'add' WHEN m.id IS NULL THEN 'tombstone' WHEN k.room = m.room THEN 'keep' ELSE 'move' END AS action FROM k FULL JOIN m ON k.id = m.id")
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, move, keep, tombstone."""
    members = _parts(spark, sf_dir, "p_partkey % 5 <> 0", "cast(case when p_partkey % 7 = 0 then p_size + 1 else p_size end as string)")
    return delta.membership_delta(_parts(spark, sf_dir, "p_partkey % 3 <> 0"), members)


@query("WITH k AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT p_partkey AS id, p_size % 2 = 0 AS on_view FROM part WHERE p_partkey % 4 = 0), d AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 3 <> 0), a AS (SELECT id, CASE WHEN on_view AND id NOT IN (SELECT id FROM k) THEN 'gain' WHEN on_view THEN 'update' WHEN id IN (SELECT id FROM k) THEN 'delete' END AS action FROM t) SELECT id, action FROM a WHERE action IS NOT NULL AND id NOT IN (SELECT id FROM d) UNION ALL SELECT id, 'delete' FROM d")
def window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a harvest window gains, updates and deletes."""
    touched = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("on_view"))
    return delta.window_delta(_parts(spark, sf_dir, "p_partkey % 3 <> 0"), touched, _parts(spark, sf_dir, "p_partkey % 10 = 0"))


@query("SELECT id, coalesce(max(room) FILTER (p = 1), max(room) FILTER (p = 0)) AS room FROM (SELECT p_partkey AS id, 'a' || p_size AS room, 0 AS p FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'b' || p_size, 1 FROM part WHERE p_partkey % 3 = 0) GROUP BY id")
def layered_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later layer wins."""
    return delta.layered(_parts(spark, sf_dir, "p_partkey % 2 = 0", "concat('a', p_size)"), _parts(spark, sf_dir, "p_partkey % 3 = 0", "concat('b', p_size)"))


_LOG = "log AS (SELECT user_id AS id, event_id AS ordinal, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value AS v FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("value").alias("v"))


@query(f"WITH {_LOG} SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS r FROM log) WHERE r = 1 AND op = 'put'")
def replayed_log_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write wins, deletions drop."""
    return delta.replay(_log(spark, sf_dir)).select("id", "v")


@query(f"WITH {_LOG}, d AS (SELECT id, max(ordinal) FILTER (op = 'delete') AS d FROM log GROUP BY id) SELECT id, arg_min(v, ordinal) AS v FROM log JOIN d USING (id) WHERE op = 'put' AND (d IS NULL OR ordinal > d) GROUP BY id")
def replayed_log_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first write since the last deletion wins."""
    return delta.replay(_log(spark, sf_dir), keep="first").select("id", "v")


@query("SELECT DISTINCT p_name AS title FROM part WHERE p_name <> '' AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 9 = 0)")
def uncached_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the cache lacks."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return delta.new_keys(p, p.where("p_partkey % 9 = 0").select("title").distinct(), "title")


@query("SELECT p_partkey AS id, concat_ws(' ', CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'syn-' || lower(p_type) END, CASE WHEN p_name LIKE 'red%' THEN 'crimson' END) AS synonyms FROM part")
def synonyms_folded_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms of values and of exact titles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("classification"))
    vocab = p.select(F.col("classification").alias("value")).distinct().where(F.col("value").isin("ECONOMY", "STANDARD")).withColumn("synonyms", F.concat(F.lit("syn-"), F.lower("value")))
    titles = p.select("title").distinct().where("title like 'red%'").withColumn("synonyms", F.lit("crimson"))
    return delta.fold_in(p, vocab, titles).select("id", "synonyms")


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE 'blue%' THEN 'azul' ELSE '' END AS titleAlt, CASE p_type WHEN 'ECONOMY' THEN 'budget' ELSE p_type END AS classification, concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'even' END, CASE p_type WHEN 'ECONOMY' THEN 'ECONOMY' END) AS tags FROM part")
def translated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations fold in, originals go to the tags."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("classification"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("").alias("tags"))
    titles = p.select("title").distinct().where("title like 'blue%'").withColumn("translated", F.lit("azul"))
    vocab = spark.createDataFrame([("ECONOMY", "budget")], "value string, translated string")
    return delta.translate(p, titles, vocab, ("classification",)).select("id", "titleAlt", "classification", "tags")


@query("SELECT 'f' || p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 5 = 1 THEN 'size' ELSE 'hash' END AS problem FROM part WHERE p_partkey % 5 IN (0, 1) OR (p_partkey % 5 IN (2, 3) AND p_partkey % 6 = 0)")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: missing files, size drift, hash drift."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").alias("bytes"), F.sha2(F.col("p_name"), 256).alias("sha256"), "p_partkey")
    m = F.col("p_partkey") % 5
    found = p.where(m != 0).select("key", F.when(m == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(m.isin(1, 2, 3) & (F.col("p_partkey") % 6 == 0), "drift").otherwise(F.col("sha256")).alias("sha256"))
    return delta.verify_manifest(p.select("key", "bytes", "sha256"), found)


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '-run' AS version FROM orders WHERE o_orderdate < DATE '1995-06-15' - INTERVAL 14 DAY AND strftime(o_orderdate, '%Y-%m-%d') <> '1995-01-01'")
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: versions over fourteen days old, but not the live one."""
    v = table(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-run")).alias("version")).distinct()
    return delta.expired_versions(v, "1995-01-01-run", F.to_date(F.lit("1995-06-15")))


@query("WITH o AS (SELECT o_orderkey AS name, CAST(o_totalprice AS BIGINT) AS bytes, epoch_ms(o_orderdate) AS mtime FROM orders), r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY mtime, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER () AS total FROM o) SELECT name FROM r WHERE total > 2000000000 AND total - before > 2000000000 * 0.8")
def evicted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest files over the mark."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.round("o_totalprice").cast("long").alias("bytes"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    return delta.evict(o, 2_000_000_000).select("name")


@query("SELECT 'a' AS source, p_partkey AS id FROM part WHERE p_size <= 20 UNION ALL SELECT 'b', p_partkey FROM part WHERE p_size > 20")
def isolated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source fails and keeps its previous rows, the other is fresh."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 20, "a").otherwise("b").alias("source"), F.col("p_partkey").alias("id"))

    def broken() -> DataFrame:
        raise OSError("the source does not answer")

    return delta.isolated({"a": lambda: p.where("source = 'a'"), "b": broken}, p)[0]
