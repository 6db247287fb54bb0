"""Incremental maintenance: delta actions, tombstones, layered baselines, logs, manifests, versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SPANS = 1000


def upsert_actions(known: DataFrame, on_view: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """(id, action): hydrate what is new on view or changed and relevant; tombstone what is known but off view."""
    flag = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    j = flag(known, "_k").join(flag(on_view, "_v"), key, "full_outer").join(flag(changed, "_c"), key, "full_outer")
    k, v, c = (F.coalesce(F.col(x), F.lit(False)) for x in ("_k", "_v", "_c"))
    action = F.when((v & ~k) | (c & (v | k)), F.when(v, "hydrate").otherwise("tombstone")).when(k & ~v, "tombstone").when(k, "keep")
    return j.select(key, action.alias("action")).where("action is not null")


def apply_delta(known: DataFrame, fresh: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """The next snapshot: kept rows, hydrated rows with a room; roomless and tombstoned rows go."""
    kept = known.join(actions.where("action = 'keep'").select(key), key, "left_semi")
    new = fresh.join(actions.where("action = 'hydrate'").select(key), key, "left_semi").where("room is not null and room <> ''")
    return kept.unionByName(new)


def membership_delta(known: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """(id, room, action): add new members, move known ones to their present room, tombstone the lost."""
    j = known.select(key, F.col("room").alias("_old"), F.lit(True).alias("_k")).join(members.select(key, F.col("room").alias("_new"), F.lit(True).alias("_m")), key, "full_outer")
    action = F.when(F.col("_k").isNull(), "add").when(F.col("_m").isNull(), "tombstone").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("move")
    return j.select(key, F.coalesce("_new", "_old").alias("room"), action.alias("action"))


def window_delta(known: DataFrame, touched: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """(id, action) of a harvest window: gained, updated, lost (touched but off view) and deleted ids. touched: (id, on_view)."""
    t = touched.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    a = F.when(F.col("on_view") & F.col("_k").isNull(), "gain").when(F.col("on_view"), "update").when(F.col("_k"), "delete")
    gone = deleted.select(key).distinct().join(known.select(key).distinct(), key, "left_semi").withColumn("action", F.lit("delete"))
    return t.select(key, a.alias("action")).where("action is not null").join(gone.select(key), key, "left_anti").unionByName(gone)


def layered(*layers: DataFrame, key: str = "id") -> DataFrame:
    """One row a key, from the last layer that has it."""
    cols = layers[0].columns
    out = layers[0].withColumn("_p", F.lit(0))
    for p, x in enumerate(layers[1:], 1):
        out = out.unionByName(x.select(cols).withColumn("_p", F.lit(p)))
    best = out.groupBy(key).agg(F.max_by(F.struct(*cols), "_p").alias("_r"))
    return best.select("_r.*")


def replay(log: DataFrame, key: str = "id", order: str = "ordinal", keep: str = "last") -> DataFrame:
    """The state after an append log (op 'put' or 'delete'): first or last put wins; a deleted key stays out until put again."""
    cols = [c for c in log.columns if c not in ("op", order)]
    if keep == "first":
        gone = log.groupBy(key).agg(F.max(F.when(F.col("op") == "delete", F.col(order))).alias("_d"))
        live = log.join(gone, key).where((F.col("op") == "put") & (F.col("_d").isNull() | (F.col(order) > F.col("_d"))))
        return live.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select("_r.*")
    last = log.groupBy(key).agg(F.max_by(F.struct("op", *cols), order).alias("_r"))
    return last.where("_r.op = 'put'").select(*(F.col(f"_r.{c}").alias(c) for c in cols))


def new_keys(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that a cache lacks; cached ones are never computed again."""
    return rows.select(key).where(F.col(key) != "").distinct().join(cache.select(key), key, "left_anti")


def fold_in(objects: DataFrame, vocabulary: DataFrame, titles: DataFrame) -> DataFrame:
    """synonyms of an object: those of its values (value, synonyms) and of its exact title (title, synonyms)."""
    out = objects
    for c in ("classification", "culture", "medium"):
        if c in objects.columns:
            v = vocabulary.select(F.col("value").alias(c), F.col("synonyms").alias(f"_{c}"))
            out = out.join(v, c, "left")
    out = out.join(titles.select("title", F.col("synonyms").alias("_title")), "title", "left")
    extra = [f"_{c}" for c in ("classification", "culture", "medium", "title") if f"_{c}" in out.columns]
    return out.withColumn("synonyms", F.concat_ws(" ", *extra)).drop(*extra)


def translate(objects: DataFrame, titles: DataFrame, vocabulary: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """titleAlt from (title, translated); facets into their translation (value, translated), originals added to tags."""
    out = objects.join(titles.select("title", F.col("translated").alias("titleAlt")), "title", "left").withColumn("titleAlt", F.coalesce("titleAlt", F.lit("")))
    olds = []
    for c in facets:
        v = vocabulary.select(F.col("value").alias(c), F.col("translated").alias(f"_{c}"))
        out = out.join(v, c, "left").withColumn(f"_o{c}", F.when(F.col(f"_{c}").isNotNull(), F.col(c))).withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        olds.append(f"_o{c}")
    tags = F.concat_ws("|", F.when(F.col("tags") != "", F.col("tags")), *olds)
    return out.withColumn("tags", tags).drop(*olds)


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(key, problem): missing, size drift, hash drift; each file once, the first that applies. Columns key, bytes, sha256."""
    f = found.select("key", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    return manifest.join(f, "key", "left").select("key", problem.alias("problem")).where("problem is not null")


def expired_versions(versions: DataFrame, live: str, today: Column, keep_days: int = 14) -> DataFrame:
    """Versions whose date in the prefix is more than ``keep_days`` old; never the live one nor undated ones."""
    day = F.try_to_date(F.regexp_extract("version", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return versions.where((F.col("version") != live) & (F.col("version") != "latest") & day.isNotNull() & (F.datediff(today, day) > keep_days))


def publish(df: DataFrame, root: str, version: str) -> dict[str, object]:
    """Write a version, read it back, and only then move the pointer; returns what the pointer says.

    The pointer is a one-row table replaced last: readers see the old version until then.
    """
    spark = df.sparkSession
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    check = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum")
    back = spark.read.parquet(path).agg(F.count("*").alias("rows"), check).first()
    sent = df.agg(F.count("*").alias("rows"), check).first()
    if back != sent:
        raise ValueError(f"version {version} differs after reading it back: {back} and {sent}")
    spark.createDataFrame([(version, back["rows"], str(back["checksum"]))], "version string, rows long, checksum string").coalesce(1).write.mode("overwrite").parquet(f"{root}/latest")
    return {"version": version, "rows": back["rows"]}


def read_latest(spark, root: str) -> DataFrame:  # noqa: ANN001
    """The published version."""
    version = spark.read.parquet(f"{root}/latest").first()["version"]
    return spark.read.parquet(f"{root}/v={version}")


def side_outputs(df: DataFrame, root: str, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Writes each part of one snapshot, which is computed once, to a folder of its own; returns what can be read back."""
    snapshot = written(df, "snapshot")
    out = {}
    for name, make in parts.items():
        made = make(snapshot)
        made.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = df.sparkSession.read.schema(made.schema).parquet(f"{root}/{name}")
    return out


def evict(files: DataFrame, cap: int, share: float = 0.8) -> DataFrame:
    """The oldest files that must go until ``share`` of the cap is left; none while within the cap. Columns name, bytes, mtime."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if total <= cap:
        return files.limit(0)
    # running sums in two levels: over at most SPANS spans of time, then within each
    first, last = files.agg(F.min("mtime"), F.max("mtime")).first()
    span = F.floor((F.col("mtime") - first) * SPANS / (last - first + 1))
    spans = files.groupBy(span.alias("_span")).agg(F.sum("bytes").alias("_own"))
    spans = spans.select("_span", (F.sum("_own").over(Window.orderBy("_span")) - F.col("_own")).alias("_earlier"))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("_span").orderBy("mtime", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = files.withColumn("_span", span).withColumn("_before", inside).join(spans, "_span").withColumn("_before", F.col("_before") + F.col("_earlier"))
    return out.where(F.lit(total) - F.col("_before") > cap * share).select(files.columns)


def isolated(loaders: dict, previous: DataFrame, by: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """Fresh rows of every source that loads, the previous rows of those that fail, and the status of each.

    A loader is a call that returns a DataFrame with the columns of ``previous``; its rows are written to the
    shared folder, so that a source that fails at any row fails here and alone.
    """
    out, status = None, {}
    for name, load in loaders.items():
        try:
            rows = written(load().select(previous.columns), "source")
            status[name] = "fresh"
        except Exception as e:  # any failure of one source must not stop the others
            rows = previous.where(F.col(by) == name)
            status[name] = f"stale: {type(e).__name__}"
        out = rows if out is None else out.unionByName(rows)
    return (previous.limit(0) if out is None else out), status
