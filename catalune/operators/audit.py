"""Data-quality audits: fill and join rates, duplicates, clusters, order-statistic quantiles, churn, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATES = ("PASS", "WARN", "FAIL")


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part * 100.0 / whole)


def fill_rates(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """n and, for each column, the count and percentage of non-empty texts."""
    counts = [F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"{c}_filled") for c in cols]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    return out.withColumns({f"{c}_pct": percent(F.col(f"{c}_filled"), F.col("n")) for c in cols})


def join_rate(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """total, matched and pct of rows with a partner; 100 where there are no rows. Keys of ``right`` need not be unique."""
    flags = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    out = left.join(flags, keys, "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("_hit").alias("matched"))
    return out.withColumn("pct", percent(F.col("matched"), F.col("total"), 100.0))


def band(pct: Column) -> Column:
    return F.when(pct >= 99, "PASS").when(pct >= 95, "WARN").otherwise("FAIL")


def duplicates(df: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def violations(df: DataFrame, c: str, allowed: DataFrame) -> DataFrame:
    """Distinct values outside the allowed set."""
    return df.select(c).distinct().join(allowed, c, "left_anti")


def index_quantiles(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Order statistics sorted[min(n - 1, floor(n p))], by rank, without collecting a group."""
    w = Window.partitionBy(*by).orderBy(value)
    ranked = df.select(*by, value, (F.row_number().over(w) - 1).alias("_at"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)))
    return ranked.groupBy(*by).agg(F.first("_n").alias("n"), *(F.max(F.when(F.col("_at") == at(p), F.col(value))).alias(name) for name, p in points.items()))


def churn(prev: DataFrame, curr: DataFrame, key: list[str], place: str, by: str) -> DataFrame:
    """matched, added, removed, moved between two snapshots, by one full outer join; the baseline is at least one."""
    p = prev.select(*key, F.col(place).alias("_p"), F.lit(1).alias("_in_p"))
    c = curr.select(*key, F.col(place).alias("_c"), F.lit(1).alias("_in_c"))
    both = p.join(c, key, "full_outer")
    hit = F.col("_in_p").isNotNull() & F.col("_in_c").isNotNull()
    out = both.groupBy(by).agg(
        F.count("_in_p").alias("before"),
        F.count_if(hit).alias("matched"),
        F.count_if(F.col("_in_p").isNull()).alias("added"),
        F.count_if(F.col("_in_c").isNull()).alias("removed"),
        F.count_if(hit & ~F.col("_p").eqNullSafe(F.col("_c"))).alias("moved"),
    )
    base = F.greatest(F.col("before"), F.lit(1))
    return out.withColumns({"added_pct": F.col("added") * 100.0 / base, "removed_pct": F.col("removed") * 100.0 / base, "moved_pct": percent(F.col("moved"), F.col("matched"))})


def worst(gates: DataFrame, by: list[str]) -> DataFrame:
    """The worst status of each group of checks (check, status)."""
    rank = F.array_position(F.array(*map(F.lit, GATES)), F.col("status"))
    out = gates.groupBy(*by).agg(F.max(rank).cast("int").alias("_r"), F.count("*").alias("checks"))
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, GATES)), F.col("_r"))).drop("_r")


def resolve(df: DataFrame, key: str, exact: DataFrame, aliases: DataFrame) -> DataFrame:
    """room and via: the exact code, else an alias, else the code without leading zeros.

    exact has (code); aliases has (alias, code).
    """
    e = exact.select(F.col("code").alias("_e"))
    a = aliases.select(F.col("alias").alias("_k"), F.col("code").alias("_a"))
    z = exact.select(F.col("code").alias("_z"))
    bare = F.regexp_replace(F.col(key), "^0+", "")
    out = df.join(e, F.col(key) == F.col("_e"), "left").join(a, F.col(key) == F.col("_k"), "left").join(z, bare == F.col("_z"), "left")
    via = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_a").isNotNull(), "alias").when(F.col("_z").isNotNull(), "zero-pad")
    return out.withColumns({"room": F.coalesce("_e", "_a", "_z"), "via": via}).drop("_e", "_k", "_a", "_z")


def canonical_codes(df: DataFrame, key: str, codes: DataFrame) -> DataFrame:
    """Leading zeros go iff the stripped code exists and the padded one does not. codes has (code)."""
    bare = F.regexp_replace(F.col(key), "^0+", "")
    p = codes.select(F.col("code").alias("_p"))
    s = codes.select(F.col("code").alias("_s"))
    out = df.join(p, F.col(key) == F.col("_p"), "left").join(s, bare == F.col("_s"), "left")
    return out.withColumn("canonical", F.when(F.col("_p").isNull() & F.col("_s").isNotNull(), bare).otherwise(F.col(key))).drop("_p", "_s")


def late_filled(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """The first non-null value of each column by order: labels that come late still fill."""
    return df.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols))


def union_checks(*checks: DataFrame) -> DataFrame:
    """Check tables (check, status, detail) one under another."""
    return reduce(DataFrame.unionByName, checks)


def win_loss(df: DataFrame, group: str, item: str, value: str, incumbent: str) -> DataFrame:
    """Each group's paired differences to the incumbent: n, mean difference, wins, ties, losses."""
    base = df.where(F.col(group) == incumbent).select(item, F.col(value).alias("_b"))
    d = df.where(F.col(group) != incumbent).join(base, item).withColumn("_d", F.col(value) - F.col("_b"))
    return d.groupBy(group).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") == 0).alias("ties"), F.count_if(F.col("_d") < 0).alias("losses"))


def bootstrap(df: DataFrame, value: str, resamples: int = 1000, seed: int = 7, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile bootstrap of the mean by Poisson weights: every row is seen once, no row is gathered.

    In resample r a row counts k times with probability 1 / (e k!); k follows
    from a hash of (row, r), so the result does not depend on partitions. The
    weights of 64 resamples are summed at a time, as columns.
    """
    steps = []
    total, p = 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    row = F.xxhash64(F.col("_key"), F.lit(seed))
    base = df.select(F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_key")) if "_key" not in df.columns else df.select(F.col(value).cast("double").alias("_v"), "_key")

    def weight(r: int) -> Column:
        u = F.pmod(F.xxhash64(row, F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
        w = F.lit(8.0)
        for k in range(7, -1, -1):
            w = F.when(u < steps[k], float(k)).otherwise(w)
        return w

    parts = []
    for a in range(0, resamples, 64):
        own = range(a, min(a + 64, resamples))
        sums = base.select("_v", *(weight(r).alias(f"w{r}") for r in own)).agg(*(F.sum(F.col(f"w{r}") * F.col("_v")).alias(f"s{r}") for r in own), *(F.sum(f"w{r}").alias(f"n{r}") for r in own))
        parts.append(sums.select(F.explode(F.array(*(F.col(f"s{r}") / F.col(f"n{r}") for r in own))).alias("mean")))
    means = reduce(DataFrame.union, parts).where("mean is not null")
    q = index_quantiles(means.withColumn("_g", F.lit(0)), "mean", ["_g"], {"lo": low, "hi": high}).drop("_g", "n")
    return q.withColumn("resamples", F.lit(resamples))
