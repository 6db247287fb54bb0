"""Audit, aggregation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit
from ..registry import query, table
from ..sources.adapters import part_objects

_PAIR = """prev AS (SELECT p_brand AS museum, p_partkey AS sourceId, p_size AS gallery FROM part WHERE p_partkey % 11 <> 0),
    curr AS (SELECT p_brand AS museum, p_partkey AS sourceId, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS gallery FROM part WHERE p_partkey % 10 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A previous and a current snapshot of the parts, by a fixed edit."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("museum"), F.col("p_partkey").alias("sourceId"), F.col("p_size").alias("gallery"))
    moved = F.when(F.col("sourceId") % 7 == 0, F.col("gallery") + 1).otherwise(F.col("gallery"))
    return p.where("sourceId % 11 <> 0"), p.where("sourceId % 10 <> 0").withColumn("gallery", moved)


@query("SELECT source AS museum, count(*) AS n, count(*) FILTER (text <> '') AS text_filled, count(*) FILTER (CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END <> '') AS label_filled, round(count(*) FILTER (text <> '') * 100.0::DOUBLE / count(*), 6) AS text_pct, round(count(*) FILTER (CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END <> '') * 100.0::DOUBLE / count(*), 6) AS label_pct FROM documents GROUP BY source")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: non-empty shares by museum."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("museum"), "text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("label"))
    out = audit.fill_rates(d, ["text", "label"], ["museum"])
    return out.withColumns({c: F.round(c, 6) for c in ("text_pct", "label_pct")})


@query("SELECT r_name AS site, count(*) AS n, count(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END) AS labelled FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: not-null coverage for a set of sites."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("site")).agg(F.count("*").alias("n"), F.count(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))).alias("labelled"))


@query("WITH x AS (SELECT c_mktsegment AS museum, count(*) AS total, count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)) AS matched FROM customer GROUP BY 1) SELECT museum, total, matched, round(matched * 100.0::DOUBLE / total, 6) AS pct, CASE WHEN matched * 100.0 / total >= 99 THEN 'PASS' WHEN matched * 100.0 / total >= 95 THEN 'WARN' ELSE 'FAIL' END AS status FROM x")
def join_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with a partner, banded."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("museum"), F.col("c_nationkey").alias("n_nationkey"))
    out = audit.join_rate(c, table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0"), ["n_nationkey"], ["museum"])
    return out.withColumn("status", audit.band(F.col("pct"))).withColumn("pct", F.round("pct", 6))


@query("SELECT p_name AS title, p_brand AS artist, count(*) AS n FROM part WHERE p_name <> '' GROUP BY ALL HAVING count(*) > 3")
def noise_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and artist pairs that occur more than three times."""
    p = table(spark, sf_dir, "part").where("p_name <> ''").select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return audit.duplicates(p, ["title", "artist"], 3)


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def value_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: values outside the allowed set."""
    allowed = spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    return audit.violations(table(spark, sf_dir, "events"), "event_type", allowed)


@query("WITH g AS (SELECT l_shipmode AS k, l_orderkey, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_orderkey FROM lineitem) GROUP BY ALL), r AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS pos, count(*) OVER (PARTITION BY k) AS c FROM g) SELECT k AS flag, max(c) AS n, max(n) FILTER (pos = least(c - 1, floor(c * 0.5))) AS p50, max(n) FILTER (pos = least(c - 1, floor(c * 0.95))) AS p95, max(n) FILTER (pos = least(c - 1, floor(c * 1.0))) AS max FROM r GROUP BY k")
def group_size_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-statistic quantiles of group sizes."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_orderkey").agg(F.count("*").alias("size"))
    return audit.index_quantiles(g, "size", ["flag"], {"p50": 0.5, "p95": 0.95, "max": 1.0})


@query("SELECT l_returnflag AS license, l_linestatus AS imageLicense, count(*) AS n FROM lineitem GROUP BY ALL")
def license_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two columns."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("license"), F.col("l_linestatus").alias("imageLicense")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent values, ties by value."""
    p = table(spark, sf_dir, "part").where("p_brand <> ''")
    return p.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(12)


@query("SELECT 'classification' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'culture', p_brand, count(*) FROM part GROUP BY p_brand")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: value counts of two facets, in one pass over the rows."""
    p = table(spark, sf_dir, "part")
    facets = F.array(F.struct(F.lit("classification").alias("facet"), F.col("p_type").alias("value")), F.struct(F.lit("culture").alias("facet"), F.col("p_brand").alias("value")))
    return p.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS site, count(*) AS objects, count(DISTINCT c_nationkey) AS galleries, max_by(c_nationkey, (k, -c_nationkey)) AS fullest FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS k FROM customer) GROUP BY 1")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by site, distinct galleries, and the fullest gallery (ties: smallest)."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("site"), "c_nationkey").agg(F.count("*").alias("k"))
    return g.groupBy("site").agg(F.sum("k").alias("objects"), F.count("*").alias("galleries"), F.max_by("c_nationkey", F.struct(F.col("k"), -F.col("c_nationkey"))).alias("fullest"))


@query("SELECT n_regionkey AS code, string_agg(DISTINCT n_name, ' / ' ORDER BY n_name) AS title, count(DISTINCT s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a group joined, member sets united."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    titles = F.array_join(F.array_sort(F.collect_set("n_name")), " / ")
    return j.groupBy(F.col("n_regionkey").alias("code")).agg(titles.alias("title"), F.count_distinct("s_suppkey").alias("members"))


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS title, arg_min(value, event_id) FILTER (value > 50) AS floor FROM events GROUP BY user_id")
def late_filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label seen, late ones filling the gaps."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("title"), F.when(F.col("value") > 50, F.col("value")).alias("floor"))
    return audit.late_filled(e, "user_id", "event_id", ["title", "floor"])


@query("SELECT r_name AS site, sum(CASE WHEN n_nationkey % 3 = 0 THEN s ELSE 0 END)::BIGINT AS covered, sum(s)::BIGINT AS members, round(sum(CASE WHEN n_nationkey % 3 = 0 THEN s ELSE 0 END)::DOUBLE / sum(s), 6) AS share, round(max(s)::DOUBLE / sum(s), 6) AS modal_share FROM (SELECT n_nationkey, n_regionkey, count(c_custkey) AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of members in matched groups, share of the modal group."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("s"))
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["s"])
    got = F.sum(F.when(F.col("n_nationkey") % 3 == 0, F.col("s")).otherwise(0))
    return n.groupBy(F.col("r_name").alias("site")).agg(got.alias("covered"), F.sum("s").alias("members"), F.round(got / F.sum("s"), 6).alias("share"), F.round(F.max("s") / F.sum("s"), 6).alias("modal_share"))


@query(
    """WITH f AS (SELECT source AS museum, 'labels' AS "check", CASE WHEN count(quality) * 100.0 / count(*) >= 40 THEN 'PASS' WHEN count(quality) * 100.0 / count(*) >= 35 THEN 'WARN' ELSE 'FAIL' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
    UNION ALL SELECT source, 'duplicates', CASE WHEN count(*) - count(DISTINCT text) = 0 THEN 'PASS' ELSE 'WARN' END FROM documents GROUP BY source)
    SELECT museum, count(*) AS checks, CASE max(CASE status WHEN 'PASS' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END) WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS status FROM f GROUP BY museum"""
)
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of each museum's checks."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pct = F.count("quality") * 100.0 / F.count("*")
    a = d.join(q, "doc_id", "left").groupBy(F.col("source").alias("museum")).agg(F.when(pct >= 40, "PASS").when(pct >= 35, "WARN").otherwise("FAIL").alias("status")).withColumn("check", F.lit("labels"))
    copies = F.count("*") - F.count_distinct("text")
    b = d.groupBy(F.col("source").alias("museum")).agg(F.when(copies == 0, "PASS").otherwise("WARN").alias("status")).withColumn("check", F.lit("duplicates"))
    return audit.worst(audit.union_checks(a, b), ["museum"])


@query(
    f"""WITH {_PAIR}, j AS (SELECT museum, p.gallery AS pg, c.gallery AS cg, p.sourceId AS ps, c.sourceId AS cs FROM prev p FULL JOIN curr c USING (museum, sourceId)),
    g AS (SELECT museum, count(ps) AS before, count(*) FILTER (ps IS NOT NULL AND cs IS NOT NULL) AS matched, count(*) FILTER (ps IS NULL) AS added, count(*) FILTER (cs IS NULL) AS removed, count(*) FILTER (ps IS NOT NULL AND cs IS NOT NULL AND pg <> cg) AS moved FROM j GROUP BY museum)
    SELECT *, round(added * 100.0::DOUBLE / greatest(before, 1), 6) AS added_pct, round(removed * 100.0::DOUBLE / greatest(before, 1), 6) AS removed_pct, round(CASE WHEN matched = 0 THEN 0 ELSE moved * 100.0::DOUBLE / matched END, 6) AS moved_pct FROM g"""
)
def snapshot_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, added, removed and moved rows between snapshots."""
    out = audit.churn(*_snapshots(spark, sf_dir), ["museum", "sourceId"], "gallery", "museum")
    return out.withColumns({c: F.round(c, 6) for c in ("added_pct", "removed_pct", "moved_pct")})


@query(
    """WITH k AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN lpad(CAST(s_nationkey AS VARCHAR), 3, '0') WHEN 1 THEN 'N' || s_nationkey WHEN 2 THEN CAST(s_nationkey AS VARCHAR) ELSE 'zz' END AS code FROM supplier),
    c AS (SELECT CAST(n_nationkey AS VARCHAR) AS code FROM nation), a AS (SELECT 'N' || n_nationkey AS alias, CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey % 2 = 0)
    SELECT id, coalesce(e.code, a.code, z.code) AS room, CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN a.code IS NOT NULL THEN 'alias' WHEN z.code IS NOT NULL THEN 'zero-pad' END AS via
    FROM k LEFT JOIN c e ON e.code = k.code LEFT JOIN a ON a.alias = k.code LEFT JOIN c z ON z.code = regexp_replace(k.code, '^0+', '')"""
)
def resolved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, alias, zero-pad cascade."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    own = F.col("s_nationkey").cast("string")
    m = F.col("s_suppkey") % 4
    k = s.select(F.col("s_suppkey").alias("id"), F.when(m == 0, F.lpad(own, 3, "0")).when(m == 1, F.concat(F.lit("N"), own)).when(m == 2, own).otherwise("zz").alias("k"))
    codes = n.select(F.col("n_nationkey").cast("string").alias("code"))
    aliases = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_nationkey").cast("string").alias("code"))
    return audit.resolve(k, "k", codes, aliases).select("id", "room", "via")


@query(
    """WITH c AS (SELECT CASE WHEN n_nationkey < 5 THEN lpad(CAST(n_nationkey AS VARCHAR), 3, '0') ELSE CAST(n_nationkey AS VARCHAR) END AS code FROM nation),
    k AS (SELECT s_suppkey AS id, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS k FROM supplier)
    SELECT id, CASE WHEN k NOT IN (SELECT code FROM c) AND regexp_replace(k, '^0+', '') IN (SELECT code FROM c) THEN regexp_replace(k, '^0+', '') ELSE k END AS canonical FROM k"""
)
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading zeros go only where the stripped code alone exists."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    own = F.col("n_nationkey").cast("string")
    codes = n.select(F.when(F.col("n_nationkey") < 5, F.lpad(own, 3, "0")).otherwise(own).alias("code"))
    k = s.select(F.col("s_suppkey").alias("id"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0").alias("k"))
    return audit.canonical_codes(k, "k", codes).select("id", "canonical")


@query("SELECT l_returnflag AS museum, l_linestatus AS site, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per museum, per site and overall, in one pass."""
    r = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "museum", "l_linestatus": "site"})
    return r.rollup("museum", "site").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT role AS model, count(*) AS calls, sum(len(text))::BIGINT AS chars, round(avg(len(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means by model."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.char_length("text")).alias("chars"), F.round(F.avg(F.char_length("text")), 6).alias("mean_chars"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of the mean price (seeded by row key; no SQL twin)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_key"), F.col("o_totalprice").alias("v"))
    return audit.bootstrap(o, "v", resamples=200).select("resamples", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("WITH s AS (SELECT l_returnflag AS model, l_partkey AS item, max(l_quantity) AS score FROM lineitem GROUP BY ALL) SELECT a.model, count(*) AS n, round(avg(a.score - b.score), 6) AS mean_delta, count(*) FILTER (a.score > b.score) AS wins, count(*) FILTER (a.score = b.score) AS ties, count(*) FILTER (a.score < b.score) AS losses FROM s a JOIN s b ON a.item = b.item AND b.model = 'N' WHERE a.model <> 'N' GROUP BY a.model")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model against the incumbent on shared items."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("item")).agg(F.max("l_quantity").alias("score"))
    return audit.win_loss(s, "model", "item", "score", "N").withColumn("mean_delta", F.round("mean_delta", 6))


@query("WITH c AS (SELECT o_orderpriority AS class, o_orderkey % 5 = 0 AS negative, (o_orderstatus = 'F' OR o_totalprice > 250000) AS hit FROM orders) SELECT class, count(*) AS n, round(avg(hit::INT) FILTER (NOT negative), 6) AS recall, round(avg(hit::INT) FILTER (negative), 6) AS false_positives FROM c GROUP BY class")
def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and false positives by class, a hit by any of several expectations."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), (F.col("o_orderkey") % 5 == 0).alias("negative"), ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 250000)).cast("int").alias("hit"))
    return c.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("negative"), F.col("hit"))), 6).alias("recall"), F.round(F.avg(F.when(F.col("negative"), F.col("hit"))), 6).alias("false_positives"))


@query("SELECT p_size AS gallery, count(*) AS n, round(avg(CASE WHEN p_name = '' THEN 1.0 ELSE 0 END) * 100, 6) AS empty_title_pct FROM part GROUP BY p_size")
def gallery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and empty titles of each gallery."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("gallery")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_name") == "").cast("int")) * 100, 6).alias("empty_title_pct"))


@query("WITH r AS (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS at, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT r.o_orderkey, r.stratum FROM r JOIN range(20) s(i) ON r.at = CAST(floor(i * n / 20.0) AS BIGINT)")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty evenly spaced rows of each stratum."""
    w = Window.partitionBy("stratum")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    r = o.withColumns({"at": F.row_number().over(w.orderBy("o_orderkey")) - 1, "n": F.count("*").over(w)})
    # the row at `at` is picked by the smallest i with floor(i n / 20) = at, if there is one
    i = F.ceil(F.col("at") * 20 / F.col("n"))
    return r.where((i < 20) & (F.floor(i * F.col("n") / 20) == F.col("at"))).select("o_orderkey", "stratum")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY sha256(CAST(o_orderkey AS VARCHAR)) LIMIT 25")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by hash order, the same on every run."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256)).select("o_orderkey").limit(25)


@query("WITH a AS (SELECT c_custkey AS id, 0 AS list, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer QUALIFY rn <= 15), b AS (SELECT s_suppkey AS id, 1 AS list, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier QUALIFY rn <= 15), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, list, row_number() OVER (ORDER BY rn, list) AS place FROM u QUALIFY place <= 20")
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists taken in turns, twenty in all."""
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).select(F.col("c_custkey").alias("id"), F.lit(0).alias("list"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rn"))
    s = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(15).select(F.col("s_suppkey").alias("id"), F.lit(1).alias("list"), F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rn"))
    w = Window.orderBy("rn", "list")
    return c.unionByName(s).withColumn("place", F.row_number().over(w)).where("place <= 20").select("id", "list", "place")
