"""Vector retrieval and index maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..registry import query, table

_SIM = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_INDEX = "idx AS (SELECT vec_id AS objectID, vec_id AS row, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'h' || label END AS imageHash FROM embeddings), cur AS (SELECT vec_id AS objectID, CASE WHEN vec_id % 7 = 0 THEN 'x' ELSE 'h' || label END AS currentHash FROM embeddings WHERE vec_id % 11 <> 0)"


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    h = F.concat(F.lit("h"), F.col("label").cast("string"))
    idx = e.select(F.col("vec_id").alias("objectID"), F.col("vec_id").alias("row"), F.when(F.col("vec_id") % 5 == 0, None).otherwise(h).alias("imageHash"))
    cur = e.where("vec_id % 11 <> 0").select(F.col("vec_id").alias("objectID"), F.when(F.col("vec_id") % 7 == 0, "x").otherwise(h).alias("currentHash"))
    return idx, cur


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: vectors at unit length."""
    e = table(spark, sf_dir, "embeddings")
    u = vectors.normalize(F.col("embedding"))
    return e.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.element_at(u, 1), 6).alias("first"))


@query("SELECT b.vec_id, b.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 5")
def similar_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows most similar to one, with their labels, to four places."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 3").first()
    best = vectors.top_k(e, list(q.embedding), 5)
    return e.select("vec_id", "label").join(F.broadcast(best), "vec_id").withColumn("similarity", F.round("similarity", 4))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({_SIM}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: exact five nearest of every row whose id is divisible by 20, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    out = vectors.knn(e, e.where("vec_id % 20 = 0"), 5)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH r AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS bl, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5), g AS (SELECT q, bool_or(rank = 1 AND ql = bl) AS t1, bool_or(ql = bl) AS t5 FROM r GROUP BY q) SELECT count(*) AS n, round(avg(t1::INT), 6) AS top1, round(avg(t5::INT), 6) AS top5 FROM g")
def room_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a neighbour of their own label at rank 1 and among 5."""
    e = table(spark, sf_dir, "embeddings")
    r = vectors.knn(e, e.where("vec_id % 20 = 0"), 5)
    lab = e.select("vec_id", "label")
    j = r.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    g = j.groupBy("query_id").agg(F.max(((F.col("rank") == 1) & (F.col("label") == F.col("own"))).cast("int")).alias("t1"), F.max((F.col("label") == F.col("own")).cast("int")).alias("t5"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("t1"), 6).alias("top1"), F.round(F.avg("t5"), 6).alias("top5"))


@query(f"WITH {_INDEX} SELECT CASE WHEN cur.objectID IS NULL THEN 'off-view' WHEN imageHash IS NULL OR imageHash = currentHash THEN 'keep' ELSE 'image-changed' END AS action, count(*) AS n FROM idx LEFT JOIN cur USING (objectID) GROUP BY 1")
def compaction_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: what a compaction keeps and drops."""
    return vectors.compaction_plan(*_index(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_INDEX}, k AS (SELECT objectID, row_number() OVER (ORDER BY row) - 1 AS row, coalesce(imageHash, currentHash) AS imageHash FROM idx JOIN cur USING (objectID) WHERE imageHash IS NULL OR imageHash = currentHash) SELECT objectID, row, CAST(floor(row / 64) AS BIGINT) AS shard, row % 64 AS \"offset\", imageHash FROM k")
def compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, K3: dense numbers in old order, shards of 64."""
    return vectors.compaction_apply(vectors.compaction_plan(*_index(spark, sf_dir)), 64)


@query(f"WITH {_INDEX} SELECT cur.objectID, currentHash FROM cur LEFT JOIN idx USING (objectID) WHERE imageHash IS NULL OR imageHash <> currentHash")
def embeddings_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: new or changed images."""
    idx, cur = _index(spark, sf_dir)
    return vectors.needs_embedding(cur, idx)


@query("SELECT vec_id, 'img/' || CASE WHEN label % 2 = 0 THEN 'm' || label || '/' ELSE '' END || vec_id || '/' || substr(sha256('u' || vec_id), 1, 12) AS key, CAST(('0x' || substr(sha256('m' || label || '/' || vec_id), 1, 12)) AS BIGINT) AS id48 FROM embeddings")
def thumbnail_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: content-addressed keys and 48-bit ids."""
    e = table(spark, sf_dir, "embeddings")
    v, m = F.col("vec_id").cast("string"), F.concat(F.lit("m"), F.col("label").cast("string"))
    key = F.concat(F.lit("img/"), F.when(F.col("label") % 2 == 0, F.concat(m, F.lit("/"))).otherwise(""), v, F.lit("/"), F.substring(F.sha2(F.concat(F.lit("u"), v), 256), 1, 12))
    from ..functions.text import id48

    return e.select("vec_id", key.alias("key"), id48(F.concat(m, F.lit("/"), v)).alias("id48"))


@query("WITH u AS (SELECT vec_id, min(p) AS priority FROM (SELECT vec_id, 0 AS p FROM embeddings WHERE vec_id % 37 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id, 2 FROM embeddings WHERE label IN (3, 5)) GROUP BY vec_id) SELECT vec_id, priority FROM u ORDER BY priority, vec_id LIMIT 60")
def stratified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of priority pools, each id at its best, up to a cap."""
    e = table(spark, sf_dir, "embeddings")
    pools = F.array_compact(F.array(F.when(F.col("vec_id") % 37 == 0, F.lit(0)), F.when(F.col("label") == 3, F.lit(1)), F.when(F.col("label").isin(3, 5), F.lit(2))))
    return e.select("vec_id", F.array_min(pools).alias("priority")).where("priority is not null").orderBy("priority", "vec_id").limit(60)
