"""Dense vectors: exact nearest neighbours, evaluation, index maintenance.

Products are summed in double. Equal similarities go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def top_k(rows: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """The k rows (vec_id, embedding of unit length) most similar to a query; an error if sizes differ."""
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    literal = F.array(*(F.lit(float(x)) for x in q))
    size = F.when(F.size("embedding") != len(q), F.raise_error(F.lit("the query and the index differ in dimensions")).cast("double"))
    sim = F.coalesce(size, dot(F.col("embedding"), literal))
    return rows.select("vec_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def knn(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, slice_rows: int = 20_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact k nearest of each query.

    Queries go out in slices of at most ``slice_rows``. Each task scores blocks
    of rows against a slice with a matrix product and keeps k a query, so the
    shuffle carries at most k rows a query and task.
    """
    count = queries.count()
    slices = max(1, -(-count // slice_rows))
    parts = []
    for s in range(slices):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).select("vec_id", "embedding").toArrow()
        ids = own.column("vec_id").to_numpy()
        if not len(ids):
            continue
        mat = np.array(own.column("embedding").to_pylist(), float)
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
        order = np.argsort(ids)
        shared = rows.sparkSession.sparkContext.broadcast((ids[order], mat[order]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qid, q = shared.value
            best_s = np.full((len(qid), k), -np.inf)
            best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
            for b in batches:
                for a in range(0, b.num_rows, 2048):
                    part = b.slice(a, 2048)
                    i = part.column(0).to_numpy()
                    v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(i), -1)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    sim = q @ v.T
                    if exclude_self:
                        sim[qid[:, None] == i[None, :]] = -np.inf
                    alls = np.hstack((best_s, sim))
                    alli = np.hstack((best_i, np.broadcast_to(i, sim.shape)))
                    pick = np.lexsort((alli, -alls), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(alls, pick, 1), np.take_along_axis(alli, pick, 1)
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], best_s.shape)[keep]), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query_id", "vec_id", "similarity"])

        parts.append(rows.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, vec_id long, similarity double"))
    if not parts:
        return rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(ranked: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of queries whose expected row is among the first ranks; absent counts as a miss. truth: (query_id, vec_id)."""
    hit = truth.join(ranked, ["query_id", "vec_id"], "left")
    return hit.agg(F.count("*").alias("n"), *(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"top{k}") for k in at))


def compaction_plan(index: DataFrame, current: DataFrame) -> DataFrame:
    """index (objectID, row, imageHash) with action: keep, off-view or image-changed.

    current: (objectID, currentHash). A row without a hash is kept if its object is still there.
    """
    j = index.join(current.withColumn("_in", F.lit(True)), "objectID", "left")
    action = F.when(F.col("_in").isNull(), "off-view").when(F.col("imageHash").isNull() | (F.col("imageHash") == F.col("currentHash")), "keep").otherwise("image-changed")
    return j.withColumn("action", action).drop("_in")


def compaction_apply(plan: DataFrame, shard_size: int = 1024) -> DataFrame:
    """Kept rows numbered densely in old row order: (objectID, row, shard, offset, imageHash), hashes filled in.

    Numbers come from counts of row ranges and ranks within them, not from one global sort.
    """
    kept = plan.where("action = 'keep'").withColumn("_b", F.floor(F.col("row") / shard_size))
    sizes = kept.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_start", before).drop("_n")
    n = F.row_number().over(Window.partitionBy("_b").orderBy("row")) - 1 + F.col("_start")
    out = kept.join(starts, "_b").withColumn("_row", n)
    return out.select("objectID", F.col("_row").alias("row"), F.floor(F.col("_row") / shard_size).alias("shard"), (F.col("_row") % shard_size).alias("offset"), F.coalesce("imageHash", "currentHash").alias("imageHash"))


def needs_embedding(current: DataFrame, index: DataFrame) -> DataFrame:
    """Objects that are new or whose image changed."""
    j = current.join(index.select("objectID", "imageHash"), "objectID", "left")
    return j.where(F.col("imageHash").isNull() | (F.col("imageHash") != F.col("currentHash"))).drop("imageHash")


def pack_shards(vectors: DataFrame, size: int, pad: int = 0) -> DataFrame:
    """(shard, count, dims, ids, data): little-endian float32 rows, ``size`` a shard, by (vec_id, n, embedding) with n numbered from 0.

    ``pad`` rows of zeros follow in the last shard's place, as in a file that was allocated ahead.
    """

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        m = np.stack(p.embedding.to_numpy()).astype("<f4")
        data = np.vstack([m, np.zeros((pad, m.shape[1]), "<f4")]).tobytes()
        return pd.DataFrame({"shard": [p.n.iloc[0] // size], "count": [len(p)], "dims": [m.shape[1]], "ids": [p.vec_id.tolist()], "data": [data]})

    own = vectors.select("vec_id", "n", "embedding").withColumn("shard", F.floor(F.col("n") / size))
    return own.groupBy("shard").applyInPandas(pack, "shard long, count long, dims int, ids array<long>, data binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """(vec_id, embedding) of packed shards; bytes beyond a shard's count are not read."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                m = np.frombuffer(r.data, "<f4", r.count * r.dims).reshape(r.count, r.dims)
                yield pd.DataFrame({"vec_id": list(r.ids), "embedding": list(m)})

    return shards.mapInPandas(unpack, "vec_id long, embedding array<float>")


def locate(paths: dict[str, Callable[[], DataFrame]], schema: str, spark: SparkSession) -> tuple[DataFrame, dict[str, str]]:
    """(path, *schema): the rows of every path that works, and what became of each; an error if none works."""
    out, status = spark.createDataFrame([], f"path string, {schema}"), {}
    for name, run in paths.items():
        try:
            out = out.unionByName(written(run().select(F.lit(name).alias("path"), *out.columns[1:]), "path"))
            status[name] = "ok"
        except Exception as e:  # either path may fail alone
            status[name] = f"failed: {type(e).__name__}"
    if paths and not any(s == "ok" for s in status.values()):
        raise RuntimeError(f"no path works: {status}")
    return out, status
