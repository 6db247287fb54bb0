"""Small helpers of the queries and operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is named and all runs on one machine (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    known = context._jsc.sc().getCheckpointDir()
    if named or known.isDefined():
        if not known.isDefined():
            context.setCheckpointDir(named)
        return named or known.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = os.path.join(tempfile.gettempdir(), "catalune-checkpoints")
    context.setCheckpointDir(made)
    return made


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished plans.

    It does so once the driver's JVM has collected the objects that refer to
    them, so a collection is asked for; otherwise the disks hold the shuffles
    of every finished step at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path, schema = _path(spark, name), df.schema
    df.write.parquet(path)
    del df
    _release(spark)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: joins by it do not move the table again.

    No dictionaries: what it holds are mostly hashes.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).options(path=path, compression="zstd", **{"parquet.enable.dictionary": "false"}).saveAsTable(made)
    del df
    _release(spark)
    return spark.table(made)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` or ``bucketed`` made and that no plan will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            made = folder.rsplit("/", 1)[1].replace("-", "_")
            if spark.catalog.tableExists(made):
                spark.sql(f"DROP TABLE {made}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled rows outside the held-out fold.

    The sample is the rows of smallest id hash, so it does not depend on order
    or partitioning. An id labelled twice takes the larger label.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit("training sample")), "doc_id")
        .limit(rows)
    )
