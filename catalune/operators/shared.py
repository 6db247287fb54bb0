"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where none is named and all runs on one machine (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "/tmp/catalune-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Unlike a checkpoint it is computed once and carries no constraints on."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and that no plan will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
