"""Driver tables as canonical objects, galleries and their vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as objects with short fields."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("objectID"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("classification"),
        F.col("p_size").cast("string").alias("galleryNumber"),
        F.format_string("%.2f", "p_retailprice").alias("accession"),
        (F.col("p_size") % 10 == 0).alias("isHighlight"),
    )


def part_galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galleries of the part objects: code and floor from nation and region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("string").alias("galleryNumber"), F.col("n_name").alias("galleryTitle"), F.col("r_name").alias("floor"))


def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as objects with long, multilingual text."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("objectID"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.col("source").alias("museum"),
        F.col("lang").alias("site"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("isHighlight"),
    )
