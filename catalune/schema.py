"""The canonical catalogue schema and feature detection.

Text columns of objects use '' for missing values, never null; galleries use null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "accession title artist culture period classification medium tags galleryNumber site rotation imageUrl metadataDate synonyms museum sourceId locationNote titleAlt license imageLicense thumbKey".split()
OBJECTS = T.StructType([T.StructField("objectID", T.LongType(), False), *(T.StructField(c, T.StringType(), False) for c in _TEXT), T.StructField("isHighlight", T.BooleanType(), False)])
GALLERIES = T.StructType([T.StructField("galleryNumber", T.StringType(), False), T.StructField("site", T.StringType(), False), *(T.StructField(c, T.StringType()) for c in ("title", "floor")), *(T.StructField(c, T.DoubleType()) for c in ("centroidLat", "centroidLon"))])
NODES = T.StructType([T.StructField("id", T.StringType(), False), *(T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "floor")), *(T.StructField(c, T.StringType()) for c in ("site", "gallery", "kind", "name"))])
EDGES = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.StringType(), False), T.StructField("len", T.DoubleType(), False), T.StructField("kind", T.StringType()), T.StructField("bearing", T.DoubleType()), T.StructField("room", T.StringType())])


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that an older artifact lacks, as literals."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def canonical_objects(df: DataFrame) -> DataFrame:
    """All object columns in order: missing columns and null texts become ''."""
    df = ensure_columns(df, {c: "" for c in _TEXT} | {"isHighlight": False})
    cols = [F.coalesce(F.col(f.name).cast(f.dataType), F.lit("" if isinstance(f.dataType, T.StringType) else False)).alias(f.name) if f.name != "objectID" else F.col("objectID").cast("long") for f in OBJECTS]
    return df.select(cols)


def union_sources(*snapshots: DataFrame) -> DataFrame:
    """One catalogue from several source snapshots; columns that a source lacks are filled."""
    out = canonical_objects(snapshots[0])
    for s in snapshots[1:]:
        out = out.unionByName(canonical_objects(s))
    return out
