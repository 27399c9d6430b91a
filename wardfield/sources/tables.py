"""Input tables: the long panel and the boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
#: A polygon is its outer ring and the rings of its holes; no holes may be an empty array or NULL.
PARTS = T.ArrayType(T.StructType([
    T.StructField("part_id", T.IntegerType()),
    T.StructField("ring", T.ArrayType(POINT)),
    T.StructField("holes", T.ArrayType(T.ArrayType(POINT))),
]))
BOUNDARY_SCHEMA = T.StructType([
    T.StructField("iso_a3_eh", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("parts", PARTS),
])

# The kinds of area that count as a country.
COUNTRY_TYPES = ["Sovereign country", "Country", "Sovereignty"]


def panel_schema(periods: list[str]) -> T.StructType:
    keys = [T.StructField(c, T.StringType()) for c in ("code", "entity", "variable")]
    return T.StructType(keys + [T.StructField(p, T.DoubleType()) for p in periods])


def load_panel(spark: SparkSession, path: str, periods: list[str]) -> DataFrame:
    """Long unit x variable table with a known schema: nothing is inferred."""
    return spark.read.schema(panel_schema(periods)).parquet(path)


def keep_countries(raw: DataFrame) -> DataFrame:
    """Sovereign states and countries only; the ISO code becomes the join key."""
    return raw.where(F.col("type").isin(COUNTRY_TYPES)).select(
        F.col("iso_a3_eh").alias("code"), "parts")


def load_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return keep_countries(spark.read.schema(BOUNDARY_SCHEMA).parquet(path))


def star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
