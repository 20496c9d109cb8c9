"""Geographic features from GeoJSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,coordinates:string>"
SCHEMA = f"features array<struct<id:bigint,properties:map<string,string>,geometry:{GEOMETRY}>>"
#: Nesting of coordinates by geometry type.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, type, coordinates): one row per feature of a collection; coordinates stay JSON text."""
    d = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return d.select("f.id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def vertices(kind: Column, coordinates: Column) -> Column:
    """All vertices of a geometry in order, as an array of arrays of numbers; unknown types raise."""
    out = F
    for name, depth in DEPTH.items():
        x = F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        x = F.array(x) if depth == 0 else x
        for _ in range(depth - 1):
            x = F.flatten(x)
        out = out.when(kind == name, x)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown geometry type: "), F.coalesce(kind, F.lit("null")))).cast("array<array<double>>"))


def envelope(features: DataFrame) -> DataFrame:
    """One row with west, south, east and north of all vertices."""
    v = features.select(F.explode(vertices(F.col("type"), F.col("coordinates"))).alias("v"))
    lon, lat = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return v.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def valid(features: DataFrame) -> DataFrame:
    """Features whose lines have two vertices or more, and whose polygons have three."""
    n = F.size(vertices(F.col("type"), F.col("coordinates")))
    return features.where(n >= F.when(F.col("type").contains("Polygon"), 3).when(F.col("type").contains("Line"), 2).otherwise(1))
