"""Transit schedules as CSV tables in a folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions.text import clock_minutes

REQUIRED = ("stops", "routes", "trips", "stop_times")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One CSV table, all text: quoted fields may hold commas, quotes and line breaks; names are trimmed, a byte-order
    mark goes, and of equal names the last stands."""
    d = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False).csv(path)
    lines = spark.read.options(header=False, quote='"', escape='"', multiLine=True).csv(path).limit(1).first()
    names = [(n or "").lstrip("﻿").strip() for n in (lines or [])]
    d = d.toDF(*[f"_c{i}" for i in range(len(d.columns))])
    return d.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n and n not in names[i + 1 :]])


def read_feed(spark: SparkSession, folder: str, names: tuple[str, ...] = REQUIRED) -> dict[str, DataFrame]:
    """The tables of a feed by name; a missing one of ``names`` raises when it is read."""
    return {n: read_table(spark, f"{folder}/{n}.txt") for n in names}


def stop_times(table: DataFrame) -> DataFrame:
    """(trip_id, stop_id, seq, dep): rows of a trip in the order of stop_sequence, in file order where that is missing.

    The departure is that of the row, else its arrival; neither gives null.
    """
    at = table.withColumn("_pos", F.monotonically_increasing_id())
    have = lambda c: clock_minutes(F.col(c)) if c in table.columns else F.lit(None).cast("int")
    seq = F.col("stop_sequence").try_cast("double") if "stop_sequence" in table.columns else F.lit(None).cast("double")
    w = Window.partitionBy("trip_id").orderBy(F.coalesce(seq, F.col("_pos").cast("double")), "_pos")
    return at.select(F.trim("trip_id").alias("trip_id"), F.trim("stop_id").alias("stop_id"), F.row_number().over(w).alias("seq"), F.coalesce(have("departure_time"), have("arrival_time")).alias("dep"))
