"""Indoor graphs: rooms, corridors and shafts of storeys, as joins within a building's level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def room_doors(rooms: DataFrame, corridors: DataFrame, metres: float, reach: float = 40.0) -> DataFrame:
    """(room, corridor, dist) of each room (building, level, id, x, y): its nearest corridor on the storey within ``reach``
    metres, of equally near ones the least id. ``metres``: ground metres of a unit."""
    near = corridors.select("building", "level", F.col("id").alias("corridor"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dist = F.hypot((F.col("x") - F.col("ox")).cast("double"), (F.col("y") - F.col("oy")).cast("double")) * metres
    # a cell as wide as the reach holds all that can be near, in itself and those around it
    cell = lambda c: F.floor(F.col(c) * metres / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    left = rooms.select("building", "level", F.col("id").alias("room"), "x", "y").withColumn("_cx", around("x")).withColumn("_cy", around("y"))
    j = left.join(near.withColumn("_cx", cell("ox")).withColumn("_cy", cell("oy")), ["building", "level", "_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= reach)
    return j.groupBy("building", "level", "room").agg(F.min(F.struct("dist", "corridor")).alias("m")).select("building", "level", "room", "m.corridor", "m.dist")


def capped(nodes: DataFrame, most_nodes: int = 60, most_levels: int = 8) -> DataFrame:
    """The first ``most_nodes`` nodes, by id, of each building's ``most_levels`` storeys nearest to the ground."""
    levels = nodes.select("building", "level").distinct()
    levels = levels.withColumn("_l", F.row_number().over(Window.partitionBy("building").orderBy(F.abs("level"), "level"))).where(F.col("_l") <= most_levels)
    kept = nodes.withColumn("_r", F.row_number().over(Window.partitionBy("building", "level").orderBy("id"))).where(F.col("_r") <= most_nodes)
    return kept.join(levels.drop("_l"), ["building", "level"], "left_semi").drop("_r")


def shaft_links(shafts: DataFrame) -> DataFrame:
    """(cx, cy, low, high, gap) of each two storeys that follow each other at a shaft (cx, cy, levels), and how many lie between."""
    pairs = F.arrays_zip(F.slice("levels", F.lit(1), F.greatest(F.size("levels") - 1, F.lit(0))).alias("low"), F.slice("levels", F.lit(2), F.greatest(F.size("levels") - 1, F.lit(0))).alias("high"))
    return shafts.select("cx", "cy", F.explode(pairs).alias("p")).select("cx", "cy", "p.low", "p.high", (F.col("p.high") - F.col("p.low") - 1).alias("gap"))
