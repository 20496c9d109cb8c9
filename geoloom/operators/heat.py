"""Scalar layers: densities, slopes, hotspots and subsamples of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def density(points: DataFrame, res: int, extent: int, top: int = 24) -> DataFrame:
    """The ``top`` cells of a res x res grid by number of points, then by place."""
    cell = lambda c: F.least(F.lit(res - 1), F.floor(F.col(c) * float(res) / float(extent))).cast("long")
    return points.groupBy(cell("gx").alias("x"), cell("gy").alias("y")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "y", "x").limit(top)


def slope(raster: DataFrame, width: int, height: int, res: int = 16) -> DataFrame:
    """Grade by forward differences to the right and below; a cell of the coarse grid keeps its last, row by row."""
    right = F.coalesce(F.lead("v").over(Window.partitionBy("y").orderBy("x")), F.col("v"))
    down = F.coalesce(F.lead("v").over(Window.partitionBy("x").orderBy("y")), F.col("v"))
    g = raster.select("x", "y", F.hypot(right - F.col("v"), down - F.col("v")).alias("grade"))
    cell = lambda c, n: F.floor(F.col(c) * float(res) / float(n)).cast("long")
    return g.groupBy(cell("x", width).alias("cx"), cell("y", height).alias("cy")).agg(F.max(F.struct((F.col("y") * width + F.col("x")).alias("at"), "grade")).alias("m")).select("cx", "cy", "m.grade")


def hotspots(cells: DataFrame, group: str, top: int = 5) -> DataFrame:
    """The ``top`` positive cells of each group by value; none where all values are equal.

    Ranks beyond ``top`` go in each task before a group's cells meet; extremes are an aggregate of their own.
    """
    d = cells.where("value > 0")
    uneven = d.groupBy(group).agg(F.min("value").alias("_low"), F.max("value").alias("_high")).where("_low < _high").select(group)
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    return ranked.join(uneven, group, "left_semi")


def summary(cells: DataFrame, group: str) -> DataFrame:
    """Largest value of each group, and the mean of its positive ones to one place."""
    mean = F.floor(F.avg(F.when(F.col("value") > 0, F.col("value"))) * 10 + 0.5) / 10
    return cells.groupBy(group).agg(F.max("value").alias("most"), mean.alias("mean"), F.count_if(F.col("value") > 0).alias("positive"))


def extent(raster: DataFrame) -> DataFrame:
    """Least and largest sample, and the range between them."""
    return raster.agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.max("v") - F.min("v")).alias("range"))


def subsample(raster: DataFrame, step: int) -> DataFrame:
    return raster.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
