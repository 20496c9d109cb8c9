"""Running sums over groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, groups: list[str], position: str, ties: list[str], value: str, rows: int, out: str, run: int = 256) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before, by ``position`` then ``ties``.

    ``position`` lies in [0, 1) and spreads a group's rows. The interval is cut twice, into about the square root of
    rows/run coarse cells and as many fine ones in each, so that neither a group of any size nor its cells meet in one
    task: sums of fine cells, then of coarse cells, then rows within a fine cell. Group columns may be null.
    """
    side = max(1, math.ceil(math.sqrt(rows / run)))
    keyed = df.withColumn("_fine", F.least(F.floor(F.col(position) * (side * side)), F.lit(side * side - 1)).cast("long"))
    fine = keyed.groupBy(*groups, "_fine").agg(F.sum(value).alias("_sum")).withColumn("_coarse", F.floor(F.col("_fine") / side))
    coarse = fine.groupBy(*groups, "_coarse").agg(F.sum("_sum").alias("_csum"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.withColumn("_cbase", before(Window.partitionBy(*groups).orderBy("_coarse"), "_csum"))
    fine = fine.withColumn("_fbase", before(Window.partitionBy(*groups, "_coarse").orderBy("_fine"), "_sum"))

    def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        on = [a[k].eqNullSafe(b[f"_r_{k}"]) if k in groups else a[k] == b[f"_r_{k}"] for k in keys]
        return a.join(b, on).drop(*[f"_r_{k}" for k in keys])

    base = joined(fine, coarse.drop("_csum"), [*groups, "_coarse"]).select(*groups, "_fine", (F.col("_cbase") + F.col("_fbase")).alias("_base"))
    w = Window.partitionBy(*groups, "_fine").orderBy(position, *ties)
    return joined(keyed, base, [*groups, "_fine"]).withColumn(out, F.col("_base") + before(w, value)).drop("_fine", "_base")
