"""Numbering rows in a global order without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import materialize


def numbered(df: DataFrame, order: list[str], out: str = "num", first: int = 1) -> DataFrame:
    """Add ``out``: each row's place in the order of ``order``, from ``first`` on.

    Rows are ranged into partitions and sorted there, stored with their place in their partition, and moved on by the
    number of rows in the partitions before: one row for each partition is all that meets in one place.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    stored = materialize(ranged.withColumn("_part", F.shiftrightunsigned(at, 33)).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r[0], r[1]) for r in stored.groupBy("_part").count().collect())
    before, starts = first, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    base = df.sparkSession.createDataFrame(starts, "_part long, _base long")
    return stored.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")
