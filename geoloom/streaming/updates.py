"""Realtime updates as streams: the latest update of each entity, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class LatestUpdates:
    """The last update of each entity, kept as a table of generations in ``folder``, which all executors share.

    Every micro-batch merges its own last updates with the generation before, which its number names, and writes the
    next one; a deletion stays as a mark, so that an older update that comes late does not bring its entity back. A
    batch that runs again, in another process too, starts from the same generation and replaces its own.
    """

    def __init__(self, folder: str, key: str = "entity_id", order: tuple[str, ...] = ("ts", "event_id")) -> None:
        self.folder, self.key, self.order = folder.rstrip("/"), key, order
        self.batch: int | None = None

    def merge(self, updates: DataFrame, batch: int) -> None:
        if batch > 0:
            updates = updates.unionByName(updates.sparkSession.read.parquet(f"{self.folder}/{batch - 1}"))
        w = Window.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order])
        updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        self.batch = batch

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def current(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The live entities after ``batch``, the last merged here unless given."""
        return spark.read.parquet(f"{self.folder}/{self.batch if batch is None else batch}").where("NOT is_deleted")


def window_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Events of each key in tumbling windows of event time; what is later than ``late`` is left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("hits")).select("window.start", "window.end", *keys, "hits")
