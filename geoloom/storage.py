"""Tables that jobs keep between steps, in the folder that every executor sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir`` of the session.

    Where that is unset, a cluster gets a folder in its warehouse, and a session whose executors are threads of the driver
    a temporary one that goes when the driver ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="geoloom-")
            atexit.register(shutil.rmtree, _LOCAL[context.applicationId], True)
        base = _LOCAL[context.applicationId]
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{context.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor costs a re-read and never a re-computation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete stored ``tables`` that nothing reads any more. Frames that materialize() did not give are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
