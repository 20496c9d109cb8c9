"""The star-schema test tables in the roles of stops, routes, trips, schedules, places, rasters and updates.

Integer arithmetic places them on the grid, so that Spark and any SQL engine agree on every coordinate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEST, SOUTH, EAST, NORTH = -122.42, 37.77, -122.41, 37.78


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _placed(df: DataFrame, key: str, *cols) -> DataFrame:
    gx, gy = F.pmod(F.col(key) * 7919, F.lit(4096)).cast("long"), F.pmod(F.col(key) * 6151, F.lit(4096)).cast("long")
    d = df.select(F.col(key).cast("long").alias("id"), *cols, gx.alias("gx"), gy.alias("gy"))
    return d.withColumn("lon", F.lit(-122.42) + F.col("gx") * 1e-2 / 4096e0).withColumn("lat", F.lit(37.78) - F.col("gy") * 1e-2 / 4096e0)


def stops(spark, sf):
    return _placed(_read(spark, sf, "supplier"), "s_suppkey", F.col("s_name").alias("name"))


def pois(spark, sf):
    return _placed(_read(spark, sf, "customer"), "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag"))


def routes(spark, sf):
    words = F.array(*[F.lit(w) for w in ("tram", "subway", "rail", "bus", "ferry")])
    return _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("route_id"), F.concat_ws(" ", F.element_at(words, F.col("n_regionkey") + 1), "n_name").alias("label"))


def trips(spark, sf):
    o, c = _read(spark, sf, "orders"), _read(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("trip_id"), F.col("c_nationkey").cast("long").alias("route_id"), F.col("o_orderpriority").alias("service_id"))


def stop_times(spark, sf):
    li = _read(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    dep = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 3), F.lit(None)).otherwise(F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber") * 11, F.lit(1740)))
    return li.select(F.col("l_orderkey").alias("trip_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("l_suppkey").alias("stop_id"), dep.cast("long").alias("dep"))


def updates(spark, sf):
    e = _read(spark, sf, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("entity_id"), F.col("user_id").alias("trip_id"), (F.col("event_type") == "click").alias("is_deleted"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0).alias("relationship"), (F.floor("value") - 60).cast("long").alias("delay"), F.lit(None).cast("long").alias("u_stop"))


def raster(spark, sf):
    p = _read(spark, sf, "part")
    return p.groupBy(F.pmod(F.col("p_partkey"), F.lit(40)).alias("x"), F.expr("p_partkey div 40").alias("y")).agg(F.max("p_retailprice").alias("v"))


def calendar(spark):
    return spark.sql("SELECT * FROM VALUES ('1-URGENT',20260101,20261231,true,false),('2-HIGH',20260101,20261231,true,true),('3-MEDIUM',20260101,20260630,true,true),('5-LOW',20260101,20261231,false,true) AS t(service_id,start_date,end_date,monday,saturday)")


def exceptions(spark):
    return spark.sql("SELECT * FROM VALUES ('1-URGENT',20261019,2,1),('1-URGENT',20261019,1,2),('2-HIGH',20261019,2,3),('4-NOT SPECIFIED',20261019,1,4) AS t(service_id,date,exception_type,pos)")


PRELUDE = """WITH stops AS (SELECT *, -122.42e0 + gx * 1e-2 / 4096e0 AS lon, 37.78e0 - gy * 1e-2 / 4096e0 AS lat FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, (s_suppkey * 7919) % 4096 AS gx, (s_suppkey * 6151) % 4096 AS gy FROM supplier)),
pois AS (SELECT *, -122.42e0 + gx * 1e-2 / 4096e0 AS lon, 37.78e0 - gy * 1e-2 / 4096e0 AS lat FROM (SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_mktsegment AS tag, (c_custkey * 7919) % 4096 AS gx, (c_custkey * 6151) % 4096 AS gy FROM customer)),
routes AS (SELECT CAST(n_nationkey AS BIGINT) AS route_id, CASE n_regionkey WHEN 0 THEN 'tram' WHEN 1 THEN 'subway' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' ELSE 'ferry' END || ' ' || n_name AS label FROM nation),
trips AS (SELECT o_orderkey AS trip_id, CAST(c_nationkey AS BIGINT) AS route_id, o_orderpriority AS service_id FROM orders JOIN customer ON o_custkey = c_custkey),
stop_times AS (SELECT l_orderkey AS trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq, l_suppkey AS stop_id, CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN NULL ELSE (l_partkey * 7 + l_linenumber * 11) % 1740 END AS dep FROM lineitem),
raster AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, max(p_retailprice) AS v FROM part GROUP BY 1, 2),
updates AS (SELECT event_id, ts, user_id AS entity_id, user_id AS trip_id, event_type = 'click' AS is_deleted, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS relationship, CAST(floor(value) AS BIGINT) - 60 AS delay FROM events)
"""
