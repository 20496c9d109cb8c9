"""Queries over lines, polygons, properties and heat in their compact text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, wire
from geoloom.plans import adapters as ad
from geoloom.plans.core import query

POINTS = "WITH v AS (SELECT t.trip_id, t.seq, s.gx AS x, s.gy AS y FROM stop_times t JOIN stops s ON s.id = t.stop_id)"
STEPS = POINTS + ", w AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lead(x) OVER o AS nx, lead(y) OVER o AS ny, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy FROM v WINDOW o AS (PARTITION BY trip_id ORDER BY seq))"
STEP_PATH = "'d:' || string_agg((x - coalesce(px, 0)) || ',' || (y - coalesce(py, 0)), ',' ORDER BY seq)"
FULL_PATH = "string_agg(x || ',' || y, ';' ORDER BY seq)"


def lines(spark, sf) -> DataFrame:
    """Each trip's line through its stops."""
    at = ad.stops(spark, sf).select(F.col("id").alias("stop_id"), F.col("gx").alias("x"), F.col("gy").alias("y"))
    v = ad.stop_times(spark, sf).join(at, "stop_id").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    return v.select("trip_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


@query("q_path_shorter", STEPS + f" SELECT trip_id, CASE WHEN count(*) >= 4 THEN {STEP_PATH} ELSE {FULL_PATH} END AS path FROM w GROUP BY 1")
def path_shorter(spark, sf):
    return lines(spark, sf).select("trip_id", wire.shorter(F.col("line")).alias("path"))


@query("q_path_roundtrip", STEPS + f" SELECT trip_id, {FULL_PATH} AS path, count(*) AS points FROM w GROUP BY 1")
def path_roundtrip(spark, sf):
    back = lines(spark, sf).select("trip_id", wire.line_of(wire.steps(F.col("line"))).alias("line"))
    return back.select("trip_id", wire.absolute(F.col("line")).alias("path"), F.size("line").cast("long").alias("points"))


@query("q_line_length", STEPS + " SELECT trip_id, floor(coalesce(sum(sqrt(CAST((nx-x)*(nx-x)+(ny-y)*(ny-y) AS DOUBLE))), 0e0)*1e3+5e-1)/1e3 AS length FROM w GROUP BY 1")
def line_length(spark, sf):
    return lines(spark, sf).select("trip_id", geo.half_up(wire.length(F.col("line")), 3).alias("length"))


@query("q_ring_area", STEPS + " SELECT trip_id, sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2e0 AS area FROM w GROUP BY 1")
def ring_area(spark, sf):
    return lines(spark, sf).select("trip_id", wire.ring_area(F.col("line")).alias("area"))


@query("q_line_dedupe", POINTS + ", c AS (SELECT trip_id, seq, x // 1024 AS x, y // 1024 AS y FROM v), w AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM c WINDOW o AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, string_agg(x || ',' || y, ';' ORDER BY seq) AS path FROM w WHERE px IS NULL OR px <> x OR py <> y GROUP BY 1")
def line_dedupe(spark, sf):
    coarse = F.transform("line", lambda p: F.struct(F.floor(p["x"] / 1024).alias("x"), F.floor(p["y"] / 1024).alias("y")))
    return lines(spark, sf).withColumn("line", coarse).select("trip_id", wire.absolute(wire.without_repeats(F.col("line"))).alias("path"))


@query("q_wkt", POINTS + " SELECT trip_id, 'LINESTRING(' || string_agg(x || ' ' || y, ', ' ORDER BY seq) || ')' AS wkt FROM v GROUP BY 1")
def wkt(spark, sf):
    return lines(spark, sf).select("trip_id", wire.wkt(F.col("line")).alias("wkt"))


@query("q_polygon_roundtrip", "SELECT id, gx || ',' || gy || ';' || (gx + 9) || ',' || gy || ';' || gx || ',' || (gy + 9) || '||' || gx || ',' || gy AS polygon, CAST(2 AS BIGINT) AS parts FROM stops")
def polygon_roundtrip(spark, sf):
    x, y = F.col("gx"), F.col("gy")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    shape = F.array(F.array(F.array(point(x, y), point(x + 9, y), point(x, y + 9))), F.array(F.array(point(x, y))))
    back = ad.stops(spark, sf).select("id", wire.polygon_of(wire.polygon(shape)).alias("parts"))
    return back.select("id", wire.polygon(F.col("parts")).alias("polygon"), F.size("parts").cast("long").alias("parts"))


@query("q_props_typed", "SELECT id, CAST(key AS INT) AS key, type, value FROM (SELECT p_partkey AS id, unnest([1, 2, 3, 4]) AS key, unnest(['num', 'ref', 'bool', 'token']) AS type, unnest([CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR), CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, p_brand]) AS value FROM part)", prelude=False)
def props_typed(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    text = F.concat_ws(";", F.concat(F.lit("1="), F.col("p_size").cast("string")), F.concat(F.lit("2=s"), F.col("p_partkey").cast("string")), F.concat(F.lit("3="), (F.col("p_size") > 25).cast("string")), F.concat(F.lit("4="), "p_brand"))
    return p.select(F.col("p_partkey").alias("id"), F.inline(wire.properties_of(text)))


@query("q_heat_rows", "WITH c AS (SELECT tag, gx // 256 AS x, gy // 256 AS y, count(*) AS value FROM pois GROUP BY ALL), g AS (SELECT *, x - row_number() OVER (PARTITION BY tag, y, value ORDER BY x) AS island FROM c), r AS (SELECT tag, y, min(x) AS x, count(*) AS len, value FROM g GROUP BY tag, y, value, island) SELECT tag, y, string_agg(x || ',' || len || ',' || value, ';' ORDER BY x) AS body FROM r GROUP BY 1, 2")
def heat_rows(spark, sf):
    cell = lambda c: F.floor(F.col(c) / 256)
    c = ad.pois(spark, sf).groupBy("tag", cell("gx").alias("x"), cell("gy").alias("y")).agg(F.count("*").alias("value"))
    island = F.col("x") - F.row_number().over(Window.partitionBy("tag", "y", "value").orderBy("x"))
    runs = c.withColumn("island", island).groupBy("tag", "y", "value", "island").agg(F.min("x").alias("x"), F.count("*").alias("len"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("x", "len", "value"))), lambda r: F.concat_ws(",", r["x"].cast("string"), r["len"].cast("string"), r["value"].cast("string")))
    return runs.groupBy("tag", "y").agg(F.array_join(body, ";").alias("body"))


@query("q_heat_rows_decode", "SELECT tag, gx // 256 AS x, gy // 256 AS y, count(*) AS value FROM pois GROUP BY ALL")
def heat_rows_decode(spark, sf):
    run = F.split(F.col("run"), ",")
    runs = heat_rows(spark, sf).select("tag", "y", F.explode(F.split("body", ";")).alias("run")).select("tag", "y", *[run[i].cast("long").alias(n) for i, n in enumerate(("x0", "len", "value"))])
    return runs.select("tag", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("len") - 1)).alias("x"), "y", "value")


@query("q_name_hash", "SELECT id, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INT) AS hash FROM (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM pois)")
def name_hash(spark, sf):
    return ad.pois(spark, sf).select("id", wire.name_hash(F.col("name")).alias("hash"))


@query("q_radius_label", "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN (p_size * 100) || 'm' ELSE printf('%.1fkm', p_size / 1e1) END AS label FROM part", prelude=False)
def radius_label(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), wire.radius_label(F.col("p_size") * 100).alias("label"))


@query("q_envelope", "SELECT tag, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM pois GROUP BY 1")
def envelope(spark, sf):
    return ad.pois(spark, sf).groupBy("tag").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query("q_neighbour_counts", "SELECT a AS stop_id, count(DISTINCT b) AS neighbours FROM (SELECT lag(stop_id) OVER w AS a, stop_id AS b FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq) UNION ALL SELECT lead(stop_id) OVER w, stop_id FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE a IS NOT NULL AND a <> b GROUP BY 1")
def neighbour_counts(spark, sf):
    before = F.lag("stop_id").over(Window.partitionBy("trip_id").orderBy("seq"))
    legs = ad.stop_times(spark, sf).select(before.alias("a"), F.col("stop_id").alias("b")).where("a <> b").distinct()
    return legs.unionByName(legs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("stop_id")).agg(F.countDistinct("b").alias("neighbours"))
