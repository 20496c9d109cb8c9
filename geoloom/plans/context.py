"""Queries over weather, traffic, indoor levels, elements, emission and what becomes of text and heat."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geo, hours, sky, text
from geoloom.operators import budget, emit, heat, indoor, place_graph
from geoloom.plans import adapters as ad
from geoloom.plans.core import query
from geoloom.sources import elements, tiles

SPECS = ("24/7", "off", "Mo-Fr 09:00-17:00", "mo-fr 0900-1700", "Sa-Su 10:00-14:00; Su off", "Mo-Fr about noon", "08:00-20:00", None)


@query("q_opening_hours", """WITH e AS (SELECT event_id, event_id % 8 AS k, CAST(dayofweek(ts) AS INT) AS d, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_id, CASE k WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN CASE WHEN d BETWEEN 1 AND 5 THEN m >= 540 AND m < 1020 END WHEN 3 THEN CASE WHEN d BETWEEN 1 AND 5 THEN m >= 540 AND m < 1020 END
  WHEN 4 THEN CASE d WHEN 6 THEN m >= 600 AND m < 840 WHEN 0 THEN FALSE END END AS open,
  CASE k WHEN 0 THEN '00:00-24:00' WHEN 1 THEN 'always closed' WHEN 4 THEN CASE WHEN d = 6 THEN CASE WHEN m >= 600 AND m < 840 THEN '10:00-14:00' ELSE 'closed' END WHEN d = 0 THEN 'closed on this day' ELSE 'no hours listed for this day' END
  WHEN 5 THEN CASE WHEN d BETWEEN 1 AND 5 THEN 'about noon' ELSE 'no hours listed for this day' END WHEN 6 THEN 'no hours listed for this day' WHEN 7 THEN 'no opening hours recorded'
  ELSE CASE WHEN d NOT BETWEEN 1 AND 5 THEN 'no hours listed for this day' WHEN m >= 540 AND m < 1020 THEN '09:00-17:00' ELSE 'closed' END END AS phrase FROM e""", prelude=False)
def opening_hours(spark, sf):
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("event_id") % 8 + 1).cast("int"))
    d = spark.read.parquet(f"{sf}/events.parquet").select("event_id", hours.opening(spec, F.col("ts"), 0).alias("s"))
    return d.select("event_id", "s.open", "s.phrase")


FORECAST = "WITH f AS (SELECT o_custkey AS place, o_orderkey AS hour, o_orderkey % 7 - 2 AS rain, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 31 END AS celsius FROM orders)"


def forecast(spark, sf):
    """A forecast of each customer in the form services send: arrays side by side, as JSON."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("place"), F.struct(k.alias("hour"), (k % 7 - 2).alias("rain"), F.when(k % 5 > 0, k % 31).alias("celsius")).alias("r"))
    g = o.groupBy("place").agg(F.array_sort(F.collect_list("r")).alias("r"))
    part = lambda n: F.transform("r", lambda x: x[n]).alias(n)
    body = F.to_json(F.struct(F.struct(part("hour"), part("rain"), part("celsius")).alias("hourly")), {"ignoreNullFields": "false"})
    back = F.from_json(body, "hourly struct<hour:array<long>,rain:array<long>,celsius:array<long>>")["hourly"]
    rows = sky.forecast_rows(back["hour"], rain=back["rain"], celsius=back["celsius"])
    return g.select("place", F.explode(rows).alias("x")).select("place", F.col("x.at").alias("hour"), "x.rain", "x.celsius")


@query("q_forecast_rows", f"{FORECAST} SELECT place, hour, rain, celsius FROM f", prelude=False)
def forecast_rows(spark, sf):
    return forecast(spark, sf)


@query("q_worst_hour", f"{FORECAST} SELECT place, arg_max(hour, rain * 100000000 - hour) AS hour, max(rain) AS rain FROM f GROUP BY 1", prelude=False)
def worst_hour(spark, sf):
    d = forecast(spark, sf).groupBy("place").agg(F.max(F.struct("rain", (-F.col("hour")).alias("h"))).alias("m"))
    return d.select("place", (-F.col("m.h")).alias("hour"), "m.rain")


@query("q_wet_hours", f"{FORECAST}, r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY hour) AS r FROM f WHERE rain > 0) SELECT place, string_agg(hour, ',' ORDER BY hour) AS hours FROM r WHERE r <= 4 GROUP BY 1", prelude=False)
def wet_hours(spark, sf):
    d = forecast(spark, sf).where("rain > 0").withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("hour"))).where("r <= 4")
    return d.groupBy("place").agg(F.array_join(F.array_sort(F.collect_list("hour")), ",").alias("hours"))


@query("q_flow_segments", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS road, least(1e0, (o_orderkey % 60 + 1) / 50e0) AS ratio, CASE WHEN least(1e0, (o_orderkey % 60 + 1) / 50e0) >= 9e-1 THEN 'free' WHEN (o_orderkey % 60 + 1) / 50e0 >= 75e-2 THEN 'light' WHEN (o_orderkey % 60 + 1) / 50e0 >= 6e-1 THEN 'moderate' WHEN (o_orderkey % 60 + 1) / 50e0 >= 4e-1 THEN 'heavy' ELSE 'severe' END AS level FROM orders", prelude=False)
def flow_segments(spark, sf):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("roadName"), (k % 60 + 1).alias("currentSpeed"), F.lit(50).alias("freeFlowSpeed"))).alias("flows")))
    flows = F.from_json(body, "flows array<struct<roadName:string,currentSpeed:double,freeFlowSpeed:double>>")["flows"]
    d = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), F.explode(flows).alias("s"))
    ratio = F.least(F.lit(1.0), F.col("s.currentSpeed") / F.col("s.freeFlowSpeed"))
    return d.select("id", F.col("s.roadName").alias("road"), ratio.alias("ratio"), text.flow_level(ratio).alias("level"))


@query("q_layer_keep", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", prelude=False)
def layer_keep(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer"))
    return c.join(F.broadcast(spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "layer string")), "layer", "left_semi").select("id")


# indoor levels: customers are rooms and suppliers corridors of a building on the storeys 0 to 3

ROOMS = "WITH r AS (SELECT 1 AS building, id % 4 AS level, id AS room, gx AS x, gy AS y FROM pois), c AS (SELECT 1 AS building, id % 4 AS level, id AS corridor, gx AS ox, gy AS oy FROM stops)"


def rooms(df):
    return df.select(F.lit(1).alias("building"), (F.col("id") % 4).cast("int").alias("level"), "id", F.col("gx").alias("x"), F.col("gy").alias("y"))


@query("q_room_doors", f"{ROOMS}, d AS (SELECT room, corridor, sqrt(CAST((x-ox)*(x-ox)+(y-oy)*(y-oy) AS DOUBLE)) * 25e-2 AS dist FROM r JOIN c USING (building, level)), k AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY dist, corridor) AS n FROM d WHERE dist <= 40) SELECT room, corridor, floor(dist*1e3+5e-1)/1e3 AS dist FROM k WHERE n = 1")
def room_doors(spark, sf):
    d = indoor.room_doors(rooms(ad.pois(spark, sf)), rooms(ad.stops(spark, sf)), 0.25)
    return d.select("room", "corridor", geo.half_up(F.col("dist"), 3).alias("dist"))


@query("q_indoor_caps", f"{ROOMS}, k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY room) AS n FROM r) SELECT level, room AS id FROM k WHERE n <= 10 AND level <= 2")
def indoor_caps(spark, sf):
    return indoor.capped(rooms(ad.pois(spark, sf)), 10, 3).select(F.col("level").cast("long").alias("level"), "id")


@query("q_shaft_links", "WITH l AS (SELECT DISTINCT p_brand AS cx, p_size % 40 AS level FROM part), g AS (SELECT cx, level AS low, lead(level) OVER (PARTITION BY cx ORDER BY level) AS high FROM l) SELECT cx, low, high, high - low - 1 AS gap FROM g WHERE high IS NOT NULL", prelude=False)
def shaft_links(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    shafts = p.groupBy(F.col("p_brand").alias("cx")).agg(F.sort_array(F.collect_set(F.col("p_size") % 40)).alias("levels")).withColumn("cy", F.lit(0))
    return indoor.shaft_links(shafts).select("cx", "low", "high", "gap")


# elements: stops are nodes, trips ways

@query("q_way_lines", "WITH n AS (SELECT id, gx, gy FROM stops WHERE id % 9 > 0) SELECT t.trip_id AS id, string_agg(n.gx || ' ' || n.gy, ',' ORDER BY t.seq) AS line, count(*) >= 4 AND arg_min(t.stop_id, t.seq) = arg_max(t.stop_id, t.seq) AS closed FROM stop_times t JOIN n ON n.id = t.stop_id GROUP BY 1 HAVING count(*) >= 2")
def way_lines(spark, sf):
    nodes = ad.stops(spark, sf).where("id % 9 > 0").select("id", F.create_map().cast("map<string,string>").alias("tags"), F.col("gx").cast("double").alias("lon"), F.col("gy").cast("double").alias("lat"))
    t = ad.stop_times(spark, sf).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"]).alias("refs"))
    ways = t.select(F.col("trip_id").alias("id"), F.create_map(F.lit("indoor"), F.lit("room")).alias("tags"), "refs", F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("inline"))
    d = elements.features(nodes, ways)
    line = F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p["lon"].cast("long").cast("string"), p["lat"].cast("long").cast("string"))), ",")
    return d.select("id", line.alias("line"), (F.col("kind") == "area").alias("closed"))


@query("q_tile_degrees", "SELECT id, CAST(floor((id % 16384 + gx/4096e0)/16384e0*360e0*1e7 - 180e7 + 5e-1) AS BIGINT) AS lon7, floor(degrees(atan(sinh(pi()*(1-2*(id % 999 + gy/4096e0)/16384e0))))*1e6+5e-1)/1e6 AS lat FROM pois")
def tile_degrees(spark, sf):
    k = F.col("id")
    at = tiles.to_degrees(F.lit(14), k % 16384, k % 999, F.array(F.array(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")))), F.lit(4096.0))[0][0]
    return ad.pois(spark, sf).select("id", F.floor((at["lon"] + 180) * 1e7 - 180e7 + 0.5).alias("lon7"), geo.half_up(at["lat"], 6).alias("lat"))


# heat, areas and lines

@query("q_heat_stats", "SELECT n.n_regionkey AS grp, max(p.id % 40) AS most, floor(avg(CASE WHEN p.id % 40 > 0 THEN p.id % 40 END) * 10 + 5e-1) / 10 AS mean, count(*) FILTER (WHERE p.id % 40 > 0) AS positive FROM pois p JOIN nation n ON p.id % 25 = n.n_nationkey GROUP BY 1")
def heat_stats(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey")).cast("long").alias("k"), F.col("n_regionkey").alias("grp"))
    cells = ad.pois(spark, sf).select((F.col("id") % 25).alias("k"), (F.col("id") % 40).alias("value")).join(F.broadcast(n), "k")
    return heat.summary(cells, "grp")


@query("q_elevation_extent", "SELECT min(v) AS low, max(v) AS high, max(v) - min(v) AS range FROM raster")
def elevation_extent(spark, sf):
    return heat.extent(ad.raster(spark, sf))


VERTICES = "WITH v AS (SELECT t.trip_id, t.seq, s.gx AS x, s.gy AS y FROM stop_times t JOIN stops s ON s.id = t.stop_id)"


@query("q_ring_centre", f"{VERTICES} SELECT trip_id, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE) + 5e-1) AS BIGINT) AS x, CAST(floor(sum(y) / CAST(count(*) AS DOUBLE) + 5e-1) AS BIGINT) AS y FROM v GROUP BY 1 HAVING count(*) >= 3")
def ring_centre(spark, sf):
    from geoloom.plans.wire import lines

    d = lines(spark, sf).select("trip_id", place_graph.ring_centre(F.col("line")).alias("c")).where("c IS NOT NULL")
    return d.select("trip_id", "c.x", "c.y")


@query("q_off_line", "SELECT id, floor(abs((4000-0)*(0-gy) - (0-gx)*(3000-0)) / sqrt(4000e0*4000e0+3000e0*3000e0) * 1e3 + 5e-1) / 1e3 AS off FROM pois")
def off_line(spark, sf):
    zero = F.lit(0)
    return ad.pois(spark, sf).select("id", geo.half_up(geo.off_line(F.col("gx"), F.col("gy"), zero, zero, F.lit(4000), F.lit(3000)), 3).alias("off"))


_SX, _SY = geo.grid_scale(ad.WEST, ad.SOUTH, ad.EAST, ad.NORTH)


@query("q_grid_distance", f"SELECT id, floor(sqrt(pow(gx * {_SX!r}e0, 2) + pow(gy * {_SY!r}e0, 2)) * 1e3 + 5e-1) / 1e3 AS metres FROM pois")
def grid_distance(spark, sf):
    return ad.pois(spark, sf).select("id", geo.half_up(geo.grid_distance(F.col("gx"), F.col("gy"), (_SX, _SY)), 3).alias("metres"))


# emission

@query("q_node_lines", "SELECT id, '  n' || id || ': { kind: poi' || CASE WHEN id % 3 > 0 THEN ', name: \"' || name || '\"' ELSE '' END || CASE WHEN id % 2 = 0 THEN ', tags: [' || lower(tag) || ', shop]' ELSE '' END || CASE WHEN id % 5 = 0 THEN ', height: ' || id % 90 ELSE '' END || ' }' AS line FROM pois")
def node_lines(spark, sf):
    k = F.col("id")
    tags = F.when(k % 2 == 0, F.array(F.lower("tag"), F.lit("shop")))
    return ad.pois(spark, sf).select("id", emit.node_line(k, F.lit("poi"), F.when(k % 3 > 0, F.col("name")), tags, F.when(k % 5 == 0, k % 90)).alias("line"))


@query("q_graph_text", """WITH n AS (SELECT id % 10 AS graph, 'nodes:' || chr(10) || string_agg('  n' || id || ': { kind: area }', chr(10) ORDER BY id) AS n FROM stops GROUP BY 1),
e AS (SELECT id % 10 AS graph, 'edges:' || chr(10) || string_agg('  - { from: n' || id || ', to: n' || id + 1 || ', dist: ' || gx || 'm, dir: east, path: road' || CASE WHEN id % 2 = 0 THEN ', crosswalk: true' ELSE '' END || ' }', chr(10) ORDER BY id) AS e FROM stops GROUP BY 1)
SELECT graph, n || chr(10) || e || chr(10) AS text FROM n JOIN e USING (graph)""")
def graph_text(spark, sf):
    k, none = F.col("id"), F.lit(None).cast("string")
    s = ad.stops(spark, sf).withColumn("graph", k % 10)
    nodes = s.select("graph", k.alias("ord"), emit.node_line(k, F.lit("area"), none, F.lit(None).cast("array<string>"), none).alias("line"))
    edges = s.select("graph", k.alias("ord"), emit.edge_line(k, k + 1, F.col("gx").cast("double"), F.lit("east"), F.lit("road"), k % 2 == 0, F.lit(False)).alias("line"))
    return emit.graph_text(nodes, edges)


@query("q_landmark_score", "SELECT id, CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 0 END + id % 3 * 3 + CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS score FROM pois")
def landmark_score(spark, sf):
    k = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("transit", "poi", "building", "area")]), (k % 4 + 1).cast("int"))
    tags = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < k % 3), lambda i: i.cast("string"))
    return ad.pois(spark, sf).select("id", budget.landmark_score(kind, tags, F.when(k % 5 == 0, k)).cast("long").alias("score"))


@query("q_graph_tokens", "SELECT route_id, count(DISTINCT stop_id) * 28 + count(*) * 46 + 40 AS tokens FROM stop_times JOIN trips USING (trip_id) GROUP BY 1")
def graph_tokens(spark, sf):
    d = ad.stop_times(spark, sf).join(ad.trips(spark, sf), "trip_id").groupBy("route_id").agg(F.countDistinct("stop_id").alias("n"), F.count("*").alias("e"))
    return d.select("route_id", budget.graph_tokens(F.col("n"), F.col("e")).alias("tokens"))


@query("q_fitted_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents), c AS (SELECT *, sum(CAST(ceil((length(line) + len(regexp_extract_all(line, '[\\x{10000}-\\x{10FFFF}]'))) / 4e0) AS BIGINT) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l) SELECT doc_id, count(*) FILTER (WHERE s <= 60) AS lines FROM c GROUP BY 1", prelude=False)
def fitted_lines(spark, sf):
    lines = text.fitted(F.split("text", r"\. "), 60)
    return spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("lines"))


@query("q_kept_edges", "SELECT o_orderkey AS from_id, o_custkey AS to_id, 'closed' AS type FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 3 = 0 AND o_orderkey % 2 = 0", prelude=False)
def kept_edges(spark, sf):
    e = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.lit("closed").alias("path"), (F.col("o_orderkey") % 2 == 0).alias("blocked"))
    ids = e.select(F.col("from_id").alias("num")).union(e.select("to_id")).distinct().where("num % 3 = 0")
    return place_graph.live_obstacles(place_graph.obstacles(e), place_graph.kept_edges(e, ids))


@query("q_graph_shape")
def graph_shape(spark, sf):
    """Main part and cut points of each route's graph of stops."""
    nodes, edges = route_graphs(spark, sf)
    return budget.shape(nodes, edges)


@query("q_graph_fit")
def graph_fit(spark, sf):
    """What stays of each route's graph within 2048 tokens."""
    nodes, edges = route_graphs(spark, sf)
    return budget.fitted(nodes.withColumn("worth", F.col("id") % 7), edges, 2048)


@query("q_graph_contract")
def graph_contract(spark, sf):
    """Each route's graph of first rides with its plain chains drawn together."""
    nodes, edges = route_graphs(spark, sf)
    d = budget.contracted(nodes, edges)
    return d.select("graph", "from_id", "to_id", "dx", "dy", geo.half_up(F.col("dist"), 3).alias("dist"), F.size("segments").alias("segments"))


def route_graphs(spark, sf):
    """(nodes, edges) of a graph for each route: its stops, and an edge for each two that follow each other on a trip."""
    at = ad.stops(spark, sf).select(F.col("id").alias("stop_id"), "gx", "gy")
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = ad.stop_times(spark, sf).join(ad.trips(spark, sf), "trip_id").join(at, "stop_id")
    rows = rows.withColumns({"p": F.lag("stop_id").over(w), "px": F.lag("gx").over(w), "py": F.lag("gy").over(w)}).withColumn("graph", F.col("route_id"))
    one = rows.where("p IS NOT NULL AND p <> stop_id").select("graph", F.least("p", "stop_id").alias("a"), F.greatest("p", "stop_id").alias("b")).distinct()
    xy = lambda n: at.select(F.col("stop_id").alias(n), F.col("gx").alias(f"{n}x"), F.col("gy").alias(f"{n}y"))
    e = one.join(xy("a"), "a").join(xy("b"), "b")
    step = lambda f, t: e.select("graph", F.col(f).alias("from_id"), F.col(t).alias("to_id"), (F.col(f"{t}x") - F.col(f"{f}x")).alias("dx"), (F.col(f"{t}y") - F.col(f"{f}y")).alias("dy"))
    edges = step("a", "b").unionByName(step("b", "a")).withColumn("dist", F.hypot(F.col("dx").cast("double"), F.col("dy").cast("double"))).withColumns({"path": F.lit("road"), "blocked": F.lit(False), "crosswalk": F.lit(False)})
    nodes = rows.select("graph", F.col("stop_id").alias("id")).distinct().withColumns({"kind": F.lit("intersection"), "name": F.when(F.col("id") % 4 == 0, F.col("id").cast("string"))})
    return nodes, edges
