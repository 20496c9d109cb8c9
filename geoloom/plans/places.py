"""Queries over features, the place graph, rides, realtime matches and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geo, ingest, sky, text
from geoloom.operators import document, graph, place_graph, transit
from geoloom.operators.number import numbered
from geoloom.plans import adapters as ad
from geoloom.plans.core import CLOCK, hav, query
from geoloom.sources import archives, frames, rasters, realtime, tiles

A, B = (37.775, -122.415), (37.778, -122.412)


def near(centre, radius=400, cap=8):
    dist = hav(f"{centre[0]}e0", "lat", f"{centre[1]}e0", "lon")
    return f"SELECT id, dist FROM (SELECT id, CAST(floor({dist} + 5e-1) AS BIGINT) AS dist FROM stops) WHERE dist <= {radius} ORDER BY dist, id LIMIT {cap}"


ENDS = f"WITH a AS ({near(A)}), b AS ({near(B)})"
SERVED = "v AS (SELECT DISTINCT route_id, stop_id FROM stop_times JOIN trips USING (trip_id))"
ANCHORS = """anchors AS (SELECT route_id, walk, sa, sb FROM (
  SELECT x.route_id, a.dist + b.dist AS walk, a.id AS sa, b.id AS sb,
    row_number() OVER (PARTITION BY x.route_id ORDER BY a.dist + b.dist, a.id, b.id) AS r
  FROM v x JOIN a ON a.id = x.stop_id JOIN v y ON y.route_id = x.route_id JOIN b ON b.id = y.stop_id WHERE a.id <> b.id) WHERE r = 1)"""
RIDES = """rides AS (SELECT route_id, trip_id, board, alight, dep, arrive, rides, walk FROM (
  SELECT k.route_id, t.trip_id, k.sa AS board, k.sb AS alight, k.walk, on_.dep, off_.dep AS arrive, off_.seq - on_.seq AS rides,
    row_number() OVER (PARTITION BY t.trip_id ORDER BY on_.seq, off_.seq) AS r, min(on_.seq) OVER (PARTITION BY t.trip_id) AS first_seq, on_.seq AS on_seq
  FROM anchors k JOIN trips t ON t.route_id = k.route_id AND t.service_id IN ('1-URGENT', '4-NOT SPECIFIED')
  JOIN stop_times on_ ON on_.trip_id = t.trip_id AND on_.stop_id = k.sa
  JOIN stop_times off_ ON off_.trip_id = t.trip_id AND off_.stop_id = k.sb AND off_.seq > on_.seq
  WHERE NOT EXISTS (SELECT 1 FROM stop_times e WHERE e.trip_id = t.trip_id AND e.stop_id = k.sa AND e.seq < on_.seq)) WHERE r = 1 AND dep >= 300)"""


def ends(spark, sf):
    s = ad.stops(spark, sf)
    return transit.catchment(s, *A, 400.0), transit.catchment(s, *B, 400.0)


def served(spark, sf):
    return ad.stop_times(spark, sf).join(ad.trips(spark, sf), "trip_id").select("route_id", "stop_id").distinct()


@query("q_ride_pairs", f"""{ENDS}, o AS (
  SELECT trip_id, stop_id AS board, min(seq) AS board_seq, arg_min(struct_pack(d := dep), seq).d AS dep FROM stop_times WHERE stop_id IN (SELECT id FROM a) GROUP BY 1, 2)
SELECT o.trip_id, board, s.stop_id AS alight, board_seq, CAST(o.dep AS BIGINT) AS dep, min(s.seq) AS alight_seq
FROM o JOIN stop_times s ON s.trip_id = o.trip_id AND s.seq > board_seq AND s.stop_id <> board AND s.stop_id IN (SELECT id FROM b) GROUP BY ALL""")
def rides(spark, sf):
    return transit.rides(ad.stop_times(spark, sf), *ends(spark, sf))


@query("q_shared_lines", f"{ENDS}, {SERVED}, {ANCHORS} SELECT route_id, walk, sa, sb FROM anchors")
def shared(spark, sf):
    return transit.shared_lines(served(spark, sf), *ends(spark, sf))


@query("q_catchments", f"{ENDS} SELECT 'from' AS side, id, dist FROM a UNION ALL SELECT 'to', id, dist FROM b")
def catchments(spark, sf):
    a, b = ends(spark, sf)
    return a.select(F.lit("from").alias("side"), "id", "dist").union(b.select(F.lit("to"), "id", "dist"))


def plans(spark, sf):
    services = transit.services_on(ad.calendar(spark), ad.exceptions(spark), 20261019, "monday")
    return transit.ride_plans(ad.stop_times(spark, sf), ad.trips(spark, sf), services, transit.shared_lines(served(spark, sf), *ends(spark, sf)), 300)


@query("q_ride_plans", f"{ENDS}, {SERVED}, {ANCHORS}, {RIDES} SELECT route_id, trip_id, board, alight, CAST(dep AS BIGINT) AS dep, CAST(arrive AS BIGINT) AS arrive, rides FROM rides")
def ride_plans(spark, sf):
    return plans(spark, sf).select("route_id", "trip_id", "board", "alight", "dep", "arrive", "rides")


@query("q_trip_plan", f"""{ENDS}, {SERVED}, {ANCHORS}, {RIDES}, k AS (SELECT *, count(*) OVER () AS n FROM rides ORDER BY dep, route_id, trip_id LIMIT 3)
SELECT trip_id, greatest(0, n - 3) AS more, label || ': ' || s.name || ' ' || a.dist || 'm, depart ' || {CLOCK.format(d="dep")} || ', ride ' || rides || CASE WHEN rides = 1 THEN ' stop' ELSE ' stops' END
  || coalesce(', alight ' || {CLOCK.format(d="arrive")}, ', alight time not published') AS text
FROM k JOIN routes USING (route_id) JOIN stops s ON s.id = board JOIN a ON a.id = board""")
def trip_plan(spark, sf):
    a, _ = ends(spark, sf)
    d = transit.shown_plans(plans(spark, sf)).join(ad.routes(spark, sf), "route_id").join(ad.stops(spark, sf).select(F.col("id").alias("board"), "name"), "board").join(a.select(F.col("id").alias("board"), "dist"), "board")
    full = transit.plan_text(F.col("label"), F.col("name"), F.col("dist"), F.lit("east"), F.col("dep"), F.col("suffix"), F.col("rides"), F.col("arrive"), F.lit(0), F.lit("west"))
    short = F.regexp_replace(F.regexp_replace(full, "m east, depart", "m, depart"), ", then 0m west to destination$", "")
    return d.select("trip_id", "more", short.alias("text"))


@query("q_prune_order", f"""{ENDS}, n AS (SELECT stop_id AS id, count(DISTINCT route_id) AS n_lines FROM stop_times JOIN trips USING (trip_id) GROUP BY 1), s AS (SELECT a.id, dist, coalesce(n_lines, 0) AS n_lines FROM a LEFT JOIN n USING (id))
SELECT id, CAST(row_number() OVER (ORDER BY n_lines, dist DESC, id) AS INT) AS prune, CAST(row_number() OVER (ORDER BY dist, n_lines, id) AS INT) AS shown FROM s""")
def prune_order(spark, sf):
    n = served(spark, sf).groupBy(F.col("stop_id").alias("id")).agg(F.count("*").alias("n_lines"))
    s = ends(spark, sf)[0].join(n, "id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return transit.prune_order(s).select("id", "prune", "shown")


@query("q_live_lines", """WITH e AS (SELECT stop_id, label AS text, min(trip_id * 100 + seq) AS ord FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY ord, text) AS r FROM e)
SELECT stop_id, string_agg(text, '|' ORDER BY r) AS live FROM r WHERE r <= 3 GROUP BY 1""")
def live_lines(spark, sf):
    e = ad.stop_times(spark, sf).join(ad.trips(spark, sf), "trip_id").join(ad.routes(spark, sf), "route_id")
    return transit.live_lines(e.select("stop_id", (F.col("trip_id") * 100 + F.col("seq")).alias("ord"), F.col("label").alias("text"))).select("stop_id", F.array_join("live", "|").alias("live"))


@query("q_service_note", """SELECT n_nationkey AS id, 'Stop distances are straight-line. ' || CASE WHEN n_nationkey % 3 = 0 THEN 'The feed has no service calendar; service window unknown. Routes cover the whole feed and first/last departures are not shown.'
  ELSE 'Schedule from GTFS feed for 2026-10-19 in Etc/UTC.' || CASE WHEN n_nationkey % 3 = 1 THEN ' No service runs on this date.' ELSE '' END END
  || CASE WHEN n_nationkey % 3 = 2 AND n_nationkey < 12 THEN ' Every scheduled departure for these stops has already run; the next services are another day''s.' ELSE '' END AS note,
  CASE WHEN n_nationkey % 4 = 0 THEN 'All times are scheduled; no real-time feed is configured.' WHEN n_nationkey % 4 = 1 THEN 'Real-time feed unavailable (timed out); all times shown are scheduled.'
  ELSE CASE WHEN n_regionkey = 0 THEN 'The real-time feed answered but carried no trip updates 9s before query time.' ELSE 'Real-time: ' || n_regionkey || CASE WHEN n_regionkey = 1 THEN ' trip prediction' ELSE ' trip predictions' END || ', feed 9s old at query time.' END || ' A stop without a live entry has no prediction: unknown, not on time.' END AS live FROM nation""", prelude=False)
def service_note(spark, sf):
    n, k = spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_nationkey")
    state = transit.service_state(k % 3 != 0, k % 3 - 1)
    passed = transit.all_passed(state, k, F.lit(12))
    updates = F.when(k % 4 > 1, F.col("n_regionkey"))
    live = transit.realtime_note(updates, F.lit(9), F.when(k % 4 == 1, "timed out"))
    return n.select(k.alias("id"), transit.service_note(state, F.lit(20261019), F.lit("Etc/UTC"), passed).alias("note"), live.alias("live"))


@query("q_rt_match", """WITH u AS (SELECT event_id, user_id AS trip_id, CASE WHEN event_id % 2 = 0 THEN event_id % 10 + 1 END AS stop_id, event_id % 5 + 1 AS n, delay, relationship FROM (SELECT *, entity_id AS user_id FROM updates)),
f AS (SELECT trip_id, stop_id, min(seq) AS seq FROM stop_times GROUP BY 1, 2)
SELECT event_id, u.trip_id, f.stop_id, f.seq, CASE WHEN relationship = 1 THEN 'cancelled' ELSE CASE WHEN delay < 0 THEN '-' ELSE '+' END || abs(delay) || 's' END AS suffix FROM u JOIN f ON f.trip_id = u.trip_id AND f.stop_id = u.stop_id
UNION ALL SELECT event_id, u.trip_id, s.stop_id, s.seq, CASE WHEN relationship = 1 THEN 'cancelled' ELSE CASE WHEN delay < 0 THEN '-' ELSE '+' END || abs(delay) || 's' END FROM u JOIN stop_times s ON s.trip_id = u.trip_id AND s.seq = u.n WHERE u.stop_id IS NULL""")
def rt_match(spark, sf):
    k = F.col("event_id")
    u = ad.updates(spark, sf).select("event_id", "trip_id", F.when(k % 2 == 0, k % 10 + 1).alias("stop_id"), (k % 5 + 1).alias("stop_sequence"), "delay", "relationship")
    none = F.lit(None).cast("long")
    return transit.matched_updates(u, ad.stop_times(spark, sf)).select("event_id", "trip_id", "stop_id", "seq", transit.suffix(F.col("relationship"), F.col("delay"), none, none).alias("suffix"))


# features: customers are points, and every fifth one an area

PROPS = {"highway": "CASE WHEN c_custkey % 7 = 0 THEN 'bus_stop' END", "amenity": "CASE WHEN c_custkey % 7 IN (1, 2) THEN lower(c_mktsegment) END", "shop": "CASE WHEN c_custkey % 7 = 3 THEN 'books' END", "type": "CASE WHEN c_custkey % 11 = 0 THEN 'tourism.viewpoint' END", "building": "CASE WHEN c_custkey % 13 = 0 THEN 'yes' END", "name": "CASE WHEN c_custkey % 2 = 0 THEN c_name END", "height": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS VARCHAR) END", "crossing": "CASE WHEN c_custkey % 17 = 0 THEN 'crosswalk' END", "door": "CASE WHEN c_custkey % 19 = 0 THEN 'locked' END"}


def customers(spark, sf):
    """Customers with a geometry type and a map of properties."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    props = [F.lit(x) if i % 2 == 0 else F.expr(x.replace("VARCHAR", "STRING")) for i, x in enumerate(x for kv in PROPS.items() for x in kv)]
    return c.select(k.alias("id"), F.when(k % 5 == 0, "Polygon").when(k % 5 == 1, "LineString").otherwise("Point").alias("geometry"), F.create_map(*props).alias("props"))


FEATURES = f"""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' ELSE 'Point' END AS geometry, {", ".join(f'{v} AS "{k}"' for k, v in PROPS.items())} FROM customer),
k AS (SELECT *, CASE WHEN geometry = 'LineString' THEN 'line' WHEN building IS NOT NULL THEN 'building' WHEN geometry = 'Point' THEN 'point' ELSE 'area' END AS kind FROM c),
l AS (SELECT *, CASE kind WHEN 'line' THEN 'road' WHEN 'point' THEN 'poi' ELSE kind END AS layer FROM k),
f AS (SELECT *, coalesce(type, 'highway.' || highway, 'amenity.' || amenity, 'shop.' || shop, CASE WHEN layer = 'building' OR building IS NOT NULL THEN 'building.commercial' END, CASE kind WHEN 'point' THEN 'poi' WHEN 'line' THEN 'highway.residential' ELSE 'area.generic' END) AS class FROM l)"""


def features(spark, sf):
    d = customers(spark, sf)
    layer = ingest.layer_of(F.col("geometry"), F.col("props"))
    return d.select("*", ingest.feature_kind(F.col("geometry"), F.col("props")).alias("kind"), layer.alias("layer"), ingest.class_of(F.col("geometry"), F.col("props"), layer).alias("class"), ingest.kept_properties(F.col("props")).alias("properties"))


@query("q_feature_class", f"{FEATURES} SELECT id, kind, layer, class FROM f", prelude=False)
def feature_class(spark, sf):
    return features(spark, sf).select("id", "kind", "layer", "class")


@query("q_feature_tags", f"""{FEATURES}, t AS (SELECT id, CASE WHEN class LIKE '%.%' THEN split_part(class, '.', -1) END AS leaf, crossing, door FROM f)
SELECT f.id, coalesce(leaf, '') || CASE WHEN f.crossing IS NOT NULL AND f.crossing IS DISTINCT FROM leaf THEN CASE WHEN leaf IS NULL THEN '' ELSE ',' END || f.crossing ELSE '' END AS tags, f.door IS NOT NULL AS blocked, f.crossing IS NOT NULL AS crosswalk, name, CAST(height AS DOUBLE) AS height,
  CASE WHEN class LIKE '%steps%' THEN 'stairs' WHEN layer = 'road' THEN 'road' END AS path FROM f JOIN t USING (id)""", prelude=False)
def feature_tags(spark, sf):
    p = F.col("properties")
    return features(spark, sf).select("id", F.array_join(ingest.tags_of(F.col("class"), p), ",").alias("tags"), ingest.blocked(p).alias("blocked"), ingest.has_token(p, "crossing", "crosswalk").alias("crosswalk"), ingest.name_of(p).alias("name"), ingest.height_of(p).alias("height"), ingest.path_of(F.col("class"), F.col("layer")).alias("path"))


@query("q_node_kind", f"""{FEATURES} SELECT id, CASE WHEN class = 'highway.bus_stop' THEN 'transit' WHEN class LIKE 'building%' THEN 'building' WHEN class LIKE 'highway%' THEN 'intersection' WHEN class LIKE '%park%' OR class LIKE '%garden%' THEN 'park' WHEN class LIKE '%.%' THEN 'poi' ELSE 'area' END AS kind, class = 'tourism.viewpoint' AS furniture FROM f""", prelude=False)
def node_kind(spark, sf):
    return features(spark, sf).select("id", ingest.node_kind(F.col("class")).alias("kind"), ingest.is_furniture(F.col("class")).alias("furniture"))


@query("q_property_types", """WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand WHEN 2 THEN 'true' WHEN 3 THEN 'steps' WHEN 4 THEN '-' || p_size || '.5e1' ELSE p_type END AS value FROM part)
SELECT id, value, CASE id % 6 WHEN 0 THEN 'num' WHEN 2 THEN 'bool' WHEN 3 THEN 'token' WHEN 4 THEN 'num' ELSE 'ref' END AS type FROM v""", prelude=False)
def property_types(spark, sf):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    value = F.when(k == 0, size).when(k == 1, F.col("p_brand")).when(k == 2, "true").when(k == 3, "steps").when(k == 4, F.concat(F.lit("-"), size, F.lit(".5e1"))).otherwise(F.col("p_type"))
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), value.alias("value"), ingest.typed(value).alias("type"))


@query("q_storeys", """WITH v AS (SELECT p_partkey AS id, p_size, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size - 10 AS VARCHAR) WHEN 1 THEN 'Ground Floor' WHEN 2 THEN ' basement' WHEN 3 THEN p_size || '.5' ELSE 'roof' END AS level FROM part),
n AS (SELECT id, CASE id % 5 WHEN 0 THEN p_size - 10e0 WHEN 1 THEN 0e0 WHEN 2 THEN -1e0 WHEN 3 THEN p_size + 5e-1 END AS storey FROM v)
SELECT id, storey, CASE WHEN storey = 0 THEN 'ground' WHEN storey = -1 THEN 'basement' WHEN storey < 0 THEN 'basement ' || CAST(-storey AS BIGINT) WHEN storey = floor(storey) THEN CAST(CAST(storey AS BIGINT) AS VARCHAR) ELSE CAST(storey AS VARCHAR) END AS label FROM n""", prelude=False)
def storeys(spark, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    level = F.when(k == 0, (size - 10).cast("string")).when(k == 1, "Ground Floor").when(k == 2, " basement").when(k == 3, F.concat(size.cast("string"), F.lit(".5"))).otherwise("roof")
    d = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), ingest.storey(level).alias("storey"))
    return d.withColumn("label", text.storey_label(F.col("storey")))


@query("q_search", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'large w') OR contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'promo brand#1')", prelude=False)
def search(spark, sf):
    name, tags = F.col("p_name"), F.array("p_type", "p_brand")
    return spark.read.parquet(f"{sf}/part.parquet").where(ingest.matches_search(name, tags, "Large W") | ingest.matches_search(name, tags, "promo Brand#1")).select(F.col("p_partkey").alias("id"))


@query("q_clamped", "SELECT c_custkey AS id, greatest(50e0, least(2000e0, coalesce(CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END, 500e0))) AS walk FROM customer", prelude=False)
def clamped(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), ingest.clamped(F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal").cast("string")).otherwise("far"), 50, 2000, 500).alias("walk"))


@query("q_box_relations", """WITH b AS (SELECT id, gx, gy, gx + id % 900 AS x1, gy + id % 700 AS y1 FROM pois) SELECT id, gx <= 2000 AND 1000 <= x1 AND gy <= 2000 AND 1000 <= y1 AS meets, gy >= 1000 AND y1 <= 2000 AND (gx - 1000 + 3600000) % 360 + (x1 - gx) <= 1000 AS holds, least(gx, 1000) AS west, greatest(y1, 2000) AS north FROM b""")
def box_relations(spark, sf):
    box = {"west": F.col("gx"), "south": F.col("gy"), "east": F.col("gx") + F.col("id") % 900, "north": F.col("gy") + F.col("id") % 700}
    fixed = {"west": F.lit(1000), "south": F.lit(1000), "east": F.lit(2000), "north": F.lit(2000)}
    both = ingest.box_of_both(box, fixed)
    return ad.pois(spark, sf).select("id", ingest.box_meets(box, fixed).alias("meets"), ingest.box_holds(fixed, box).alias("holds"), both["west"].alias("west"), both["north"].alias("north"))


# the place graph: trips are lines through stops, customers points, suppliers' neighbours areas


def graph_features(spark, sf):
    from geoloom.plans.wire import lines

    line = lines(spark, sf).select(F.col("trip_id").alias("ord"), F.lit("line").alias("kind"), F.when(F.col("trip_id") % 3 == 0, "highway.footway").otherwise("highway.residential").alias("class"), F.lit("road").alias("layer"), F.array("line").alias("lines"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("at"), F.array().cast(f"array<{ingest.PROPERTY}>").alias("properties"))
    p = features(spark, sf).where("geometry <> 'LineString'").join(ad.pois(spark, sf).select("id", "gx", "gy"), "id")
    place = p.select((F.col("id") + 100_000_000).alias("ord"), F.when(F.col("geometry") == "Point", "point").when(F.col("kind") == "building", "building").otherwise("polygon").alias("kind"), "class", "layer", F.lit(None).cast("array<array<struct<x:bigint,y:bigint>>>").alias("lines"), F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")).alias("at"), "properties")
    return line.unionByName(place)


GRAPH = FEATURES + """, w AS (SELECT t.trip_id AS ord, t.seq, s.gx AS x, s.gy AS y, lag(s.gx) OVER o AS px, lag(s.gy) OVER o AS py FROM stop_times t JOIN stops s ON s.id = t.stop_id WINDOW o AS (PARTITION BY t.trip_id ORDER BY t.seq)),
dd AS (SELECT ord, seq, x, y, count(*) OVER (PARTITION BY ord) AS n FROM w WHERE px IS NULL OR px <> x OR py <> y),
vv AS (SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY seq) AS i, x, y, CAST(floor(x/2e0+5e-1) AS BIGINT) AS wx, CAST(floor(y/2e0+5e-1) AS BIGINT) AS wy FROM dd WHERE n >= 2),
jj AS (SELECT wx, wy, min(ord * 1000 + i) AS first, arg_min(x, ord * 1000 + i) AS x, arg_min(y, ord * 1000 + i) AS y FROM vv GROUP BY 1, 2),
pl AS (SELECT f.id + 100000000 AS ord, CASE WHEN geometry = 'Point' THEN 1 ELSE 2 END AS step, f.name, height, class, kind AS fkind, gx AS x, gy AS y, CAST(floor(gx/2e0+5e-1) AS BIGINT) AS wx, CAST(floor(gy/2e0+5e-1) AS BIGINT) AS wy FROM f JOIN pois ON pois.id = f.id WHERE geometry <> 'LineString' AND NOT (geometry = 'Point' AND class = 'tourism.viewpoint')),
pk AS (SELECT pl.*, jj.first IS NOT NULL AS met, CASE WHEN step = 2 THEN CASE WHEN fkind = 'building' OR class LIKE 'building%' THEN 'building' ELSE 'area' END
  WHEN class = 'highway.bus_stop' THEN 'transit' WHEN class LIKE 'building%' THEN 'building' WHEN class LIKE 'highway%' THEN 'intersection' WHEN class LIKE '%.%' THEN 'poi' ELSE 'area' END AS kind FROM pl LEFT JOIN jj USING (wx, wy)),
nn AS (SELECT 0 AS step, first AS ord, wx, wy, x, y, (SELECT arg_min(k.name, k.step * 1000000000 + k.ord) FROM pk k WHERE k.met AND k.wx = jj.wx AND k.wy = jj.wy AND k.name IS NOT NULL) AS name,
    coalesce((SELECT arg_min(struct_pack(k := CASE WHEN k.step = 1 AND k.kind <> 'intersection' THEN k.kind END), k.step * 1000000000 + k.ord).k FROM pk k WHERE k.met AND k.wx = jj.wx AND k.wy = jj.wy AND k.name IS NOT NULL),
      (SELECT 'building' FROM pk k WHERE k.met AND k.wx = jj.wx AND k.wy = jj.wy AND k.step = 2 AND k.kind = 'building' LIMIT 1), 'intersection') AS kind FROM jj
  UNION ALL SELECT step, ord, NULL, NULL, x, y, name, kind FROM pk WHERE NOT met),
nodes AS (SELECT row_number() OVER (ORDER BY step, ord) AS num, * FROM nn),
walk AS (SELECT vv.ord, num, nodes.x, nodes.y, lag(num) OVER o AS pn, lag(nodes.x) OVER o AS px, lag(nodes.y) OVER o AS py FROM vv JOIN nodes ON nodes.wx = vv.wx AND nodes.wy = vv.wy WINDOW o AS (PARTITION BY vv.ord ORDER BY vv.i)),
ways AS (SELECT pn AS from_id, num AS to_id, x - px AS dx, y - py AS dy, ord, CASE WHEN ord % 3 = 0 THEN 'sidewalk' ELSE 'road' END AS path FROM walk WHERE pn IS NOT NULL AND pn <> num),
deg AS (SELECT num, count(*) * 2 AS degree FROM (SELECT from_id AS num FROM ways UNION ALL SELECT to_id FROM ways) GROUP BY 1)"""


@query("q_compile_nodes", f"{GRAPH} SELECT nodes.num, x, y, kind, name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (num) WHERE step > 0 OR degree IS NOT NULL OR name IS NOT NULL")
def compile_nodes(spark, sf):
    nodes, _ = place_graph.compile_graph(graph_features(spark, sf))
    return nodes.select("num", "x", "y", "kind", "name", "degree")


@query("q_compile_edges", f"""{GRAPH}, lost AS (SELECT nodes.num, x, y, ord FROM nodes LEFT JOIN deg USING (num) WHERE degree IS NULL AND name IS NOT NULL AND step > 0),
acc AS (SELECT * FROM (SELECT b.num AS from_id, l.num AS to_id, l.x - b.x AS dx, l.y - b.y AS dy, l.ord, 'access' AS path, row_number() OVER (PARTITION BY l.num ORDER BY (l.x-b.x)*(l.x-b.x)+(l.y-b.y)*(l.y-b.y), b.num) AS r FROM lost l CROSS JOIN (SELECT nodes.* FROM nodes JOIN deg USING (num)) b) WHERE r = 1),
e AS (SELECT from_id, to_id, dx, dy, ord, path FROM ways UNION ALL SELECT from_id, to_id, dx, dy, ord, path FROM acc)
SELECT from_id, to_id, dx, dy, ord, path, floor(sqrt(CAST(dx*dx+dy*dy AS DOUBLE)) * 1e3 + 5e-1) / 1e3 AS dist FROM (SELECT * FROM e UNION ALL SELECT to_id, from_id, -dx, -dy, ord, path FROM e)""")
def compile_edges(spark, sf):
    _, edges = place_graph.compile_graph(graph_features(spark, sf))
    return edges.select("from_id", "to_id", "dx", "dy", "ord", "path", geo.half_up(F.col("dist"), 3).alias("dist"))


# documents

DOC_SQL = """WITH s AS (SELECT s_suppkey, s_name, s_nationkey, (s_suppkey * 7919) % 4096 AS gx, (s_suppkey * 6151) % 4096 AS gy FROM supplier),
d AS (SELECT s_nationkey AS doc, 'SCR 1.0' || chr(10) || 'BBOX -122.42 37.77 -122.41 37.78' || chr(10) || 'Q 4096' || chr(10) || chr(10) || 'L 1 poi' || chr(10) || chr(10)
  || string_agg('S ' || s_suppkey || ' ' || s_name, chr(10) ORDER BY s_suppkey) || chr(10) || chr(10) || 'H 9 suppliers 8 0 1' || chr(10) || 'X 9 ' || string_agg(gx // 512 || ',' || gy // 512 || ',1', ';' ORDER BY s_suppkey) || chr(10) AS text FROM s GROUP BY 1)"""


def texts(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("ord"), "s_name", F.floor(F.pmod(F.col("s_suppkey") * 7919, F.lit(4096)) / 512).alias("x"), F.floor(F.pmod(F.col("s_suppkey") * 6151, F.lit(4096)) / 512).alias("y"))
    docs = s.select("doc").distinct()
    fixed = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).cast("long").alias("ord"), F.lit(c).alias("line")) for a, b, c in ((0, 0, "SCR 1.0"), (0, 1, "BBOX -122.42 37.77 -122.41 37.78"), (0, 2, "Q 4096"), (1, 0, "L 1 poi"), (3, 0, "H 9 suppliers 8 0 1"))])
    head = docs.select("doc", F.explode(fixed).alias("l")).select("doc", "l.*")
    names = s.select("doc", F.lit(2).alias("section"), "ord", F.concat_ws(" ", F.lit("S"), F.col("ord").cast("string"), "s_name").alias("line"))
    cells = s.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", F.lit(1).alias("value")))).alias("c"))
    heat = cells.select("doc", F.lit(3).alias("section"), F.lit(1).cast("long").alias("ord"), document.sparse_heat(F.col("c"), F.lit(9)).alias("line"))
    return document.written(head.unionByName(names).unionByName(heat))


@query("q_document_text", f"{DOC_SQL} SELECT doc, text FROM d", prelude=False)
def document_text(spark, sf):
    return texts(spark, sf)


@query("q_document_names", "SELECT s_nationkey AS doc, s_suppkey AS id, s_name AS name FROM supplier", prelude=False)
def document_names(spark, sf):
    return document.named(document.records(document.lines_of(texts(spark, sf))), "S")


@query("q_document_cells", "SELECT s_nationkey AS doc, (s_suppkey * 7919) % 4096 // 512 AS x, (s_suppkey * 6151) % 4096 // 512 AS y, count(*) AS n FROM supplier GROUP BY ALL", prelude=False)
def document_cells(spark, sf):
    r = document.records(document.lines_of(texts(spark, sf))).where("tag = 'X'")
    return r.select("doc", F.explode(document.cells_of(F.col("fields")[1])).alias("c")).groupBy("doc", "c.x", "c.y").agg(F.count("*").alias("n"))


@query("q_document_faults", "SELECT s_nationkey AS doc, 'missing Q record: quantization extent is required' AS error FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1 UNION ALL SELECT s_nationkey, 'line 6: unknown record tag \"W\"' FROM supplier WHERE s_nationkey % 2 = 1 GROUP BY 1", prelude=False)
def document_faults(spark, sf):
    lines = document.lines_of(texts(spark, sf)).where("NOT (doc % 2 = 0 AND n = 3)")
    return document.faults(document.records(lines.withColumn("text", F.when((F.col("doc") % 2 == 1) & (F.col("n") == 5), "L 1 poi").otherwise(F.when((F.col("doc") % 2 == 1) & (F.col("n") == 6), "W 1").otherwise(F.col("text"))))))


# binary documents


def binary_documents(spark, sf):
    """A document of each nation: its suppliers as points, their names as strings and properties, the cells that hold them."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")
    at = F.struct(F.pmod(F.col("id") * 7919, F.lit(4096)).alias("x"), F.pmod(F.col("id") * 6151, F.lit(4096)).alias("y"))
    none = lambda t: F.lit(None).cast(t)
    geometry = F.struct(F.lit("point").alias("is"), F.struct("at.x", "at.y", F.when(F.col("id") % 2 == 0, -F.col("id")).alias("z")).alias("point"), *[none(k.ddl).alias(n) for n, k in (("line", frames.many(frames.PATH)), ("polygon", frames.AREA), ("building", frames.AREA))])
    props = F.array(F.struct(F.lit(1).alias("key"), F.struct(F.lit("num").alias("is"), none("bigint").alias("ref"), F.col("s_acctbal").cast("double").alias("num"), none("boolean").alias("bool"), none("string").alias("token")).alias("value")))
    rows = s.withColumn("at", at).groupBy("doc").agg(
        F.collect_list(F.struct("id", F.col("s_name").alias("text"))).alias("strings"),
        F.collect_list(F.struct("id", props.alias("props"))).alias("attributes"),
        F.array_sort(F.collect_list(F.struct("id", F.lit(1).alias("layer"), F.lit(0).alias("klass"), F.col("id").alias("attributes"), geometry.alias("geometry")))).alias("features"),
    )
    header = F.from_json(F.lit('{"version": 1, "envelope": {"is": "tile", "tile": {"z": 14, "x": 2620, "y": 6332}}, "wgs84": false, "extent": 4096, "buffer": 64}'), frames.HEADER.ddl)
    kinds = {n: k for n, k in frames.SECTIONS.values()}
    parts = [F.col(n) if n in rows.columns else F.array().cast(f"array<{k.ddl}>").alias(n) for n, k in kinds.items()]
    return frames.framed(rows.select("doc", F.struct(header.alias("header"), *parts).alias("d")), F.col("d"), "zstd").select("doc", "frame", "error")


@query("q_binary_features", """SELECT s_nationkey AS doc, s_suppkey AS id, s_name AS name, CAST(s_acctbal AS DOUBLE) AS balance, (s_suppkey * 7919) % 4096 AS x, (s_suppkey * 6151) % 4096 AS y,
  CASE WHEN s_suppkey % 2 = 0 THEN -s_suppkey END AS z FROM supplier""", prelude=False)
def binary_features(spark, sf):
    d = frames.unframed(binary_documents(spark, sf), F.col("frame")).select("doc", "document.*")
    name = d.select("doc", F.explode("strings").alias("s")).select("doc", F.col("s.id").alias("id"), F.col("s.text").alias("name"))
    value = d.select("doc", F.explode("attributes").alias("a")).select("doc", F.col("a.id").alias("id"), F.col("a.props")[0]["value"]["num"].alias("balance"))
    f = d.select("doc", F.explode("features").alias("f")).select("doc", F.col("f.id").alias("id"), "f.geometry.point.*")
    return f.join(name, ["doc", "id"]).join(value, ["doc", "id"]).select("doc", "id", "name", "balance", "x", "y", "z")


@query("q_binary_faults", "SELECT s_nationkey AS doc, CASE s_nationkey % 3 WHEN 0 THEN 'not a framed document' WHEN 1 THEN 'frame too short' END AS error, s_nationkey % 3 <> 0 AND s_nationkey % 3 <> 1 AS framed FROM supplier GROUP BY 1", prelude=False)
def binary_faults(spark, sf):
    d = binary_documents(spark, sf).drop("error")
    bad = F.when(F.col("doc") % 3 == 0, F.concat(F.unhex(F.lit("00")), F.substring("frame", 2, 1 << 30))).when(F.col("doc") % 3 == 1, F.substring("frame", 1, 9)).otherwise(F.col("frame"))
    return frames.unframed(d.withColumn("frame", bad), F.col("frame")).select("doc", "error", frames.is_frame(F.col("frame")).alias("framed"))


# binary sources: written from tables, read back


def packed(df, keys, columns, write):
    """One ``content`` for each group of ``keys``, written from the group's rows, sorted."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    from geoloom.arrow import with_arrow

    return with_arrow(rows, F.col("rows"), [("content", "binary")], lambda values: [(write(v),) for v in values]).drop("rows")


@query("q_rt_decode", "SELECT CAST(event_id AS VARCHAR) AS entity_id, is_deleted, CAST(trip_id AS VARCHAR) AS trip_id, CAST(delay AS INT) AS trip_delay, relationship AS relationship, CAST(event_id % 7 AS INT) AS stop_sequence, CAST(-(event_id % 90) AS INT) AS departure_delay, 1760000000 + event_id AS arrival_time FROM updates")
def rt_decode(spark, sf):
    def write(rows):
        return realtime.encode_updates(1_760_000_000, [{"entity_id": r["event_id"], "is_deleted": r["is_deleted"], "trip_id": str(r["trip_id"]), "trip_delay": r["delay"], "stops": [{"stop_sequence": r["event_id"] % 7, "relationship": r["relationship"], "departure_delay": -(r["event_id"] % 90), "arrival_time": 1_760_000_000 + r["event_id"]}]} for r in rows])

    feeds = packed(ad.updates(spark, sf).withColumn("feed", F.col("event_id") % 64), ["feed"], ["event_id", "trip_id", "is_deleted", "delay", "relationship"], write)
    return realtime.read_updates(feeds).select("entity_id", "is_deleted", "trip_id", "trip_delay", "relationship", "stop_sequence", "departure_delay", "arrival_time")


@query("q_tile_decode", "SELECT tag AS layer, id, gx AS x, gy AS y, name, CAST(id % 40 AS VARCHAR) AS height FROM pois")
def tile_decode(spark, sf):
    def write(rows):
        return tiles.encode_tile(rows[0]["tag"], [{"id": r["id"], "kind": "point", "properties": {"name": r["name"], "height": int(r["id"] % 40)}, "parts": [[(r["gx"], r["gy"])]]} for r in rows])

    made = packed(ad.pois(spark, sf), ["tag"], ["id", "gx", "gy", "name", F.col("tag").alias("tag")], write)
    p = F.col("parts")[0][0]
    return tiles.read_tiles(made).select("layer", "id", p["x"].alias("x"), p["y"].alias("y"), F.col("properties")["name"].alias("name"), F.col("properties")["height"].alias("height"))


@query("q_tile_lines", "WITH v AS (SELECT t.trip_id, t.seq, s.gx AS x, s.gy AS y FROM stop_times t JOIN stops s ON s.id = t.stop_id) SELECT trip_id AS id, string_agg(x || ',' || y, ';' ORDER BY seq) AS path FROM v GROUP BY 1 HAVING count(*) >= 2")
def tile_lines(spark, sf):
    from geoloom.functions import wire
    from geoloom.plans.wire import lines

    def write(rows):
        return tiles.encode_tile("trips", [{"id": r["trip_id"], "kind": "line", "parts": [[(p["x"], p["y"]) for p in r["line"]]]} for r in rows])

    d = lines(spark, sf).where(F.size("line") >= 2).withColumn("k", F.col("trip_id") % 32)
    return tiles.read_tiles(packed(d, ["k"], ["trip_id", "line"], write)).select("id", wire.absolute(F.col("parts")[0]).alias("path"))


@query("q_directory", "SELECT p_partkey AS tile, p_partkey * 10 AS at, p_size AS length FROM part", prelude=False)
def directory(spark, sf):
    from geoloom.arrow import with_arrow

    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 16).alias("k"))
    made = packed(p, ["k"], ["p_partkey", "p_size"], lambda rows: tiles.encode_directory([(r["p_partkey"], r["p_partkey"] * 10, r["p_size"], 1) for r in rows]))
    entry = "array<struct<tile:bigint,at:bigint,length:int,run:int>>"
    d = with_arrow(made, F.col("content"), [("entries", entry)], lambda values: [([dict(zip(("tile", "at", "length", "run"), e)) for e in tiles.decode_directory(v)],) for v in values])
    return d.select(F.explode("entries").alias("e")).select("e.tile", "e.at", "e.length")


@query("q_terrarium", "SELECT x, y, floor(v * 256) / 256 AS v FROM raster WHERE y // 10 IN (SELECT y // 10 FROM raster GROUP BY y // 10 HAVING count(*) = 400)")
def terrarium(spark, sf):
    import numpy as np

    r = ad.raster(spark, sf).withColumn("block", F.expr("y div 10"))
    whole = r.groupBy("block").count().where("count = 400").select("block")
    made = packed(r.join(whole, "block", "left_semi"), ["block"], ["y", "x", "v"], lambda rows: rasters.encode_png(rasters.colours(np.array([q["v"] for q in rows]).reshape(10, 40)), 2))
    return rasters.read_terrarium(made).select("x", (F.col("block") * 10 + F.col("y")).alias("y"), "v")


@query("q_unzip", "SELECT 'names' AS table, n_name || chr(10) AS body FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'names', n_name || chr(10) FROM nation WHERE n_nationkey % 2 = 1", prelude=False)
def unzip(spark, sf):
    import io
    import zipfile

    def write(rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if rows[0]["n_nationkey"] % 2 else zipfile.ZIP_STORED) as z:
            z.writestr("feed/Names.TXT", rows[0]["n_name"] + "\n")
        return out.getvalue()

    made = packed(spark.read.parquet(f"{sf}/nation.parquet"), ["n_nationkey"], [F.col("n_nationkey").alias("n_nationkey"), "n_name"], write)
    return archives.read_zip(made).select("table", F.col("body").cast("string").alias("body"))


# scalars


@query("q_sun", """WITH e AS (SELECT event_id, (event_id % 160) - 80e0 AS lat, (event_id % 350) - 175e0 AS lon, epoch_us(ts) / 86400000000e0 + 2440587.5e0 AS jd FROM events),
a AS (SELECT *, jd - 2451545e0 AS d FROM e), b AS (SELECT *, radians(d*98560028e-8+3575291e-4) AS m, radians(23439e-3 - d*4e-7) AS o, radians(d*98564736e-8+280459e-3) AS l FROM a),
c AS (SELECT *, asin(sin(o)*sin(l)) AS dec, pow(tan(o/2e0),2) AS y FROM b),
q AS (SELECT *, 4e0*degrees(y*sin(m*2) - sin(m)*(2*16708634e-9) + y*sin(m)*cos(m*2)*(4*16708634e-9) - y*y*sin(m*4)*5e-1 - sin(m*2)*(125e-2*16708634e-9*16708634e-9)) AS eq FROM c),
h AS (SELECT *, ((((jd + 5e-1) - floor(jd + 5e-1)) * 1440e0 + eq + lon * 4 + 2880e0) % 1440e0) / 4 - 180e0 AS hour FROM q),
z AS (SELECT *, 90e0 - degrees(acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(dec)+cos(radians(lat))*cos(dec)*cos(radians(hour)))))) AS el, (sin(radians(-833e-3)) - sin(radians(lat))*sin(dec)) / (cos(radians(lat))*cos(dec)) AS cut FROM h)
SELECT event_id, floor(el*1e1+5e-1)/1e1 AS elevation, CASE WHEN el > 6 THEN 'day' WHEN el > -833e-3 THEN 'civil' WHEN el > -12 THEN 'nautical' ELSE 'night' END AS twilight,
  CASE WHEN cut BETWEEN -1 AND 1 THEN CAST(floor(720e0 - lon*4 - eq - degrees(acos(greatest(-1e0, least(1e0, cut))))*4 + 5e-1) AS BIGINT) END AS sunrise, CASE WHEN cut > 1 THEN 'night' WHEN cut < -1 THEN 'day' END AS polar, floor(el*1e1+5e-1)/1e1 < 6 AS needs_light FROM z""", prelude=False)
def sun(spark, sf):
    k = F.col("event_id")
    s = sky.sun((k % 160).cast("double") - 80, (k % 350).cast("double") - 175, F.col("ts"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", s["elevation"].alias("elevation"), s["twilight"].alias("twilight"), s["sunrise"].alias("sunrise"), s["polar"].alias("polar"), sky.needs_light(s["elevation"]).alias("needs_light"))


WEATHER = "WITH w AS (SELECT event_id AS id, event_id % 3 - 1 AS rain, event_id % 4 - 2 AS snow, event_id % 100 AS code, event_id % 13 - 4 AS celsius, event_id % 53 AS wind FROM events), f AS (SELECT *, CASE WHEN snow > 0 AND rain > 0 THEN 'sleet' WHEN snow > 0 THEN 'snow' WHEN code >= 95 THEN 'hail' WHEN code IN (85, 86) THEN 'snow' WHEN rain > 0 THEN CASE WHEN code BETWEEN 51 AND 57 THEN 'drizzle' ELSE 'rain' END ELSE 'none' END AS falls FROM w)"
_A = sky.ADVICE


@query("q_weather_advice", f"{WEATHER} SELECT id, falls, CASE WHEN falls IN ('snow','sleet') THEN '{_A['snow']}' WHEN falls = 'hail' THEN '{_A['hail']}' WHEN falls IN ('rain','drizzle') THEN CASE WHEN celsius <= 3 THEN '{_A['ice']}' ELSE '{_A['rain']}' END WHEN wind >= 40 THEN '{_A['wind']}' WHEN celsius <= 0 THEN '{_A['frost']}' ELSE '{_A['none']}' END AS advice FROM f", prelude=False)
def weather_advice(spark, sf):
    k = F.col("event_id")
    falls = sky.precipitation(k % 3 - 1, k % 4 - 2, k % 100)
    return spark.read.parquet(f"{sf}/events.parquet").select(k.alias("id"), falls.alias("falls"), sky.weather_advice(falls, k % 13 - 4, k % 53).alias("advice"))


@query("q_air_advice", "SELECT event_id AS id, CASE " + " ".join(f"WHEN event_id % 130 <= {m} THEN '{w}'" if m else f"ELSE '{w}'" for m, w in sky.AIR_ADVICE) + " END AS advice, concat_ws(',', CASE WHEN event_id % 60 > 50 THEN 'NO2 ' || event_id % 60 END, CASE WHEN event_id % 130 > 100 THEN 'O3 ' || event_id % 130 END, CASE WHEN event_id % 5000 > 4000 THEN 'CO ' || event_id % 5000 END) AS gases FROM events", prelude=False)
def air_advice(spark, sf):
    k = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select(k.alias("id"), sky.air_advice(k % 130).alias("advice"), F.array_join(sky.elevated_gases(no2=k % 60, ozone=k % 130, co=k % 5000), ",").alias("gases"))


@query("q_local_clock", "WITH l AS (SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts::TIMESTAMP)) AS t FROM events) SELECT event_id, CAST(hour(t) * 60 + minute(t) AS INT) AS minute, CAST(strftime(t, '%Y%m%d') AS INT) AS date, CAST(dayofweek(t) AS INT) AS weekday FROM l", prelude=False)
def local_clock(spark, sf):
    c = sky.local_clock(F.col("ts"), "America/Los_Angeles")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *[v.alias(k) for k, v in c.items()])


@query("q_numbers", "SELECT event_id, CASE WHEN event_id % 8 = 0 THEN '?' WHEN floor(value*1e1+5e-1)/1e1 = floor(floor(value*1e1+5e-1)/1e1) THEN CAST(CAST(floor(value*1e1+5e-1)/1e1 AS BIGINT) AS VARCHAR) ELSE CAST(floor(value*1e1+5e-1)/1e1 AS VARCHAR) END AS shown, CASE WHEN value < 50 THEN '-' ELSE '+' END || CAST(floor(abs(value - 50) + 5e-1) AS BIGINT) || 's' AS delay FROM events", prelude=False)
def numbers(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", sky.number(F.when(F.col("event_id") % 8 > 0, F.col("value"))).alias("shown"), text.signed_seconds(F.col("value") - 50).alias("delay"))


@query("q_tile_bounds", "WITH t AS (SELECT c_custkey AS id, c_custkey % 16384 AS x, (c_custkey * 7) % 16384 AS y FROM customer) SELECT id, x/16384e0*360 - 180 AS west, (x+1)/16384e0*360 - 180 AS east, floor(degrees(atan(sinh(pi()*(1-2*y/16384e0))))*1e6+5e-1)/1e6 AS north, floor(degrees(atan(sinh(pi()*(1-2*(y+1)/16384e0))))*1e6+5e-1)/1e6 AS south FROM t", prelude=False)
def tile_bounds(spark, sf):
    k = F.col("c_custkey")
    b = geo.tile_bounds(F.lit(14), k % 16384, k * 7 % 16384)
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("id"), b["west"].alias("west"), b["east"].alias("east"), geo.half_up(b["north"], 6).alias("north"), geo.half_up(b["south"], 6).alias("south"))


@query("q_from_grid", "SELECT id, floor(lon*1e6+53e-2)/1e6 AS lon, floor(degrees(atan(sinh((n - gy/4096e0*(n-s)))))*1e6+53e-2)/1e6 AS lat FROM (SELECT *, ln(tan(pi()/4+radians(37.78e0)/2)) AS n, ln(tan(pi()/4+radians(37.77e0)/2)) AS s FROM pois)")
def from_grid(spark, sf):
    lon, lat = geo.from_grid(F.col("gx"), F.col("gy"), ad.WEST, ad.SOUTH, ad.EAST, ad.NORTH)
    # not by halves, which many cells hit exactly
    places = lambda v: F.floor(v * 1e6 + 0.53) / 1e6
    return ad.pois(spark, sf).select("id", places(lon).alias("lon"), places(lat).alias("lat"))


@query("q_turns", "WITH t AS (SELECT id, id % 8 AS a, id // 8 % 8 AS b FROM pois) SELECT id, CASE WHEN a = b THEN 'straight' WHEN (b - a + 8) % 8 < 4 THEN 'right' ELSE 'left' END AS turn FROM t")
def turns(spark, sf):
    word = lambda n: F.element_at(F.array(*[F.lit(c) for c in geo.COMPASS]), (n + 1).cast("int"))
    return ad.pois(spark, sf).select("id", geo.turn(word(F.col("id") % 8), word(F.expr("id div 8") % 8)).alias("turn"))


@query("q_box_area", "WITH b AS (SELECT id, greatest(-180e0, least(180e0, id % 500 - 250e0)) AS w, greatest(-180e0, least(180e0, id % 400 - 200e0)) AS e, greatest(-8505112878e-8, least(8505112878e-8, id % 200 - 100e0)) AS s, greatest(-8505112878e-8, least(8505112878e-8, id % 200 - 90e0)) AS n FROM pois) SELECT id, least(w, e) AS west, greatest(w, e) AS east, floor(abs((greatest(w,e)-least(w,e))*cos(radians((n+s)/2))*111320e0*(n-s)*110574e0)/1e3+5e-1) AS square_km FROM b")
def box_area(spark, sf):
    k = F.col("id")
    b = geo.normal_box((k % 500).cast("double") - 250, (k % 200).cast("double") - 100, (k % 400).cast("double") - 200, (k % 200).cast("double") - 90)
    return ad.pois(spark, sf).select("id", b["west"].alias("west"), b["east"].alias("east"), geo.half_up(geo.box_area(**b) / 1000).cast("double").alias("square_km"))


@query("q_tiles_covering", "WITH b AS (SELECT id, id % 100 AS x, id % 90 AS y, id % 3 AS w, id % 2 AS h FROM stops) SELECT id, CAST(unnest(range(x, x + w + 1)) AS BIGINT) AS x, y, h FROM b")
def tiles_covering(spark, sf):
    k = F.col("id")
    n = 1 << 10
    lon, lat = lambda x: (x + 0.5) / n * 360 - 180, lambda y: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (F.lit(1.0) - (y + 0.5) / n * 2))))
    b = ad.stops(spark, sf).select("id", lon(k % 100).alias("west"), lon(k % 100 + k % 3).alias("east"), lat(k % 90 + 200).alias("north"), lat(k % 90 + 200 + k % 2).alias("south"), (k % 2).alias("h"))
    return tiles.tiles_covering(b, 10).groupBy("id", "x").agg((F.min("y") - 200).alias("y"), (F.max("y") - F.min("y")).alias("h"))


@query("q_route_order", "WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'R' || p_size ELSE CAST(p_size AS VARCHAR) END AS name FROM part) SELECT name, row_number() OVER (ORDER BY TRY_CAST(name AS DOUBLE) IS NULL, TRY_CAST(name AS DOUBLE), lower(name), name) AS place FROM n", prelude=False)
def route_order(spark, sf):
    size = F.col("p_size")
    d = spark.read.parquet(f"{sf}/part.parquet").select(F.when(size % 3 == 0, F.concat(F.lit("R"), size.cast("string"))).otherwise(size.cast("string")).alias("name")).distinct()
    return numbered(d.withColumn("k", text.route_order(F.col("name"))), ["k"], "place").select("name", "place")


@query("q_diff_counts", "SELECT count(*) FILTER (WHERE o IS NULL) AS added, count(*) FILTER (WHERE n IS NULL) AS removed, count(*) FILTER (WHERE o IS NOT NULL AND n IS NOT NULL AND ob <> nb) AS changed FROM (SELECT c_custkey AS o, c_name AS ob FROM customer WHERE c_custkey % 5 > 0) a FULL JOIN (SELECT c_custkey AS n, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name END AS nb FROM customer WHERE c_custkey % 6 > 0) b ON o = n", prelude=False)
def diff_counts(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("id % 6 > 0").withColumn("name", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("name")))
    return document.op_counts(graph.diff(c.where("id % 5 > 0"), new, ["name"]))


@query("q_geojson", """SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(gx AS DOUBLE) || ',' || CAST(gy AS DOUBLE) || ']},"properties":{"name":"' || name || '"}}' AS json FROM pois""")
def geojson(spark, sf):
    return ad.pois(spark, sf).select("id", document.geojson(F.lit("Point"), F.col("gx").cast("double"), F.col("gy").cast("double"), F.create_map(F.lit("name"), F.col("name"))).alias("json"))


@query("q_traffic_delay", "SELECT o_custkey AS id, avg(CAST(o_orderkey % 10 AS DOUBLE) / 10) AS ratio, max(CASE o_orderkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END) AS worst, CASE WHEN sum(o_orderkey % 4 // 3) > 0 THEN CAST(sum(o_orderkey % 4 // 3) AS DOUBLE) ELSE floor(600e0 * (1e0/greatest(2e-1, avg(CAST(o_orderkey % 10 AS DOUBLE) / 10)) - 1) + 5e-1) END AS delay FROM orders GROUP BY 1", prelude=False)
def traffic_delay(spark, sf):
    k = F.col("o_orderkey")
    level = F.element_at(F.array(*[F.lit(x) for x in ("severe", "heavy", "moderate", "light", "free")]), (k % 5 + 1).cast("int"))
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("id"), k.alias("k"), (k % 10 / 10.0).alias("ratio"), sky.severity(level).alias("worst"), F.expr("o_orderkey % 4 div 3").alias("delay"))
    # shares are added in the order of keys: a sum of fractions depends on it, and a delay of half a second rounds by its last bit
    upto = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("total", F.sum("ratio").over(upto))
    g = d.groupBy("id").agg((F.max_by("total", "k") / F.count("ratio")).alias("ratio"), F.max("worst").alias("worst"), F.sum("delay").alias("stated"))
    return g.select("id", "ratio", "worst", sky.delay_seconds(F.col("stated"), F.lit(600.0), F.col("ratio")).alias("delay"))
