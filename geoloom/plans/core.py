"""Queries over the adapters, each next to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.operators import graph, heat, transit
from geoloom.operators.number import numbered
from geoloom.plans import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}
LAT, LON = 37.775, -122.415
HAV = "2e0*6371008.8e0*asin(least(1e0,sqrt(pow(sin(radians({b}-{a})/2e0),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-({c}))/2e0),2))))"
WORDS = "['north','northeast','east','southeast','south','southwest','west','northwest']"
EVENT_EDGES = "edges AS (SELECT DISTINCT s1 AS from_id, s2 AS to_id FROM (SELECT lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS s1, stop_id AS s2 FROM stop_times) WHERE s1 IS NOT NULL AND s1 <> s2)"


def query(name: str, sql: str | None = None, *, prelude: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if prelude:
                body = ad.PRELUDE + ("," + body[5:] if body.startswith("WITH ") else body)
            SQL[name] = body
        return f

    return add


def hav(a, b, c, d):
    return HAV.format(a=a, b=b, c=c, d=d)


@query("q_haversine", f"SELECT id, CAST(floor({hav('37.775e0', 'lat', '-122.415e0', 'lon')} + 5e-1) AS BIGINT) AS dist FROM stops")
def haversine(spark, sf):
    return ad.stops(spark, sf).select("id", geo.half_up(geo.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))).cast("long").alias("dist"))


@query("q_mercator_roundtrip", "SELECT id, floor(6378137e0*radians(lon)*1e2+5e-1)/1e2 AS mx, floor(6378137e0*ln(tan(pi()/4e0+radians(lat)/2e0))*1e2+5e-1)/1e2 AS my, floor(lon*1e6+5e-1)/1e6 AS lon, floor(lat*1e6+5e-1)/1e6 AS lat FROM stops")
def mercator(spark, sf):
    d = ad.stops(spark, sf).withColumn("x", geo.merc_x(F.col("lon"))).withColumn("y", geo.merc_y(F.col("lat")))
    return d.select("id", geo.half_up(F.col("x"), 2).alias("mx"), geo.half_up(F.col("y"), 2).alias("my"), geo.half_up(geo.merc_lon(F.col("x")), 6).alias("lon"), geo.half_up(geo.merc_lat(F.col("y")), 6).alias("lat"))


def _merc(lat):
    return f"ln(tan(pi()/4e0+radians({lat})/2e0))"


@query("q_grid_quantise", f"SELECT id, CAST(floor((lon+122.42e0)/1e-2*4096e0+5e-1) AS BIGINT) AS col, CAST(floor(({_merc('37.78e0')}-{_merc('lat')})/({_merc('37.78e0')}-{_merc('37.77e0')})*4096e0+5e-1) AS BIGINT) AS row FROM pois")
def grid(spark, sf):
    col, row = geo.to_grid(F.col("lon"), F.col("lat"), ad.WEST, ad.SOUTH, ad.EAST, ad.NORTH)
    return ad.pois(spark, sf).select("id", col.cast("long").alias("col"), row.cast("long").alias("row"))


TILE = "CAST(floor((lon+180e0)/360e0*65536e0) AS BIGINT) AS x, CAST(floor((1e0-ln(tan(radians(lat))+1e0/cos(radians(lat)))/pi())/2e0*65536e0) AS BIGINT) AS y"


@query("q_slippy_tile", f"SELECT id, {TILE} FROM stops")
def slippy(spark, sf):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 16)
    return ad.stops(spark, sf).select("id", x.alias("x"), y.alias("y"))


@query("q_hilbert_id", """WITH RECURSIVE h(id, gx, gy, x, y, s, d) AS (
 SELECT CAST(s_suppkey AS BIGINT), (s_suppkey*7919)%4096, (s_suppkey*6151)%4096, CAST((s_suppkey*7919)%4096 AS BIGINT), CAST((s_suppkey*6151)%4096 AS BIGINT), CAST(2048 AS BIGINT), CAST(5592405 AS BIGINT) FROM supplier
 UNION ALL SELECT id, gx, gy,
  CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN s-1-y ELSE y END, CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN s-1-x ELSE x END, s >> 1,
  d + s*s*xor(3*CASE WHEN (x & s) > 0 THEN 1 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
SELECT id, CAST(d AS BIGINT) AS tile_id FROM h WHERE s = 0""", prelude=False)
def hilbert(spark, sf):
    return ad.stops(spark, sf).select("id", geo.hilbert_id(12, F.col("gx"), F.col("gy")).alias("tile_id"))


@query("q_compass", f"SELECT a.id, b.id AS other, {WORDS}[CAST(floor((atan2(CAST(b.gx-a.gx AS DOUBLE),CAST(a.gy-b.gy AS DOUBLE))*180e0/pi()+360e0)/45e0+5e-1) AS BIGINT)%8+1] AS dir FROM stops a JOIN stops b ON b.id = a.id + 1")
def compass(spark, sf):
    a = ad.stops(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("gx").alias("ox"), F.col("gy").alias("oy"))
    return a.join(b, "id").select("id", "other", geo.grid_compass(F.col("ox") - F.col("gx"), F.col("oy") - F.col("gy")).alias("dir"))


@query("q_bbox_around", "SELECT id, floor((lon-300e0/(cos(radians(lat))*111320e0))*1e6+5e-1)/1e6 AS west, floor((lat-300e0/110574e0)*1e6+5e-1)/1e6 AS south, floor((lon+300e0/(cos(radians(lat))*111320e0))*1e6+5e-1)/1e6 AS east, floor((lat+300e0/110574e0)*1e6+5e-1)/1e6 AS north FROM stops")
def bbox(spark, sf):
    return ad.stops(spark, sf).select("id", *[geo.half_up(c, 6).alias(k) for k, c in geo.bbox_around(F.col("lat"), F.col("lon"), F.lit(300.0)).items()])


@query("q_zoom_for_radius", "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN r<=100 THEN 18 WHEN r<=250 THEN 17 WHEN r<=500 THEN 16 WHEN r<=1000 THEN 15 WHEN r<=2500 THEN 14 WHEN r<=5000 THEN 13 WHEN r<=25000 THEN 12 WHEN r<=100000 THEN 10 WHEN r<=500000 THEN 8 ELSE 6 END AS INT) AS zoom FROM (SELECT p_partkey, p_size*p_size*p_size*10 AS r FROM part)", prelude=False)
def zooms(spark, sf):
    p = F.col("p_size")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), geo.zoom_for_radius(p * p * p * 10).alias("zoom"))


@query("q_straight_line_route", f"SELECT id, CAST(d AS BIGINT) AS dist, CAST(floor(d/1.35e0+5e-1) AS BIGINT) AS seconds FROM (SELECT id, floor({hav('37.775e0', 'lat', '-122.415e0', 'lon')}+5e-1) AS d FROM pois)")
def straight(spark, sf):
    r = geo.straight_route(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    return ad.pois(spark, sf).select("id", r["dist"].cast("long").alias("dist"), r["seconds"].cast("long").alias("seconds"))


@query("q_radius_join", "SELECT p.id, s.id AS other, CAST((p.gx-s.gx)*(p.gx-s.gx)+(p.gy-s.gy)*(p.gy-s.gy) AS BIGINT) AS d2 FROM pois p JOIN stops s ON (p.gx-s.gx)*(p.gx-s.gx)+(p.gy-s.gy)*(p.gy-s.gy) <= 40000")
def radius_join(spark, sf):
    d2 = (F.col("gx") - F.col("ox")) * (F.col("gx") - F.col("ox")) + (F.col("gy") - F.col("oy")) * (F.col("gy") - F.col("oy"))
    return transit.within_pairs(ad.pois(spark, sf).select("id", "gx", "gy"), ad.stops(spark, sf), 200.0).select("id", "other", d2.alias("d2"))


@query("q_nearest", "SELECT id, other, d2 FROM (SELECT p.id, s.id AS other, CAST((p.gx-s.gx)*(p.gx-s.gx)+(p.gy-s.gy)*(p.gy-s.gy) AS BIGINT) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.gx-s.gx)*(p.gx-s.gx)+(p.gy-s.gy)*(p.gy-s.gy), s.id) AS r FROM pois p CROSS JOIN stops s) WHERE r = 1")
def nearest(spark, sf):
    return graph.nearest(ad.pois(spark, sf), ad.stops(spark, sf)).select("id", "other", "d2")


@query("q_weld_junctions", "SELECT CAST(floor(gx/64e0+5e-1) AS BIGINT) AS wx, CAST(floor(gy/64e0+5e-1) AS BIGINT) AS wy, min(id) AS first_ord, count(*) AS vertices FROM pois GROUP BY 1, 2")
def welded(spark, sf):
    return graph.weld(ad.pois(spark, sf).withColumn("ord", F.col("id")), 64)


@query("q_snap_points", "WITH j AS (SELECT CAST(floor(gx/64e0+5e-1) AS BIGINT) AS wx, CAST(floor(gy/64e0+5e-1) AS BIGINT) AS wy, min(id) AS first_ord FROM stops GROUP BY 1, 2) SELECT p.id, j.first_ord FROM pois p LEFT JOIN j ON floor(p.gx/64e0+5e-1)=j.wx AND floor(p.gy/64e0+5e-1)=j.wy")
def snapped(spark, sf):
    j = graph.weld(ad.stops(spark, sf).withColumn("ord", F.col("id")), 64).drop("vertices")
    return graph.snap(ad.pois(spark, sf), j, 64).select("id", "first_ord")


@query("q_service_set", "SELECT * FROM (VALUES ('1-URGENT'),('4-NOT SPECIFIED')) t(service_id)", prelude=False)
def services(spark, sf):
    return transit.services_on(ad.calendar(spark), ad.exceptions(spark), 20261019, "monday")


@query("q_semi_services", "SELECT trip_id, route_id FROM trips WHERE service_id IN ('1-URGENT','4-NOT SPECIFIED')")
def semi(spark, sf):
    return ad.trips(spark, sf).join(transit.services_on(ad.calendar(spark), ad.exceptions(spark), 20261019, "monday"), "service_id", "left_semi").select("trip_id", "route_id")


@query("q_anti_orphans", "SELECT id, name FROM pois WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphans(spark, sf):
    return ad.pois(spark, sf).join(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id", "left_anti").select("id", "name")


@query("q_consecutive_edges", "SELECT s1 AS from_stop, s2 AS to_stop, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, count(*) AS trips FROM (SELECT trip_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS s1, stop_id AS s2 FROM stop_times) e JOIN trips USING (trip_id) JOIN routes USING (route_id) WHERE s1 IS NOT NULL AND s1 <> s2 GROUP BY 1, 2")
def consecutive(spark, sf):
    return transit.edges(ad.stop_times(spark, sf), ad.trips(spark, sf), ad.routes(spark, sf))


@query("q_first_last_departure", "SELECT stop_id, CAST(min(dep) AS BIGINT) AS first_dep, CAST(max(dep) AS BIGINT) AS last_dep, count(*) AS departures FROM stop_times WHERE dep IS NOT NULL GROUP BY 1")
def first_last(spark, sf):
    return transit.first_last(ad.stop_times(spark, sf))


CLOCK = "lpad(CAST({d}//60 AS VARCHAR),2,'0')||':'||lpad(CAST({d}%60 AS VARCHAR),2,'0')"


@query("q_departure_board", f"WITH r AS (SELECT DISTINCT stop_id, dep, label FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) WHERE dep >= 600), k AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY dep, label) AS rank, count(*) OVER (PARTITION BY stop_id) AS n FROM r) SELECT stop_id, CAST(rank AS INT) AS rank, label||' '||{CLOCK.format(d='dep')} AS text, greatest(0, n-3) AS more FROM k WHERE rank <= 3")
def board(spark, sf):
    return transit.board(ad.stop_times(spark, sf), ad.trips(spark, sf), ad.routes(spark, sf), 600)


SLICE = f"WITH near AS (SELECT id, name, CAST(floor({hav('37.775e0', 'lat', '-122.415e0', 'lon')}+5e-1) AS BIGINT) AS dist FROM stops), p AS (SELECT stop_id AS id, string_agg(DISTINCT label, ', ' ORDER BY label) AS lines, min(dep) AS f, max(dep) AS l FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) GROUP BY 1) SELECT near.id, name, dist, lines, {CLOCK.format(d='f')} AS first_clock, {CLOCK.format(d='l')} AS last_clock FROM near LEFT JOIN p ON near.id = p.id WHERE dist <= 400"


@query("q_transit_slice", SLICE)
def transit_slice(spark, sf):
    return transit.slice_nodes(ad.stops(spark, sf), ad.stop_times(spark, sf), ad.trips(spark, sf), ad.routes(spark, sf), LAT, LON, 400.0)


LATEST = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS r FROM updates) WHERE r = 1 AND NOT is_deleted)"


@query("q_rt_latest", f"WITH {LATEST} SELECT entity_id, event_id, relationship, delay FROM u")
def rt_latest(spark, sf):
    return transit.latest_updates(ad.updates(spark, sf)).select("entity_id", "event_id", "relationship", "delay")


@query("q_rt_overlay", f"WITH {LATEST} SELECT trip_id, seq, stop_id, dep, CASE WHEN relationship = 1 THEN 'cancelled' WHEN relationship <> 2 THEN CASE WHEN delay >= 0 THEN '+' ELSE '' END || delay || 's' END AS suffix FROM stop_times JOIN u USING (trip_id)")
def rt_overlay(spark, sf):
    return transit.overlay(ad.stop_times(spark, sf), transit.latest_updates(ad.updates(spark, sf))).select("trip_id", "seq", "stop_id", "dep", "suffix")


def stop_edges(spark, sf) -> DataFrame:
    prev = F.lag("stop_id").over(Window.partitionBy("trip_id").orderBy("seq"))
    return ad.stop_times(spark, sf).select(prev.alias("from_id"), F.col("stop_id").alias("to_id")).where("from_id IS NOT NULL AND from_id <> to_id").distinct()


@query("q_degree", f"WITH {EVENT_EDGES} SELECT id, count(*) AS degree, count(DISTINCT n) AS neighbours FROM (SELECT from_id AS id, to_id AS n FROM edges UNION ALL SELECT to_id, from_id FROM edges) GROUP BY 1")
def degree(spark, sf):
    return graph.degrees(stop_edges(spark, sf))


COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey - 1 AS b FROM lineitem UNION SELECT DISTINCT -l_partkey - 1, l_orderkey FROM lineitem),
cc(id, component) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION SELECT e.a, min(n.component) FROM cc n JOIN e ON e.b = n.id JOIN recurring.cc o ON o.id = e.a WHERE n.component < o.component GROUP BY e.a)
SELECT id, component FROM cc"""


@query("q_components", COMPONENTS, prelude=False)
def components(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return graph.components(li.select(F.col("l_orderkey").alias("from_id"), (-F.col("l_partkey") - 1).alias("to_id")).distinct())


@query("q_bidirectional", f"WITH {EVENT_EDGES}, m AS (SELECT e.from_id, e.to_id, b.gx-a.gx AS dx, b.gy-a.gy AS dy FROM edges e JOIN stops a ON a.id=from_id JOIN stops b ON b.id=to_id), t AS (SELECT * FROM m UNION ALL SELECT to_id, from_id, -dx, -dy FROM m) SELECT from_id, to_id, dx, dy, {WORDS}[CAST(floor((atan2(CAST(dx AS DOUBLE),CAST(-dy AS DOUBLE))*180e0/pi()+360e0)/45e0+5e-1) AS BIGINT)%8+1] AS dir FROM t")
def both_ways(spark, sf):
    s = ad.stops(spark, sf).select("id", "gx", "gy")
    e = stop_edges(spark, sf).join(s.toDF("from_id", "ax", "ay"), "from_id").join(s.toDF("to_id", "bx", "by"), "to_id")
    return graph.mirrored(e.select("from_id", "to_id", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")))


@query("q_density_heat", "SELECT CAST(floor(gx*16e0/4096e0) AS BIGINT) AS x, CAST(floor(gy*16e0/4096e0) AS BIGINT) AS y, count(*) AS value FROM pois GROUP BY 1, 2 ORDER BY value DESC, y, x LIMIT 24")
def density(spark, sf):
    return heat.density(ad.pois(spark, sf), 16, 4096)


@query("q_slope_grid", "WITH g AS (SELECT x, y, sqrt(pow(coalesce(lead(v) OVER (PARTITION BY y ORDER BY x), v)-v,2)+pow(coalesce(lead(v) OVER (PARTITION BY x ORDER BY y), v)-v,2)) AS grade FROM raster) SELECT CAST(floor(x*16e0/40e0) AS BIGINT) AS cx, CAST(floor(y*16e0/50e0) AS BIGINT) AS cy, floor(arg_max(grade, y*40+x)*1e4+5e-1)/1e4 AS grade FROM g GROUP BY 1, 2")
def slope(spark, sf):
    return heat.slope(ad.raster(spark, sf), 40, 50).withColumn("grade", geo.half_up(F.col("grade"), 4))


@query("q_heat_summary", "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS layer, c_custkey AS ord, c_acctbal AS value FROM customer WHERE c_acctbal > 0), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value DESC, ord) AS rank, min(value) OVER (PARTITION BY layer) AS lo, max(value) OVER (PARTITION BY layer) AS hi FROM c) SELECT layer, ord, value, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5 AND lo <> hi", prelude=False)
def hot(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return heat.hotspots(c.select(F.col("c_nationkey").cast("long").alias("layer"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("value")), "layer")


@query("q_raster_subsample", "SELECT x, y, v FROM raster WHERE x % 5 = 0 AND y % 5 = 0")
def subsample(spark, sf):
    return heat.subsample(ad.raster(spark, sf), 5)


@query("q_omission_ledger", "SELECT tag AS layer, count(*) AS omitted, min(id) AS first_ord FROM pois WHERE gx > 2048 GROUP BY 1")
def ledger(spark, sf):
    return graph.omission_ledger(ad.pois(spark, sf).where("gx > 2048").select(F.col("tag").alias("layer"), F.col("id").alias("ord")))


@query("q_node_ceiling", "SELECT grp, ord, before FROM (SELECT c_nationkey AS grp, c_custkey AS ord, CAST(coalesce(sum(c_custkey%7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS before FROM customer) WHERE before < 60", prelude=False)
def node_ceiling(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 7).alias("new_nodes"))
    return graph.ceiling(c, 60).select("grp", "ord", "before")


@query("q_doc_diff", "WITH o AS (SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part WHERE p_partkey % 11 <> 3), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part WHERE p_partkey % 13 <> 4), j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oi, n.id AS ni, concat_ws(',', CASE WHEN o.size IS DISTINCT FROM n.size THEN 'size' END, CASE WHEN o.brand IS DISTINCT FROM n.brand THEN 'brand' END) AS a FROM o FULL JOIN n ON o.id = n.id) SELECT id, CASE WHEN oi IS NULL THEN '+' WHEN ni IS NULL THEN '-' ELSE '~' END AS op, CASE WHEN oi IS NULL OR ni IS NULL THEN '' ELSE a END AS aspects FROM j WHERE oi IS NULL OR ni IS NULL OR a <> ''", prelude=False)
def doc_diff(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    new = p.where("id % 13 <> 4").select("id", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 5 != 0, F.col("brand")).alias("brand"))
    return graph.diff(p.where("id % 11 <> 3"), new, ["size", "brand"])


@query("q_score_node", "WITH d AS (SELECT c_custkey AS id, c_mktsegment AS t, c_custkey % 9 AS degree FROM customer) SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END + CASE t WHEN 'BUILDING' THEN 20 WHEN 'MACHINERY' THEN 40 WHEN 'FURNITURE' THEN 30 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS DOUBLE) + degree / 8e0 * 25e0 AS score FROM d", prelude=False)
def scored(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "id")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "building").when(F.col("c_mktsegment") == "MACHINERY", "transit").when(F.col("c_mktsegment") == "FURNITURE", "poi").otherwise("other")
    s = graph.score(F.col("id") % 3 == 0, kind, F.col("id") % 2 == 0, F.col("id") % 5 == 0, (F.col("id") % 9).cast("double"), F.lit(8.0))
    return c.select("id", s.cast("double").alias("score"))


@query("q_token_estimate", "SELECT doc_id, CAST(ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4e0) AS BIGINT) AS tokens FROM documents", prelude=False)
def token_estimate(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


YAML_SQL = (
    "length(translate({s}, '" + text.INDICATORS.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', '')) < length({s}) OR regexp_matches({s}, '^[ \\t\\n\\r\\f\\v]|[ \\t\\n\\r\\f\\v]$') OR lower({s}) IN ("
    + ", ".join(f"'{w}'" for w in text.RESERVED)
    + ") OR regexp_matches(regexp_replace({s}, '^-', ''), '^[0-9]+([.][0-9]+)?$')"
)


@query("q_yaml_quote", f"""SELECT page_id, CASE WHEN {YAML_SQL.format(s="url")} THEN '"' || replace(url, '"', chr(92) || '"') || '"' ELSE url END AS scalar FROM pages""", prelude=False)
def yaml_quote(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.yaml_scalar(F.col("url")).alias("scalar"))


@query("q_gtfs_time", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 30 * 60 + p_partkey % 60 END AS minutes FROM part", prelude=False)
def gtfs_time(spark, sf):
    k = F.col("p_partkey")
    s = F.when(k % 7 == 0, F.concat((k % 30).cast("string"), F.lit(":5"))).otherwise(F.concat((k % 30).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00")))
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), text.clock_minutes(s).cast("long").alias("minutes"))


def _case(x: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {m} THEN '{n}'" for m, n in bands if m is not None) + f" ELSE '{bands[-1][1]}' END"


@query("q_aqi_bands", f"SELECT event_id, {_case('value', text.EU_AQI)} AS eu, {_case('value', text.US_AQI)} AS us FROM events", prelude=False)
def aqi(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.eu_air(F.col("value")).alias("eu"), text.us_air(F.col("value")).alias("us"))


@query("q_flow_levels", "SELECT event_id, CASE WHEN r >= 0.9e0 THEN 'free' WHEN r >= 0.75e0 THEN 'light' WHEN r >= 0.6e0 THEN 'moderate' WHEN r >= 0.4e0 THEN 'heavy' ELSE 'severe' END AS level FROM (SELECT event_id, least(1e0, value / 250e0) AS r FROM events)", prelude=False)
def flow(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.flow_level(F.least(F.lit(1.0), F.col("value") / 250.0)).alias("level"))


@query("q_wmo_codes", "SELECT event_id, CASE WHEN c IN (0, 1) AND event_id % 2 = 1 THEN n || ' night' ELSE n END AS sky FROM (SELECT event_id, event_id % 100 AS c, CASE event_id % 100 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in text.WMO.items()) + " ELSE 'unknown' END AS n FROM events)", prelude=False)
def wmo(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.sky((F.col("event_id") % 100).cast("int"), F.col("event_id") % 2 == 0).alias("sky"))


@query("q_rate_limit", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS hits FROM events GROUP BY 1, 2", prelude=False)
def rate(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("hits"))


@query("q_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", prelude=False)
def props(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("q_attr_dedup", "WITH s AS (SELECT p_brand || '|' || p_size AS signature, min(p_partkey) AS first_ord FROM part GROUP BY 1) SELECT signature, first_ord, CAST(row_number() OVER (ORDER BY first_ord) AS INT) AS set_id FROM s", prelude=False)
def attr_dedup(spark, sf):
    s = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("signature")).agg(F.min("p_partkey").alias("first_ord"))
    return numbered(s, ["first_ord"], "set_id").withColumn("set_id", F.col("set_id").cast("int"))


@query("q_delta_encode", "WITH v AS (SELECT t.trip_id, t.seq, s.gx, s.gy, lag(s.gx) OVER w AS px, lag(s.gy) OVER w AS py FROM stop_times t JOIN stops s ON s.id = t.stop_id WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, 'd:' || string_agg(CAST(gx - coalesce(px, 0) AS VARCHAR) || ',' || CAST(gy - coalesce(py, 0) AS VARCHAR), ',' ORDER BY seq) AS path FROM v GROUP BY 1")
def delta_encode(spark, sf):
    v = ad.stop_times(spark, sf).join(ad.stops(spark, sf).select(F.col("id").alias("stop_id"), "gx", "gy"), "stop_id")
    w = Window.partitionBy("trip_id").orderBy("seq")
    step = F.concat_ws(",", (F.col("gx") - F.coalesce(F.lag("gx").over(w), F.lit(0))).cast("string"), (F.col("gy") - F.coalesce(F.lag("gy").over(w), F.lit(0))).cast("string"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda x: x["step"])
    return v.withColumn("step", step).groupBy("trip_id").agg(F.concat(F.lit("d:"), F.array_join(path, ",")).alias("path"))
