"""Further queries over the adapters: ranks, gaps, ranges, ledgers and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import text
from geoloom.operators import transit
from geoloom.operators.number import numbered
from geoloom.plans import adapters as ad
from geoloom.plans.core import query


@query("q_routes_per_stop", "SELECT stop_id, count(DISTINCT label) AS n_lines, string_agg(DISTINCT split_part(label, ' ', 1), ',' ORDER BY split_part(label, ' ', 1)) AS words FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) GROUP BY 1")
def routes_per_stop(spark, sf):
    pairs = ad.stop_times(spark, sf).join(ad.trips(spark, sf), "trip_id").select("stop_id", "route_id").distinct().join(ad.routes(spark, sf), "route_id")
    return pairs.groupBy("stop_id").agg(F.countDistinct("label").alias("n_lines"), F.array_join(F.sort_array(F.collect_set(F.split_part("label", F.lit(" "), F.lit(1)))), ",").alias("words"))


@query("q_level_gaps", "WITH l AS (SELECT DISTINCT p_brand AS building, p_size + p_size // 3 AS level FROM part), g AS (SELECT building, level, lag(level) OVER (PARTITION BY building ORDER BY level) AS prev FROM l) SELECT building, CAST(unnest(range(prev + 1, level)) AS INT) AS missing FROM g WHERE level > prev + 1", prelude=False)
def level_gaps(spark, sf):
    levels = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("building"), F.expr("CAST(p_size + p_size div 3 AS INT)").alias("level")).distinct()
    prev = F.lag("level").over(Window.partitionBy("building").orderBy("level"))
    return levels.withColumn("prev", prev).where("level > prev + 1").select("building", F.explode(F.sequence(F.col("prev") + 1, F.col("level") - 1)).alias("missing"))


@query("q_shaft_groups", "SELECT CAST(floor(gx/32e0+5e-1) AS BIGINT) AS cx, CAST(floor(gy/32e0+5e-1) AS BIGINT) AS cy, string_agg(DISTINCT tag, ',' ORDER BY tag) AS levels, bool_or(id % 5 = 0) AS wheelchair FROM pois GROUP BY 1, 2")
def shafts(spark, sf):
    cell = lambda c: F.floor(F.col(c) / 32.0 + 0.5)
    return ad.pois(spark, sf).groupBy(cell("gx").alias("cx"), cell("gy").alias("cy")).agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("levels"), F.bool_or(F.col("id") % 5 == 0).alias("wheelchair"))


@query("q_corridor_pairs", "SELECT a.id, b.id AS other FROM pois a JOIN pois b ON a.tag = b.tag AND a.id < b.id AND (a.gx-b.gx)*(a.gx-b.gx)+(a.gy-b.gy)*(a.gy-b.gy) <= 3600")
def corridors(spark, sf):
    p = ad.pois(spark, sf)
    tags = p.select(F.col("id").alias("other"), F.col("tag").alias("other_tag"))
    near = transit.within_pairs(p.select("id", "gx", "gy", "tag"), p, 60.0, 64).where("id < other")
    return near.join(tags, "other").where("tag = other_tag").select("id", "other")


@query("q_range_lookup", "WITH e AS (SELECT s_suppkey * 40 AS lo, s_suppkey * 40 + s_suppkey % 37 AS hi, s_suppkey AS entry FROM supplier) SELECT p_partkey AS id, entry FROM part JOIN e ON p_partkey BETWEEN lo AND hi", prelude=False)
def range_lookup(spark, sf):
    k = F.col("s_suppkey")
    runs = spark.read.parquet(f"{sf}/supplier.parquet").select((k * 40).alias("lo"), (k * 40 + k % 37).alias("hi"), k.alias("entry"))
    # runs are cut into cells of 64 ids, so that the range becomes an equi-join
    cells = runs.withColumn("cell", F.explode(F.sequence(F.expr("lo div 64"), F.expr("hi div 64"))))
    ids = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 64").alias("cell"))
    return ids.join(cells, "cell").where("id BETWEEN lo AND hi").select("id", "entry")


@query("q_waypoint_thin", "WITH n AS (SELECT trip_id, seq, stop_id, count(*) OVER (PARTITION BY trip_id) AS n FROM stop_times) SELECT trip_id, seq, stop_id FROM n WHERE (seq - 1) % greatest(1, n // 3) = 0 OR seq = n")
def thin(spark, sf):
    d = ad.stop_times(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("trip_id")))
    return d.where("(seq - 1) % greatest(1, n div 3) = 0 OR seq = n").select("trip_id", "seq", "stop_id")


@query("q_line_budget_trim", "WITH l AS (SELECT conv_id, turn, CAST(ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4e0) AS BIGINT) + 1 AS cost FROM conversations), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, cost) AS BIGINT) AS spent FROM l) SELECT conv_id, turn, spent FROM r WHERE spent <= 200", prelude=False)
def trim(spark, sf):
    lines = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", (text.tokens(F.col("text")) + 1).alias("cost"))
    return lines.withColumn("spent", F.sum("cost").over(Window.partitionBy("conv_id").orderBy("turn", "cost"))).where("spent <= 200").select("conv_id", "turn", "spent")


@query("q_traffic_level", "WITH f AS (SELECT user_id, least(1e0, value/250e0) AS r FROM events), l AS (SELECT user_id, r, CASE WHEN r >= 0.9e0 THEN 0 WHEN r >= 0.75e0 THEN 1 WHEN r >= 0.6e0 THEN 2 WHEN r >= 0.4e0 THEN 3 ELSE 4 END AS s FROM f) SELECT user_id, floor(avg(r)*1e3+5e-1)/1e3 AS ratio, ['free','light','moderate','heavy','severe'][max(s)+1] AS worst, count(*) AS segments FROM l GROUP BY 1", prelude=False)
def traffic(spark, sf):
    ratio = F.least(F.lit(1.0), F.col("value") / 250.0)
    rank = F.array(*[F.lit(n) for _, n in text.FLOW])
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", ratio.alias("r"), F.array_position(rank, text.flow_level(ratio)).alias("s"))
    return e.groupBy("user_id").agg((F.floor(F.avg("r") * 1e3 + 0.5) / 1e3).alias("ratio"), F.element_at(rank, F.max("s").cast("int")).alias("worst"), F.count("*").alias("segments"))


@query("q_layer_counts", "SELECT tag AS layer, count(*) AS features, count(*) FILTER (WHERE name IS NOT NULL) AS named FROM pois GROUP BY 1")
def layers(spark, sf):
    return ad.pois(spark, sf).groupBy(F.col("tag").alias("layer")).agg(F.count("*").alias("features"), F.count("name").alias("named"))


@query("q_string_intern", "WITH s AS (SELECT p_type AS text, min(p_partkey) AS first_ord FROM part GROUP BY 1) SELECT text, CAST(99 + row_number() OVER (ORDER BY first_ord) AS INT) AS string_id FROM s", prelude=False)
def interned(spark, sf):
    s = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_type").alias("text")).agg(F.min("p_partkey").alias("first_ord"))
    return numbered(s, ["first_ord"], "string_id", 100).select("text", F.col("string_id").cast("int").alias("string_id"))


@query("q_survival_rank", "SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY tier DESC, score DESC, id) AS INT) AS rank FROM (SELECT c_nationkey AS grp, c_custkey AS id, c_custkey % 3 AS tier, c_acctbal AS score FROM customer)", prelude=False)
def survival(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("tier"), F.col("c_acctbal").alias("score"))
    return c.select("grp", "id", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("tier"), F.desc("score"), "id")).alias("rank"))
