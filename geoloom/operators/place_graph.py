"""Compiling features to a graph of places: junctions, named places, areas and the edges between them.

Features are rows of (ord, kind, class, layer, lines, at, properties): ``ord`` their order, ``kind`` line, point, polygon or
building, ``lines`` the parts of a line as arrays of (x, y), ``at`` a point's place or the mean of an area's ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, ingest, wire
from geoloom.operators import graph
from geoloom.operators.number import numbered
from geoloom.storage import materialize


def ring_centre(ring: Column) -> Column:
    """The rounded mean of a ring's vertices, the closing one among them; null for fewer than three."""
    mean = lambda c: F.floor(F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.size(ring) + 0.5).cast("long")
    return F.when(F.size(ring) >= 3, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def vertices(features: DataFrame) -> DataFrame:
    """(ord, part, i, x, y, layer, class, properties) of lines, repeated points left out, parts of one point too."""
    parts = features.where("kind = 'line'").select("ord", "class", "layer", "properties", F.posexplode("lines").alias("part", "line"))
    parts = parts.withColumn("line", wire.without_repeats(F.col("line"))).where(F.size("line") >= 2)
    return parts.select("ord", "class", "layer", "properties", "part", F.posexplode("line").alias("i", "p")).select("*", F.col("p.x").alias("x"), F.col("p.y").alias("y")).drop("p")


def _keyed(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("wx", geo.weld_key(F.col("x"), size)).withColumn("wy", geo.weld_key(F.col("y"), size))


def places(features: DataFrame) -> DataFrame:
    """Points that are places and areas, in the order in which they come: (step, ord, x, y, and what they tell)."""
    wanted = (F.col("kind") == "point") & ~ingest.is_furniture(F.col("class")) | F.col("kind").isin("polygon", "building")
    d = features.where(wanted & F.col("at").isNotNull())
    area = F.when((F.col("kind") == "building") | F.col("class").startswith("building"), "building").otherwise("area")
    return d.select(
        F.when(F.col("kind") == "point", 1).otherwise(2).alias("step"),
        "ord",
        "layer",
        F.col("at.x").alias("x"),
        F.col("at.y").alias("y"),
        F.when(F.col("kind") == "point", ingest.node_kind(F.col("class"))).otherwise(area).alias("kind"),
        ingest.name_of(F.col("properties")).alias("name"),
        ingest.tags_of(F.col("class"), F.col("properties")).alias("tags"),
        ingest.height_of(F.col("properties")).alias("height"),
    )


def compile_graph(features: DataFrame, weld: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``features``.

    Nodes: num in the order in which features first name them (lines, then points, then areas), x, y, kind, layer, name,
    tags, height and the features' ords. Vertices in one weld cell are one junction; points and areas in a junction's cell
    join it: the first name stays, and its point's kind unless that is a junction itself; an area makes an unnamed
    junction's kind building. Junctions without an edge go unless they are named. Edges: both directions of consecutive
    junctions of a line, with dx, dy, dist, dir, path, blocked and crosswalk, and of each named place without an edge to the
    nearest node of two or more edges. Weld cells, lines and places are each shuffled by their key once.
    """
    v = materialize(_keyed(vertices(features), weld), "vertices")
    first = F.min(F.struct("ord", "part", "i", "x", "y", "layer")).alias("f")
    junctions = v.groupBy("wx", "wy").agg(first, F.array_sort(F.collect_set("ord")).alias("lines"))
    j = junctions.select("wx", "wy", F.lit(0).alias("step"), F.col("f.ord").alias("ord"), F.col("f.part").alias("part"), F.col("f.i").alias("i"), F.col("f.x").alias("x"), F.col("f.y").alias("y"), F.col("f.layer").alias("layer"), "lines")
    p = _keyed(places(features), weld).join(junctions.select("wx", "wy", F.lit(True).alias("met")), ["wx", "wy"], "left")
    p = materialize(p, "places")

    told = F.struct("step", "ord", "name", "kind", "tags", "height")
    met = p.where("met").groupBy("wx", "wy").agg(F.array_sort(F.collect_list(told)).alias("told"))
    named = F.get(F.filter("told", lambda t: t["name"].isNotNull()), F.lit(0))
    own_kind = F.when((named["step"] == 1) & (named["kind"] != "intersection"), named["kind"])
    built = F.exists(F.col("told"), lambda t: (t["step"] == 2) & (t["kind"] == "building"))
    high = F.filter("told", lambda t: t["height"].isNotNull() & ((t["step"] == 2) | (t["kind"] == "building")))
    on = j.join(met, ["wx", "wy"], "left").select(
        "step", "ord", "part", "i", "wx", "wy", "x", "y", "layer",
        F.coalesce(own_kind, F.when(built, "building"), F.lit("intersection")).alias("kind"),
        named["name"].alias("name"),
        F.array_distinct(F.flatten(F.transform(F.coalesce("told", F.array().cast("array<struct<step:int,ord:bigint,name:string,kind:string,tags:array<string>,height:double>>")), lambda t: t["tags"]))).alias("tags"),
        F.get(F.reverse(high), F.lit(0))["height"].alias("height"),
        F.array_distinct(F.concat("lines", F.coalesce(F.transform("told", lambda t: t["ord"]), F.array().cast("array<bigint>")))).alias("features"),
    )
    none = F.lit(None).cast("long")
    off = p.where("met IS NULL").select("step", "ord", F.lit(0).alias("part"), F.lit(0).alias("i"), none.alias("wx"), none.alias("wy"), "x", "y", "layer", "kind", "name", "tags", "height", F.array("ord").alias("features"))
    nodes = numbered(on.unionByName(off), ["step", "ord", "part", "i"])

    at = nodes.where("step = 0").select("wx", "wy", "num", F.col("x").alias("nx"), F.col("y").alias("ny"))
    w = Window.partitionBy("ord", "part").orderBy("i")
    walk = v.join(at, ["wx", "wy"])
    walk = walk.select("ord", "part", "i", "num", "nx", "ny", "class", "layer", "properties", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("num", "nx", "ny")])
    ways = walk.where("p_num IS NOT NULL AND p_num <> num").select(
        F.col("p_num").alias("from_id"), F.col("num").alias("to_id"), (F.col("nx") - F.col("p_nx")).alias("dx"), (F.col("ny") - F.col("p_ny")).alias("dy"), "ord",
        ingest.path_of(F.col("class"), F.col("layer")).alias("path"), ingest.blocked(F.col("properties")).alias("blocked"), ingest.has_token(F.col("properties"), "crossing", "crosswalk").alias("crosswalk"),
    )
    ways = materialize(ways, "ways")
    ends = ways.select(F.col("from_id").alias("num"), F.lit(2).alias("d")).union(ways.select("to_id", F.lit(2))).groupBy("num").agg(F.sum("d").alias("degree"))
    nodes = materialize(nodes.join(ends, "num", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "nodes")
    nodes = nodes.where("step > 0 OR degree > 0 OR name IS NOT NULL")
    lost = nodes.where("name IS NOT NULL AND degree = 0").select(F.col("num").alias("id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("features")[0].alias("ord"))
    backbone = nodes.where("degree >= 2").select(F.col("num").alias("id"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    near = graph.nearest(lost, backbone).join(lost, "id").join(backbone.select(F.col("id").alias("other"), F.col("gx").alias("ox"), F.col("gy").alias("oy")), "other")
    access = near.select(F.col("other").alias("from_id"), F.col("id").alias("to_id"), (F.col("gx") - F.col("ox")).alias("dx"), (F.col("gy") - F.col("oy")).alias("dy"), "ord", F.lit("access").alias("path"), F.lit(False).alias("blocked"), F.lit(False).alias("crosswalk"))
    return nodes.select("num", "x", "y", "kind", "layer", "name", "tags", "height", "features", "degree"), both_ways(ways.unionByName(access))


def both_ways(ways: DataFrame) -> DataFrame:
    """Each way and its way back, with length and compass word."""
    back = ways.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id"), "dx": -F.col("dx"), "dy": -F.col("dy")})
    word = geo.grid_compass(F.col("dx"), F.col("dy"))
    forth = ways.withColumn("dir", word).unionByName(back.withColumn("dir", geo.opposite(geo.grid_compass(-F.col("dx"), -F.col("dy")))))
    return forth.withColumn("dist", F.hypot(F.col("dx").cast("double"), F.col("dy").cast("double")))


def obstacles(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, type) of blocked edges."""
    return edges.where("blocked").select("from_id", "to_id", F.coalesce("path", F.lit("obstruction")).alias("type"))


def live_obstacles(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Obstacles whose edge is still there."""
    return found.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_semi")


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    ids = nodes.select("num")
    return edges.join(ids.withColumnRenamed("num", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("num", "to_id"), "to_id", "left_semi")
