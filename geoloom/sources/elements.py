"""OpenStreetMap elements (nodes, ways, relations) as features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags by which a closed way is an area, and those by which it is none.
AREA_KEYS = ("building", "landuse", "leisure", "amenity", "natural", "place", "indoor")
AT = "struct<lon:double,lat:double>"


def is_closed(line: Column) -> Column:
    """Whether a line of four or more points, or of nodes by their ids, ends where it began."""
    return (F.size(line) >= 4) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))


def is_area(tags: Column) -> Column:
    """Whether a closed way's tags make it an area: said so, or by a key that areas have unless it is a road or barrier."""
    said, has = F.coalesce(tags["area"], F.lit("")), lambda k: F.coalesce(tags[k], F.lit("no")) != "no"
    by_key = F.greatest(*[has(k) for k in AREA_KEYS]) & ~has("highway") & ~has("barrier")
    return F.when(said == "yes", True).when(said == "no", False).otherwise(by_key)


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tags, line, closed) of ways (id, tags, refs, inline): their own coordinates, else those of their nodes in order.

    ``inline``, where present, is a way's array of (lon, lat). References to nodes that are not there are left out. A way of
    references closes if it ends at the node it began at: another node at the same place does not close it.
    """
    wanted = ways.where("inline IS NULL").select("id", F.posexplode("refs").alias("i", "ref"))
    at = nodes.select(F.col("id").alias("ref"), F.struct("lon", "lat").cast(AT).alias("p"))
    found = wanted.join(at, "ref").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "ref", "p"))).alias("x"))
    found = found.select("id", F.transform("x", lambda v: v["p"]).alias("resolved"), is_closed(F.transform("x", lambda v: v["ref"])).alias("ring"))
    line = F.coalesce(F.col("inline").cast(f"array<{AT}>"), "resolved", F.array().cast(f"array<{AT}>"))
    closed = F.when(F.col("inline").isNull(), F.coalesce("ring", F.lit(False))).otherwise(is_closed(F.col("inline")))
    return ways.join(found, "id", "left").select("id", "tags", line.alias("line"), closed.alias("closed"))


def features(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(kind, id, tags, line): tagged nodes as points, ways of two or more points as lines, closed ones of areas as areas."""
    points = nodes.where(F.size("tags") > 0).select(F.lit("point").alias("kind"), "id", "tags", F.array(F.struct("lon", "lat").cast(AT)).alias("line"))
    lines = way_lines(ways, nodes).where(F.size("line") >= 2)
    kind = F.when(F.col("closed") & is_area(F.col("tags")), "area").otherwise("line")
    return points.unionByName(lines.select(kind.alias("kind"), "id", "tags", "line"))


def wanted_layers(names: list[str], aliases: dict[str, str], known: list[str]) -> list[str]:
    """The layers that ``names`` ask for, in the order of ``known``, each once; an unknown one is an error."""
    plain = {aliases.get(n.strip().lower(), n.strip().lower()) for n in names if n.strip()}
    if unknown := plain - set(known):
        raise ValueError(f"unknown layers: {', '.join(sorted(unknown))}")
    return [k for k in known if k in plain]
