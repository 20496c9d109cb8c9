"""The compact text forms of lines, polygons, properties and heat, as column expressions.

A line is an array of (x, y) structs of whole numbers, a polygon an array of parts, each an array of rings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:bigint,y:bigint>"


def _pair(x: Column, y: Column, by: str = ",") -> Column:
    return F.concat_ws(by, x.cast("string"), y.cast("string"))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")).cast(POINT)


def absolute(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: _pair(p["x"], p["y"])), ";")


def steps(line: Column) -> Column:
    """The first point, then each point less the one before; an empty line gives an empty text."""
    step = lambda p, i: F.when(i == 0, _pair(p["x"], p["y"])).otherwise(_pair(p["x"] - F.get(line, i - 1)["x"], p["y"] - F.get(line, i - 1)["y"]))
    return F.when(F.size(line) > 0, F.concat(F.lit("d:"), F.array_join(F.transform(line, step), ","))).otherwise("")


def shorter(line: Column) -> Column:
    """Steps from four points on, where they save characters; else absolute."""
    return F.when(F.size(line) >= 4, steps(line)).otherwise(absolute(line))


def _from_absolute(text: Column) -> Column:
    chunks = F.filter(F.split(text, ";"), lambda c: c != "")
    return F.transform(chunks, lambda c: _point(F.split(c, ",")[0], F.split(c, ",")[1]))


def _from_steps(text: Column) -> Column:
    nums = F.transform(F.filter(F.split(F.substr(text, F.lit(3)), ","), lambda n: n != ""), lambda n: n.cast("bigint"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(nums) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(nums)))
    moved = lambda acc, d: F.when(F.size(acc) == 0, d).otherwise(_point(F.get(acc, F.size(acc) - 1)["x"] + d["x"], F.get(acc, F.size(acc) - 1)["y"] + d["y"]))
    # each step extends a copy of the line so far: meant for lines of up to some thousand points
    return F.aggregate(F.transform(at, lambda i: _point(F.get(nums, i), F.get(nums, i + 1))), F.array().cast(f"array<{POINT}>"), lambda acc, d: F.concat(acc, F.array(moved(acc, d))))


def line_of(text: Column) -> Column:
    """Either form back to a line."""
    return F.when(text.startswith("d:"), _from_steps(text)).otherwise(_from_absolute(text))


def closed(line: Column) -> Column:
    return F.when((F.size(line) == 0) | (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1)), line).otherwise(F.concat(line, F.slice(line, 1, 1)))


def opened(line: Column) -> Column:
    same = (F.size(line) >= 2) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))
    return F.when(same, F.slice(line, F.lit(1), F.size(line) - 1)).otherwise(line)


def _legs(line: Column) -> Column:
    """Each point with the next one."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, F.lit(1), n).alias("a"), F.slice(line, F.lit(2), n).alias("b"))


def length(line: Column) -> Column:
    return F.aggregate(_legs(line), F.lit(0.0), lambda s, e: s + F.hypot((e["a"]["x"] - e["b"]["x"]).cast("double"), (e["a"]["y"] - e["b"]["y"]).cast("double")))


def ring_area(line: Column) -> Column:
    """Half the shoelace sum of the closed ring; the sign tells its winding."""
    return F.aggregate(_legs(closed(line)), F.lit(0).cast("bigint"), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / F.lit(2.0)


def without_repeats(line: Column) -> Column:
    """Points equal to the one before go."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def polygon(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda rings: F.array_join(F.transform(rings, shorter), "|")), "||")


def polygon_of(text: Column) -> Column:
    rings = lambda part: F.transform(F.filter(F.split(part, r"\|"), lambda r: r != ""), line_of)
    return F.filter(F.transform(F.split(text, r"\|\|"), rings), lambda r: F.size(r) > 0)


def wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: _pair(p["x"], p["y"], " ")), ", "), F.lit(")"))


def properties_of(text: Column) -> Column:
    """Array of (key, type, value) of ``key=value;...``: ref for s and digits, bool, num, else token. '' and '0' have none."""

    def typed(chunk: Column) -> Column:
        raw = F.regexp_extract(chunk, r"^[^=]*=(.*)$", 1)
        kind = F.when(raw.rlike(r"^s[0-9]+$"), "ref").when(raw.isin("true", "false"), "bool").when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "num").otherwise("token")
        return F.struct(F.split(chunk, "=")[0].cast("int").alias("key"), kind.alias("type"), F.when(kind == "ref", F.substr(raw, F.lit(2))).otherwise(raw).alias("value"))

    return F.transform(F.filter(F.split(F.when(text == "0", "").otherwise(text), ";"), lambda c: c != ""), typed)


def name_hash(text: Column) -> Column:
    """31-polynomial of the code points in 32 signed bits."""
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def radius_label(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%dm", metres.cast("bigint"))).otherwise(F.format_string("%.1fkm", metres.cast("double") / 1000))
