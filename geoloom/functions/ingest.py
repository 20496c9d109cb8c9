"""What a feature is and carries: its kind, layer, class, typed properties, tags and path, as column expressions.

Properties come as a map of strings, in which a number or boolean stands as its text. Typed properties are an array of
(key, type, value), sorted by key; a missing map counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ids under which properties are kept, the words that stay bare tokens, and what follows from a class.
KEYS = {"name": 10, "height": 12, "height_m": 12, "building:levels": 12, "amenity": 13, "brand": 14, "opening_hours": 15, "highway": 16, "railway": 17, "crossing": 18, "indoor": 19, "layer": 20, "wheelchair": 21, "level": 22, "door": 23}
BLOCKING = ("construction", "closed", "no", "barrier", "locked")
BARE = (*BLOCKING, "yes", "private", "footway", "pedestrian", "path", "steps", "cycleway", "corridor", "service", "track", "motorway", "trunk", "crossing", "crosswalk", "sidewalk")
PATHS = {"footway": "sidewalk", "pedestrian": "sidewalk", "path": "path", "steps": "stairs", "cycleway": "bikeway", "corridor": "indoor", "service": "service", "track": "track", "motorway": "highway", "trunk": "highway"}
FURNITURE = ("traffic_signals", "crossing", "street_lamp", "give_way", "stop", "elevator", "turning_circle", "milestone", "speed_camera", "traffic_calming", "passing_place", "emergency_bay")
WEAK = ("tourism.artwork", "tourism.viewpoint", "tourism.information", "tourism.board", "tourism.map", "amenity.waste_basket", "amenity.bicycle_parking", "amenity.post_box", "amenity.vending_machine", "amenity.drinking_water", "amenity.bench", "amenity.parking_entrance")
TRANSIT = ("public_transport.station", "highway.bus_stop", "railway.tram_stop", "railway.light_rail")
STOREYS = {"ground": 0, "groundfloor": 0, "ground_floor": 0, "ground-floor": 0, "main": 0, "lobby": 0, "reception": 0, "basement": -1, "underground": -1, "lowerground": -1}
CLASS_KEYS = ("highway", "railway", "amenity", "shop", "leisure", "tourism")

PROPERTY = "struct<key:int,type:string,value:string>"


def _has(props: Column, key: str) -> Column:
    return F.coalesce(props[key], F.lit("")) != ""


def feature_kind(geometry: Column, props: Column) -> Column:
    """line, point, building or area."""
    point, line = geometry.isin("Point", "MultiPoint"), geometry.isin("LineString", "MultiLineString")
    return F.when(line, "line").when(_has(props, "building") | (point & _has(props, "building:part")), "building").when(point, "point").otherwise("area")


def layer_of(geometry: Column, props: Column, key: str | None = None) -> Column:
    """The property ``key`` where the feature has it, else what its kind says."""
    kind = feature_kind(geometry, props)
    own = F.when(kind == "line", "road").when(kind == "point", "poi").otherwise(kind)
    return F.coalesce(props[key], own) if key else own


def class_of(geometry: Column, props: Column, layer: Column) -> Column:
    """A feature's class: its own, a dotted type, the first key that classes it, or what its kind says."""
    kind = feature_kind(geometry, props)
    named = [F.when(_has(props, k), F.concat(F.lit(f"{k}."), props[k])) for k in CLASS_KEYS]
    built = F.when((layer == "building") | _has(props, "building"), F.lit("building.commercial"))
    other = F.when(kind == "point", "poi").when(kind == "line", "highway.residential").otherwise("area.generic")
    return F.coalesce(props["class"], F.when(F.contains(props["type"], F.lit(".")), props["type"]), *named, built, other)


def typed(value: Column) -> Column:
    """(type, value) of a property's text: num where it reads as a number, bool, a bare token, or ref for all other text."""
    number = F.trim(value).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & F.trim(value).rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$")
    return F.when(finite, "num").when(value.isin("true", "false"), "bool").when(value.isin(*BARE), "token").otherwise("ref")


def kept_properties(props: Column) -> Column:
    """The kept keys of a map, typed, by key id and then in the order of KEYS; empty values go."""
    at = F.array(*[F.struct(F.lit(i).alias("key"), props[k].alias("v")) for k, i in sorted(KEYS.items(), key=lambda x: x[1])])
    there = F.filter(at, lambda x: F.coalesce(x["v"], F.lit("")) != "")
    return F.transform(there, lambda x: F.struct(x["key"].alias("key"), typed(x["v"]).alias("type"), x["v"].alias("value"))).cast(f"array<{PROPERTY}>")


def signature(properties: Column) -> Column:
    """The text by which equal sets of properties are found."""
    return F.array_join(F.transform(properties, lambda p: F.concat(p["key"].cast("string"), F.lit("="), F.when(p["type"] == "ref", F.concat(F.lit("s:"), p["value"])).otherwise(p["value"]))), ";")


def first_of(properties: Column, key: str, *kinds: str) -> Column:
    """The value of a key's first property of one of the types ``kinds``; null if it has none."""
    found = F.filter(properties, lambda p: (p["key"] == KEYS[key]) & p["type"].isin(*kinds))
    return F.get(found, F.lit(0))["value"]


def name_of(properties: Column) -> Column:
    return first_of(properties, "name", "ref")


def height_of(properties: Column) -> Column:
    return first_of(properties, "height_m", "num").cast("double")


def has_token(properties: Column, *words: str) -> Column:
    return F.exists(properties, lambda p: (p["type"] == "token") & p["value"].isin(*words))


def blocked(properties: Column) -> Column:
    return has_token(properties, *BLOCKING)


def tags_of(class_name: Column, properties: Column, most: int = 4) -> Column:
    """The class's leaf and all tokens that don't block, each once, at most four."""
    leaf = F.when(F.contains(class_name, F.lit(".")), F.substring_index(class_name, ".", -1))
    words = F.transform(F.filter(properties, lambda p: (p["type"] == "token") & ~p["value"].isin(*BLOCKING)), lambda p: p["value"])
    return F.slice(F.array_distinct(F.concat(F.filter(F.array(leaf), lambda t: t.isNotNull() & (t != "")), words)), 1, most)


def path_of(class_name: Column, layer: Column) -> Column:
    """The way's sort by the first word its class contains, else road on the road layer."""
    hints = [F.when(F.contains(class_name, F.lit(word)), F.lit(path)) for word, path in PATHS.items()]
    return F.coalesce(*hints, F.when(layer == "road", F.lit("road")))


def is_furniture(class_name: Column) -> Column:
    """Street furniture and places too weak to be one."""
    tail = F.coalesce(F.get(F.split(class_name, "[.]"), F.lit(1)), class_name)
    return tail.isin(*FURNITURE) | class_name.isin(*WEAK)


def node_kind(class_name: Column) -> Column:
    has = lambda *ws: F.greatest(*[F.contains(class_name, F.lit(w)) for w in ws])
    e = F.when(class_name.isin(*TRANSIT), "transit").when(class_name.startswith("building"), "building")
    e = e.when(class_name.startswith("highway") | class_name.startswith("railway"), "intersection")
    return e.when(has("park", "garden"), "park").when(has("water", "river"), "water").when(F.contains(class_name, F.lit(".")), "poi").otherwise("area")


def storey(level: Column) -> Column:
    """A storey's number, also by its name; null where it has none."""
    s = F.trim(level)
    names = F.create_map(*[F.lit(x) for k, v in STOREYS.items() for x in (k, float(v))])
    return F.coalesce(F.when(s.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast("double")), names[F.regexp_replace(F.lower(s), r"\s+", "")])


def is_indoor(props: Column) -> Column:
    """Whether a feature is of a building's inside: it names a storey or what it is indoors, unless that is no."""
    return (_has(props, "level") | _has(props, "layer") | _has(props, "indoor")) & (F.coalesce(props["indoor"], F.lit("")) != "no")


def widened(low: Column, high: Column, least: float = 1e-7) -> tuple[Column, Column]:
    """An extent's ends, moved apart around their middle where they are closer than ``least``."""
    middle, flat = (low + high) / 2, (high - low) < least
    return F.when(flat, middle - least / 2).otherwise(low), F.when(flat, middle + least / 2).otherwise(high)


def plausible_part(line: Column, west: float, south: float, east: float, north: float) -> Column:
    """The points of ``line`` (structs lon, lat) within a box and its slack, if they are more than half of it; else none.

    The slack is a quarter of the box's span on each axis, at least 0.0015 and at most 0.05 degrees.
    """
    dx, dy = (max(0.0015, min(0.05, 0.25 * span)) for span in (east - west, north - south))
    inside = F.filter(line, lambda p: p["lon"].between(west - dx, east + dx) & p["lat"].between(south - dy, north + dy))
    return F.when(F.size(inside) * 2 > F.size(line), inside)


def matches_search(name: Column, tags: Column, wanted: str) -> Column:
    """Whether a place's name or tags hold ``wanted``, in any case."""
    return F.contains(F.lower(F.concat_ws(" ", name, F.array_join(tags, " "))), F.lit(wanted.lower()))


def clamped(value: Column, low: float, high: float, otherwise: float) -> Column:
    """A request's number within its limits; ``otherwise`` where it is null or not a number."""
    v = value.try_cast("double")
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(F.when(F.isnan(v), F.lit(None)).otherwise(v), F.lit(float(otherwise)))))


def box_holds(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    """Whether a box lies within another one, either of which may cross the antimeridian (west beyond east)."""
    span = lambda b: F.when(b["east"] >= b["west"], b["east"] - b["west"]).otherwise(b["east"] - b["west"] + 360)
    shift = F.pmod(inner["west"] - outer["west"], F.lit(360.0))
    return (inner["south"] >= outer["south"]) & (inner["north"] <= outer["north"]) & (shift + span(inner) <= span(outer))


def box_meets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def box_of_both(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {k: (F.least if k in ("west", "south") else F.greatest)(a[k], b[k]) for k in ("west", "south", "east", "north")}
