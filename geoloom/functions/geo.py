"""Geometry and map projections as column expressions. Halves round up, so that cells agree on either side of zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH, MERCATOR, MAX_LAT = 6371008.8, 6378137.0, 85.0511287798066
LAT_DEGREE, LON_DEGREE = 110574.0, 111320.0
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
# Zooms, speeds in metres a second, lengths of a degree.
#: Largest radius in metres for each zoom, then the zoom beyond.
ZOOMS, FAR_ZOOM = ((100, 18), (250, 17), (500, 16), (1000, 15), (2500, 14), (5000, 13), (25000, 12), (100000, 10), (500000, 8)), 6
SPEEDS = {"walk": 1.35, "bike": 4.5, "drive": 11.0}


def half_up(x: Column, places: int = 0) -> Column:
    p = float(10**places)
    return F.floor(x * p + 0.5) / p if places else F.floor(x + 0.5)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def merc_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR


def merc_y(lat: Column) -> Column:
    lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR


def merc_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR)


def merc_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / MERCATOR)))


def to_grid(lon: Column, lat: Column, west: float, south: float, east: float, north: float, extent: int = 4096) -> tuple[Column, Column]:
    """Grid column and row of a point; rows grow to the south."""
    x0, x1, y0, y1 = merc_x(F.lit(west)), merc_x(F.lit(east)), merc_y(F.lit(south)), merc_y(F.lit(north))
    return half_up((merc_x(lon) - x0) / (x1 - x0) * extent), half_up((y1 - merc_y(lat)) / (y1 - y0) * extent)


def word_of(degrees: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def grid_compass(dx: Column, dy: Column) -> Column:
    """Direction of a step on the grid."""
    return word_of(F.pmod(F.degrees(F.atan2(dx.cast("double"), -dy.cast("double"))) + 360, F.lit(360.0)))


def opposite(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(COMPASS) for x in (c, COMPASS[(i + 4) % 8])]), word)


def sphere_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    clamp = lambda t: F.greatest(F.lit(0), F.least(F.lit((1 << zoom) - 1), F.floor(t))).cast("long")
    lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return clamp((lon + 180.0) / 360.0 * n), clamp((F.lit(1.0) - F.log(F.tan(F.radians(lat)) + F.lit(1.0) / F.cos(F.radians(lat))) / math.pi) / 2 * n)


def hilbert_id(zoom: int, x: Column, y: Column) -> Column:
    """Cumulative Hilbert index of a tile over all lower zooms."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit((4**zoom - 1) // 3).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("long"), (a["y"].bitwiseAND(s) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        nx, ny = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, ny).otherwise(nx).alias("x"), F.when(ry == 0, nx).otherwise(ny).alias("y"), (a["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"))

    sides = F.array(*[F.lit(1 << k).cast("long") for k in range(zoom - 1, -1, -1)]).cast("array<bigint>")
    return F.aggregate(sides, start, step, lambda a: a["d"])


def zoom_for_radius(radius: Column) -> Column:
    e = F
    for most, zoom in ZOOMS:
        e = e.when(radius <= most, zoom)
    return e.otherwise(FAR_ZOOM)


def bbox_around(lat: Column, lon: Column, radius: Column) -> dict[str, Column]:
    dlat, dlon = radius / LAT_DEGREE, radius / (F.cos(F.radians(lat)) * LON_DEGREE)
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def straight_route(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mode: str = "walk") -> dict[str, Column]:
    dist = half_up(haversine(lat1, lon1, lat2, lon2))
    return {"dist": dist, "seconds": half_up(dist / SPEEDS[mode]), "direction": word_of(sphere_bearing(lat1, lon1, lat2, lon2))}


def weld_key(v: Column, size: int = 2) -> Column:
    return F.floor(v / float(size) + 0.5)


def from_grid(gx: Column, gy: Column, west: float, south: float, east: float, north: float, extent: int = 4096) -> tuple[Column, Column]:
    """Longitude and latitude of a grid column and row."""
    x0, x1, y0, y1 = merc_x(F.lit(west)), merc_x(F.lit(east)), merc_y(F.lit(south)), merc_y(F.lit(north))
    return merc_lon(x0 + gx / float(extent) * (x1 - x0)), merc_lat(y1 - gy / float(extent) * (y1 - y0))


def grid_scale(west: float, south: float, east: float, north: float, extent: int = 4096) -> tuple[float, float]:
    """Ground metres of a grid unit on each axis, at the middle latitude."""
    flat = lambda lat: math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * MERCATOR
    shrink = math.cos(math.radians((south + north) / 2))
    return math.radians(east - west) * MERCATOR / extent * shrink, (flat(north) - flat(south)) / extent * shrink


def grid_distance(dx: Column, dy: Column, scale: tuple[float, float]) -> Column:
    """Ground metres of a step on the grid."""
    return F.hypot(dx * scale[0], dy * scale[1])


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    n, full = F.pow(F.lit(2.0), z), math.pi * MERCATOR
    lat = lambda row: merc_lat(F.lit(full) - row * (2 * full) / n)
    return {"west": x / n * 360 - 180, "south": lat(y + 1), "east": (x + 1) / n * 360 - 180, "north": lat(y)}


def turn(inbound: Column, outbound: Column) -> Column:
    """straight, right or left, for arriving in one direction and leaving in another; a half turn is left."""
    place = lambda w: F.array_position(F.array(*[F.lit(c) for c in COMPASS]), w)
    eighths = F.pmod(place(outbound) - place(inbound), F.lit(8))
    return F.when(eighths == 0, "straight").when(eighths < 4, "right").otherwise("left")


def normal_box(west: Column, south: Column, east: Column, north: Column) -> dict[str, Column]:
    """A box within the world, west before east."""
    within = lambda v, most: F.greatest(F.lit(-most), F.least(F.lit(most), v))
    w, e = within(west, 180.0), within(east, 180.0)
    return {"west": F.least(w, e), "south": within(south, 85.05112878), "east": F.greatest(w, e), "north": within(north, 85.05112878)}


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Ground square metres, about."""
    return F.abs((east - west) * F.cos(F.radians((north + south) / 2)) * LON_DEGREE * (north - south) * LAT_DEGREE)


def off_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far a point lies from the line through two others; from the first where both are the same."""
    long = F.hypot((bx - ax).cast("double"), (by - ay).cast("double"))
    return F.when(long == 0, F.hypot((px - ax).cast("double"), (py - ay).cast("double"))).otherwise(F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / long)


def simplified(line: list, tolerance: float) -> list:
    """A line without the points whose triangle with their living neighbours is least, while that is not beyond the
    square of ``tolerance`` (areas doubled). Ends stay; of equal triangles the first in the line goes first."""
    import heapq

    n = len(line)
    if tolerance <= 0 or n <= 2:
        return list(line)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]

    def doubled(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = line[before[i]], line[i], line[after[i]]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))

    areas = {i: doubled(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in areas.items()]
    heapq.heapify(heap)
    while heap and heap[0][0] <= tolerance * tolerance:
        a, i = heapq.heappop(heap)
        if areas.get(i) != a:
            continue
        del areas[i]
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for k in (p, q):
            if k in areas:
                areas[k] = doubled(k)
                heapq.heappush(heap, (areas[k], k))
    return [line[i] for i in range(n) if i in (0, n - 1) or i in areas]
