"""Schedules: stops in reach, lines and departures at a stop, edges between stops, rides and realtime changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.text import clock, signed_seconds


def stops_within(stops: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Stops at most ``radius`` metres from a centre, with whole metres; a box test comes first and reaches the scan."""
    box_lat, box_lon = radius / geo.LAT_DEGREE * 1.01, radius / (geo.LON_DEGREE * math.cos(math.radians(lat))) * 1.01
    near = stops.where(F.col("lat").between(lat - box_lat, lat + box_lat) & F.col("lon").between(lon - box_lon, lon + box_lon))
    return near.withColumn("dist", geo.half_up(geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).cast("long")).where(F.col("dist") <= radius)


def within_pairs(left: DataFrame, right: DataFrame, radius: float, cell: int = 256) -> DataFrame:
    """Pairs of grid points at most ``radius`` units apart: an equi-join on cells, each left point looking into nine."""
    if radius > cell:
        raise ValueError("a cell must be as wide as the radius")
    key = lambda c: F.floor(F.col(c) / float(cell))
    around = lambda c: F.explode(F.sequence(key(c) - 1, key(c) + 1))
    a = left.withColumn("_cx", around("gx")).withColumn("_cy", around("gy"))
    b = right.select(F.col("id").alias("other"), F.col("gx").alias("ox"), F.col("gy").alias("oy")).withColumn("_cx", key("ox")).withColumn("_cy", key("oy"))
    d = F.hypot((F.col("gx") - F.col("ox")).cast("double"), (F.col("gy") - F.col("oy")).cast("double"))
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("_cx", "_cy")


def edges(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Consecutive stops of trips, (from, to, labels): each direction once, labels sorted and distinct."""
    prev = F.lag("stop_id").over(Window.partitionBy("trip_id").orderBy("seq"))
    pairs = stop_times.withColumn("from_stop", prev).where("from_stop IS NOT NULL AND from_stop <> stop_id").select("trip_id", "from_stop", F.col("stop_id").alias("to_stop"))
    lines = trips.join(routes, "route_id").select("trip_id", "label")
    return pairs.join(lines, "trip_id").groupBy("from_stop", "to_stop").agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("labels"), F.count("*").alias("trips"))


def services_on(calendar: DataFrame, exceptions: DataFrame, date: int, weekday: str) -> DataFrame:
    """Services that run on a date: those of the calendar less removed ones, and added ones. The last exception counts."""
    regular = calendar.where((F.col("start_date") <= date) & (F.col("end_date") >= date) & F.col(weekday)).select("service_id")
    last = exceptions.where(F.col("date") == date).groupBy("service_id").agg(F.max_by("exception_type", "pos").alias("t"))
    return regular.join(last.where("t = 2"), "service_id", "left_anti").union(last.where("t <> 2").select("service_id")).distinct()


def first_last(stop_times: DataFrame) -> DataFrame:
    return stop_times.where("dep IS NOT NULL").groupBy("stop_id").agg(F.min("dep").alias("first_dep"), F.max("dep").alias("last_dep"), F.count("*").alias("departures"))


def board(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, now: int, top: int = 3) -> DataFrame:
    """The next ``top`` departures of each stop from minute ``now`` on, equal lines and times once, and how many follow.

    The count is an aggregate of its own, so that the ranking keeps ``top`` rows of a stop in each task before they meet.
    """
    rows = stop_times.where(F.col("dep") >= now).select("trip_id", "stop_id", "dep").join(trips.join(routes, "route_id").select("trip_id", "label"), "trip_id").select("stop_id", "dep", "label").distinct()
    n = rows.groupBy("stop_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stop_id").orderBy("dep", "label"))).where(F.col("rank") <= top)
    return rows.join(n, "stop_id").select("stop_id", "rank", F.concat_ws(" ", "label", clock(F.col("dep"))).alias("text"), F.greatest(F.lit(0), F.col("n") - top).alias("more"))


def rides(stop_times: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rides without a change: from the first row of a trip at each stop of ``a`` to the first later row at one of ``b``."""
    rows = stop_times.select("trip_id", "stop_id", "seq", "dep")
    on = rows.join(a.select(F.col("id").alias("stop_id")), "stop_id", "left_semi").groupBy("trip_id", F.col("stop_id").alias("board")).agg(F.min(F.struct("seq", "dep")).alias("x"))
    off = rows.join(b.select(F.col("id").alias("stop_id")), "stop_id", "left_semi").select("trip_id", F.col("stop_id").alias("alight"), F.col("seq").alias("off_seq"))
    j = on.join(off, "trip_id").where("off_seq > x.seq AND alight <> board")
    return j.groupBy("trip_id", "board", "alight").agg(F.first("x.seq").alias("board_seq"), F.first("x.dep").alias("dep"), F.min("off_seq").alias("alight_seq"))


def catchment(stops: DataFrame, lat: float, lon: float, radius: float, cap: int = 8) -> DataFrame:
    """(id, dist) of the ``cap`` nearest stops within ``radius`` metres of a point; of equally near ones the least ids."""
    return stops_within(stops, lat, lon, radius).orderBy("dist", "id").limit(cap).select("id", "dist")


def shared_lines(served: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """For each route that serves a stop of both catchments, the pair of different stops with the least walk, ties by ids.

    Of each side a route needs its two nearest stops only: the best pair is among those, even where both sides begin with
    the same stop. So no more than four pairs of a route are made.
    """

    def two(side: DataFrame, stop: str, walk: str) -> DataFrame:
        d = served.select("route_id", "stop_id").distinct().join(F.broadcast(side.select(F.col("id").alias("stop_id"), F.col("dist").alias(walk))), "stop_id")
        d = d.select("route_id", F.col("stop_id").alias(stop), walk)
        return d.withColumn("_r", F.row_number().over(Window.partitionBy("route_id").orderBy(walk, stop))).where("_r <= 2").drop("_r")

    best = F.min(F.struct((F.col("wa") + F.col("wb")).alias("walk"), "sa", "sb")).alias("m")
    return two(a, "sa", "wa").join(two(b, "sb", "wb"), "route_id").where("sa <> sb").groupBy("route_id").agg(best).select("route_id", "m.*")


def ride_plans(stop_times: DataFrame, trips: DataFrame, services: DataFrame, anchors: DataFrame, now: int, predicted: DataFrame | None = None) -> DataFrame:
    """Rides of running trips between each route's anchor stops (route_id, sa, sb) that depart at minute ``now`` or later.

    A ride goes from a trip's first row at ``sa`` to its first later row at ``sb``; trips without a time at ``sa`` give
    none. ``predicted`` (trip_id, stop_id, suffix) tells what realtime says of the departure; cancelled rides are marked,
    not left out.
    """
    running = trips.join(services.select("service_id"), "service_id", "left_semi").join(F.broadcast(anchors), "route_id")
    rows = stop_times.join(running.select("trip_id", "route_id", "sa", "sb", "walk"), "trip_id")
    first = rows.where("stop_id = sa").groupBy("trip_id").agg(F.min(F.struct("seq", "dep")).alias("a"))
    later = rows.where("stop_id = sb").join(first, "trip_id").where("seq > a.seq")
    ride = later.groupBy("trip_id", "route_id", "sa", "sb", "walk").agg(F.min(F.struct("seq", "dep")).alias("b"), F.first("a").alias("a"))
    ride = ride.where(F.col("a.dep") >= now).select("route_id", "trip_id", F.col("sa").alias("board"), F.col("sb").alias("alight"), F.col("a.dep").alias("dep"), F.col("b.dep").alias("arrive"), (F.col("b.seq") - F.col("a.seq")).alias("rides"), "walk")
    if predicted is None:
        return ride.withColumn("suffix", F.lit(None).cast("string"))
    return ride.join(predicted.select("trip_id", F.col("stop_id").alias("board"), "suffix"), ["trip_id", "board"], "left")


def shown_plans(plans: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` rides by departure that are not cancelled, and in ``more`` how many follow."""
    alive = plans.where("suffix IS NULL OR suffix <> 'cancelled'")
    first = alive.orderBy("dep", "route_id", "trip_id").limit(top)
    n = alive.agg(F.count("*").alias("n"))
    return first.crossJoin(F.broadcast(n)).withColumn("more", F.greatest(F.lit(0), F.col("n") - top)).drop("n")


def plan_text(label: Column, board: Column, walk_to: Column, way_to: Column, dep: Column, suffix: Column, rides: Column, arrive: Column, walk_from: Column, way_from: Column) -> Column:
    """A ride in words."""
    alight = F.when(arrive.isNull(), ", alight time not published").otherwise(F.concat(F.lit(", alight "), clock(arrive)))
    told = F.when(suffix.isNull() | (suffix == ""), "").otherwise(F.concat(F.lit(" "), suffix))
    many = F.when(rides == 1, " stop").otherwise(" stops")
    text = [label, F.lit(": "), board, F.lit(" "), walk_to.cast("string"), F.lit("m "), way_to, F.lit(", depart "), clock(dep), told, F.lit(", ride "), rides.cast("string"), many, alight, F.lit(", then "), walk_from.cast("string"), F.lit("m "), way_from, F.lit(" to destination")]
    return F.concat(*text)


def service_state(has_calendar: Column, running: Column) -> Column:
    """True if services run, False if none do, null without a calendar."""
    return F.when(has_calendar, running > 0)


def all_passed(state: Column, last: Column, now: Column) -> Column:
    """Whether the latest departure lies before ``now`` on a day with service."""
    return F.coalesce(state, F.lit(False)) & F.coalesce(last < now, F.lit(False))


def service_note(state: Column, date: Column, zone: Column, passed: Column) -> Column:
    """What a slice's schedule rests on, in sentences."""
    day = F.concat_ws("-", F.lpad(F.floor(date / 10000).cast("string"), 4, "0"), F.lpad(F.pmod(F.floor(date / 100), F.lit(100)).cast("string"), 2, "0"), F.lpad(F.pmod(date, F.lit(100)).cast("string"), 2, "0"))
    none = F.lit(None).cast("string")
    return F.concat_ws(
        " ",
        F.lit("Stop distances are straight-line."),
        F.when(state.isNotNull(), F.concat(F.lit("Schedule from GTFS feed for "), day, F.lit(" in "), zone, F.lit("."))).otherwise("The feed has no service calendar; service window unknown."),
        F.when(state.isNull(), "Routes cover the whole feed and first/last departures are not shown.").when(~state, "No service runs on this date.").otherwise(none),
        F.when(zone.isNull(), "The feed states no agency_timezone, so the service day could not be read.").otherwise(none),
        F.when(passed, "Every scheduled departure for these stops has already run; the next services are another day's.").otherwise(none),
    )


def realtime_note(updates: Column, age_seconds: Column, reason: Column) -> Column:
    """What a slice's realtime data rests on; ``updates`` is null where no feed answered, then ``reason`` tells why, if one is configured."""
    n = updates.cast("string")
    none, got = F.when(reason.isNull(), "All times are scheduled; no real-time feed is configured."), F.concat(F.lit("Real-time: "), n, F.when(updates == 1, " trip prediction").otherwise(" trip predictions"), F.lit(", feed "), age_seconds.cast("string"), F.lit("s old at query time."))
    empty = F.concat(F.lit("The real-time feed answered but carried no trip updates "), age_seconds.cast("string"), F.lit("s before query time."))
    tail = F.lit(" A stop without a live entry has no prediction: unknown, not on time.")
    away = F.concat(F.lit("Real-time feed unavailable ("), reason, F.lit("); all times shown are scheduled."))
    return F.when(updates.isNull(), F.coalesce(none, away)).when(updates == 0, F.concat(empty, tail)).otherwise(F.concat(got, tail))


def matched_updates(updates: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Realtime stop updates with the scheduled row they speak of, ``seq``: a trip's first row at their stop, else, where they
    name none, the row of their number (from 1). Updates that find no row go."""
    rows = stop_times.select("trip_id", "stop_id", "seq", "dep")
    first = rows.groupBy("trip_id", "stop_id").agg(F.min(F.struct("seq", "dep")).alias("m")).select("trip_id", "stop_id", "m.*")
    named = updates.where("stop_id IS NOT NULL").join(first, ["trip_id", "stop_id"])
    placed = rows.withColumn("stop_sequence", F.row_number().over(Window.partitionBy("trip_id").orderBy("seq")))
    rest = updates.where("stop_id IS NULL AND stop_sequence IS NOT NULL").drop("stop_id").join(placed, ["trip_id", "stop_sequence"])
    return named.unionByName(rest)


def suffix(relationship: Column, delay: Column, time: Column, scheduled: Column) -> Column:
    """How a departure differs: cancelled where it is skipped, its delay, or its time less the scheduled epoch."""
    return F.when(relationship == 1, "cancelled").when(delay.isNotNull(), signed_seconds(delay)).when(time.isNotNull() & scheduled.isNotNull(), signed_seconds(time - scheduled))


def live_lines(entries: DataFrame, most: int = 3) -> DataFrame:
    """(stop_id, live): the first ``most`` different entries (stop_id, ord, text) of each stop, in order."""
    first = entries.groupBy("stop_id", "text").agg(F.min("ord").alias("ord"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("stop_id").orderBy("ord", "text"))).where(F.col("_r") <= most)
    return ranked.groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("_r", "text"))).alias("x")).select("stop_id", F.transform("x", lambda t: t["text"]).alias("live"))


def prune_order(stops: DataFrame) -> DataFrame:
    """Add ``prune``, the order in which stops of a slice (id, lines, dist) would go, and ``shown``, that in which they are told."""
    go, show = Window.orderBy("n_lines", F.desc("dist"), "id"), Window.orderBy("dist", "n_lines", "id")
    return stops.withColumn("prune", F.row_number().over(go)).withColumn("shown", F.row_number().over(show))


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last update of each entity; a deletion takes the entity away."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return updates.withColumn("_r", F.row_number().over(w)).where("_r = 1 AND NOT is_deleted").drop("_r")


def overlay(stop_times: DataFrame, updates: DataFrame) -> DataFrame:
    """Delay suffixes on scheduled rows: by stop where the update names one, else by the trip as a whole."""
    u = updates.select("trip_id", "u_stop", "delay", "relationship")
    by_stop = u.where("u_stop IS NOT NULL").select("trip_id", F.col("u_stop").alias("stop_id"), F.col("delay").alias("d1"), F.col("relationship").alias("r1"))
    by_trip = u.where("u_stop IS NULL").select("trip_id", F.col("delay").alias("d2"), F.col("relationship").alias("r2"))
    j = stop_times.join(by_stop, ["trip_id", "stop_id"], "left").join(by_trip, "trip_id", "left").where("r1 IS NOT NULL OR r2 IS NOT NULL")
    d, r = F.coalesce("d1", "d2"), F.coalesce("r1", "r2")
    return j.withColumn("suffix", F.when(r == 1, "cancelled").when(r != 2, F.concat(F.when(d >= 0, "+").otherwise(""), d.cast("string"), F.lit("s")))).drop("d1", "d2", "r1", "r2")


def slice_nodes(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Stops in reach with their lines, and first and last departure. The stops, few, filter the schedule before it is joined."""
    near = stops_within(stops, lat, lon, radius)
    rows = stop_times.join(near.select(F.col("id").alias("stop_id")), "stop_id", "left_semi")
    served = rows.join(trips.join(routes, "route_id").select("trip_id", "label"), "trip_id")
    per = served.groupBy(F.col("stop_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("lines"), F.min("dep").alias("first_dep"), F.max("dep").alias("last_dep"))
    return near.join(per, "id", "left").select("id", "name", "dist", "lines", clock(F.col("first_dep")).alias("first_clock"), clock(F.col("last_dep")).alias("last_clock"))
