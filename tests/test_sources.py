"""Readers, opening hours and streams."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.functions.hours import is_open, open_at
from geoloom.sources import features, schedules
from geoloom.streaming.updates import LatestUpdates, window_counts


def test_csv_tables(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('﻿stop_id, stop_name ,x,x\nS1,"A, ""b""",1,2\n\nS2,"two\nlines",3,4\n')
    rows = schedules.read_table(spark, str(tmp_path / "stops.txt")).collect()
    assert [tuple(r) for r in rows] == [("S1", 'A, "b"', "2"), ("S2", "two\nlines", "4")]


def test_stop_times_order_and_fallback(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence,departure_time,arrival_time\nt,B,2,,25:10:00\nt,A,1,07:05:00,\nt,C,3,noon,\n")
    got = schedules.stop_times(schedules.read_table(spark, str(tmp_path / "stop_times.txt"))).orderBy("seq").collect()
    assert [(r.stop_id, r.seq, r.dep) for r in got] == [("A", 1, 425), ("B", 2, 1510), ("C", 3, None)]


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1, 2]), ("LineString", [[0, 0], [4, 5]]), ("LineString", [[9, 9]]), ("Polygon", [[[0, 0], [1, 0], [1, -3], [0, 0]]])]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": i, "properties": {"name": "n", "height": 3}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes)]}))
    d = features.valid(features.read_geojson(spark, str(tmp_path / "f.json")))
    assert sorted(r.id for r in d.collect()) == [0, 1, 3]
    assert tuple(features.envelope(d).first()) == (0.0, -3.0, 4.0, 5.0)
    with pytest.raises(Exception, match="unknown geometry type"):
        spark.range(1).select(features.vertices(F.lit("Blob"), F.lit("[]"))).collect()


@pytest.mark.parametrize(("spec", "day", "minute", "want"), [("24/7", 3, 0, True), ("off", 3, 0, False), ("Mo-Fr 09:00-17:00", 2, 540, True), ("Mo-Fr 09:00-17:00", 2, 1020, False), ("Mo-Fr 09:00-17:00", 5, 600, None), ("08:00-20:00", 1, 600, None), ("Mo-Su 10:00-20:00; We off", 2, 700, False), ("Fr-Sa 20:00-02:00", 5, 60, True), ("Fr 20:00-02:00; Sa off", 5, 60, False), (None, 1, 1, None)])
def test_opening_hours(spec, day, minute, want):
    assert is_open(spec, day, minute) is want


def test_opening_hours_column(spark):
    d = spark.sql("SELECT 'Mo-Fr 09:00-17:00' AS s, timestamp'2026-10-07 19:00:00' AS t UNION ALL SELECT NULL, NULL")
    assert [r[0] for r in d.select(open_at(F.col("s"), F.col("t"), -420)).collect()] == [True, None]


EVENTS = "event_id long, ts timestamp, entity_id long, is_deleted boolean, user_id long"


def test_latest_updates_and_window_counts(spark, tmp_path):
    src = tmp_path / "in"
    rows = "SELECT * FROM VALUES {} AS t(event_id, ts, entity_id, is_deleted, user_id)"
    put = lambda *v: spark.sql(rows.format(",".join(v))).selectExpr("cast(event_id as long) event_id", "ts", "cast(entity_id as long) entity_id", "is_deleted", "cast(user_id as long) user_id").write.mode("append").parquet(str(src))
    latest = LatestUpdates(str(tmp_path / "state"))
    put("(1, timestamp'2024-01-01 00:00:05', 1, false, 7)", "(2, timestamp'2024-01-01 00:00:50', 2, false, 7)")
    stream = spark.readStream.schema(EVENTS).parquet(str(src))
    latest.start(stream, str(tmp_path / "ck")).awaitTermination()
    put("(4, timestamp'2024-01-01 00:02:00', 1, true, 7)", "(5, timestamp'2024-01-01 00:02:30', 2, false, 8)")
    latest.start(stream, str(tmp_path / "ck")).awaitTermination()
    put("(3, timestamp'2024-01-01 00:01:00', 1, false, 7)")
    latest.start(stream, str(tmp_path / "ck")).awaitTermination()
    assert [(r.entity_id, r.event_id) for r in latest.current(spark).collect()] == [(2, 5)]
    q = window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.hits) for r in spark.sql("SELECT * FROM counts").collect()) == [(7, 1), (7, 1), (7, 2), (8, 1)]
