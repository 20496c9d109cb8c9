"""Graphs, documents, binary sources, hours and streams against brute force and known values."""

import gzip
import itertools
import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom import arrow
from geoloom.functions import geo, ingest, sky, text
from geoloom.functions.hours import state
from geoloom.operators import budget, document, indoor, place_graph
from geoloom.operators.number import numbered
from geoloom.sources import archives, elements, frames, protobuf, rasters, realtime, tiles
from geoloom.streaming.sessions import rate_limited, session_changes


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def n_parts(near):
    return len(budget.parts(near))


def without(near, n):
    return {m: near[m] - {n} for m in near if m != n}


def test_cut_points_of_all_graphs_of_five_nodes():
    ways = list(itertools.combinations(range(5), 2))
    for k in range(1 << len(ways)):
        near = budget.adjacency(list(range(5)), [w for i, w in enumerate(ways) if k >> i & 1])
        want = {n for n in near if n_parts(without(near, n)) > n_parts(near)}
        assert budget.cut_points(near) == want, k


def test_main_part_weighs_junctions_and_takes_the_first_of_equals():
    near = budget.adjacency([1, 2, 3, 4, 5, 6], [(1, 2), (3, 4), (4, 5)])
    assert budget.main_part(near, {1: 10, 2: 10, 3: 1, 4: 1, 5: 1, 6: 1}) == {1, 2}
    assert budget.main_part(near, dict.fromkeys(near, 1)) == {3, 4, 5}
    assert budget.main_part(budget.adjacency([7, 8], []), {7: 1, 8: 1}) == {7}
    assert budget.main_part({}, {}) == set()


def test_fit_keeps_what_is_worth_most_and_the_parts_whole():
    n = 60
    near = budget.adjacency(list(range(n)), [(i, i + 1) for i in range(n - 1)])
    kept = budget.fit(list(range(n)), near, list(range(n)), 1500)
    assert kept == set(range(len(kept))) and 0 < len(kept) < n
    cost = len(kept) * budget.NODE_TOKENS + 2 * (len(kept) - 1) * budget.EDGE_TOKENS + budget.FRAME_TOKENS
    assert cost <= 1500 * (1 - budget.OVERHEAD)
    assert budget.fit(list(range(n)), near, list(range(n)), 10**6) == set(range(n))
    assert len(budget.fit(list(range(n)), near, list(range(n)), 0)) == 0


def test_chains_are_drawn_together(spark):
    ways = [(1, 2, 10, 0), (2, 3, 0, 5), (3, 4, 7, 0), (4, 1, -17, -5), (3, 5, 1, 1), (5, 6, 1, 1)]
    rows = [(0, a, b, float(dx), float(dy), float(np.hypot(dx, dy)), "road", a == 5, False) for a, b, dx, dy in ways]
    rows += [(g, b, a, -dx, -dy, d, p, x, c) for g, a, b, dx, dy, d, p, x, c in rows]
    edges = spark.createDataFrame(rows, "graph long, from_id long, to_id long, dx double, dy double, dist double, path string, blocked boolean, crosswalk boolean")
    nodes = spark.createDataFrame([(0, i, "intersection", "kept" if i in (1, 6) else None) for i in range(1, 7)], "graph long, id long, kind string, name string")
    out = {(r.from_id, r.to_id): r for r in budget.contracted(nodes, edges).collect()}
    # 2 goes; 4 then would double the way from 1 to 3; 5 lies at a blocked way
    assert set(out) == {(1, 3), (3, 1), (3, 4), (4, 3), (4, 1), (1, 4), (3, 5), (5, 3), (5, 6), (6, 5)}
    assert (out[1, 3].dx, out[1, 3].dy, out[1, 3].dist) == (10, 5, 15) and [tuple(s) for s in out[3, 1].segments] == [(0, -5), (-10, 0)]
    shape = {r.id: (r.in_main, r.is_cut) for r in budget.shape(nodes, edges).collect()}
    assert shape == {1: (True, False), 2: (True, False), 3: (True, True), 4: (True, False), 5: (True, True), 6: (True, False)}
    kept = budget.fitted(nodes.withColumn("worth", F.lit(1)), edges, 10_000)
    assert kept.where("kept").count() == 6 and budget.fitted(nodes.limit(0).withColumn("worth", F.lit(1)), edges.limit(0), 64).count() == 0


def test_chains_are_work_of_their_own(spark):
    rnd = np.random.default_rng(5)
    nodes, ways = [], {}
    for g in range(30):  # hubs 1 to 4, chains of junctions between them, some edges between hubs, and a ring of junctions
        nodes += [(g, h, "poi", None) for h in range(1, 5)]
        free, lines = rnd.permutation(np.arange(10, 90)).tolist(), []
        for _ in range(7):
            a, b = rnd.integers(1, 5, 2).tolist()
            chain = [free.pop() for _ in range(int(rnd.integers(1, 5)) + (a == b))]
            nodes += [(g, n, "intersection", "named" if rnd.random() < 0.1 else rnd.choice(["", None])) for n in chain]
            lines.append([a, *chain, b])
        ring = [free.pop() for _ in range(4)]
        nodes += [(g, n, "intersection", None) for n in ring]
        lines += [[*ring, ring[0]], *([h, h + 1] for h in (1, 2, 3) if rnd.random() < 0.5)]
        for line in lines:
            for a, b in itertools.pairwise(line):
                leg = budget.Leg(*rnd.integers(-9, 10, 3).astype(float).tolist(), [], ("road" if rnd.random() < 0.9 else "path", bool(rnd.random() < 0.05), False))
                leg.steps = [(leg.dx, leg.dy)]
                ways[g, a, b], ways[g, b, a] = leg, leg.back()
    want = {}
    for g in range(30):  # the whole graph at once
        legs = {n: {} for f, n, _, _ in nodes if f == g}
        for (f, a, b), leg in ways.items():
            if f == g:
                legs[a][b] = leg
        order = sorted(legs)
        budget.contract(order, {n for f, n, kind, name in nodes if f == g and kind == "intersection" and not name}, legs)
        want |= {(g, a, b): (x.dx, x.dy, x.dist, x.kind[0], len(x.steps)) for a, near in legs.items() for b, x in near.items()}
    assert len(want) < len(ways) - 100
    edges = spark.createDataFrame([(*k, x.dx, x.dy, x.dist, *x.kind) for k, x in ways.items()], "graph long, from_id long, to_id long, dx double, dy double, dist double, path string, blocked boolean, crosswalk boolean")
    out = budget.contracted(spark.createDataFrame(nodes, "graph long, id long, kind string, name string"), edges)
    assert "CoGroup" not in out._jdf.queryExecution().toString()  # no task holds a whole graph
    got = out.collect()
    assert {(r.graph, r.from_id, r.to_id): (r.dx, r.dy, r.dist, r.path, len(r.segments)) for r in got} == want and len(got) == len(want)


def test_compile_of_a_crossing(spark):
    line = lambda *p: [[{"x": x, "y": y} for x, y in p]]
    rows = [
        (1, "line", "highway.footway", "road", line((0, 0), (0, 0), (100, 0), (200, 0)), None, []),
        (2, "line", "highway.residential", "road", line((100, 100), (99, 0), (100, -100)), None, [(19, "token", "construction")]),
        (3, "line", "highway.residential", "road", line((5, 5), (5, 5)), None, []),
        (4, "point", "amenity.cafe", "poi", None, {"x": 100, "y": -1}, [(10, "ref", "Bean")]),
        (5, "point", "amenity.bench", "poi", None, {"x": 9, "y": 9}, []),
        (6, "point", "shop.books", "poi", None, {"x": 190, "y": 20}, [(10, "ref", "Leaf")]),
        (7, "building", "building.commercial", "building", None, {"x": 0, "y": -1}, [(12, "num", "18")]),
        (8, "polygon", "leisure.park", "area", None, None, []),
        (9, "point", "poi", "poi", None, None, []),
    ]
    d = spark.createDataFrame(rows, "ord long, kind string, class string, layer string, lines array<array<struct<x:bigint,y:bigint>>>, at struct<x:bigint,y:bigint>, properties array<struct<key:int,type:string,value:string>>")
    nodes, edges = place_graph.compile_graph(d)
    got = {r.num: (r.x, r.y, r.kind, r.name, r.tags, r.height, r.degree) for r in nodes.collect()}
    assert got == {
        1: (0, 0, "building", None, ["commercial"], 18.0, 2),
        2: (100, 0, "poi", "Bean", ["cafe"], None, 8),
        3: (200, 0, "intersection", None, [], None, 2),
        4: (100, 100, "intersection", None, [], None, 2),
        5: (100, -100, "intersection", None, [], None, 2),
        6: (190, 20, "poi", "Leaf", ["books"], None, 0),
    }
    e = {(r.from_id, r.to_id): (r.dx, r.dy, r.dir, r.path, r.blocked) for r in edges.collect()}
    assert e[1, 2] == (100, 0, "east", "sidewalk", False) and e[2, 1] == (-100, 0, "west", "sidewalk", False)
    assert e[4, 2] == (0, -100, "north", "road", True) and e[3, 6] == (-10, 20, "southwest", "access", False) and len(e) == 10
    assert place_graph.obstacles(edges).count() == 4
    empty = place_graph.compile_graph(d.limit(0))
    assert [x.count() for x in empty] == [0, 0]


def test_ingest_rules(spark):
    props = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv]) if k else F.create_map().cast("map<string,string>")
    p = F.lit("Point")
    cls = lambda g, **k: ingest.class_of(F.lit(g), props(**k), ingest.layer_of(F.lit(g), props(**k)))
    assert list(one(spark, cls("Point"), cls("LineString"), cls("Polygon"), cls("Polygon", building="yes"), cls("Point", type="a.b"), cls("Point", type="ab", shop="x"), cls("Point", highway="h", amenity="a"), cls("Point", **{"class": "own"}))) == ["poi", "highway.residential", "area.generic", "building.commercial", "a.b", "shop.x", "highway.h", "own"]
    assert [one(spark, ingest.typed(F.lit(v)))[0] for v in ("18", " 1.5 ", "1e3", "true", "no", "steps", "NaN", "Infinity", "12a", "x")] == ["num", "num", "num", "bool", "token", "token", "ref", "ref", "ref", "ref"]
    kept = one(spark, ingest.kept_properties(props(level="2", name="N", created_by="z", height="", door="no")))[0]
    assert [tuple(x) for x in kept] == [(10, "ref", "N"), (22, "num", "2"), (23, "token", "no")]
    levels = ("2", "-1", "2.5", " Ground Floor ", "basement", "roof", "", None)
    assert [one(spark, ingest.storey(F.lit(v).cast("string")))[0] for v in levels] == [2, -1, 2.5, 0, -1, None, None, None]
    assert [one(spark, ingest.is_indoor(props(**k)))[0] for k in ({"level": "1"}, {"indoor": "no", "level": "1"}, {"indoor": "room"}, {})] == [True, False, True, False]
    assert list(one(spark, *ingest.widened(F.lit(1.0), F.lit(1.0)), *ingest.widened(F.lit(1.0), F.lit(2.0)))) == pytest.approx([1 - 5e-8, 1 + 5e-8, 1, 2])
    points = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(0.5).alias("lat")) for x in (0.1, 0.2, 90.0)])
    assert len(one(spark, ingest.plausible_part(points, 0, 0, 1, 1))[0]) == 2 and one(spark, ingest.plausible_part(points, 50, 0, 51, 1))[0] is None
    box = lambda w, e: {"west": F.lit(w), "east": F.lit(e), "south": F.lit(0), "north": F.lit(1)}
    assert list(one(spark, ingest.box_holds(box(170, -170), box(175, -175)), ingest.box_holds(box(170, -170), box(-160, -150)))) == [True, False]
    del p


@pytest.mark.parametrize(("spec", "day", "minute", "want"), [("mo-fr 0900-1700", 0, 600, (True, "09:00-17:00")), ("Mo-Fr 09:00-17:00", 0, 1100, (False, "closed")), ("Mo-Fr soon", 0, 600, (None, "soon")), ("Fr-Sa 18:00-02:00", 4, 1140, (True, "open")), ("Fr-Sa 18:00-02:00", 5, 150, (False, "18:00-02:00")), ("Fr-Sa 18:00-02:00", 4, 60, (False, "18:00-02:00")), ("Fr-Sa 18:00-02:00", 5, 60, (True, "open")), ("Mo 08:00-10:00 (not; in May)", 0, 500, (True, "08:00-10:00")), ("Sa-Mo 10:00-12:00", 6, 650, (True, "10:00-12:00")), ("", 0, 0, (None, "no opening hours recorded")), ("24/7", 0, 0, (True, "00:00-24:00"))])
def test_hours_in_words(spec, day, minute, want):
    assert state(spec, day, minute) == want


def test_varints_and_fields():
    for v in (0, 1, 127, 128, 300, 2**32, 2**63 - 1, -1, -(2**63)):
        raw = protobuf.write_varint(v)
        assert protobuf.signed(protobuf.varint(raw, 0)[0]) == v
        assert protobuf.unzigzag(protobuf.zigzag(v)) == v
    m = protobuf.write(1, 150) + protobuf.write(2, "text") + protobuf.write(3, 1.5) + b"\x25" + struct.pack("<f", 2.5) + b"\x2b\x08\x01\x2c" + protobuf.write(6, 7)
    assert [(n, v if k != 1 else protobuf.as_double(v)) for n, k, v in protobuf.fields(m)][:3] == [(1, 150), (2, b"text"), (3, 1.5)]
    assert [n for n, _, _ in protobuf.fields(m)] == [1, 2, 3, 4, 6]
    for cut in (b"\x80", b"\x0a\x05ab", b"\x09\x01", b"\x0f"):
        with pytest.raises(ValueError):
            list(protobuf.fields(cut))


def test_realtime_feeds(spark):
    feed = realtime.encode_updates(99, [{"entity_id": "a", "trip_id": "T", "trip_delay": -30}, {"entity_id": "b", "is_deleted": True}, {"entity_id": "c", "trip_id": "U", "stops": [{"stop_id": "S", "departure_delay": 5}, {"stop_sequence": 2, "arrival_time": 7, "relationship": 1}]}])
    rows = spark.createDataFrame([(1, feed), (2, gzip.compress(feed)), (3, feed[:-3]), (4, None), (5, b"")], "id int, content binary")
    out = [r.asDict() for r in realtime.read_updates(rows).collect()]
    first = [r for r in out if r["id"] == 1]
    assert [(r["entity_id"], r["trip_id"], r["trip_delay"], r["is_deleted"], r["ord"], r["stop_id"], r["departure_delay"], r["arrival_time"], r["relationship"]) for r in first] == [("a", "T", -30, False, 0, None, None, None, None), ("b", None, None, True, 0, None, None, None, None), ("c", "U", None, False, 0, "S", 5, None, None), ("c", "U", None, False, 1, None, None, 7, 1)]
    assert [{**r, "id": 1} for r in out if r["id"] == 2] == first and {r["id"] for r in out} == {1, 2, 3}
    assert [r["error"] is not None for r in out if r["id"] == 3] == [True]


def test_vector_tiles(spark):
    shapes = [("point", [[(5, 7)], [(3, -2)]]), ("line", [[(0, 0), (9, 9), (4, 4)], [(1, 1), (2, 2)]]), ("polygon", [[(0, 0), (10, 0), (10, 10), (0, 0)]])]
    tile = tiles.encode_tile("l", [{"id": i, "kind": k, "properties": {"n": i, "s": "x", "b": True, "d": 2.5}, "parts": p} for i, (k, p) in enumerate(shapes)], 512)
    got = tiles.decode_tile(tile)
    assert [(f["kind"], f["parts"]) for f in got] == shapes and got[1]["properties"] == {"n": "1", "s": "x", "b": "true", "d": "2.5"} and got[0]["extent"] == 512
    rows = spark.createDataFrame([(1, gzip.compress(tile)), (2, tile[:20]), (3, None)], "id int, content binary")
    assert sorted((r.id, r.error is None) for r in tiles.read_tiles(rows).collect()) == [(1, True)] * 3 + [(2, False)]


def test_tile_archives():
    bodies = {0: b"zero", 5: b"five", 6: b"five", 7: b"seven"}
    data = b"zerofiveseven"
    leaf = tiles.encode_directory([(5, 4, 4, 2), (7, 8, 5, 1)])
    root = tiles.encode_directory([(0, 0, 4, 1), (5, 0, len(gzip.compress(leaf, mtime=0)), 0)])
    root, leaf = gzip.compress(root, mtime=0), gzip.compress(leaf, mtime=0)
    at = tiles.HEADER.size
    head = tiles.HEADER.pack(b"PMTiles", 3, at, len(root), 0, 0, at + len(root), len(leaf), at + len(root) + len(leaf), len(data), 4, 3, 3, 1, 2, 1, 1, 0, 2, 0, 0, 0, 0, 0, 0, 0)
    archive = head + root + leaf + data
    assert dict(tiles.read_archive(archive)) == bodies and dict(tiles.read_archive(archive, [6])) == {6: b"five"}
    entries = tiles.decode_directory(tiles.encode_directory([(1, 0, 5, 3), (9, 5, 2, 1), (20, 100, 7, 0)]))
    assert entries == [(1, 0, 5, 3), (9, 5, 2, 1), (20, 100, 7, 0)]
    assert [tiles.find_entry(entries, t) for t in (0, 3, 4, 9, 99)] == [None, entries[0], None, entries[1], entries[2]]
    with pytest.raises(ValueError):
        tiles.read_archive(b"nothing")
    assert len(head) == 127


def test_inflate_by_first_bytes():
    raw = b"some text " * 50
    deflated = zlib.compressobj(wbits=-15)
    assert all(tiles.inflate_any(x) == raw for x in (raw, gzip.compress(raw), zlib.compress(raw), deflated.compress(raw) + deflated.flush()))


def test_images(spark):
    r = np.random.default_rng(1)
    for channels in (3, 4):
        pixels = r.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        for kind in (0, 2):
            assert (rasters.decode_png(rasters.encode_png(pixels, kind)) == pixels).all()
    # rows by each filter, made from their definition
    pixels = r.integers(0, 256, (5, 6, 3)).astype(int)
    flat, body = pixels.reshape(5, -1), b""
    for y in range(5):
        out = []
        for i in range(18):
            a, b, c = (flat[y][i - 3] if i > 2 else 0), (flat[y - 1][i] if y else 0), (flat[y - 1][i - 3] if y and i > 2 else 0)
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(v - (a + b - c))))[y]
            out.append((flat[y][i] - guess) % 256)
        body += bytes([y, *out])
    whole = rasters.encode_png(np.zeros((5, 6, 3), np.uint8))
    head, tail = whole[: 8 + 25], whole[-12:]
    packed = zlib.compress(body)
    assert (rasters.decode_png(head + struct.pack(">I", len(packed)) + b"IDAT" + packed + b"\0\0\0\0" + tail) == pixels).all()
    metres = np.array([[-32768.0, 0.0], [8848.5, 12.25]])
    assert (rasters.heights(rasters.colours(metres)) == metres).all()
    assert rasters.resampled(np.array([[0.0, 2.0], [4.0, 6.0]]), 3).tolist() == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    rows = spark.createDataFrame([(1, rasters.encode_png(rasters.colours(metres))), (2, b"no"), (3, None)], "id int, content binary")
    got = rasters.read_terrarium(rows).collect()
    assert sorted((q.x, q.y, q.v) for q in got if q.id == 1) == [(0, 0, -32768.0), (0, 1, 8848.5), (1, 0, 0.0), (1, 1, 12.25)] and {q.id for q in got} == {1, 2}


def test_zip_archives(spark):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/Stops.TXT", "x")
        z.writestr("b.csv", "y", zipfile.ZIP_DEFLATED)
        z.writestr("c.pdf", "z")
        z.mkdir("d")
    bad = BytesIO()
    with zipfile.ZipFile(bad, "w", zipfile.ZIP_LZMA) as z:
        z.writestr("a.txt", "x")
    rows = spark.createDataFrame([(1, out.getvalue()), (2, bad.getvalue()), (3, b"zip"), (4, None)], "id int, content binary")
    got = archives.read_zip(rows).collect()
    assert sorted((r.table or "-", r.name, bytes(r.body)) for r in got if r.id == 1) == [("-", "c.pdf", b"z"), ("b", "b.csv", b"y"), ("stops", "a/Stops.TXT", b"x")]
    assert sorted(r.id for r in got if r.error) == [2, 3]


def test_delays_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    from geoloom.plans.places import traffic_delay

    keys = [0, 2, 32, 41, 46, 64, 74, 89, 94]  # 1087.5 s: shares added backwards are an ulp more and make 1087
    total = 0.0
    for k in keys:
        total += k % 10 / 10
    for name, rows in (("up", keys), ("down", keys[::-1])):
        spark.createDataFrame([(k, 7) for k in rows], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert [tuple(r) for r in traffic_delay(spark, f"{tmp_path}/{name}").collect()] == [(7, total / 9, 5, 1088.0)], name


def test_a_way_closes_at_the_node_it_began_at(spark):
    nodes = spark.createDataFrame([(1, {}, 0.0, 0.0), (2, {}, 1.0, 0.0), (3, {}, 1.0, 1.0), (4, {}, 0.0, 0.0)], "id long, tags map<string,string>, lon double, lat double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(10, [1, 2, 3, 1], None), (11, [1, 2, 3, 4], None), (12, [9, 1, 2, 3, 1, 9], None), (13, [1, 2, 1], None), (14, None, ring), (15, [1, 2, 3, 4], ring), (16, None, ring[:3]), (17, None, None)]
    ways = spark.createDataFrame([(i, {"building": "yes"}, r, x) for i, r, x in rows], "id long, tags map<string,string>, refs array<bigint>, inline array<struct<lon:double,lat:double>>")
    got = {r.id: r.closed for r in elements.way_lines(ways, nodes).collect()}
    assert got == {10: True, 11: False, 12: True, 13: False, 14: True, 15: True, 16: False, 17: False}
    assert {r.id: r.kind for r in elements.features(nodes, ways).collect()} == {i: "area" if got[i] else "line" for i in range(10, 17)}


def test_elements_become_features(spark):
    nodes = spark.createDataFrame([(1, {"amenity": "cafe"}, 0.0, 0.0), (2, {}, 1.0, 0.0), (3, {}, 1.0, 1.0)], "id long, tags map<string,string>, lon double, lat double")
    at = "array<struct<lon:double,lat:double>>"
    ways = spark.createDataFrame([(10, {"building": "yes"}, [1, 2, 3, 1], None), (11, {"highway": "path", "building": "yes"}, [1, 2, 3, 1], None), (12, {}, [1, 9], None), (13, {}, None, [(5.0, 5.0), (6.0, 6.0)]), (14, {"area": "no", "building": "yes"}, [1, 2, 3, 1], None)], f"id long, tags map<string,string>, refs array<bigint>, inline {at}")
    got = {r.id: (r.kind, len(r.line)) for r in elements.features(nodes, ways).collect()}
    assert got == {1: ("point", 1), 10: ("area", 4), 11: ("line", 4), 13: ("line", 2), 14: ("line", 4)}
    assert elements.wanted_layers(["Roads", "poi", "road"], {"roads": "road"}, ["poi", "road"]) == ["poi", "road"]
    with pytest.raises(ValueError):
        elements.wanted_layers(["x"], {}, ["poi"])


def test_documents(spark):
    good = "SCR 1.0\r\nBBOX 0 0 1 1\nQ 4096\n\nS 100 Fifth  Ave\nROUTE 1 walk dist=9\nSTEP 1 dist=4 turn=left go on\nROUTE 2 bike\nSTEP 1 ride\n"
    bad = ["Q 1\n", "SCR 1.0\nQ 4096\n", "SCR 1.0\nBBOX 0 0 1 1\n", "SCR 1.0\nBBOX 0 0 1\nQ 1\n", "SCR 1.0\nWHAT\n"]
    d = spark.createDataFrame(list(enumerate([good, *bad])), "doc int, text string")
    r = document.records(document.lines_of(d))
    assert [tuple(x) for x in document.named(r.where("doc = 0"), "S").collect()] == [(0, 100, "Fifth  Ave")]
    assert sorted(tuple(x) for x in document.steps(r.where("doc = 0")).collect()) == [(0, 1, 1, 4, "left", "go on"), (0, 2, 1, None, None, "ride")]
    assert {x.doc: x.error for x in document.faults(r).collect()} == {1: "line 1: no header", 2: "missing envelope: need TILE or BBOX", 3: "missing Q record: quantization extent is required", 4: "line 2: BBOX needs 4 fields", 5: 'line 2: unknown record tag "WHAT"'}
    cells = one(spark, document.cells_of(F.lit("1,2,0.5;3,4")))[0]
    assert [tuple(c) for c in cells] == [(1, 2, 0.5), (3, 4, None)]


def test_numbering_over_partitions(spark):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.num == r.k + 1 for r in numbered(d, ["k"]).collect()) and numbered(d.limit(0), ["k"]).count() == 0


def test_lines_simplify():
    line = [(0, 0), (1, 1), (2, 0), (10, 0), (20, 30), (30, 0)]
    assert geo.simplified(line, 0) == line and geo.simplified(line, 2) == [(0, 0), (10, 0), (20, 30), (30, 0)]
    assert geo.simplified(line, 1000) == [(0, 0), (30, 0)] and geo.simplified([], 5) == []


def test_words_and_texts(spark):
    assert list(one(spark, geo.turn(F.lit("north"), F.lit("east")), geo.turn(F.lit("north"), F.lit("south")), geo.turn(F.lit("west"), F.lit("west")))) == ["right", "left", "straight"]
    assert list(one(spark, sky.number(F.lit(2.04)), sky.number(F.lit(2.25)), sky.number(F.lit(float("nan"))), text.signed_seconds(F.lit(-45)))) == ["2", "2.3", "?", "-45s"]
    lines = F.array(*[F.lit(x) for x in ("a" * 8, "b" * 8, "c" * 400, "d")])
    assert [one(spark, F.size(text.fitted(lines, n)))[0] for n in (0, 3, 6, 500)] == [0, 1, 2, 4]
    s = sky.sun(F.lit(89.0), F.lit(0.0), F.lit("2026-06-21 00:00:00").cast("timestamp"))
    assert list(one(spark, s["polar"], s["sunrise"], s["twilight"])) == ["day", None, "day"]
    assert one(spark, sky.service_epoch(F.lit(20261101), F.lit(25 * 60 + 30), "America/Los_Angeles"))[0] == 1793611800


def test_rooms_doors(spark):
    rooms = spark.createDataFrame([(1, 0, 5, 0, 0), (1, 0, 6, 500, 0), (1, 1, 7, 0, 0)], "building int, level int, id int, x int, y int")
    ways = spark.createDataFrame([(1, 0, 1, 30, 0), (1, 0, 2, -30, 0), (2, 0, 3, 0, 0)], "building int, level int, id int, x int, y int")
    assert [(r.room, r.corridor, r.dist) for r in indoor.room_doors(rooms, ways, 1.0).collect()] == [(5, 1, 30.0)]


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_rate_limit_from_the_first_hit(spark, tmp_path):
    hits = [("a", s) for s in (50, 55, 59, 61, 100, 109, 110, 111)] + [("b", 40)]
    spark.createDataFrame(hits, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    run(rate_limited(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in"), most=3, seconds=60), "limited")
    got = [(r.key, r.s, r.allowed) for r in spark.sql("SELECT key, unix_timestamp(ts) s, allowed FROM limited ORDER BY key, s").collect()]
    assert got == [("a", 50, True), ("a", 55, True), ("a", 59, True), ("a", 61, False), ("a", 100, False), ("a", 109, False), ("a", 110, True), ("a", 111, True), ("b", 40, True)]


def test_session_changes(spark, tmp_path):
    schema = "session string, view long, ids array<long>, hashes array<long>"
    spark.createDataFrame([("s", 1, [1, 2], [10, 20]), ("s", 2, [2, 3], [21, 30]), ("t", 1, [], [])], schema).write.parquet(f"{tmp_path}/in")
    run(session_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "changes")
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM changes").collect()) == [("s", 1, "+", 1), ("s", 1, "+", 2), ("s", 2, "+", 3), ("s", 2, "-", 1), ("s", 2, "~", 2)]


def test_binary_documents(spark):
    ring = [{"x": 0, "y": 0}, {"x": 70, "y": -3}, {"x": 5, "y": 900}]
    doc = {
        "header": {"version": 1, "envelope": {"is": "bbox", "bbox": {"west": -1.5, "south": 2.0, "east": 3.0, "north": 4.25}}, "wgs84": True, "extent": 0, "buffer": -64},
        "layers": [{"id": 2, "name": "é"}, {"id": 1, "name": ""}, {"id": 2, "name": "later"}],
        "attributes": [{"id": 1, "props": [{"key": 1, "value": {"is": "bool", "bool": True}}, {"key": 2, "value": {"is": "token", "token": "t"}}, {"key": 3, "value": {"is": "ref", "ref": 300}}]}],
        "features": [
            {"id": 1, "layer": 1, "klass": 0, "attributes": 1, "geometry": {"is": "building", "building": [[ring, []], []]}},
            {"id": 2, "layer": 1, "klass": 0, "attributes": 0, "geometry": {"is": "line", "line": [ring, ring[:1]]}},
        ],
        "heat": [{"id": 1, "name": "h", "resolution": 8, "low": 0.0, "high": 1.0, "cells": {"is": "rle", "rle": [{"y": 1, "runs": [{"x": 0, "len": 2, "value": 0.5}]}]}}],
        "omissions": [{"layer": 1, "count": 3, "centre": {"x": 1, "y": 2}, "note": None}],
        "refs": [{"kind": "full", "uri": "u", "mime": None, "note": 7}],
    }
    back = frames.decode(frames.encode(doc))
    assert back["header"] == doc["header"] | {"extent": 4096} and back["layers"] == [{"id": 1, "name": ""}, {"id": 2, "name": "later"}]
    assert all(back[k] == doc.get(k, []) for k in ("classes", "strings", "attributes", "features", "heat", "omissions", "refs"))
    least = {"header": {"version": 1, "extent": 64}, "layers": [{"id": 1, "name": "a"}]}
    plain = bytes.fromhex("31524353" "0c000000" "01000000" "00" "000000" "00" "8001" "00" "02" "02" "02" "61")
    assert frames.encode(least) == plain
    assert frames.wrap(plain, "raw") == bytes.fromhex("31524353" "a7" "00") + struct.pack("<I", len(plain)) + plain
    for codec in ("raw", "gzip", "zstd"):
        assert frames.unwrap(frames.wrap(plain, codec)) == plain
    r = np.random.default_rng(3)
    bad, whole = [], frames.wrap(frames.encode(doc), "raw")
    for i in range(200):
        b = bytearray(whole)
        for at in r.integers(10, len(b), 3):
            b[at] = r.integers(0, 256)
        bad.append((i, bytes(b[: r.integers(0, len(b))] if i % 2 else b)))
    rows = [(-1, None), (-2, b""), (-3, whole[:-1]), (-4, whole[:5] + b"\x02" + whole[6:]), (-5, whole)]
    out = {x.id: x for x in frames.unframed(spark.createDataFrame(rows + bad, "id long, frame binary"), F.col("frame")).collect()}
    assert out[-1].document is None and out[-1].error is None
    assert [out[i].error for i in (-2, -3, -4)] == ["frame too short", f"frame cut: {len(whole) - 10} bytes told, {len(whole) - 11} there", "codec brotli is not available"]
    assert out[-5].document.features[0].geometry.building[0][0][2].y == 900 and out[-5].document.refs[0].note == 7
    assert all((x.document is None) != (x.error is None) for i, x in out.items() if i != -1)
    empty = frames.framed(spark.createDataFrame([(None,)], f"d {frames.DOCUMENT}"), F.col("d")).first()
    assert empty.frame is None and empty.error is None
    far = frames.framed(spark.range(1).select(F.from_json(F.lit('{"layers": [{"id": 1073741824}]}'), frames.DOCUMENT).alias("d")), F.col("d")).first()
    assert far.frame is None and "out of range" in far.error


def test_batches_are_taken_in_slices(monkeypatch):
    monkeypatch.setattr(arrow, "SLICE_BYTES", 10)
    values = ["a" * 4, None, "b" * 7, "c" * 30, "", "d", "e" * 12, "f"]
    for kind in (pa.string(), pa.binary()):
        b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([v and v.encode() if kind == pa.binary() else v for v in values], kind)], ["i", "v"])
        parts = list(arrow.slices(b, 1))
        assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist() and [p.num_rows for p in parts] == [3, 1, 3, 1]
    whole = pa.RecordBatch.from_arrays([pa.array([[1] * 5] * 4)], ["v"])
    assert pa.Table.from_batches(list(arrow.slices(whole, 0))).to_pylist() == whole.to_pylist()
    assert [p.num_rows for p in arrow.slices(whole.slice(0, 0), 0)] == [0]
