"""Queries against their SQL on the smallest tables, and functions against values known beforehand."""

import glob
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.operators import graph, transit
from geoloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    d = QUERIES[name](spark, SF)
    names = sorted(d.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in d.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_clocks(spark):
    r = one(spark, *[text.clock_minutes(F.lit(s)) for s in ("00:00:00", "07:05:00", "25:10:00", "", "9:5", "noon")], text.clock(F.lit(1510)))
    assert list(r) == [0, 425, 1510, None, None, None, "25:10"]


def test_halves_round_up(spark):
    assert list(one(spark, geo.half_up(F.lit(-2.5)), geo.half_up(F.lit(2.5)))) == [-2, 3]


def test_hilbert_ids(spark):
    assert list(one(spark, geo.hilbert_id(0, F.lit(0), F.lit(0)), *[geo.hilbert_id(1, F.lit(x), F.lit(y)) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))])) == [0, 1, 2, 3, 4]


def test_compass_and_way_back(spark):
    r = one(spark, geo.grid_compass(F.lit(1), F.lit(0)), geo.grid_compass(F.lit(0), F.lit(1)), geo.opposite(F.lit("northeast")))
    assert list(r) == ["east", "south", "southwest"]


def test_yaml_scalars(spark):
    assert list(one(spark, *[text.yaml_scalar(F.lit(s)) for s in ("plain", "Yes", "4.5", 'a"b', "x: y", "-")])) == ["plain", '"Yes"', '"4.5"', '"a\\"b"', '"x: y"', '"-"']


def test_token_estimate_counts_utf16(spark):
    assert list(one(spark, text.tokens(F.lit("")), text.tokens(F.lit("abcd")), text.tokens(F.lit("abcde")), text.tokens(F.lit("\U0001f600\U0001f600\U0001f600")))) == [0, 1, 2, 2]


def test_nearest_far_target_is_found(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 4000, 4000)], "id long, gx long, gy long")
    t = spark.createDataFrame([(9, 4090, 4090), (8, 4090, 4090)], "id long, gx long, gy long")
    assert sorted((r.id, r.other) for r in graph.nearest(p, t).collect()) == [(1, 8), (2, 8)]


def test_last_exception_of_a_service_counts(spark):
    cal = spark.createDataFrame([("a", 1, 9, True)], "service_id string, start_date int, end_date int, monday boolean")
    exc = spark.createDataFrame([("a", 5, 1, 1), ("a", 5, 2, 2), ("b", 5, 1, 3)], "service_id string, date int, exception_type int, pos int")
    assert [r[0] for r in transit.services_on(cal, exc, 5, "monday").collect()] == ["b"]


def test_diff_of_equal_sides_is_empty(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert graph.diff(d, d, ["v"]).count() == 0


@pytest.mark.parametrize("few", [40, 1000])
def test_few_edges_are_solved_at_once(spark, few):
    """The same roots as by rounds alone, whether few edges are there from the start or left after some rounds."""
    pairs = [(x * 37 % 101, (x * 53 + x // 7) % 101) for x in range(60)] + [(200 + i, 201 + i) for i in range(90)] + [(-7, 5), (3, 3), (1 << 62, -(1 << 62))]
    edges = spark.createDataFrame([*pairs, *pairs, (None, 1), (4, None)], "a long, b long")
    want = {tuple(x) for x in graph.connected(edges).collect()}
    got = [tuple(x) for x in graph.connected(edges, few).collect()]
    assert set(got) == want and len(got) == len(want) and {(290, 200), (1 << 62, -(1 << 62))} <= want
    assert graph.connected(edges.limit(0), few).count() == 0


def test_components_of_whole_table(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect():
        a, b = sorted((find(r[0]), find(-r[1] - 1)))
        root[b] = a
    want = {x: find(x) for x in list(root)}
    assert {r["id"]: r["component"] for r in QUERIES["q_components"](spark, SF).collect()} == want
