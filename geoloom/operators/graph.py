"""Place graphs: welding of vertices, snapping, nearest neighbours, degrees, components, ledgers and ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators.prefix import prefix_sums
from geoloom.storage import discard, materialize


def weld(vertices: DataFrame, size: int = 2) -> DataFrame:
    """One junction per weld cell, numbered by its first vertex: (wx, wy, first_ord, vertices)."""
    return vertices.groupBy(geo.weld_key(F.col("gx"), size).alias("wx"), geo.weld_key(F.col("gy"), size).alias("wy")).agg(F.min("ord").alias("first_ord"), F.count("*").alias("vertices"))


def snap(points: DataFrame, junctions: DataFrame, size: int = 2) -> DataFrame:
    """Points with the junction of their weld cell, if it has one."""
    keyed = points.withColumn("wx", geo.weld_key(F.col("gx"), size)).withColumn("wy", geo.weld_key(F.col("gy"), size))
    return keyed.join(junctions, ["wx", "wy"], "left")


def nearest(points: DataFrame, targets: DataFrame, cell: int = 512) -> DataFrame:
    """Each point's nearest target, least id on ties, by squared distance; no row where there are no targets.

    Points look into the cells around their own; those whose answer is not proven by that (a target within a cell's width)
    are stored and look again with cells four times as wide, until three cells span all coordinates. Each pass is an
    equi-join on cells.
    """
    t = targets.select(F.col("id").alias("other"), F.col("gx").alias("ox"), F.col("gy").alias("oy"))
    ends = [x for c in ("x", "y") for x in points.select(F.col(f"g{c}").alias("v")).unionByName(t.select(F.col(f"o{c}").alias("v"))).agg(F.min("v"), F.max("v")).first()]
    extent = 0 if None in ends else max(ends[1] - ends[0], ends[3] - ends[2])
    left, out = points.select("id", "gx", "gy"), None
    while True:
        key = lambda c, w=cell: F.floor(F.col(c) / float(w))
        look = left.withColumn("_cx", F.explode(F.sequence(key("gx") - 1, key("gx") + 1))).withColumn("_cy", F.explode(F.sequence(key("gy") - 1, key("gy") + 1)))
        d2 = (F.col("gx") - F.col("ox")) * (F.col("gx") - F.col("ox")) + (F.col("gy") - F.col("oy")) * (F.col("gy") - F.col("oy"))
        best = look.join(t.withColumn("_cx", key("ox")).withColumn("_cy", key("oy")), ["_cx", "_cy"]).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "other")).alias("m")).select("id", "m.*")
        if cell >= extent:
            return best if out is None else out.unionByName(best)
        sure = materialize(best.where(F.col("d2") <= float(cell) * cell), "nearest")
        out = sure if out is None else out.unionByName(sure)
        left, cell = materialize(left.join(sure, "id", "left_anti"), "far"), cell * 4


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge and its way back."""
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    return edges.select("from_id", "to_id", "dx", "dy").unionByName(back).withColumn("dir", geo.grid_compass(F.col("dx"), F.col("dy")))


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends and distinct neighbours of each node."""
    ends = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("n")).unionByName(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("n")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.countDistinct("n").alias("neighbours"))


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the components of each pair (i, j) become one."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a whole graph. Batches are all its edges (a, b)."""
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    nodes, places = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    i, j = places.reshape(2, -1)
    root = merged(np.arange(len(nodes)), i, j)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def connected(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root): the least node reachable by ``edges`` (a, b), for each node that an edge joins to another.

    Rounds of large-star and small-star: each node hands its larger, then its smaller, neighbours to the least of them.
    Their number grows with the logarithm of the longest path. Every round is a stored table, which goes once the next one
    is there; a count and a hash of the edges tell the end. As soon as at most ``few`` edges are there or left, which need
    long ids then, one task solves them, and the driver is spared the plans and tasks of (further) rounds.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    if few and edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_rooted, "node long, root long")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select("m", F.col("a").alias("x")).union(small.select("m", F.col("b").alias("x"))).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        nxt = materialize(small, "links")
        discard(edges)
        edges = nxt
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if 0 < now[0] <= few:
            return edges.coalesce(1).mapInArrow(_rooted, "node long, root long")
        if now == state or not now[0]:
            return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least node id each node of ``edges`` (from_id, to_id) reaches; null ends are no node."""
    ends = edges.where("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    root = connected(ends)
    every = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))).distinct()
    return every.join(root, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def score(named: Column, kind: Column, has_tags: Column, has_height: Column, degree: Column, most: Column) -> Column:
    """A node's worth when places have to go."""
    by_kind = F.when(kind == "transit", 40).when(kind == "poi", 30).when(kind.isin("building", "entrance"), 20).otherwise(0)
    return F.when(named, 100).otherwise(0) + by_kind + F.when(has_tags, 10).otherwise(0) + F.when(has_height, 5).otherwise(0) + F.when(most > 0, degree / most * 25).otherwise(F.lit(0.0))


def omission_ledger(dropped: DataFrame) -> DataFrame:
    """How many places of each layer were left out, and which was the first."""
    return dropped.groupBy("layer").agg(F.count("*").alias("omitted"), F.min("ord").alias("first_ord"))


def ceiling(features: DataFrame, most: int) -> DataFrame:
    """Features, in order within their group, whose predecessors' new nodes stay below ``most``.

    Sums are taken in cells of the order's range, so that a group of any size is spread over tasks.
    """
    rows, low, high = features.agg(F.count("*"), F.min("ord"), F.max("ord")).first()
    if not rows:
        return features.withColumn("before", F.lit(0).cast("long"))
    placed = features.withColumn("_pos", (F.col("ord") - low) / F.lit(float(high - low + 1)))
    return prefix_sums(placed, ["grp"], "_pos", ["ord"], "new_nodes", rows, "before").drop("_pos").where(F.col("before") < most)


def diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(id, op, aspects): + and - for rows of one side, ~ with the names of the columns that differ."""
    j = old.select("id", *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(1).alias("o")).join(new.select("id", *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(1).alias("n")), "id", "full_outer")
    aspects = F.concat_ws(",", *[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), c) for c in columns])
    op = F.when(F.col("o").isNull(), "+").when(F.col("n").isNull(), "-").when(aspects != "", "~")
    return j.select("id", op.alias("op"), F.when(op == "~", aspects).otherwise("").alias("aspects")).where("op IS NOT NULL")
