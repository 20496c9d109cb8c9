"""Making a place graph small: its main part, its cut points, chains drawn together, and nodes left out until it fits.

Frames hold many graphs, told apart by ``graph``. Work on one graph is sequential, and each graph one group, but for
contracted(), where a chain is.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import connected
from geoloom.storage import materialize

# What a node, an edge and a graph's frame cost in tokens, and what a junction weighs in a component.
NODE_TOKENS, EDGE_TOKENS, FRAME_TOKENS, JUNCTION_WEIGHT, LEAST_BUDGET, OVERHEAD = 28, 46, 40, 10, 64, 0.12


def adjacency(nodes: list[int], ways: list[tuple[int, int]]) -> dict[int, set[int]]:
    """Neighbours of each node, both ways; loops and ends that are no node are left out."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in ways:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    return near


def parts(near: dict[int, set[int]]) -> list[list[int]]:
    """Components in the order of their first nodes."""
    seen: set[int] = set()
    out = []
    for n in near:
        if n not in seen:
            seen.add(n)
            part = [n]
            for x in part:
                fresh = near[x] - seen
                seen |= fresh
                part += sorted(fresh)
            out.append(part)
    return out


def main_part(near: dict[int, set[int]], weight: dict[int, int]) -> set[int]:
    """The component of most weight, of equals the one met first."""
    return set(max(parts(near), key=lambda p: sum(weight[n] for n in p), default=[]))


def cut_points(near: dict[int, set[int]]) -> set[int]:
    """Nodes without which their component falls apart, by discovery times and low links, without recursion."""
    found: dict[int, int] = {}
    low: dict[int, int] = {}
    out: set[int] = set()
    for root in near:
        if root in found:
            continue
        found[root] = low[root] = len(found)
        branches, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            n, parent, rest = stack[-1]
            m = next(rest, None)
            if m is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[n])
                    if parent == root:
                        branches += 1
                    elif low[n] >= found[parent]:
                        out.add(parent)
            elif m not in found:
                found[m] = low[m] = len(found)
                stack.append((m, n, iter(sorted(near[m]))))
            elif m != parent:
                low[n] = min(low[n], found[m])
        if branches > 1:
            out.add(root)
    return out


class Leg:
    """One direction of an edge, with the steps of which it was made."""

    __slots__ = ("dx", "dy", "dist", "steps", "kind")

    def __init__(self, dx: float, dy: float, dist: float, steps: list[tuple[float, float]], kind: tuple) -> None:
        self.dx, self.dy, self.dist, self.steps, self.kind = dx, dy, dist, steps, kind

    def back(self) -> Leg:
        return Leg(-self.dx, -self.dy, self.dist, [(-x, -y) for x, y in reversed(self.steps)], self.kind)


#: Stands between the two ends of a chain, of which is not known here whether an edge joins them.
ENDS = object()


def together(to_a: Leg, to_b: Leg) -> Leg:
    """The way from a to b through a node with these legs."""
    first = to_a.back()
    return Leg(first.dx + to_b.dx, first.dy + to_b.dy, first.dist + to_b.dist, first.steps + to_b.steps, first.kind)


def contract(order: list, plain: set, legs: dict[object, dict[object, Leg]], last: list | None = None) -> list:
    """Draw chains through ``plain`` nodes together, in their order; the nodes that went.

    A node goes if it has exactly two neighbours, one edge to each, both of one kind and not blocked, and its neighbours
    have no edge yet. Its neighbours keep their numbers of neighbours, so one pass looks at each node once. A node that
    would go but for ENDS between its neighbours stays, and is added to ``last``.
    """
    gone = []
    for n in order:
        if n not in plain or len(legs.get(n, ())) != 2:
            continue
        (a, to_a), (b, to_b) = legs[n].items()
        if to_a is None or to_b is None or to_a.kind != to_b.kind or to_a.kind[1]:
            continue
        if b in legs[a]:
            if legs[a][b] is ENDS:
                last.append(n)
            continue
        whole = together(to_a, to_b)
        del legs[a][n], legs[b][n], legs[n]
        legs[a][b], legs[b][a] = whole, whole.back()
        gone.append(n)
    return gone


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, in_main, is_cut) of each node (graph, id, kind) of graphs with ``edges`` (graph, from_id, to_id)."""

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("id")
        near = adjacency(n["id"].tolist(), list(zip(e["from_id"].tolist(), e["to_id"].tolist())))
        main = main_part(near, {i: JUNCTION_WEIGHT if k == "intersection" else 1 for i, k in zip(n["id"].tolist(), n["kind"].tolist())})
        cuts = cut_points(near)
        return pd.DataFrame({"graph": n["graph"], "id": n["id"], "in_main": [i in main for i in n["id"].tolist()], "is_cut": [i in cuts for i in n["id"].tolist()]})

    a, b = nodes.select("graph", "id", "kind").groupBy("graph"), edges.select(F.col("graph").alias("of_graph"), "from_id", "to_id").groupBy("of_graph")
    return a.cogroup(b).applyInPandas(one, "graph long, id long, in_main boolean, is_cut boolean")


EDGE = "graph long, from_id long, to_id long, dx double, dy double, dist double, path string, blocked boolean, crosswalk boolean, segments array<struct<dx:double,dy:double>>"


#: Nodes of chains that one task holds at a time, or one longer chain; up to so many rows are broadcast, more are shuffled.
CHAIN_NODES, BROADCAST_NODES = 20_000, 200_000
_DRAWN = EDGE.replace("graph long", "graph long, closes long, closed boolean")


def _drawn(e: pd.DataFrame) -> pd.DataFrame:
    """The edges of whole chains after contract(): (graph, closes, closed) and those of EDGE.

    Where a chain's last node, ``closes``, would join its two ends, its edges come both ways: ``closed`` if it goes, and if
    it stays. ``closed`` is null elsewhere.
    """
    legs: dict[tuple, dict[tuple, Leg | None]] = {}
    rows, plain = {}, set()
    for r in e.sort_values(["graph", "chain", "from_id", "to_id"]).itertuples():
        a, b = (r.graph, r.chain, r.from_id), (r.graph, r.chain, r.to_id)
        rows[a, b] = leg = Leg(r.dx, r.dy, r.dist, [(r.dx, r.dy)], (r.path, r.blocked, r.crosswalk))
        legs.setdefault(b, {})
        legs.setdefault(a, {})[b] = leg if r.several == 1 else None
        plain |= {x for x, inner in ((a, r.inner_from), (b, r.inner_to)) if inner}
    ends: dict[tuple, list[tuple]] = {}
    for x in legs.keys() - plain:
        ends.setdefault(x[:2], []).append(x)
    for a, *b in ends.values():
        if b:
            legs[a][b[0]] = legs[b[0]][a] = ENDS
    last: list[tuple] = []
    contract(sorted(plain), plain, legs, last)
    closes = {n[:2]: n for n in last}
    out = []

    def add(a: tuple, b: tuple, leg: Leg, closed: bool | None) -> None:
        n = closes[a[:2]][2] if closed is not None else None
        out.append((a[0], n, closed, a[2], b[2], leg.dx, leg.dy, leg.dist, *leg.kind, [{"dx": x, "dy": y} for x, y in leg.steps]))

    for a, ways in legs.items():
        for b, leg in ways.items():
            if leg is not ENDS:
                add(a, b, leg or rows[a, b], False if a[:2] in closes else None)
    for n in last:
        (a, to_a), (b, to_b) = legs[n].items()
        whole = together(to_a, to_b)
        add(a, b, whole, True)
        add(b, a, whole.back(), True)
    d = pd.DataFrame(out, columns=[x.split()[0] for x in _DRAWN.split(", ")])
    return d.astype({"closes": "Int64", "closed": "boolean"})


def contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges after unnamed junctions that only pass a way on are drawn into it; their steps stay as ``segments``.

    ``nodes``: (graph, id, kind, name); ``edges``: both directions, (graph, from_id, to_id, dx, dy, dist, path, blocked,
    crosswalk). Of several edges between two nodes the greatest stays. Rows without a graph or an id are left out.

    No node's number of neighbours changes, so that only unnamed junctions of two neighbours, met one after the other in
    chains, take part: a chain is work of its own, and all other edges pass. What ties chains together is settled after:
    of those that would join the same two ends the one whose last node comes first does, unless an edge joins them already.
    """
    plain = F.coalesce(F.col("kind") == "intersection", F.lit(False)) & (F.coalesce("name", F.lit("")) == "")
    known = nodes.where("graph IS NOT NULL AND id IS NOT NULL").groupBy("graph", "id").agg(F.max(plain).alias("plain"))
    e = edges.where("from_id <> to_id").select("graph", "from_id", "to_id", *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "dist")], "path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("blocked", "crosswalk")])
    e = e.join(known.select("graph", F.col("id").alias("to_id")), ["graph", "to_id"], "left_semi").join(known.withColumnRenamed("id", "from_id"), ["graph", "from_id"])
    e = e.groupBy("graph", "from_id", "to_id").agg(F.count("*").alias("several"), F.max("plain").alias("plain"), F.max(F.struct("dx", "dy", "dist", "path", "blocked", "crosswalk")).alias("leg"))
    inner = F.col("plain") & (F.count("*").over(Window.partitionBy("graph", "from_id")) == 2)
    legs = materialize(e.select("graph", "from_id", "to_id", "several", "leg.*", inner.alias("inner_from")), "legs")

    small = lambda d, n: F.broadcast(d) if n <= BROADCAST_NODES else d
    key = lambda c: F.struct("graph", F.col(c).alias("id"))
    outward = legs.where("inner_from")
    mids = materialize(outward.select("graph", F.col("from_id").alias("to_id")).distinct().withColumn("inner_to", F.lit(True)), "mids")
    n = mids.count()
    roots = connected(outward.join(small(mids, n), ["graph", "to_id"], "left_semi").select(key("from_id").alias("a"), key("to_id").alias("b")))
    chains = mids.join(roots.select("node.graph", F.col("node.id").alias("to_id"), F.col("root.id").alias("chain")), ["graph", "to_id"], "left").select("graph", F.col("to_id").alias("id"), F.coalesce("chain", "to_id").alias("chain"))
    chains = materialize(chains, "chains")
    flagged = legs.join(small(mids, n), ["graph", "to_id"], "left").withColumn("inner_to", F.coalesce("inner_to", F.lit(False)))
    pieces = flagged.where("inner_from OR inner_to").withColumn("id", F.when(F.col("inner_from"), F.col("from_id")).otherwise(F.col("to_id"))).join(small(chains, n), ["graph", "id"])
    task = F.pmod(F.xxhash64("graph", "chain"), F.lit(max(1, math.ceil(n / CHAIN_NODES))))
    drawn = materialize(pieces.drop("id").groupBy(task.alias("task")).applyInPandas(_drawn, _DRAWN), "drawn")

    closing = drawn.where("closed AND from_id < to_id").select("graph", "from_id", "to_id", "closes")
    direct = legs.where("NOT inner_from").select("graph", "from_id", "to_id").join(small(closing.select("graph", "from_id", "to_id").distinct(), n), ["graph", "from_id", "to_id"], "left_semi")
    first = closing.join(direct, ["graph", "from_id", "to_id"], "left_anti").groupBy("graph", "from_id", "to_id").agg(F.min("closes").alias("closes")).select("graph", "closes", F.lit(True).alias("won"))
    settled = drawn.join(first, ["graph", "closes"], "left").where("closed IS NULL OR closed = coalesce(won, false)")
    columns = [x.split()[0] for x in EDGE.split(", ")]
    passed = flagged.where("NOT inner_from AND NOT inner_to").withColumn("segments", F.array(F.struct("dx", "dy")))
    return passed.select(*columns).unionByName(settled.select(*columns))


def graph_tokens(n_nodes: Column, n_edges: Column) -> Column:
    """About how many tokens a graph of so many nodes and (directed) edges takes."""
    return n_nodes * NODE_TOKENS + n_edges * EDGE_TOKENS + FRAME_TOKENS


def fit(order: list[int], near: dict[int, set[int]], keep_first: list[int], budget: int) -> set[int]:
    """The nodes that stay within ``budget`` tokens.

    ``keep_first`` lists nodes from the most to the least worth keeping. From its end nodes go, unless the rest of their
    component would fall apart, or a landmark next to them would lose its last edge; where no node may go any more, the least
    worth go all the same, so that the answer always fits.
    """
    near = {n: set(near[n]) for n in order}
    limit = max(LEAST_BUDGET, budget) * (1 - OVERHEAD)
    cost = lambda: len(near) * NODE_TOKENS + sum(map(len, near.values())) * EDGE_TOKENS + FRAME_TOKENS

    def drop(n: int) -> None:
        for m in near.pop(n):
            near[m].discard(n)

    while near and cost() > limit:
        cuts = cut_points(near)
        victims = [n for n in reversed(keep_first) if n in near and n not in cuts]
        batch = max(1, math.ceil((cost() - limit) / (NODE_TOKENS + 4 * EDGE_TOKENS) / 4))
        alive = [n for n in reversed(keep_first) if n in near]
        tail = set(alive[: max(1, len(alive) // 4)])  # one round takes no node far above the least worth
        dropped = 0
        for n in victims:
            if dropped and n not in tail:
                break
            if any(len(near[m]) == 1 for m in near[n]) and len(near) > 2:
                continue
            if dropped and n in cut_points(near):
                continue
            drop(n)
            dropped += 1
            if dropped >= batch or cost() <= limit:
                break
        if not dropped:
            drop(next(n for n in reversed(keep_first) if n in near))
    return set(near)


def fitted(nodes: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(graph, id, kept) of nodes (graph, id, kind, name, worth): those that stay when each graph must fit ``budget`` tokens.

    A node of the main component is worth more than any other, a named one more than an unnamed one, then ``worth`` counts, then the lower id.
    """

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("id")
        order = n["id"].tolist()
        near = adjacency(order, list(zip(e["from_id"].tolist(), e["to_id"].tolist())))
        main = main_part(near, {i: JUNCTION_WEIGHT if k == "intersection" else 1 for i, k in zip(order, n["kind"].tolist())})
        rank = sorted(zip(order, n["name"].tolist(), n["worth"].tolist()), key=lambda x: (x[0] not in main, not x[1], -x[2], x[0]))
        kept = fit(order, near, [r[0] for r in rank], budget)
        return pd.DataFrame({"graph": n["graph"], "id": n["id"], "kept": [i in kept for i in order]})

    a, b = nodes.select("graph", "id", "kind", "name", F.col("worth").cast("double").alias("worth")).groupBy("graph"), edges.select(F.col("graph").alias("of_graph"), "from_id", "to_id").groupBy("of_graph")
    return a.cogroup(b).applyInPandas(one, "graph long, id long, kept boolean")


def landmark_score(kind: Column, tags: Column, height: Column) -> Column:
    by_kind = F.when(kind == "transit", 10).when(kind == "poi", 5).when(kind == "building", 3).otherwise(0)
    return by_kind + F.coalesce(F.size(tags), F.lit(0)) * 3 + F.when(height.isNotNull(), 2).otherwise(0)


def omitted_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("omitted"), F.lit(0)).cast("long").alias("omitted_total"))
