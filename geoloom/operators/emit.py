"""The graph as YAML text: a line for each node and edge, and whole documents of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import yaml_scalar


def _field(name: str, value: Column) -> Column:
    """``name: value``, or null where there is no value."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))


def node_line(id_: Column, kind: Column, name: Column, tags: Column, height: Column) -> Column:
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("["), F.array_join(F.transform(tags, yaml_scalar), ", "), F.lit("]")))
    body = F.concat_ws(", ", _field("kind", kind), _field("name", yaml_scalar(name)), _field("tags", listed), _field("height", height))
    return F.concat(F.lit("  n"), id_.cast("string"), F.lit(": { "), body, F.lit(" }"))


def edge_line(from_id: Column, to_id: Column, metres: Column, word: Column, path: Column, crosswalk: Column, blocked: Column) -> Column:
    told = lambda flag, name: F.when(F.coalesce(flag, F.lit(False)), F.lit(f"{name}: true"))
    body = F.concat_ws(", ", F.concat(F.lit("from: n"), from_id.cast("string")), F.concat(F.lit("to: n"), to_id.cast("string")), F.concat(F.lit("dist: "), F.floor(metres + 0.5).cast("string"), F.lit("m")), _field("dir", word), _field("path", yaml_scalar(path)), told(crosswalk, "crosswalk"), told(blocked, "blocked"))
    return F.concat(F.lit("  - { "), body, F.lit(" }"))


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, text) of node lines (graph, ord, line) and edge lines (graph, ord, line)."""
    head = lambda name: F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n"))
    a = nodes.groupBy("graph").agg(head("nodes").alias("n"))
    b = edges.groupBy("graph").agg(head("edges").alias("e"))
    return a.join(b, "graph", "left").select("graph", F.concat(F.concat_ws("\n", "n", "e"), F.lit("\n")).alias("text"))
