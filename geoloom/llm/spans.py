"""Spans of patterns in texts, and trees of trained forests, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.llm.common import let, running_sums

#: Characters of context kept on either side of a span.
CONTEXT = 32
SPAN = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"


def matches(text: Column, pattern: str, over: bool = False) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` with start, end (code points, exclusive), text and context.

    Matches and the gaps between them come from two passes of the same pattern; positions are running sums of lengths.
    Context ends at the neighbouring matches, or with ``over`` takes in the one on either side. Null text has none.
    ``pattern`` must not match the empty string.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def around(g: Column, i: Column) -> tuple[Column, Column]:
            if not over:
                return F.get(g, i), F.get(g, i + 1)
            near = lambda j: F.coalesce(F.get(found, j), F.lit(""))
            return F.concat(near(i - 1), F.get(g, i)), F.concat(F.get(g, i + 1), near(i + 1))

        def at(g: Column) -> Column:
            ends = running_sums(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(g, i))))
            return F.transform(F.arrays_zip(found.alias("m"), ends.alias("e")), lambda x, i: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("text"), F.right(around(g, i)[0], F.lit(CONTEXT)).alias("before"), F.left(around(g, i)[1], F.lit(CONTEXT)).alias("after")))

        return let(gaps, at)

    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m).cast(f"array<{SPAN}>")).otherwise(none))


def trees(description: str, values: list[Column]) -> list[Column]:
    """Each tree of a trained forest's ``toDebugString`` as a column over the features' ``values``."""
    out: list[Column] = []
    lines = [x.strip() for x in description.splitlines()]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        if not m:
            raise ValueError(f"no tree node: {line}")
        yes = node()
        at += 1  # Else (...)
        return F.when(values[int(m[1])] <= F.lit(float(m[2])), yes).otherwise(node())

    while at < len(lines):
        at += 1
        if lines[at - 1].startswith("Tree "):
            out.append(node())
    return out


def bound(values: list[Column], body: Callable[[list[Column]], Column]) -> Column:
    """``body(values)`` with each value evaluated once, however many nodes of trees look at it."""
    fields = [f"f{i}" for i in range(len(values))]
    return let(F.struct(*[v.alias(f) for f, v in zip(fields, values, strict=True)]), lambda x: body([x[f] for f in fields]))


def total(columns: list[Column]) -> Column:
    """Their sum, as a balanced expression."""
    while len(columns) > 1:
        columns = [columns[i] + columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def pick(options: list[str], key: Column) -> Column:
    """One of ``options`` by a hashed key."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


def digits(n: int, *key: Column) -> Column:
    """``n`` pseudo-random digits, n at most 12."""
    return F.lpad(F.pmod(F.xxhash64(*key), F.lit(10**n)).cast("string"), n, "0")
