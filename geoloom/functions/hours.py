"""Opening hours: whether a place is open at an instant, by its published rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
CLOCK = r"([0-9]{1,2}):?([0-9]{2})"
SPAN = re.compile(rf"{CLOCK}[ \t]*-[ \t]*{CLOCK}")
NO_HOURS, NO_DAY = "no opening hours recorded", "no hours listed for this day"


def days_of(selector: str) -> set[int]:
    """The weekdays a rule is for; 0 is Monday. Ranges wrap around the week, what is no weekday counts for none."""
    out: set[int] = set()
    for part in selector.split(","):
        ends = [DAYS.index(d) if d in DAYS else None for d in (x.strip() for x in part.split("-", 1))]
        if None not in ends:
            out |= {(ends[0] + i) % 7 for i in range((ends[-1] - ends[0]) % 7 + 1)}
    return out


def without_remarks(spec: str) -> str:
    """``spec`` without what stands in parentheses, so that a semicolon there parts no rules."""
    out, depth = [], 0
    for c in spec:
        depth += c == "("
        if not depth:
            out.append(c)
        elif c == ")":
            depth -= 1
            out.append(" ")
    return "".join(out)


def rule_for(spec: str, day: int) -> str | None:
    """The body of the last rule with a selector that covers ``day``, in lower case."""
    found = None
    for rule in without_remarks(spec.lower()).split(";"):
        selector, space, body = rule.strip().partition(" ")
        if space and day in days_of(selector):
            found = body.strip()
    return found


def windows(rule: str | None) -> list[tuple[int, int]]:
    """Minutes (from, to) at which a rule opens. A window that ends at or before its start runs past midnight."""
    spans = [(int(a) * 60 + int(b), int(c) * 60 + int(d)) for a, b, c, d in SPAN.findall(rule or "")]
    return [(a, b if b > a else b + 1440) for a, b in spans]


def state(spec: str | None, day: int, minute: int) -> tuple[bool | None, str]:
    """(open, phrase): None where the rules do not say, and what to tell of it. ``day``: 0 is Monday.

    The night after a window that runs past midnight belongs to it. A rule whose windows cannot be read says nothing.
    """
    text = (spec or "").strip()
    if not text:
        return None, NO_HOURS
    if text.lower() == "24/7":
        return True, "00:00-24:00"
    if text.lower() in ("off", "closed"):
        return False, "always closed"
    rule = rule_for(text, day)
    if rule is None:
        return None, NO_DAY
    if rule in ("off", "closed"):
        return False, "closed on this day"
    today, night = windows(rule), [b - 1440 for _, b in windows(rule_for(text, (day - 1) % 7)) if b > 1440]
    if not today:
        return None, rule
    is_open_now = any(a <= minute < b for a, b in today) or any(minute < b for b in night)
    if len(today) == 1 and not night and today[0][1] <= 1440 and is_open_now:
        return True, "-".join(f"{m // 60 % 24:02d}:{m % 60:02d}" for m in today[0])
    single = len(today) == 1 and not night and today[0][1] <= 1440
    return is_open_now, "open" if is_open_now else "closed" if single else rule


def is_open(spec: str | None, day: int, minute: int) -> bool | None:
    return state(spec, day, minute)[0]


def _local_minutes(instant: Column, offset_minutes: int) -> Column:
    """Whole local minutes since a Monday, 1969-12-29."""
    return F.floor(F.unix_timestamp(instant) / 60).cast("long") + offset_minutes + 3 * 1440


def opening(spec: Column, instant: Column, offset_minutes: int) -> Column:
    """(open, phrase) of ``spec`` at ``instant`` (UTC) on a local clock ``offset_minutes`` from UTC; a null instant gives null."""

    @F.pandas_udf("open boolean, phrase string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for specs, minutes in batches:
            rows = [state(s, int(m) // 1440 % 7, int(m) % 1440) if pd.notna(m) else (None, None) for s, m in zip(specs, minutes, strict=True)]
            yield pd.DataFrame({"open": pd.Series([r[0] for r in rows], dtype="object"), "phrase": pd.Series([r[1] for r in rows], dtype="object")})

    return run(spec, _local_minutes(instant, offset_minutes))


def open_at(spec: Column, instant: Column, offset_minutes: int) -> Column:
    """Whether ``spec`` is open at ``instant``; null if unknown."""
    return opening(spec, instant, offset_minutes)["open"]
