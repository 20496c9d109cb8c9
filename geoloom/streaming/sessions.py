"""Streams with state of their own: rate limits from the first hit on, and changes of a session's view."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(hits: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed) of a stream of hits (key, ts): the first ``most`` of each window are allowed.

    A key's window begins with the first hit after the last window's end and lasts ``seconds``. Hits of one batch count in
    the order of their times. Hits later than the watermark, a window behind the latest, go, and so does the state of keys
    whose last window ended before it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed = []
        for t in (rows["ts"].astype("int64") // 1_000 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            if start is None or t >= start + seconds * 1_000_000:
                start, n = t, 0
            n += 1
            allowed.append(n <= most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start // 1000 + 2 * seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "ts": rows["ts"].values, "allowed": allowed})

    return hits.select("key", "ts").withWatermark("ts", f"{seconds} seconds").groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def session_changes(views: DataFrame) -> DataFrame:
    """(session, view, op, id) of a stream of views (session, view, ids, hashes): what each adds, removes or changes.

    ``ids`` are the features that a view shows, ``hashes`` one number for each that changes with it. Views of a session
    count in their order; the state of a session is its last view.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        out = []
        for view, ids, hashes in pd.concat(list(batches)).sort_values("view")[["view", "ids", "hashes"]].itertuples(index=False):
            now = dict(zip(map(int, ids), map(int, hashes)))
            for i in sorted(now.keys() | last.keys()):
                op = "+" if i not in last else "-" if i not in now else "~" if now[i] != last[i] else None
                if op:
                    out.append((key[0], int(view), op, i))
            last = now
        state.update((list(last), list(last.values())))
        yield pd.DataFrame(out, columns=["session", "view", "op", "id"])

    return views.groupBy("session").applyInPandasWithState(run, "session string, view long, op string, id long", "ids array<long>, hashes array<long>", "append", GroupStateTimeout.NoTimeout)
