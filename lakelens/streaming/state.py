"""Keyed state that expires, and a circuit breaker, as arbitrary stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CACHE = "key string, at timestamp, value string, hit boolean"
BREAKER = "key string, at timestamp, ok boolean, allowed boolean, state string"


def cached(rows: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """rows(key, at, value): the first value of a key is kept for a while; later rows within it get that value and count as hits. A key that is not met again for that long leaves the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, since = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            now = r.at.timestamp()
            hit = since is not None and now - since < seconds
            if not hit:
                held, since = r.value, now
            out.append((key[0], r.at, held, hit))
        state.update((held, since))
        state.setTimeoutTimestamp(max(int((since + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "value", "hit"])

    return rows.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, CACHE, "value string, since double", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(rows: DataFrame, failures: int = 5, open_seconds: int = 60, idle_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """rows(key, at, ok): after so many failures in a row calls are refused for a while, then one trial is let through. A key without calls for a day starts anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, opened = state.get if state.exists else (0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            now, mode = r.at.timestamp(), "closed"
            if opened:
                mode = "open" if now - opened < open_seconds else "half_open"
            if mode != "open":
                if r.ok:
                    count, opened = 0, 0.0
                else:
                    count += 1
                    if mode == "half_open" or count >= failures:
                        opened = now
            out.append((key[0], r.at, r.ok, mode != "open", mode))
        state.update((count, opened))
        state.setTimeoutTimestamp(max(int((now + idle_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "ok", "allowed", "state"])

    return rows.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, BREAKER, "count int, opened double", "append", GroupStateTimeout.EventTimeTimeout)
