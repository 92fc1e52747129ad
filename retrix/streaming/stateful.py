"""Operators with state: rate limits from the first event on, circuit breakers, entries that expire, debounced files.

The state of a key that has had no events for a time (``idle`` seconds on the clock of the run, far longer than what the
state tells of) is dropped, so the state doesn't grow with all keys that ever were. A run over what is there now
(trigger availableNow) would wait for that for ever: it takes ``idle=None``, and keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _kept(run, idle: float):
    """A state function that drops the state of a key without events for ``idle`` seconds."""

    def with_timeout(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from run(key, frames, state)
        state.setTimeoutDuration(int(idle * 1000))

    return with_timeout


def _stateful(stream: DataFrame, run, output: str, held: str, idle: float | None) -> DataFrame:
    if idle is None:
        return stream.groupBy("key").applyInPandasWithState(run, output, held, "append", GroupStateTimeout.NoTimeout)
    return stream.groupBy("key").applyInPandasWithState(_kept(run, idle), output, held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def limiter(window: float = 60.0, most_requests: int = 60, most_tokens: int = 100_000):
    """State function of a fixed window that begins with its first event, not on the clock: (start, requests, tokens)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, requests, used = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        allowed = []
        for at, tokens in zip(rows["at"].astype("int64") / 1e9 if str(rows["at"].dtype).startswith("datetime") else rows["at"], rows["tokens"]):
            if start is None or at - start >= window:
                start, requests, used = float(at), 0, 0
            fits = requests + 1 <= most_requests and used + int(tokens) <= most_tokens
            if fits:
                requests, used = requests + 1, used + int(tokens)
            allowed.append(fits)
        state.update((start, requests, used))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "allowed": allowed})

    return run


def rate_limited(stream: DataFrame, idle: float | None = 3600.0, **how) -> DataFrame:
    """Which requests (``key``, ``id``, ``at`` in seconds, ``tokens``) a limit lets through: ``key``, ``id``, ``allowed``."""
    return _stateful(stream, limiter(**how), "key string, id long, allowed boolean", "start double, requests long, used long", idle)


def breaker(failures: int = 5, recovery: float = 60.0):
    """State function of a circuit breaker: closed, open after so many failures in a row, half open after the recovery."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, count, since = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for at, good in zip(rows["at"], rows["ok"]):
            if mode == "open" and at - since >= recovery:
                mode = "half_open"
            if mode == "open":
                out.append(("open", False))
                continue
            if good:
                mode, count = "closed", 0
            else:
                count += 1
                if mode == "half_open" or count >= failures:
                    mode, since = "open", float(at)
            out.append((mode, True))
        state.update((mode, count, since))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "state": [m for m, _ in out], "executed": [e for _, e in out]})

    return run


def circuit_breaker(stream: DataFrame, idle: float | None = 86_400.0, **how) -> DataFrame:
    """State after each call (``key``, ``id``, ``at`` in seconds, ``ok``), and whether it was let through."""
    return _stateful(stream, breaker(**how), "key string, id long, state string, executed boolean", "mode string, count long, since double", idle)


def expiring_cache(ttl: float = 86_400.0):
    """State function of a cache: each look-up tells whether an entry written less than ``ttl`` seconds ago is there."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        hits = []
        for at in rows["at"]:
            hit = written is not None and at - written < ttl
            hits.append(hit)
            if not hit:
                written = float(at)
        state.update((written,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "hit": hits})

    return run


def cache_lookups(stream: DataFrame, idle: float | None = 172_800.0, **how) -> DataFrame:
    """Hits and misses of look-ups (``key``, ``id``, ``at`` in seconds); a miss writes the entry."""
    return _stateful(stream, expiring_cache(**how), "key string, id long, hit boolean", "written double", idle)


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by gap; a session comes out once the watermark has passed its end."""
    rows = stream.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))


def new_paths(stream: DataFrame, path_col: str = "path", time_col: str = "modificationTime", late: str = "10 minutes") -> DataFrame:
    """Each path once within the watermark: what a queue of changed files hands on."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([path_col])


def weights(feedback: list[tuple[float, float]], start: float = 0.5) -> float:
    """A pattern's weight after feedback (satisfaction, rate) in order; each step is kept between 0.1 and 1."""
    value = start
    for satisfaction, rate in feedback:
        value = min(1.0, max(0.1, value + rate * (satisfaction - 0.5)))
    return value


def folded_weights(rows: DataFrame, by: str, order: str, satisfaction: str, rate: float = 0.1, start: float = 0.5) -> DataFrame:
    """The same as a fold in the engine: ``by`` and ``weight``."""
    ordered = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(satisfaction).alias("s")))).alias("f"))
    step: Any = lambda acc, x: F.least(F.lit(1.0), F.greatest(F.lit(0.1), acc + rate * (x["s"] - 0.5)))
    return ordered.select(by, F.round(F.aggregate("f", F.lit(start), step), 9).alias("weight"))
