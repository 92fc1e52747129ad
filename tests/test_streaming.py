"""Streams over what is there: windows, sessions and operators with state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retrix.streaming import stateful, windows


def stream_of(spark, rows, schema, tmp_path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def results(spark, frame, mode="append"):
    return spark.read.parquet(windows.run_now(frame, mode)).collect()


def test_limit_begins_with_the_first_event(spark, tmp_path):
    rows = [("a", k, float(t), 10) for k, t in enumerate([5, 6, 7, 64, 65, 66])]
    frame = stateful.rate_limited(stream_of(spark, rows, "key string, id long, at double, tokens long", tmp_path), most_requests=2, idle=None)
    assert {r["id"]: r["allowed"] for r in results(spark, frame)} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_limit_of_tokens(spark, tmp_path):
    rows = [("a", 0, 0.0, 60), ("a", 1, 1.0, 60), ("a", 2, 2.0, 30), ("b", 3, 0.0, 100)]
    frame = stateful.rate_limited(stream_of(spark, rows, "key string, id long, at double, tokens long", tmp_path), most_tokens=100, idle=None)
    assert {r["id"]: r["allowed"] for r in results(spark, frame)} == {0: True, 1: False, 2: True, 3: True}


def test_breaker(spark, tmp_path):
    calls = [(0, 0, False), (1, 1, False), (2, 2, True), (3, 62, False), (4, 63, True), (5, 125, True), (6, 126, True)]
    frame = stateful.circuit_breaker(stream_of(spark, [("s", i, float(t), ok) for i, t, ok in calls], "key string, id long, at double, ok boolean", tmp_path), failures=2, idle=None)
    found = {r["id"]: (r["state"], r["executed"]) for r in results(spark, frame)}
    assert found == {0: ("closed", True), 1: ("open", True), 2: ("open", False), 3: ("open", True), 4: ("open", False), 5: ("closed", True), 6: ("closed", True)}


def test_cache_expires(spark, tmp_path):
    frame = stateful.cache_lookups(stream_of(spark, [("k", i, float(t)) for i, t in enumerate([0, 5, 11, 20, 22])], "key string, id long, at double", tmp_path), ttl=10, idle=None)
    assert [r["hit"] for r in sorted(results(spark, frame), key=lambda r: r["id"])] == [False, True, False, True, False]


def test_windows_against_batch(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").count()
    assert {(r["hour"], r["event_type"], r["n"]) for r in windows.hourly_counts(spark, data).collect()} == {tuple(r) for r in batch.collect()}


def test_sessions_come_out_behind_the_watermark(spark, data):
    found = results(spark, stateful.sessions(windows.event_stream(spark, data), "ts", "user_id"))
    assert found and all(r["events"] >= 1 for r in found)


@pytest.mark.parametrize("feedback", [[(1.0, 0.1)] * 8, [(0.0, 0.1)] * 9 + [(1.0, 0.1)] * 3])
def test_weights_are_kept_in_range_at_every_step(spark, feedback):
    rows = spark.createDataFrame([("p", i, s) for i, (s, _) in enumerate(feedback)], "p string, i long, s double")
    assert stateful.folded_weights(rows, "p", "i", "s").first()["weight"] == pytest.approx(stateful.weights(feedback))


def test_state_of_idle_keys_is_dropped():
    class State:
        hasTimedOut, exists, held, waits = False, False, None, None

        def update(self, value):
            self.held, self.exists = value, True

        @property
        def get(self):
            return self.held

        def remove(self):
            self.held, self.exists = None, False

        def setTimeoutDuration(self, milliseconds):
            self.waits = milliseconds

    import pandas as pd

    run, state = stateful._kept(stateful.expiring_cache(10.0), 60.0), State()
    frame = pd.DataFrame({"id": [1, 2], "at": [0.0, 5.0]})
    assert list(next(run(("k",), iter([frame]), state))["hit"]) == [False, True]
    list(run(("k",), iter([frame]), state))
    assert state.waits == 60_000 and state.exists
    state.hasTimedOut = True
    assert list(run(("k",), iter([]), state)) == [] and not state.exists
