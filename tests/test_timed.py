"""Streams with timers: out of order, restarted, late, idle."""

import random

import pytest

from folioframe.streaming import streams, timed


def feed(spark, path, batches, columns):
    """Each batch as one file, in order."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(path))
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("seen"):
                os.rename(path / f, path / f"seen{i:03d}-{f}")
        time.sleep(0.01)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)).selectExpr("* except (t)", "timestamp_micros(cast(t * 1000000 as bigint)) ts")


def limited(rows, seconds, limit):
    held, out = {}, []
    for mode, i, t, n in sorted(rows, key=lambda r: (r[2], r[1])):
        held[mode] = [(s, m) for s, m in held.get(mode, []) if s >= t - seconds]
        ok = limit == 0 or sum(m for _, m in held[mode]) + n <= limit
        held[mode] += [(t, n)] if ok else []
        out.append((mode, i, t, n, ok))
    return sorted(out, key=str)


@pytest.fixture(autouse=True)
def provider(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rolling_limits_in_event_time(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c"]), i, 1000.0 + rng.randrange(400), rng.randrange(1, 30)) for i in range(120)]
    rows.sort(key=lambda r: r[2] + rng.uniform(-15, 15))  # at most 30 seconds out of order
    schema = "mode string, id long, t double, tokens long"
    feed(spark, tmp_path / "in", [rows[:40], rows[40:80]], schema)
    out = lambda: streams.drain(timed.rolling_limit(stream(spark, tmp_path / "in", schema), 60, 100, "40 seconds"), str(tmp_path / "out"), "append", str(tmp_path / "cp"))
    first = out().count()
    assert 0 < first < 80
    feed(spark, tmp_path / "in", [rows[80:], [("z", 999, 10_000.0, 1)], [("a", 1000, 5.0, 1)]], schema)  # the last one comes too late
    got = [tuple(r) for r in out().collect()]
    assert sorted((r for r in got if r[1] < 999), key=str) == limited(rows, 60, 100)
    assert not any(r[1] == 1000 for r in got)


def test_idle_keys_are_forgotten(spark, tmp_path):
    schema = "mode string, id long, t double, tokens long"
    feed(spark, tmp_path / "in", [[(f"k{i}", i, 1.0 + i, 5) for i in range(50)], [("end", 99, 5000.0, 1)], [("end", 100, 9000.0, 1)]], schema)
    df = timed.rolling_limit(stream(spark, tmp_path / "in", schema), 60, 100)
    query = df.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].customMetrics for p in query.recentProgress if p.stateOperators]
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert spark.table("idle").count() >= 51 and rows[-1] < 10 < max(rows), (rows, held[-1:])


def test_calls_are_told_once(spark, tmp_path):
    schema = "call_id string, seq long, delta string, last boolean, t double"
    calls = {"a": "hello world", "b": "x", "c": "never ends", "d": "gap here"}
    parts = [(k, i, w, i == len(t) - 1 and k != "c", 10.0 + i) for k, t in calls.items() for i, w in enumerate(t) if not (k == "d" and i == 3)]
    random.Random(2).shuffle(parts)
    feed(spark, tmp_path / "in", [parts[:9], parts[9:20] + parts[:3]], schema)
    run = lambda: {r.call_id: (r.text, r.n, r.complete) for r in streams.drain(timed.joined_calls(stream(spark, tmp_path / "in", schema), 100, "60 seconds"), str(tmp_path / "out"), "append", str(tmp_path / "cp")).collect()}
    run()
    feed(spark, tmp_path / "in", [parts[20:], [("end", 0, "e", True, 50.0)], [("end2", 0, None, True, 500.0)], [("end3", 0, "f", True, 900.0)]], schema)
    got = run()
    assert got["a"] == ("hello world", 11, True) and got["b"] == ("x", 1, True) and got["end"] == ("e", 1, True) and got["end2"] == ("", 1, True)
    assert got["c"] == ("never ends", 10, False) and got["d"] == ("gaphere", 7, False)
