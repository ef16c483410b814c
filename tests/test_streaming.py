"""Streaming operators: remediation fixture, and stream == batch on a file source (availableNow)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tessera.streaming import core as ST
from tessera.streaming import remediation as RM

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
ALERTS = [
    (T0, "cost_spike", 8.50, "m"), (T0 + dt.timedelta(seconds=10), "latency_spike", 6200.0, "m"),
    (T0 + dt.timedelta(seconds=20), "error_rate_high", 0.22, "m"), (T0 + dt.timedelta(seconds=30), "dlp_burst", 15.0, None),
    (T0 + dt.timedelta(seconds=40), "cost_spike", 1.00, "m"), (T0 + dt.timedelta(seconds=50), "cost_spike", 9.0, "m"),
    (T0 + dt.timedelta(seconds=60), "other", 1.0, "m"), (T0 + dt.timedelta(seconds=700), "cost_spike", 9.0, "m"),
]
SCHEMA = "ts timestamp_ntz, anomaly_type string, metric_value double, model string"


def test_remediation_fixture(spark):
    d = RM.remediate(spark.createDataFrame(ALERTS, SCHEMA)).orderBy("ts").collect()
    got = [(r["anomaly_type"], r["handled"], r["skipped"], r["cooldown_sec"]) for r in d]
    assert got == [("cost_spike", True, False, 600), ("latency_spike", True, False, 300),
                   ("error_rate_high", True, False, 900), ("dlp_burst", True, False, 1800),
                   ("cost_spike", False, False, None), ("cost_spike", True, True, None), ("other", False, False, None),
                   ("cost_spike", True, False, 600)]
    assert d[4]["reason"].startswith("value 1.0 < threshold 5.0")
    assert d[6]["reason"] == "unknown anomaly_type: other"


def test_weight_timeline(spark):
    w = RM.weight_timeline(RM.remediate(spark.createDataFrame(ALERTS, SCHEMA))).orderBy("ts", "cause").collect()
    first = w[0]
    assert first["cause"] == "cost_spike" and round(first["cost_weight"], 6) == 0.6 and round(first["quality_weight"], 6) == 0.3
    restore = [r for r in w if r["cause"] == "restore"][0]
    assert restore["ts"] == T0 + dt.timedelta(seconds=600)
    assert (restore["cost_weight"], restore["quality_weight"], restore["speed_weight"]) == (0.3, 0.5, 0.2)


def test_weight_timeline_by_force(spark):
    """Against one pass over the line: several spikes, errors and latency alerts around the limits."""
    import random
    rnd = random.Random(2)
    rows = sorted({(T0 + dt.timedelta(seconds=rnd.randrange(20000)), rnd.choice(["cost_spike", "latency_spike", "error_rate_high", "error_rate_high", "dlp_burst"]))
                   for _ in range(60)})
    df = spark.createDataFrame([(t, a, True, False) for t, a in rows], "ts timestamp_ntz, anomaly_type string, handled boolean, skipped boolean")
    got = sorted(map(tuple, RM.weight_timeline(df).collect()))
    line = sorted([(t, 1, a) for t, a in rows if a != "dlp_burst"] + [(t + dt.timedelta(seconds=600), 0, "restore") for t, a in rows if a == "cost_spike"])
    w, saved, expected = [0.3, 0.5, 0.2], None, []
    for t, _, cause in line:
        if cause == "restore":
            w = list(saved)
        elif cause == "cost_spike":
            saved = saved or list(w)
            w = [w[0] + 0.3, w[1] - 0.2, w[2]]
        elif cause == "latency_spike":
            w[2] = min(0.6, w[2] + 0.2)
        else:
            w = [max(0.1, w[0] - 0.1), min(0.7, w[1] + 0.1), w[2]]
        expected.append((t, cause, *[round(x, 6) for x in w]))
    assert [(a[0], a[1]) for a in got] == [(a[0], a[1]) for a in sorted(expected)]
    assert all(abs(x - y) < 2e-6 for a, b in zip(got, sorted(expected)) for x, y in zip(a[2:], b[2:]))


def test_cache_replay_by_force(spark):
    import random

    from tessera.operators import routing as RT
    rnd = random.Random(6)
    rows = [(f"r{k:03d}", T0 + dt.timedelta(seconds=rnd.randrange(300)), rnd.choice(["p", "q"]), "m", rnd.choice([0.0, 0.0, 0.7, None])) for k in range(200)]
    got = {r["request_id"]: (r["cache_hit"], r["entry_written_at"]) for r in RT.exact_cache_replay(
        spark.createDataFrame(rows, "request_id string, ts timestamp_ntz, prompt string, model string, temperature double"), ttl_seconds=40).collect()}
    until, expected = {}, {}
    for i, t, p, _, temp in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (p, temp or 0.0)
        hit = key in until and t < until[key]
        write = not hit and not (temp or 0.0) > 0
        if write:
            until[key] = t + dt.timedelta(seconds=40)
        expected[i] = (hit, t if write else None)
    assert got == expected


def _write_parts(spark, rows, schema, n_parts):
    path = tempfile.mkdtemp(prefix="tessera-stream-")
    df = spark.createDataFrame(rows, schema)
    df.repartition(n_parts).write.mode("overwrite").parquet(os.path.join(path, "in"))
    return os.path.join(path, "in"), path


def _run_stream(spark, sdf, root, name, mode="append"):
    q = (sdf.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", os.path.join(root, "ckpt-" + name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_remediation_stream_equals_batch(spark):
    inp, root = _write_parts(spark, ALERTS, SCHEMA, 1)
    stream = spark.readStream.schema(SCHEMA).parquet(inp)
    out = _run_stream(spark, RM.remediate_stream(stream), root, "remed_eq")
    batch = RM.remediate(spark.read.parquet(inp))
    cols = ["ts", "anomaly_type", "handled", "skipped", "cooldown_sec"]
    assert sorted(map(tuple, out.select(*cols).collect()), key=str) == sorted(map(tuple, batch.select(*cols).collect()), key=str)


def test_timechart_stream_equals_batch(spark):
    rows = [(dt.datetime(2024, 1, 1, h, m), "mcp_llm_call", "gpt-4o", 0.01 * (h + m), 100.0 + m, True)
            for h in range(3) for m in range(0, 60, 7)]
    schema = "timestamp timestamp_ntz, event_type string, model string, cost_usd double, latency_ms double, success boolean"
    inp, root = _write_parts(spark, rows, schema, 3)
    stream = spark.readStream.schema(schema).parquet(inp)
    out = _run_stream(spark, ST.stream_timechart(stream, "1 hour", "0 seconds", by="model"), root, "tc_eq")
    batch = ST.stream_timechart(spark.read.parquet(inp), "1 hour", by="model")
    # the watermark closes every window but the last, which a finished stream flushes only when it advances
    got = {r["window_start"]: r["calls"] for r in out.collect()}
    want = {r["window_start"]: r["calls"] for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_dedupe_stream(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0)), (1, dt.datetime(2024, 1, 1, 0, 1)), (2, dt.datetime(2024, 1, 1, 0, 2))]
    schema = "event_id long, timestamp timestamp_ntz"
    inp, root = _write_parts(spark, rows, schema, 1)
    out = _run_stream(spark, ST.dedupe_events(spark.readStream.schema(schema).parquet(inp)), root, "dd_eq")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2]


def test_suppression(spark):
    s = RM.suppress(spark.createDataFrame(ALERTS, SCHEMA), "anomaly_type", 600).filter("anomaly_type = 'cost_spike'")
    assert [r["emitted"] for r in s.orderBy("ts").collect()] == [True, False, False, True]
