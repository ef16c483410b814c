"""Cooldown chains by list ranking against the plain fold: one key with every event, many keys, blocks of a few events."""

import datetime as dt
import random

import pytest

from tessera.operators import cooldown
from tessera.streaming import remediation as RM

T0 = dt.datetime(2024, 1, 1)


def fold(rows):
    """(key, t, fires, last) by one pass per key."""
    out, until, last = [], {}, {}
    for key, t, c in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        fires = t >= until.get(key, t)
        if fires:
            until[key], last[key] = t + c, t
        out.append((key, t, fires, last[key]))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "key string, t long, cooldown long").repartition(6)
    got = [tuple(r) for r in cooldown.fired(df, "key").collect()]
    assert sorted(got, key=str) == sorted(fold(rows), key=str)


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
@pytest.mark.parametrize("keys", [1, 2, 40])
def test_chains(spark, monkeypatch, block, keys):
    monkeypatch.setattr(cooldown, "BLOCK", block)
    rnd = random.Random(block * 100 + keys)
    rows = {(f"k{rnd.randrange(keys)}", rnd.randrange(3000)) for _ in range(600)}
    check(spark, [(k, t, 1 + 37 * int(k[1:]) % 90) for k, t in rows])


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(cooldown, "BLOCK", 4)
    check(spark, [("a", 5, 10)])
    check(spark, [])
    check(spark, [("a", t, 1) for t in range(30)] + [("b", t, 10 ** 9) for t in range(30)])  # all fire; only the first


def test_one_key_uses_many_tasks(spark, monkeypatch):
    """With every event in one key, both passes over the blocks run in many groups, none of them larger than a block."""
    monkeypatch.setattr(cooldown, "BLOCK", 50)
    df = spark.createDataFrame([("a", 3 * t, 7) for t in range(2000)], "key string, t long, cooldown long")
    chain = cooldown._numbered(df, "key")
    sizes = [r["count"] for r in chain.groupBy("block").count().collect()]
    assert len(sizes) == 41 and max(sizes) == 50
    plan = cooldown.fired(df, "key")._jdf.queryExecution().toString()
    assert "hashpartitioning(key" not in plan


def alerts(n, types, seed=1):
    rnd = random.Random(seed)
    return [(T0 + dt.timedelta(seconds=rnd.randrange(6000)), rnd.choice(types), rnd.choice([0.01, 12.0, 7000.0, 200000.0, None]),
             rnd.choice(["m1", "m2", None])) for _ in range(n)]


def remediated_by_force(rows, policies):
    until, out = {}, []
    for ts, typ, value, model in sorted(rows, key=lambda r: (r[1], r[0], r[3] is not None, r[3] or "", r[2] or 0)):
        p = policies.get(typ)
        if p is None or value is None or value < p.trigger_threshold:
            out.append((ts, typ, value, model, False, False, None))
        elif typ in until and ts < until[typ]:
            out.append((ts, typ, value, model, True, True, None))
        else:
            until[typ] = ts + dt.timedelta(seconds=p.cooldown_sec)
            out.append((ts, typ, value, model, True, False, until[typ]))
    return out


@pytest.mark.parametrize("types", [["cost_spike"], ["cost_spike", "dlp_burst", "latency_spike", "other", "free"]])
def test_remediation_by_force(spark, monkeypatch, types):
    monkeypatch.setattr(cooldown, "BLOCK", 32)
    policies = [*RM.DEFAULT_POLICIES, RM.Policy("free", 1.0, ("note",), cooldown_sec=0)]
    rows = alerts(400, types)
    rows += rows[:30]  # repeated alerts
    df = spark.createDataFrame(rows, "ts timestamp_ntz, anomaly_type string, metric_value double, model string")
    got = [tuple(r[c] for c in ("ts", "anomaly_type", "metric_value", "model", "handled", "skipped", "cooldown_until"))
           for r in RM.remediate(df, policies).collect()]
    assert sorted(got, key=str) == sorted(remediated_by_force(rows, {p.anomaly_type: p for p in policies}), key=str)


def test_reasons_and_missing_values(spark):
    rows = [(T0, "cost_spike", 9.0, "m"), (T0 + dt.timedelta(seconds=100), "cost_spike", 9.0, "m"), (None, "cost_spike", 9.0, "m"),
            (T0, None, 1.0, None), (T0, "cost_spike", None, "x")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, anomaly_type string, metric_value double, model string")
    got = {(r["ts"], r["anomaly_type"], r["metric_value"]): r["reason"] for r in RM.remediate(df).collect()}
    assert got == {(T0, "cost_spike", 9.0): None, (T0 + dt.timedelta(seconds=100), "cost_spike", 9.0): "cooldown active (500s remaining)",
                   (None, "cost_spike", 9.0): "no time", (T0, None, 1.0): "unknown anomaly_type: None",
                   (T0, "cost_spike", None): "value None < threshold 5.0"}


def test_suppression_by_force(spark, monkeypatch):
    monkeypatch.setattr(cooldown, "BLOCK", 16)
    rows = [(T0 + dt.timedelta(seconds=7 * k % 900), None if k % 5 == 0 else f"k{k % 3}", float(k % 4), "m") for k in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, anomaly_type string, metric_value double, model string")
    got = sorted(map(tuple, RM.suppress(df, seconds=60).select("ts", "anomaly_type", "metric_value", "model", "emitted").collect()), key=str)
    last, expected = {}, []
    for ts, typ, value, model in sorted(rows, key=lambda r: (str(r[1]), r[0], r[2])):
        emitted = typ not in last or ts >= last[typ] + dt.timedelta(seconds=60)
        if emitted:
            last[typ] = ts
        expected.append((ts, typ, value, model, emitted))
    assert got == sorted(expected, key=str)
    assert RM.suppress(df.limit(0)).count() == 0
    assert RM.suppress(df, seconds=0).filter("emitted").count() == 300
