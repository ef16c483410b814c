"""Sources and sinks: telemetry JSON, document folders, audit log, vouchers, ingest + dispatch streams."""

import datetime as dt
import json
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from tessera.operators import reports as R
from tessera.sources import connectors as C
from tessera.sources import telemetry as TEL
from tessera.streaming import core as ST


def test_read_telemetry_json_and_enrich(spark):
    d = tempfile.mkdtemp(prefix="tessera-tel-")
    rows = [{"event_type": "mcp_llm_call", "timestamp": "2024-01-01T00:00:00Z", "event_id": "e1", "model": "claude-3-haiku",
             "prompt_tokens": 10, "completion_tokens": 5, "cost_usd": 0.1, "latency_ms": 10.0, "success": True},
            {"event_type": "mcp_tool_call", "timestamp": "2024-01-01T00:00:01Z", "event_id": "e2", "tool_name": "web",
             "latency_ms": 30.0, "success": False}]
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    df = TEL.enrich_llm_events(TEL.read_telemetry(spark, d))
    r = {x["event_id"]: x for x in df.collect()}
    assert r["e1"]["provider"] == "anthropic" and r["e1"]["total_tokens"] == 15
    assert r["e2"]["provider"] is None
    stats = {x["tool_name"]: x for x in R.tool_statistics(df).collect()}
    assert stats["web"]["calls"] == 1 and stats["web"]["success_rate"] == 0.0


def test_read_documents_with_acl(spark):
    root = tempfile.mkdtemp(prefix="tessera-docs-")
    os.makedirs(os.path.join(root, "sub"))
    open(os.path.join(root, "a.txt"), "w").write("hello")
    open(os.path.join(root, "sub", "b.md"), "w").write("world")
    open(os.path.join(root, "sub", "b.md.acl"), "w").write("grp:sales, usr:E1 ,")
    open(os.path.join(root, "c.bin"), "w").write("x")
    got = {r["external_id"]: (r["title"], r["content"], list(r["acl"])) for r in C.read_documents(spark, root).collect()}
    assert got == {"a.txt": ("a", "hello", []), "sub/b.md": ("b", "world", ["grp:sales", "usr:E1"])}


def test_audit_log_roundtrip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-audit-"), "log")
    df = spark.createDataFrame([("2024-01-01 00:00:00", "tool_call", "u1", "t", "a", "ok", "{}"),
                                ("2024-01-01 00:00:05", "security_violation", "u2", "t", "a", "blocked", "{}")],
                               "timestamp string, event_type string, user_id string, tool_name string, action string, "
                               "result string, details string").withColumn("timestamp", F.to_timestamp("timestamp"))
    C.write_audit(df, path)
    back = C.read_audit(spark, path, user_id="u2")
    assert [r["event_type"] for r in back.collect()] == ["security_violation"]
    s = {(r["dimension"], r["key"]): r for r in R.audit_summary(C.read_audit(spark, path)).collect()}
    assert s[("event_type", "tool_call")]["count"] == 1 and s[("user", "u2")]["security_violations"] == 1


def test_vouchers(spark):
    v = spark.createDataFrame([(json.dumps({"voucher_no": 7, "order_id": "o1", "amount": "12.5"}),)], "payload string")
    r = C.normalize_vouchers(v, "voucher").first()
    assert (r["external_id"], r["order_id"], r["amount"], r["currency"], r["kind"]) == ("7", "o1", 12.5, "KRW", "sale")
    i = spark.createDataFrame([(json.dumps({"Id": "9", "PrivateNote": "order o2", "TotalAmt": 3}),)], "payload string")
    r = C.normalize_vouchers(i, "invoice").first()
    assert (r["order_id"], r["currency"], r["amount"]) == ("o2", "USD", 3.0)


def test_campaign_summary(spark):
    m = spark.createDataFrame([("1", "meta", 1000, 10, 100.0, 2), ("2", "google", 0, 0, 0.0, 0)],
                              "campaign_id string, channel string, impressions long, clicks long, spend double, conversions long")
    r = R.campaign_summary(m).first()
    assert (r["ctr"], r["cpa"]) == (0.01, 50.0)
    assert R.campaign_summary(m, "google").first()["cpa"] == 0.0


def test_ingest_sink_and_metrics(spark):
    src = tempfile.mkdtemp(prefix="tessera-in-")
    with open(os.path.join(src, "e.json"), "w") as f:
        f.write(json.dumps({"event_type": "mcp_llm_call", "timestamp": "2024-01-01T00:00:00", "event_id": "x"}))
    out, ck = tempfile.mkdtemp(prefix="tessera-out-"), tempfile.mkdtemp(prefix="tessera-ck-")
    q = ST.start_sink(ST.telemetry_stream(spark, src), out, ck, trigger=None)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 1
    assert ST.ingest_metrics(q).agg(F.sum("input_rows")).first()[0] == 1


ACTIVITIES = "id string, type string, subject_type string, subject_id string"


def _outbox(spark, root, handlers, **more):
    stream = spark.readStream.schema(ACTIVITIES).parquet(os.path.join(root, "acts"))
    paths = [os.path.join(root, x) for x in ("processed", "out", "dead", "ck")]
    ST.dispatch_stream(stream, handlers, *paths, **more).awaitTermination()


def _strict(a):
    """A handler that fails when its output is written, for subjects that are no numbers."""
    return a.select("id", F.col("subject_id").cast("int").alias("n"))


def test_dispatch_stream_isolates_single_events(spark):
    root = tempfile.mkdtemp(prefix="tessera-dispatch-")
    rows = [(f"a{k}", "as.opened", "as", "x" if k in (3, 11) else str(k)) for k in range(20)] + [("b1", "delivery.done", "order", "7"), ("c1", "note", "order", "1")]
    spark.createDataFrame(rows, ACTIVITIES).write.parquet(os.path.join(root, "acts"))

    def raising(a):
        raise RuntimeError("no route")

    _outbox(spark, root, {("as.opened", "as"): _strict, ("delivery.done", "order"): raising})
    out = spark.read.parquet(os.path.join(root, "out", "as.opened__as"))
    assert {r["n"] for r in out.collect()} == set(range(20)) - {3, 11}
    dead = {r["id"]: r["error"] for r in spark.read.parquet(os.path.join(root, "dead")).collect()}
    assert set(dead) == {"a3", "a11", "b1"} and "no route" in dead["b1"]
    assert spark.read.parquet(os.path.join(root, "processed")).count() == 22
    again = spark.read.parquet(os.path.join(root, "dead"))
    ST.redeliver(again, {("as.opened", "as"): lambda a: a.select("id", F.lit(-1).alias("n"))}, os.path.join(root, "out"), os.path.join(root, "dead2"), "retry")
    assert spark.read.parquet(os.path.join(root, "out", "as.opened__as")).count() == 20


def test_dispatch_stream_once(spark):
    """Repeated ids and repeated runs trigger nothing new."""
    root = tempfile.mkdtemp(prefix="tessera-dispatch-")
    rows = [("a1", "as.opened", "as", "1"), ("a1", "as.opened", "as", "1"), ("a2", "as.opened", "as", "2")]
    handlers = {("as.opened", "as"): _strict}
    for more in (rows, rows[:1] + [("a3", "as.opened", "as", "3")]):
        spark.createDataFrame(more, ACTIVITIES).write.mode("append").parquet(os.path.join(root, "acts"))
        _outbox(spark, root, handlers)
    _outbox(spark, root, handlers)
    out = spark.read.parquet(os.path.join(root, "out", "as.opened__as"))
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 3]


def test_dispatch_restart_between_output_and_ids(spark, monkeypatch):
    """A worker that dies after the outputs of an epoch and before its ids repeats the epoch without doubling outputs."""
    root = tempfile.mkdtemp(prefix="tessera-dispatch-")
    spark.createDataFrame([("a1", "as.opened", "as", "1"), ("a2", "as.opened", "as", "2")], ACTIVITIES).write.parquet(os.path.join(root, "acts"))
    written = ST._written

    def dying(out, path):
        if "/processed/" in path:
            raise OSError("lost")
        written(out, path)

    monkeypatch.setattr(ST, "_written", dying)
    with pytest.raises(Exception, match="lost"):
        _outbox(spark, root, {("as.opened", "as"): _strict})
    assert spark.read.parquet(os.path.join(root, "out", "as.opened__as")).count() == 2 and not os.path.exists(os.path.join(root, "processed"))
    monkeypatch.setattr(ST, "_written", written)
    _outbox(spark, root, {("as.opened", "as"): _strict})
    assert spark.read.parquet(os.path.join(root, "out", "as.opened__as")).count() == 2
    assert spark.read.parquet(os.path.join(root, "processed")).count() == 2


def test_failed_traces_become_agent_errors(spark):
    from tessera.sources import telemetry as TEL
    from tessera.sources.bindings import spans_from_events
    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, t0, 1, "view", 1.0, '{"k": 1}'), (2, t0, 1, "error", 2.0, '{"k": 2}'), (3, t0, 2, "view", 3.0, '{"k": 3}')],
                                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    got = TEL.spans_to_events(spans_from_events(events)).filter(F.col("event_id").startswith("agent-")).collect()
    assert {(r["user_id"], r["event_type"], r["success"], r["error"]) for r in got} == {
        ("1", TEL.AGENT_ERROR, False, "error"), ("2", TEL.AGENT_COMPLETE, True, "")}


def test_agent_performance_counts_failed_traces(spark):
    from tessera.operators import reports as R
    from tessera.sources import telemetry as TEL
    from tessera.sources.bindings import spans_from_events
    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, t0, 1, "view", 1.0, '{"k": 1}'), (2, t0, 1, "error", 2.0, '{"k": 2}'), (3, t0, 2, "view", 3.0, '{"k": 3}')],
                                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    got = R.agent_performance(TEL.spans_to_events(spans_from_events(events))).first()
    assert (got["success_count"], got["total_count"], got["success_rate"]) == (1, 2, 50.0)
