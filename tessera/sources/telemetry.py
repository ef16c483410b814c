"""Typed telemetry events.

A telemetry frame is one wide, nullable row per event: the common header plus the union of
the seven payload shapes, with ``event_type`` as discriminator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import epoch_ms

# Event type names of the telemetry stream.
LLM_CALL = "mcp_llm_call"
TOOL_CALL = "mcp_tool_call"
ROUTER_DECISION = "mcp_router_decision"
DLP_VIOLATION = "mcp_dlp_violation"
CACHE_HIT = "mcp_cache_hit"
CACHE_MISS = "mcp_cache_miss"
AGENT_START = "mcp_agent_start"
AGENT_COMPLETE = "mcp_agent_complete"
AGENT_ERROR = "mcp_agent_error"
AUDIT_EVENT = "mcp_audit_event"
ANOMALY = "mcp_anomaly"
REMEDIATION = "mcp_remediation"

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()

HEADER = [("event_type", _S), ("timestamp", T.TimestampNTZType()), ("event_id", _S), ("session_id", _S),
          ("user_id", _S), ("app", _S), ("version", _S)]
PAYLOAD = [
    # llm_call
    ("model", _S), ("provider", _S), ("prompt_tokens", _L), ("completion_tokens", _L), ("total_tokens", _L),
    ("cost_usd", _D), ("latency_ms", _D), ("success", _B), ("cached", _B), ("complexity", _S), ("error", _S),
    # tool_call
    ("tool_name", _S), ("tool_args", _S), ("result_size", _L), ("dlp_checked", _B), ("dlp_clean", _B),
    # router_decision
    ("query_complexity", _S), ("complexity_confidence", _D), ("selected_model", _S), ("fallback_model", _S),
    ("strategy", _S), ("estimated_cost", _D), ("estimated_latency_ms", _I), ("decision_time_ms", _D),
    # dlp_violation
    ("rule_id", _S), ("rule_name", _S), ("sensitivity", _S), ("action_taken", _S), ("direction", _S),
    ("matched_patterns", _I), ("matched_keywords", _I), ("data_hash", _S), ("destination", _S),
    # cache
    ("cache_key", _S), ("saved_cost", _D), ("saved_latency_ms", _D),
    # agent
    ("query", _S), ("tools_used", _S), ("total_steps", _I), ("duration_ms", _D), ("total_cost", _D),
    # anomaly
    ("anomaly_type", _S), ("metric_name", _S), ("current_value", _D), ("threshold", _D),
    ("remediation_triggered", _B),
]
TELEMETRY_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in HEADER + PAYLOAD])


def conform(df: DataFrame) -> DataFrame:
    """Project any event frame onto the full telemetry schema (missing fields become null)."""
    cols = []
    for f in TELEMETRY_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_telemetry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read events with an explicit schema (no inference); JSON lines or parquet."""
    if fmt == "parquet":
        return conform(spark.read.parquet(path))
    return spark.read.schema(TELEMETRY_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]['Z']") \
        .json(path)


ENVELOPE_FIELDS = ("time", "host", "source", "sourcetype", "index", "event")


def to_envelope(df: DataFrame, index: str = "agents", host: str = "agents",
                source: str = "agents", sourcetype_prefix: str = "agents:") -> DataFrame:
    """Wrap each event into the transport envelope (epoch seconds + nested event)."""
    return df.select(
        (epoch_ms("timestamp") / 1000.0).alias("time"),
        F.lit(host).alias("host"),
        F.lit(source).alias("source"),
        F.concat(F.lit(sourcetype_prefix), F.col("event_type")).alias("sourcetype"),
        F.lit(index).alias("index"),
        F.struct(*[F.col(c) for c in df.columns]).alias("event"),
    )


def from_envelope(df: DataFrame) -> DataFrame:
    """Unwrap; accepts the nested struct or the event serialised as JSON text."""
    if isinstance(df.schema["event"].dataType, T.StringType):
        df = df.withColumn("event", F.from_json("event", TELEMETRY_SCHEMA))
    return df.select("event.*")


# Model-name prefixes mapped to providers.
PROVIDER_PREFIXES = [("claude", "anthropic"), ("gpt", "openai"), ("gemini", "google")]


def enrich_llm_events(df: DataFrame, query_len: int = 200, tool_args_len: int = 256) -> DataFrame:
    """Provider from the model name and total tokens (LLM calls), text truncation (all rows)."""
    is_llm = F.col("event_type") == F.lit(LLM_CALL)
    m = F.lower(F.coalesce(F.col("model"), F.lit("")))
    prov = F.lit("unknown")
    for prefix, name in reversed(PROVIDER_PREFIXES):
        prov = F.when(m.contains(prefix), F.lit(name)).otherwise(prov)
    missing = F.col("provider").isNull() | (F.col("provider") == "")
    out = df.withColumn("provider", F.when(is_llm & missing, prov).otherwise(F.col("provider")))
    tokens = F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("completion_tokens"), F.lit(0))
    out = out.withColumn("total_tokens", F.when(is_llm & F.col("total_tokens").isNull(), tokens.cast("long"))
                         .otherwise(F.col("total_tokens")))
    if "query" in df.columns:
        out = out.withColumn("query", F.substring("query", 1, query_len))
    if "tool_args" in df.columns:
        out = out.withColumn("tool_args", F.substring("tool_args", 1, tool_args_len))
    return out


def tag_and_union(frames: dict) -> DataFrame:
    """Union several record sets, each serialised to JSON and tagged with its sourcetype."""
    out = None
    for sourcetype, df in frames.items():
        part = df.select(F.lit(sourcetype).alias("sourcetype"),
                         F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("event"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_retention(df: DataFrame, ts: str = "timestamp", seconds: int = 7_776_000, now=None) -> DataFrame:
    """Keep events of the last ``seconds`` (90 days by default) relative to ``now``."""
    now_col = F.lit(now) if now is not None else F.current_timestamp()
    return df.filter(F.col(ts) >= now_col - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def spans_to_events(spans: DataFrame) -> DataFrame:
    """Trace spans -> telemetry events, plus one event per trace: agent_complete, or agent_error when any span failed.

    spans: trace_id, span_id, name, span_type, status, start_time, duration_ms, model, prompt_tokens,
    completion_tokens, tokens_used, cost, error, user_id, query_complexity, selected_model,
    fallback_model, strategy, cache_hit, trace_name.
    """
    ok = F.col("status") != F.lit("error")
    t = F.col("span_type")
    span_events = spans.select(
        F.when(t == "llm_call", F.lit(LLM_CALL))
         .when(t == "tool_call", F.lit(TOOL_CALL))
         .when(t == "router", F.lit(ROUTER_DECISION))
         .when((t == "cache") & F.col("cache_hit"), F.lit(CACHE_HIT))
         .when(t == "cache", F.lit(CACHE_MISS)).alias("event_type"),
        F.col("start_time").alias("timestamp"),
        F.col("span_id").alias("event_id"),
        F.col("trace_id").alias("session_id"),
        F.col("user_id"),
        F.when(t.isin("llm_call", "cache"), F.col("model")).alias("model"),
        F.when(t == "llm_call", F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(t == "llm_call", F.col("completion_tokens")).alias("completion_tokens"),
        F.when(t == "llm_call", F.col("cost")).alias("cost_usd"),
        F.when(t == "llm_call", F.col("query_complexity")).alias("complexity"),
        F.when(t.isin("llm_call", "tool_call"), F.coalesce(F.col("duration_ms"), F.lit(0.0))).alias("latency_ms"),
        F.when(t.isin("llm_call", "tool_call"), ok).alias("success"),
        F.when(t.isin("llm_call", "tool_call"), F.coalesce(F.col("error"), F.lit(""))).alias("error"),
        F.when(t == "tool_call", F.regexp_replace("name", "^Tool: ", "")).alias("tool_name"),
        F.when(t == "router", F.col("query_complexity")).alias("query_complexity"),
        F.when(t == "router", F.col("selected_model")).alias("selected_model"),
        F.when(t == "router", F.col("fallback_model")).alias("fallback_model"),
        F.when(t == "router", F.col("strategy")).alias("strategy"),
        F.when(t == "router", F.coalesce(F.col("duration_ms"), F.lit(0.0))).alias("decision_time_ms"),
        F.when((t == "cache") & F.col("cache_hit"), F.col("cost")).alias("saved_cost"),
        F.when((t == "cache") & F.col("cache_hit"), F.coalesce(F.col("duration_ms"), F.lit(0.0)))
         .alias("saved_latency_ms"),
    ).filter(F.col("event_type").isNotNull())

    start_ms = epoch_ms("start_time")
    end_ms = start_ms + F.coalesce(F.col("duration_ms"), F.lit(0.0))
    traces = spans.groupBy("trace_id").agg(
        F.min("start_time").alias("timestamp"),
        F.first("user_id", ignorenulls=True).alias("user_id"),
        F.first("trace_name", ignorenulls=True).alias("query"),
        F.array_join(F.array_sort(F.collect_list(F.when(t == "tool_call",
                                                        F.regexp_replace("name", "^Tool: ", "")))), ",")
         .alias("tools_used"),
        F.count(F.lit(1)).cast("int").alias("total_steps"),
        (F.max(end_ms) - F.min(start_ms)).alias("duration_ms"),
        F.sum(F.coalesce(F.col("cost"), F.lit(0.0))).alias("total_cost"),
        F.sum(F.coalesce(F.col("tokens_used"), F.lit(0))).cast("long").alias("total_tokens"),
        F.bool_and(ok).alias("success"),
        F.min(F.when(~ok, F.struct("start_time", "span_id", "error"))).getField("error").alias("_error"),
    )
    agent_events = traces.select(
        F.when(F.col("success"), F.lit(AGENT_COMPLETE)).otherwise(F.lit(AGENT_ERROR)).alias("event_type"), "timestamp",
        F.concat(F.lit("agent-"), F.col("trace_id")).alias("event_id"),
        F.col("trace_id").alias("session_id"), "user_id", "query", "tools_used", "total_steps",
        "duration_ms", "total_cost", "total_tokens", "success", F.coalesce("_error", F.lit("")).alias("error"))
    return conform(span_events).unionByName(conform(agent_events))
