"""DuckDB SQL twins of the registered queries.

Each statement recomputes the same binding and operator from the raw tables, independently of
the Spark code, so the driver can compare results value by value.
"""

from __future__ import annotations

MODELS_SQL = "['gpt-4o', 'gpt-4o-mini', 'claude-3.5-sonnet', 'gemini-1.5-flash']"

TELEMETRY_CTE = f"""
ev_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
spans AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS trace_id,
         CAST(event_id AS VARCHAR) AS span_id,
         'span-' || event_type AS name,
         CASE WHEN event_type IN ('view', 'error') THEN 'llm_call'
              WHEN event_type IN ('click', 'signup') THEN 'cache'
              WHEN event_type = 'purchase' THEN 'router' END AS span_type,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         ts AS start_time, value AS duration_ms,
         ({MODELS_SQL})[k % 4 + 1] AS model,
         CAST(100 + k * 10 AS BIGINT) AS prompt_tokens,
         CAST(20 + k * 5 AS BIGINT) AS completion_tokens,
         CAST(120 + k * 15 AS BIGINT) AS tokens_used,
         value / 1000.0 AS cost,
         CASE WHEN event_type = 'error' THEN 'error' END AS error,
         CAST(user_id AS VARCHAR) AS user_id,
         (['trivial', 'simple', 'moderate', 'complex', 'expert'])[k % 5 + 1] AS query_complexity,
         ({MODELS_SQL})[k % 4 + 1] AS selected_model,
         ({MODELS_SQL})[(k + 1) % 4 + 1] AS fallback_model,
         (['balanced', 'cost', 'quality', 'speed'])[user_id % 4 + 1] AS strategy,
         event_type = 'click' AS cache_hit,
         'session ' || CAST(user_id AS VARCHAR) AS trace_name
  FROM ev_k
),
span_events AS (
  SELECT CASE WHEN span_type = 'llm_call' THEN 'mcp_llm_call'
              WHEN span_type = 'router' THEN 'mcp_router_decision'
              WHEN span_type = 'cache' AND cache_hit THEN 'mcp_cache_hit'
              WHEN span_type = 'cache' THEN 'mcp_cache_miss' END AS event_type,
         start_time AS timestamp, span_id AS event_id, trace_id AS session_id, user_id,
         CASE WHEN span_type IN ('llm_call', 'cache') THEN model END AS model,
         CASE WHEN span_type = 'llm_call' THEN prompt_tokens END AS prompt_tokens,
         CASE WHEN span_type = 'llm_call' THEN completion_tokens END AS completion_tokens,
         CASE WHEN span_type = 'llm_call' THEN cost END AS cost_usd,
         CASE WHEN span_type = 'llm_call' THEN query_complexity END AS complexity,
         CASE WHEN span_type = 'llm_call' THEN coalesce(duration_ms, 0.0) END AS latency_ms,
         CASE WHEN span_type = 'llm_call' THEN status <> 'error' END AS success,
         CASE WHEN span_type = 'llm_call' THEN coalesce(error, '') END AS error,
         CAST(NULL AS BOOLEAN) AS cached,
         CASE WHEN span_type = 'router' THEN query_complexity END AS query_complexity,
         CASE WHEN span_type = 'router' THEN selected_model END AS selected_model,
         CASE WHEN span_type = 'router' THEN fallback_model END AS fallback_model,
         CASE WHEN span_type = 'router' THEN strategy END AS strategy,
         CASE WHEN span_type = 'router' THEN coalesce(duration_ms, 0.0) END AS decision_time_ms,
         CASE WHEN span_type = 'cache' AND cache_hit THEN cost END AS saved_cost,
         CASE WHEN span_type = 'cache' AND cache_hit THEN coalesce(duration_ms, 0.0) END AS saved_latency_ms,
         CAST(NULL AS VARCHAR) AS query, CAST(NULL AS VARCHAR) AS tools_used,
         CAST(NULL AS INTEGER) AS total_steps, CAST(NULL AS DOUBLE) AS duration_ms,
         CAST(NULL AS DOUBLE) AS total_cost, CAST(NULL AS BIGINT) AS total_tokens_agent
  FROM spans
),
agent_events AS (
  SELECT CASE WHEN bool_and(status <> 'error') THEN 'mcp_agent_complete' ELSE 'mcp_agent_error' END AS event_type, min(start_time) AS timestamp,
         'agent-' || trace_id AS event_id, trace_id AS session_id, first(user_id) AS user_id,
         NULL AS model, NULL AS complexity, NULL AS prompt_tokens, NULL AS completion_tokens, NULL AS cost_usd,
         NULL AS latency_ms, NULL AS cached, bool_and(status <> 'error') AS success,
         CASE WHEN bool_or(status = 'error') THEN 'error' ELSE '' END AS error, NULL AS query_complexity, NULL AS selected_model, NULL AS fallback_model, NULL AS strategy,
         NULL AS decision_time_ms, NULL AS saved_cost, NULL AS saved_latency_ms,
         first(trace_name) AS query, '' AS tools_used, CAST(count(*) AS INTEGER) AS total_steps,
         max(epoch_us(start_time) / 1000.0 + coalesce(duration_ms, 0.0)) - min(epoch_us(start_time) / 1000.0)
           AS duration_ms,
         sum(coalesce(cost, 0.0)) AS total_cost, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS total_tokens_agent
  FROM spans GROUP BY trace_id
),
telemetry AS (
  SELECT *,
         CASE WHEN event_type = 'mcp_llm_call' THEN
           CASE WHEN contains(lower(coalesce(model, '')), 'claude') THEN 'anthropic'
                WHEN contains(lower(coalesce(model, '')), 'gpt') THEN 'openai'
                WHEN contains(lower(coalesce(model, '')), 'gemini') THEN 'google'
                ELSE 'unknown' END END AS provider,
         CASE WHEN event_type = 'mcp_llm_call' THEN CAST(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS BIGINT)
              ELSE total_tokens_agent END AS total_tokens
  FROM (SELECT * FROM span_events UNION ALL BY NAME SELECT * FROM agent_events)
)"""


def with_telemetry(body: str) -> str:
    return f"WITH {TELEMETRY_CTE}\n{body}"


def _llm(body: str) -> str:
    return with_telemetry(body)


SQL: dict[str, str] = {}

SQL["cost_by_model"] = _llm("""
SELECT model, round(sum(cost_usd), 6) AS total_cost_usd, count(*) AS call_count,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model""")

SQL["error_rate_by_model"] = _llm("""
SELECT model, total, errors, round(errors / total * 100, 2) AS error_rate FROM (
  SELECT model, count(*) AS total,
         CAST(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'false' THEN 1 ELSE 0 END) AS BIGINT) AS errors
  FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model)""")

SQL["latency_by_model"] = _llm("""
SELECT model, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
       max(latency_ms) AS max_ms
FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model""")

SQL["cache_savings"] = _llm("""
SELECT round(sum(saved_cost), 6) AS total_saved_usd, round(sum(saved_latency_ms), 6) AS total_saved_ms,
       count(*) AS cache_hits
FROM telemetry WHERE event_type = 'mcp_cache_hit'""")

SQL["router_decisions"] = _llm("""
SELECT query_complexity, selected_model, strategy, count(*) AS count
FROM telemetry WHERE event_type = 'mcp_router_decision' GROUP BY ALL""")

SQL["router_decisions_by_model"] = _llm("""
SELECT selected_model, count(*) AS count
FROM telemetry WHERE event_type = 'mcp_router_decision' GROUP BY ALL""")

SQL["agent_performance"] = _llm("""
SELECT round(avg(duration_ms), 6) AS avg_duration, round(avg(total_cost), 6) AS avg_cost,
       round(avg(total_tokens), 6) AS avg_tokens,
       CAST(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
       count(*) AS total_count,
       round(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) / count(*) * 100, 2)
         AS success_rate
FROM telemetry WHERE event_type IN ('mcp_agent_complete', 'mcp_agent_error')""")

SQL["agent_errors"] = _llm("""
SELECT session_id, user_id, error, total_steps, round(total_cost, 6) AS total_cost, total_tokens
FROM telemetry WHERE event_type = 'mcp_agent_error'""")

SQL["top_users"] = _llm("""
SELECT user_id, round(coalesce(sum(cost_usd), 0.0), 6) AS total_cost, count(*) AS total_calls
FROM telemetry GROUP BY user_id ORDER BY total_cost DESC, user_id ASC LIMIT 10""")

SQL["model_performance"] = _llm("""
SELECT model, count(*) AS calls, round(avg(latency_ms), 6) AS avg_latency, round(avg(cost_usd), 9) AS avg_cost,
       CAST(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
       round(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) / count(*) * 100, 1)
         AS success_rate
FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model""")

SQL["cache_hit_rate"] = _llm("""
SELECT model, hits, misses, total_saved_usd, round(hits / (hits + misses) * 100, 1) AS hit_rate FROM (
  SELECT model, CAST(sum(CASE WHEN event_type = 'mcp_cache_hit' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         CAST(sum(CASE WHEN event_type = 'mcp_cache_miss' THEN 1 ELSE 0 END) AS BIGINT) AS misses,
         round(sum(saved_cost), 6) AS total_saved_usd
  FROM telemetry WHERE event_type IN ('mcp_cache_hit', 'mcp_cache_miss') GROUP BY model)""")

SQL["kpi_tiles"] = _llm("""
SELECT round(sum(CASE WHEN event_type = 'mcp_llm_call' THEN cost_usd END), 6) AS total_cost,
       CAST(sum(CASE WHEN event_type = 'mcp_llm_call' THEN 1 ELSE 0 END) AS BIGINT) AS calls,
       round(CASE WHEN sum(CASE WHEN event_type IN ('mcp_cache_hit', 'mcp_cache_miss') THEN 1 ELSE 0 END) = 0 THEN 0.0
             ELSE sum(CASE WHEN event_type = 'mcp_cache_hit' THEN 1 ELSE 0 END)
                  / sum(CASE WHEN event_type IN ('mcp_cache_hit', 'mcp_cache_miss') THEN 1 ELSE 0 END) END * 100, 1)
         AS hit_rate,
       CAST(sum(CASE WHEN event_type = 'mcp_dlp_violation' THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM telemetry""")

SQL["calls_by_model"] = _llm("""
SELECT model, count(*) AS count FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model""")

SQL["system_health"] = _llm("""
SELECT round(least(coalesce(c, 0.0) / 12.0 * 100, 100.0), 1) AS cpu_pct,
       round((1 - e / greatest(t, 1)) * 100, 1) AS mem_pct,
       round(e / greatest(t, 1) * 100, 2) AS disk_pct
FROM (SELECT sum(cost_usd) AS c, count(*) AS t,
             sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'false' THEN 1 ELSE 0 END) AS e
      FROM telemetry WHERE event_type = 'mcp_llm_call')""")

SQL["component_health"] = with_telemetry(""",
recent AS (SELECT * FROM telemetry WHERE timestamp >= (SELECT max(timestamp) FROM telemetry) - INTERVAL 5 MINUTE),
comp AS (
  SELECT CASE WHEN event_type = 'mcp_llm_call' THEN 'Multi-LLM Router'
              WHEN event_type IN ('mcp_cache_hit', 'mcp_cache_miss') THEN 'Semantic Cache'
              WHEN event_type = 'mcp_dlp_violation' THEN 'DLP Engine'
              WHEN event_type = 'mcp_anomaly' THEN 'Auto-Remediation'
              WHEN event_type = 'mcp_router_decision' THEN 'Intelligent Router'
              ELSE 'HEC Telemetry' END AS component, count(*) AS event_count
  FROM recent GROUP BY 1)
SELECT component, 0 AS errors, 0 AS warns, CASE WHEN event_count > 0 THEN 'ok' ELSE 'warning' END AS status,
       event_count FROM comp
UNION ALL
SELECT 'HEC Telemetry', 1, 0, 'critical', 0 WHERE NOT EXISTS (SELECT 1 FROM comp)""")

SQL["error_rate_alert"] = with_telemetry(""",
recent AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'
           AND timestamp >= (SELECT max(timestamp) FROM telemetry) - INTERVAL 10 MINUTE
           AND timestamp <= (SELECT max(timestamp) FROM telemetry)),
agg AS (SELECT model, count(*) AS total,
               sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'false' THEN 1 ELSE 0 END) AS errors
        FROM recent GROUP BY model)
SELECT 'error_rate_high' AS anomaly_type, round(errors / total, 4) AS metric_value, model
FROM agg WHERE round(errors / total, 4) > 0.15""")

_STATS = """count(*) AS total_requests,
       round(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 0 ELSE 1 END) / count(*), 6) AS error_rate,
       round(sum(CASE WHEN lower(CAST(cached AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) / count(*), 6) AS cache_hit_rate,
       round(avg(latency_ms), 6) AS latency_mean, round(median(latency_ms), 6) AS latency_median,
       min(latency_ms) AS latency_min, max(latency_ms) AS latency_max,
       round(sum(cost_usd), 6) AS cost_total, round(avg(cost_usd), 9) AS cost_mean,
       round(median(cost_usd), 9) AS cost_median,
       CASE WHEN count(latency_ms) >= 20
            THEN list_sort(list(latency_ms))[CAST(floor(count(latency_ms) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1]
            ELSE max(latency_ms) END AS latency_p95"""

SQL["model_statistics"] = _llm(f"""
SELECT model, {_STATS} FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY model""")

SQL["overall_summary"] = _llm(f"""
SELECT {_STATS}, list_sort(list(DISTINCT model)) AS models_used
FROM telemetry WHERE event_type = 'mcp_llm_call'""")

SQL["complexity_breakdown"] = with_telemetry(""",
llm AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
per_model AS (SELECT complexity, model, count(*) AS n FROM llm GROUP BY ALL),
mode AS (SELECT complexity, model AS most_used_model FROM (
  SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY n DESC, model ASC) AS r FROM per_model) WHERE r = 1)
SELECT s.*, m.most_used_model FROM (
  SELECT complexity, count(*) AS count, round(avg(latency_ms), 6) AS avg_latency, round(avg(cost_usd), 9) AS avg_cost,
         round(sum(cost_usd), 6) AS total_cost FROM llm GROUP BY complexity) s
LEFT JOIN mode m USING (complexity)""")

SQL["daily_costs"] = _llm("""
SELECT CAST(timestamp AS DATE) AS day, round(sum(cost_usd), 6) AS daily_cost
FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY 1""")

SQL["model_costs"] = _llm("""
SELECT model, round(sum(cost_usd), 6) AS model_cost FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY 1""")

SQL["cost_summary"] = with_telemetry(""",
llm AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
a AS (SELECT sum(cost_usd) AS total, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS tin,
             CAST(sum(completion_tokens) AS BIGINT) AS tout,
             sum(CASE WHEN lower(CAST(cached AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) AS cached,
             max(CAST(timestamp AS DATE)) AS today FROM llm),
t AS (SELECT CAST(timestamp AS DATE) AS today, sum(cost_usd) AS today_cost FROM llm GROUP BY 1)
SELECT round(total, 6) AS total_cost, n AS total_requests,
       round(CASE WHEN n = 0 THEN 0.0 ELSE total / n END, 9) AS average_cost_per_request,
       tin AS total_input_tokens, tout AS total_output_tokens,
       round(CASE WHEN n = 0 THEN 0.0 ELSE cached / n END, 6) AS cache_hit_rate, a.today AS today,
       round(10.0 - coalesce(today_cost, 0.0), 6) AS budget_remaining
FROM a LEFT JOIN t USING (today)""")

SQL["routing_statistics"] = with_telemetry(""",
r AS (SELECT * FROM telemetry WHERE event_type = 'mcp_router_decision'),
dist AS (SELECT 'model' AS dimension, selected_model AS key, count(*) AS count FROM r GROUP BY 2
         UNION ALL SELECT 'complexity', query_complexity, count(*) FROM r GROUP BY 2),
tot AS (SELECT count(*) AS total_routings, round(coalesce(sum(CAST(NULL AS DOUBLE)), 0.0), 6) AS total_estimated_cost,
               round(coalesce(avg(CAST(NULL AS INTEGER)), 0.0), 6) AS avg_estimated_latency FROM r)
SELECT * FROM dist CROSS JOIN tot""")

_SPANS = TELEMETRY_CTE.split("span_events AS")[0].rstrip().rstrip(",")

SQL["span_statistics"] = f"""WITH {_SPANS},
by_ts AS (SELECT span_type, status, count(*) AS spans FROM spans GROUP BY ALL),
tot AS (SELECT count(DISTINCT trace_id) AS total_traces, count(*) AS total_spans,
               round(sum(coalesce(duration_ms, 0.0)), 6) AS total_duration_ms,
               round(avg(coalesce(duration_ms, 0.0)), 6) AS avg_span_duration_ms,
               CAST(sum(tokens_used) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS total_cost,
               CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
               round(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate FROM spans)
SELECT * FROM by_ts CROSS JOIN tot"""

SQL["trace_summary"] = f"""WITH {_SPANS}
SELECT trace_id, first(trace_name) AS name, first(user_id) AS user_id, min(start_time) AS start_time,
       count(*) AS span_count, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost,
       round(max(epoch_us(start_time) / 1000.0 + coalesce(duration_ms, 0.0)) - min(epoch_us(start_time) / 1000.0), 3)
         AS duration_ms
FROM spans GROUP BY trace_id"""

SQL["cache_statistics"] = _llm("""
SELECT hits, misses, semantic_hits, hits + misses AS total_requests,
       round(CASE WHEN hits + misses = 0 THEN 0.0 ELSE hits / (hits + misses) END, 6) AS hit_rate,
       round(CASE WHEN hits = 0 THEN 0.0 ELSE semantic_hits / hits END, 6) AS semantic_hit_ratio FROM (
  SELECT CAST(sum(CASE WHEN event_type = 'mcp_cache_hit' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         CAST(sum(CASE WHEN event_type = 'mcp_cache_miss' THEN 1 ELSE 0 END) AS BIGINT) AS misses,
         CAST(0 AS BIGINT) AS semantic_hits
  FROM telemetry WHERE event_type IN ('mcp_cache_hit', 'mcp_cache_miss'))""")

SQL["events_quality_summary"] = """
SELECT 'event_id' AS "column", 'bigint' AS dtype, round(avg(CASE WHEN event_id IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2)
         AS missing_pct, count(DISTINCT event_id) AS n_unique FROM events
UNION ALL SELECT 'ts', 'timestamp_ntz', round(avg(CASE WHEN ts IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2),
         count(DISTINCT ts) FROM events
UNION ALL SELECT 'user_id', 'bigint', round(avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2),
         count(DISTINCT user_id) FROM events
UNION ALL SELECT 'event_type', 'string', round(avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2),
         count(DISTINCT event_type) FROM events
UNION ALL SELECT 'value', 'double', round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2),
         count(DISTINCT value) FROM events
UNION ALL SELECT 'props', 'string', round(avg(CASE WHEN props IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2),
         count(DISTINCT props) FROM events"""

# --- filters and time series -------------------------------------------------------------------
SQL["last_day_llm_calls"] = _llm("""
SELECT event_id, timestamp, model, cost_usd FROM telemetry
WHERE event_type = 'mcp_llm_call'
  AND timestamp >= date_trunc('hour', (SELECT max(timestamp) FROM telemetry) - INTERVAL 24 HOUR)
  AND timestamp <= (SELECT max(timestamp) FROM telemetry)""")

SQL["raw_events"] = _llm("""
SELECT event_id, timestamp, event_type, user_id FROM telemetry ORDER BY timestamp DESC, event_id DESC LIMIT 50""")


def _timechart_sql(where: str, aggs: str, names: list[str], span: int, by: str | None) -> str:
    byc = f"{by}, " if by else ""
    fill = ", ".join(f"coalesce(a.{n}, 0) AS {n}" for n in names)
    series = f"(SELECT DISTINCT {by} FROM agg)" if by else "(SELECT 1 AS _one)"
    join_by = f" AND a.{by} = s.{by}" if by else ""
    sel_by = f"s.{by}, " if by else ""
    return with_telemetry(f""",
src AS (SELECT * FROM telemetry WHERE {where}),
agg AS (SELECT make_timestamp(CAST(floor(epoch(timestamp) / {span}) * {span} AS BIGINT) * 1000000) AS _time,
               {byc}{aggs} FROM src GROUP BY ALL),
bounds AS (SELECT CAST(epoch(min(_time)) AS BIGINT) AS lo, CAST(epoch(max(_time)) AS BIGINT) AS hi FROM agg),
grid AS (SELECT s.*, make_timestamp(g.x * 1000000) AS _time
         FROM {series} s, bounds, LATERAL (SELECT unnest(range(lo, hi + 1, {span})) AS x) g)
SELECT {sel_by}s._time, {fill} FROM grid s LEFT JOIN agg a ON a._time = s._time{join_by}""")


SQL["hourly_cost_timechart"] = _timechart_sql(
    "event_type = 'mcp_llm_call'", "round(sum(cost_usd), 6) AS total_cost, count(*) AS call_count",
    ["total_cost", "call_count"], 3600, "model")

SQL["cost_anomaly_band"] = _timechart_sql(
    "event_type = 'mcp_llm_call'", "round(sum(cost_usd), 6) AS cost_5m", ["cost_5m"], 300, None).replace(
    "SELECT s._time, coalesce(a.cost_5m, 0) AS cost_5m FROM grid s LEFT JOIN agg a ON a._time = s._time",
    """, series AS (SELECT s._time, coalesce(a.cost_5m, 0) AS cost_5m FROM grid s LEFT JOIN agg a ON a._time = s._time),
banded AS (SELECT _time, cost_5m,
    avg(cost_5m) OVER w AS expected, stddev_samp(cost_5m) OVER w AS sd FROM series
    WINDOW w AS (ORDER BY _time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT _time, cost_5m, round(expected, 6) AS expected, round(sd, 6) AS sd,
       round(expected + 1.96 * sd, 6) AS upper95, coalesce(cost_5m > expected + 1.96 * sd, false) AS breach
FROM banded""").replace("SELECT s._time, coalesce", "SELECT s._time, coalesce", 1)

SQL["latency_anomaly_trend"] = with_telemetry(""",
src AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
series AS (SELECT make_timestamp(CAST(floor(epoch(timestamp) / 3600) * 3600 AS BIGINT) * 1000000) AS _time, model,
                  round(avg(latency_ms), 6) AS avg_latency FROM src GROUP BY ALL),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY _time) AS DOUBLE) AS _x FROM series),
b AS (SELECT *, regr_intercept(avg_latency, _x) OVER w + regr_slope(avg_latency, _x) OVER w * _x AS expected,
             stddev_samp(avg_latency) OVER w AS sd
      FROM x WINDOW w AS (PARTITION BY model ORDER BY _time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT _time, model, avg_latency, round(expected, 2) AS expected, round(expected + 1.96 * sd, 2) AS upper95,
       coalesce(avg_latency > expected + 1.96 * sd, false) OR avg_latency > 5000.0 AS breach
FROM b""")

SQL["bucket_analysis"] = with_telemetry(""",
src AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
st AS (SELECT epoch_us(max(timestamp)) - 24 * 3600 * CAST(1000000 AS BIGINT) AS s FROM src),
b AS (SELECT src.*, CAST(floor((epoch_us(timestamp) - st.s) / 3600000000.0) AS BIGINT) AS _b, st.s FROM src, st)
SELECT make_timestamp(s + _b * 3600000000) AS start, make_timestamp(s + (_b + 1) * 3600000000) AS "end",
       count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency, round(sum(cost_usd), 6) AS total_cost,
       CAST(sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 0 ELSE 1 END) AS BIGINT) AS error_count,
       CAST(sum(CASE WHEN lower(CAST(cached AS VARCHAR)) = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS cache_hit_count
FROM b WHERE _b >= 0 AND _b < 24 GROUP BY s, _b""")

SQL["budget_alerts"] = with_telemetry(""",
src AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
r AS (SELECT event_id, timestamp, sum(coalesce(cost_usd, 0.0)) OVER (PARTITION BY CAST(timestamp AS DATE)
        ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dc FROM src)
SELECT event_id, timestamp, round(dc, 6) AS daily_cost,
       CASE WHEN dc >= 5.0 THEN 'exceeded' WHEN dc >= 4.0 THEN 'warning' ELSE 'ok' END AS budget_status FROM r""")

SQL["performance_alerts"] = with_telemetry(""",
src AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
r AS (SELECT event_id, model, latency_ms,
        count(*) OVER w AS c,
        sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'true' THEN 0 ELSE 1 END) OVER w AS e
      FROM src WINDOW w AS (PARTITION BY model ORDER BY timestamp, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, model, CAST(c AS BIGINT) AS running_count, round(e / c, 6) AS running_error_rate,
       latency_ms > 400.0 AS latency_alert, c >= 10 AND e / c > 0.1 AS error_rate_alert FROM r""")

SQL["streamstats_rows"] = _llm("""
SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY timestamp, event_id) AS BIGINT)
       AS "row" FROM telemetry""")

# --- operations hub -------------------------------------------------------------------------------
HUB_CTE = """
h_employees AS (
  SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
         (['sales', 'production', 'as', 'accounting', 'manager'])[s_suppkey % 5 + 1] AS role FROM supplier),
h_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment,
         'E' || CAST((c_custkey % 20) * 5 AS VARCHAR) AS owner_employee_id FROM customer),
h_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'O' THEN 'placed' WHEN 'P' THEN 'in_production' WHEN 'F' THEN 'delivered' END AS status,
         o_totalprice AS total_amount, o_orderdate AS created_at,
         'E' || CAST((o_custkey % 20) * 5 AS VARCHAR) AS actor_employee_id FROM orders),
h_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_quantity AS INTEGER) AS qty, l_extendedprice / l_quantity AS unit_price FROM lineitem),
h_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
         p_retailprice AS unit_price, CAST(p_size * 20 AS INTEGER) AS stock_qty FROM part),
h_tickets AS (
  SELECT 'T' || CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS customer_id,
         CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS severity,
         (['open', 'in_progress', 'resolved'])[k % 3 + 1] AS status,
         CASE WHEN k % 7 = 0 THEN NULL ELSE 'E' || CAST((k % 20) * 5 + 2 AS VARCHAR) END AS assignee_id,
         (['refund request for a duplicate invoice', 'app crash after login update',
           'delivery is late and tracking shows missing parcel', 'power defect, device stopped - urgent',
           'question about how to reset the display', 'minor noise from the fan'])[k % 6 + 1] AS summary,
         CASE WHEN k % 3 = 2 THEN 'part replaced and verified' END AS resolution, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')),
h_leads AS (
  SELECT 'L' || CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS customer_id,
         (['ads', 'web', 'referral'])[user_id % 3 + 1] AS source,
         (['new', 'qualified', 'converted', 'lost', 'new'])[k % 5 + 1] AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup')),
h_txns AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'sale' AS kind,
         o_totalprice + CASE WHEN o_orderkey % 70 = 0 THEN 50.0 ELSE 0.0 END AS amount
  FROM orders WHERE o_orderkey % 50 <> 0),
h_activities AS (
  SELECT 'order.placed:order:' || id AS id, 'order.placed' AS type, actor_employee_id, 'order' AS subject_type,
         id AS subject_id, 'app' AS source, created_at AS occurred_at FROM h_orders
  UNION ALL SELECT 'order.placed:customer:' || id, 'order.placed', actor_employee_id, 'customer', customer_id, 'app',
         created_at FROM h_orders
  UNION ALL SELECT 'production.queued:production:' || id, 'production.queued', NULL, 'production', 'job-' || id, 'app',
         created_at FROM h_orders
  UNION ALL SELECT 'delivery.done:order:' || id, 'delivery.done', NULL, 'order', id, 'app', created_at
         FROM h_orders WHERE status = 'delivered'
  UNION ALL SELECT 'delivery.done:customer:' || id, 'delivery.done', NULL, 'customer', customer_id, 'app', created_at
         FROM h_orders WHERE status = 'delivered'
  UNION ALL SELECT 'as.opened:' || id, 'as.opened', NULL, 'as', id, 'app', created_at FROM h_tickets
  UNION ALL SELECT 'as.resolved:' || id, 'as.resolved', assignee_id, 'as', id, 'app', created_at
         FROM h_tickets WHERE status = 'resolved')"""


def with_hub(body: str) -> str:
    return f"WITH {HUB_CTE}\n{body}"


SQL["customer_360"] = with_hub("""
SELECT c.id AS customer_id, c.name, c.segment, coalesce(o.orders, 0) AS orders,
       coalesce(t.open_as_tickets, 0) AS open_as_tickets, coalesce(t.as_tickets, 0) AS as_tickets,
       coalesce(l.leads, 0) AS leads, a.last_activity_at, coalesce(a.timeline_events, 0) AS timeline_events,
       round(coalesce(o.ltv, 0.0), 2) AS lifetime_value
FROM h_customers c
LEFT JOIN (SELECT customer_id, count(*) AS orders, sum(total_amount) AS ltv FROM h_orders GROUP BY 1) o
  ON o.customer_id = c.id
LEFT JOIN (SELECT customer_id, CAST(sum(CASE WHEN status <> 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS open_as_tickets,
                  count(*) AS as_tickets FROM h_tickets GROUP BY 1) t ON t.customer_id = c.id
LEFT JOIN (SELECT customer_id, count(*) AS leads FROM h_leads GROUP BY 1) l ON l.customer_id = c.id
LEFT JOIN (SELECT subject_id, max(occurred_at) AS last_activity_at, count(*) AS timeline_events
           FROM h_activities WHERE subject_type = 'customer' GROUP BY 1) a ON a.subject_id = c.id""")

SQL["customer_timeline"] = with_hub("""
SELECT subject_id AS customer_id, type, occurred_at AS at, source,
       id
FROM h_activities WHERE subject_type = 'customer'""")

SQL["inventory_status"] = with_hub("""
SELECT p.id AS product_id, p.sku, p.name, p.stock_qty, CAST(coalesce(a.allocated, 0) AS BIGINT) AS allocated,
       CAST(p.stock_qty - coalesce(a.allocated, 0) AS BIGINT) AS available
FROM h_products p LEFT JOIN (
  SELECT l.product_id, sum(l.qty) AS allocated FROM h_lines l JOIN h_orders o ON l.order_id = o.id
  WHERE o.status IN ('placed', 'in_production') GROUP BY 1) a ON a.product_id = p.id""")

SQL["employee_performance"] = with_hub("""
, bt AS (SELECT actor_employee_id AS employee_id, type, count(*) AS n FROM h_activities
         WHERE actor_employee_id IS NOT NULL GROUP BY ALL),
b AS (SELECT employee_id, CAST(sum(n) AS BIGINT) AS activity_count,
             string_agg(type || '=' || CAST(n AS VARCHAR), ';' ORDER BY type) AS by_type FROM bt GROUP BY 1),
tk AS (SELECT assignee_id AS employee_id,
              CAST(sum(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS as_resolved,
              CAST(sum(CASE WHEN status <> 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS as_open
       FROM h_tickets WHERE assignee_id IS NOT NULL GROUP BY 1)
SELECT e.id AS employee_id, e.name, e.role, coalesce(b.activity_count, 0) AS activity_count,
       coalesce(b.by_type, '') AS by_type, coalesce(tk.as_resolved, 0) AS as_resolved, coalesce(tk.as_open, 0) AS as_open
FROM h_employees e LEFT JOIN b ON b.employee_id = e.id LEFT JOIN tk ON tk.employee_id = e.id""".replace(
    "\n, bt AS", ", bt AS", 1))

SQL["lead_funnel"] = with_hub("""
, bys AS (SELECT status, count(*) AS n FROM h_leads GROUP BY 1),
lr AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS lead_total,
              CAST(coalesce(sum(CASE WHEN status = 'converted' THEN n END), 0) AS BIGINT) AS converted,
              string_agg(status || '=' || CAST(n AS VARCHAR), ';' ORDER BY status) AS by_status FROM bys),
orr AS (SELECT count(*) AS orders, round(coalesce(sum(total_amount), 0.0), 2) AS revenue FROM h_orders)
SELECT lead_total, converted, by_status, orders, revenue,
       round(CASE WHEN lead_total = 0 THEN 0.0 ELSE converted / lead_total END, 4) AS conversion_rate
FROM lr, orr""".replace("\n, bys AS", ", bys AS", 1))

_RECON = """
, placed AS (SELECT DISTINCT subject_id AS order_id FROM h_activities
             WHERE type = 'order.placed' AND subject_type = 'order'),
ex AS (SELECT p.order_id, CASE WHEN o.status = 'cancelled' THEN 0.0 ELSE coalesce(o.total_amount, 0.0) END AS expected
       FROM placed p LEFT JOIN h_orders o ON o.id = p.order_id),
ac AS (SELECT order_id, sum(CASE WHEN kind = 'sale' THEN amount ELSE -amount END) AS actual, count(*) AS vouchers
       FROM h_txns GROUP BY 1),
detail AS (
  SELECT coalesce(ex.order_id, ac.order_id) AS order_id, ex.expected, round(ac.actual, 2) AS actual,
         coalesce(ac.vouchers, 0) AS vouchers,
         CASE WHEN ex.order_id IS NULL THEN 'orphan'
              WHEN ac.vouchers IS NULL AND ex.expected = 0.0 THEN 'matched'
              WHEN ac.vouchers IS NULL THEN 'missing'
              WHEN abs(ac.actual - ex.expected) < 0.01 THEN 'matched' ELSE 'mismatched' END AS recon_status
  FROM ex FULL OUTER JOIN ac ON ex.order_id = ac.order_id)"""

SQL["reconcile_detail"] = with_hub(_RECON.replace("\n, placed", ", placed", 1) + "\nSELECT * FROM detail")

_RECON_SUM = """
, s AS (SELECT CAST(sum(CASE WHEN recon_status <> 'orphan' THEN 1 ELSE 0 END) AS BIGINT) AS total_orders,
              CAST(sum(CASE WHEN recon_status = 'matched' THEN 1 ELSE 0 END) AS BIGINT) AS matched,
              CAST(sum(CASE WHEN recon_status = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
              CAST(sum(CASE WHEN recon_status = 'mismatched' THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
              CAST(sum(CASE WHEN recon_status = 'orphan' THEN 1 ELSE 0 END) AS BIGINT) AS orphan_transactions
        FROM detail),
summary AS (SELECT *, CASE WHEN total_orders = 0 THEN 1.0 ELSE round(matched / total_orders, 4) END AS integrity_rate
            FROM s)"""

SQL["reconcile_summary"] = with_hub(_RECON.replace("\n, placed", ", placed", 1) + _RECON_SUM + """
SELECT *, integrity_rate >= 0.99 AND orphan_transactions = 0 AS healthy FROM summary""")

SQL["pending_postings"] = with_hub("""
SELECT p.order_id, o.customer_id, 'sale' AS kind, coalesce(o.total_amount, 0.0) AS amount, 'order ' || p.order_id AS memo
FROM (SELECT DISTINCT subject_id AS order_id FROM h_activities WHERE type = 'order.placed' AND subject_type = 'order') p
LEFT JOIN h_orders o ON o.id = p.order_id
WHERE p.order_id NOT IN (SELECT order_id FROM h_txns) AND coalesce(o.status, '') <> 'cancelled'""")

SQL["order_totals"] = with_hub("""
SELECT l.order_id, round(sum(coalesce(l.unit_price, p.unit_price, 0.0) * coalesce(l.qty, 1)), 2) AS total_amount,
       count(*) AS lines
FROM h_lines l LEFT JOIN h_products p ON p.id = l.product_id GROUP BY 1""")

SQL["order_activities"] = with_hub("""
SELECT id, type, actor_employee_id, subject_type, subject_id, source, occurred_at FROM h_activities WHERE type IN ('order.placed', 'production.queued', 'delivery.done')""")

_TRIAGE_BASE = """
, cls AS (
  SELECT t.*, lower(coalesce(summary, '')) AS txt FROM h_tickets t),
c2 AS (
  SELECT *,
    CASE WHEN {billing} THEN 'billing' WHEN {hardware} THEN 'hardware' WHEN {software} THEN 'software'
         WHEN {delivery} THEN 'delivery' ELSE 'other' END AS category_rule,
    CASE WHEN {high} THEN 'high' WHEN {low} THEN 'low' ELSE 'medium' END AS severity_rule FROM cls),
c3 AS (
  SELECT id, created_at, coalesce(category, category_rule) AS category, coalesce(severity, severity_rule) AS severity
  FROM c2),
c4 AS (
  SELECT *, CASE category WHEN 'billing' THEN 'accounting' WHEN 'hardware' THEN 'production'
                 WHEN 'software' THEN 'production' WHEN 'delivery' THEN 'as' WHEN 'other' THEN 'as' ELSE 'as' END
            AS owner_role FROM c3),
ld AS (SELECT assignee_id AS emp_id, count(*) AS open_load FROM h_tickets
       WHERE status <> 'resolved' AND assignee_id IS NOT NULL GROUP BY 1),
cand AS (SELECT e.id AS emp_id, e.name AS assignee_name, e.role AS owner_role, coalesce(ld.open_load, 0) AS open_load,
                row_number() OVER (PARTITION BY e.role ORDER BY coalesce(ld.open_load, 0), e.id) - 1 AS slot,
                count(*) OVER (PARTITION BY e.role) AS n_cand
         FROM h_employees e LEFT JOIN ld ON ld.emp_id = e.id)"""


def _kw(words):
    return "(" + " OR ".join(f"contains(txt, '{w.lower()}')" for w in words) + ")"


def _triage_sql():
    from tessera.operators.hub import CATEGORY_KEYWORDS, HIGH_SEVERITY, LOW_SEVERITY
    kw = {name: _kw(ws) for name, ws in CATEGORY_KEYWORDS}
    return _TRIAGE_BASE.format(high=_kw(HIGH_SEVERITY), low=_kw(LOW_SEVERITY), **kw).replace("\n, cls", ", cls", 1)


SQL["ticket_triage"] = with_hub(_triage_sql() + """
SELECT c4.id, c4.category, c4.severity, c4.owner_role, cand.emp_id AS assignee_id_new, cand.assignee_name
FROM c4 LEFT JOIN cand ON cand.owner_role = c4.owner_role AND cand.slot = 0""")

# One ticket after the other: each step gives the least loaded member one more and keeps the loads as a list.
SQL["ticket_triage_sequential"] = with_hub(_triage_sql() + """
, own AS (SELECT c4.*, t.assignee_id, t.status AS st FROM c4 JOIN h_tickets t ON t.id = c4.id),
seq AS (SELECT id, owner_role, row_number() OVER (PARTITION BY owner_role ORDER BY created_at, id) AS k
        FROM own WHERE st <> 'resolved' AND assignee_id IS NULL),
goal AS (SELECT owner_role, max(k) AS n FROM seq GROUP BY 1),
sim AS (
  SELECT owner_role, 0 AS k, list_sort(list({'load': open_load, 'emp': emp_id})) AS loads, CAST(NULL AS VARCHAR) AS pick
  FROM cand GROUP BY owner_role
  UNION ALL
  SELECT sim.owner_role, sim.k + 1,
         list_sort(list_append(sim.loads[2:], {'load': sim.loads[1].load + 1, 'emp': sim.loads[1].emp})), sim.loads[1].emp
  FROM sim JOIN goal ON goal.owner_role = sim.owner_role WHERE sim.k < goal.n)
SELECT own.id, own.category, own.severity, own.owner_role, coalesce(own.assignee_id, sim.pick) AS assignee_id_new, e.name AS assignee_name
FROM own LEFT JOIN seq ON seq.id = own.id LEFT JOIN sim ON sim.owner_role = seq.owner_role AND sim.k = seq.k
LEFT JOIN h_employees e ON e.id = coalesce(own.assignee_id, sim.pick)""").replace("WITH ", "WITH RECURSIVE ", 1)

SQL["insight_signals"] = with_hub("""
, inv AS (
  SELECT p.sku, p.stock_qty - coalesce(a.allocated, 0) AS available FROM h_products p LEFT JOIN (
    SELECT l.product_id, sum(l.qty) AS allocated FROM h_lines l JOIN h_orders o ON l.order_id = o.id
    WHERE o.status IN ('placed', 'in_production') GROUP BY 1) a ON a.product_id = p.id),
lr AS (SELECT count(*) AS lead_total, sum(CASE WHEN status = 'converted' THEN 1 ELSE 0 END) AS converted FROM h_leads),
pipe AS (SELECT lead_total, round(CASE WHEN lead_total = 0 THEN 0.0 ELSE converted / lead_total END, 4) AS conversion_rate
         FROM lr),
perf AS (SELECT e.name, coalesce(t.as_open, 0) AS as_open FROM h_employees e LEFT JOIN (
           SELECT assignee_id, sum(CASE WHEN status <> 'resolved' THEN 1 ELSE 0 END) AS as_open FROM h_tickets
           WHERE assignee_id IS NOT NULL GROUP BY 1) t ON t.assignee_id = e.id)
SELECT 'inventory_oversold' AS type, 'high' AS severity, sku || ' available ' || CAST(available AS VARCHAR) AS detail
FROM inv WHERE available < 0
UNION ALL
SELECT 'low_conversion', 'medium', 'conversion ' || CAST(conversion_rate AS VARCHAR) || ' over '
       || CAST(lead_total AS VARCHAR) || ' leads' FROM pipe WHERE lead_total >= 5 AND conversion_rate < 0.2
UNION ALL
SELECT 'overloaded_staff', 'medium', name || ' has ' || CAST(as_open AS VARCHAR) || ' open AS tickets'
FROM perf WHERE as_open >= 3""".replace("\n, inv", ", inv", 1))

SQL["adoption_metrics"] = with_hub(_RECON.replace("\n, placed", ", placed", 1) + _RECON_SUM + """,
now AS (SELECT max(occurred_at) AS now FROM h_activities),
act AS (SELECT count(DISTINCT CASE WHEN occurred_at >= (SELECT now FROM now) - INTERVAL 7 DAY
                                    AND actor_employee_id IS NOT NULL THEN actor_employee_id END) AS active,
               count(*) AS total_activity FROM h_activities),
emp AS (SELECT count(*) AS employees FROM h_employees),
fu AS (SELECT count(*) AS followups_drafted, CAST(0 AS BIGINT) AS followups_sent FROM h_orders WHERE status = 'delivered'),
tk AS (SELECT CAST(sum(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS resolved_tickets FROM h_tickets),
kn AS (SELECT count(*) AS knowledge_items FROM h_tickets WHERE status = 'resolved')
SELECT 7 AS window_days, employees, active, round(CASE WHEN employees = 0 THEN 0.0 ELSE active / employees END, 4)
         AS dau_ratio, total_activity, followups_drafted, followups_sent,
       round(CASE WHEN followups_drafted = 0 THEN 0.0 ELSE followups_sent / followups_drafted END, 4) AS approval_rate,
       resolved_tickets, knowledge_items,
       round(CASE WHEN resolved_tickets = 0 THEN 0.0 ELSE knowledge_items / resolved_tickets END, 4) AS coverage,
       integrity_rate AS accounting_integrity
FROM act, emp, fu, tk, kn, summary""")

SQL["activity_by_source"] = with_hub("SELECT source, count(*) AS count FROM h_activities GROUP BY 1")

SQL["ownership_coverage"] = with_hub("""
, dom AS (SELECT unnest(['marketing', 'crm', 'production', 'inventory', 'as', 'accounting', 'schedule', 'knowledge',
                         'performance']) AS domain),
own AS (SELECT DISTINCT CASE role WHEN 'sales' THEN 'crm' WHEN 'production' THEN 'production' WHEN 'as' THEN 'as'
                           WHEN 'accounting' THEN 'accounting' WHEN 'manager' THEN 'performance' END AS domain
        FROM h_employees)
SELECT domain, domain IN (SELECT domain FROM own WHERE domain IS NOT NULL) AS assigned FROM dom""".replace(
    "\n, dom", ", dom", 1))


def _triage_cls_only():
    from tessera.operators.hub import CATEGORY_KEYWORDS
    kw = {name: _kw(ws) for name, ws in CATEGORY_KEYWORDS}
    return ("CASE WHEN {billing} THEN 'billing' WHEN {hardware} THEN 'hardware' WHEN {software} THEN 'software' "
            "WHEN {delivery} THEN 'delivery' ELSE 'other' END").format(**kw)


SQL["knowledge_capture"] = with_hub(f"""
, c AS (SELECT *, {_triage_cls_only()} AS cat FROM (SELECT *, lower(coalesce(summary, '')) AS txt FROM h_tickets)
        WHERE status = 'resolved')
SELECT 'K-' || id AS id, id AS ticket_id, '[' || cat || '] ' || substr(coalesce(summary, 'AS resolution'), 1, 80) AS title,
       'Symptom: ' || coalesce(summary, '-') || chr(10) || 'Category: ' || cat || ' / Severity: '
         || coalesce(severity, '-') || chr(10) || 'Resolution: ' || coalesce(resolution, '-') || chr(10)
         || 'Prevention: (review needed)' AS body,
       [cat, 'as'] AS tags, 'draft' AS status FROM c""".replace("\n, c AS", ", c AS", 1))

SQL["followup_drafts"] = with_hub("""
SELECT 'F-' || o.id AS id, o.id AS order_id, o.customer_id, 'email' AS channel, 'draft' AS status,
       c.name || ', we are checking that your order (no. ' || substr(o.id, 1, 8) || ') arrived well. '
       || 'If anything is inconvenient or unclear, please reply any time. Thank you.' AS draft
FROM h_orders o LEFT JOIN h_customers c ON c.id = o.customer_id WHERE o.status = 'delivered'""")

SQL["visible_widgets"] = with_hub("""
, prefs AS (SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS employee_id FROM supplier WHERE s_suppkey % 3 = 0),
layout AS (SELECT * FROM (VALUES (0, 'pipeline'), (1, 'inventory'), (2, 'as_queue'), (3, 'insights')) t(position, widget)),
wr AS (SELECT * FROM (VALUES ('pipeline', 'sales'), ('pipeline', 'manager'), ('inventory', 'production'),
         ('inventory', 'accounting'), ('inventory', 'manager'), ('as_queue', 'as'), ('as_queue', 'manager'),
         ('insights', 'manager')) t(widget, role)),
presets AS (SELECT * FROM (VALUES ('sales', 0, 'pipeline'), ('sales', 1, 'customer_directory'),
         ('sales', 2, 'followup_queue'), ('production', 0, 'production_queue'), ('production', 1, 'inventory'),
         ('as', 0, 'as_queue'), ('as', 1, 'followup_queue'), ('as', 2, 'knowledge_recent'),
         ('accounting', 0, 'accounting_health'), ('accounting', 1, 'inventory'), ('manager', 0, 'pipeline'),
         ('manager', 1, 'performance'), ('manager', 2, 'inventory'), ('manager', 3, 'accounting_health'),
         ('manager', 4, 'insights')) t(role, position, widget))
SELECT e.id AS employee_id, e.role, l.position, l.widget
FROM h_employees e JOIN prefs p ON p.employee_id = e.id CROSS JOIN layout l
WHERE e.role = 'manager' OR EXISTS (SELECT 1 FROM wr WHERE wr.widget = l.widget AND wr.role = e.role)
UNION ALL
SELECT e.id, e.role, ps.position, ps.widget FROM h_employees e JOIN presets ps ON ps.role = e.role
WHERE e.id NOT IN (SELECT employee_id FROM prefs)""".replace("\n, prefs", ", prefs", 1))

SQL["open_ticket_queue"] = with_hub("SELECT id, status, assignee_id, created_at FROM h_tickets WHERE status <> 'resolved'")

SQL["scoped_customers_sales"] = with_hub("""
SELECT c.id, c.name, c.segment, c.owner_employee_id,
       lower(replace(c.name, '#', '.')) || '@example.com' AS email,
       printf('010-%04d-%04d', CAST(k.c_custkey % 10000 AS INTEGER), CAST((k.c_custkey * 7) % 10000 AS INTEGER)) AS phone
FROM h_customers c JOIN customer k ON CAST(k.c_custkey AS VARCHAR) = c.id WHERE c.owner_employee_id = 'E5'""")

SQL["scoped_customers_as"] = with_hub("""
SELECT c.id, c.name, c.segment, c.owner_employee_id,
       lower(replace(c.name, '#', '.')) || '@example.com' AS email,
       printf('010-%04d-%04d', CAST(k.c_custkey % 10000 AS INTEGER), CAST((k.c_custkey * 7) % 10000 AS INTEGER)) AS phone
FROM h_customers c JOIN customer k ON CAST(k.c_custkey AS VARCHAR) = c.id
WHERE c.id IN (SELECT customer_id FROM h_tickets WHERE assignee_id = 'E2')""")

SQL["scoped_tickets_as"] = with_hub("""
SELECT id, status, assignee_id FROM h_tickets WHERE status <> 'resolved' AND (assignee_id = 'E2' OR assignee_id IS NULL)""")

SQL["employee_principals"] = with_hub("""
SELECT id, role, array_to_string(list_sort(list_distinct(
  CASE role WHEN 'sales' THEN ['grp:all', 'grp:sales'] WHEN 'production' THEN ['grp:all', 'grp:production']
            WHEN 'as' THEN ['grp:all', 'grp:as'] WHEN 'accounting' THEN ['grp:all', 'grp:accounting']
            WHEN 'manager' THEN ['grp:all', 'grp:sales', 'grp:production', 'grp:as', 'grp:accounting', 'grp:manager']
            ELSE ['grp:all'] END || ['usr:' || id])), ',') AS principals FROM h_employees""")

SQL["orders_missing_vouchers"] = with_hub("""
SELECT id AS order_id, status, total_amount FROM h_orders WHERE id NOT IN (SELECT order_id FROM h_txns)""")

SQL["customers_with_assigned_ticket"] = with_hub("""
SELECT id, name FROM h_customers WHERE id IN (SELECT customer_id FROM h_tickets WHERE assignee_id IS NOT NULL)""")

SQL["llm_price_lookup"] = with_telemetry(""",
prices AS (SELECT * FROM (VALUES
  ('claude-3-opus*', 0.015, 0.075, 'anthropic', 'premium'), ('claude-3.5-sonnet*', 0.003, 0.015, 'anthropic', 'standard'),
  ('claude-3-haiku*', 0.00025, 0.00125, 'anthropic', 'economy'), ('gpt-4o*', 0.005, 0.015, 'openai', 'standard'),
  ('gpt-4o-mini*', 0.00015, 0.0006, 'openai', 'economy'), ('gpt-3.5-turbo*', 0.0005, 0.0015, 'openai', 'economy'),
  ('gemini-1.5-pro*', 0.0035, 0.0105, 'google', 'standard'), ('gemini-1.5-flash*', 0.00035, 0.00105, 'google', 'economy'))
  t(pattern, inp, outp, provider, tier)),
llm AS (SELECT * FROM telemetry WHERE event_type = 'mcp_llm_call'),
cand AS (SELECT m.model AS m, p.*, row_number() OVER (PARTITION BY m.model ORDER BY length(rtrim(p.pattern, '*')) DESC,
                p.pattern) AS r
         FROM (SELECT DISTINCT model FROM llm) m JOIN prices p
           ON CASE WHEN ends_with(p.pattern, '*') THEN starts_with(m.model, rtrim(p.pattern, '*'))
                   ELSE m.model = p.pattern END)
SELECT l.event_id, l.model, c.pattern AS price_pattern, c.provider AS price_provider, c.tier AS price_tier,
       round(coalesce(l.prompt_tokens, 0) / 1000.0 * CAST(c.inp AS DOUBLE)
             + coalesce(l.completion_tokens, 0) / 1000.0 * CAST(c.outp AS DOUBLE), 8) AS price_cost_usd
FROM llm l LEFT JOIN (SELECT * FROM cand WHERE r = 1) c ON c.m = l.model""")

SQL["event_type_lookup"] = _llm("""
SELECT event_type, CASE event_type WHEN 'mcp_llm_call' THEN 'LLM call' WHEN 'mcp_cache_hit' THEN 'Cache hit'
                                   WHEN 'mcp_cache_miss' THEN 'Cache miss' ELSE 'unknown' END AS label,
       count(*) AS events FROM telemetry GROUP BY ALL""")

SQL["related_entities"] = """
WITH edges AS (
  SELECT n_name AS src, 'in_region' AS relation, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
names AS (SELECT DISTINCT name FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation))
SELECT n.name AS entity, e.relation, e.dst AS neighbour FROM edges e JOIN names n ON e.src = n.name
UNION ALL
SELECT n.name, 'inverse_' || e.relation, e.src FROM edges e JOIN names n ON e.dst = n.name"""

SQL["parties_union"] = """
SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS acctbal FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier"""

SQL["distinct_order_parts"] = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"

SQL["parts_never_ordered"] = """
SELECT p_partkey AS partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)"""

SQL["top_parts_per_brand"] = """
WITH rev AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1),
j AS (SELECT p_brand, p_partkey, revenue FROM rev JOIN part ON l_partkey = p_partkey)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS rank FROM j)
WHERE rank <= 3"""

# --- DLP, PII and governance ------------------------------------------------------------------------
DLP_REQ_CTE = """
req AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, text,
         CASE WHEN role = 'user' THEN 'outbound' WHEN role = 'assistant' THEN 'inbound' ELSE 'internal' END AS direction,
         (['web_search', 'email_send', 'file_upload', 'db_query'])[conv_id % 4 + 1] AS tool_name,
         'u' || CAST(conv_id % 50 AS VARCHAR) AS user_id,
         (['', 'partner.example.com', '', 'mail.example.org'])[(conv_id + turn) % 4 + 1] AS destination,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS BIGINT)) + to_seconds(CAST(turn AS BIGINT)) AS ts
  FROM conversations
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR), text, 'outbound', (['file_upload', 'email_send'])[doc_id % 2 + 1], source,
         (['', 'partner.example.com', '', 'mail.example.org'])[doc_id % 4 + 1],
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS BIGINT))
  FROM documents)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _dlp_sql_parts():
    from tessera.operators.protect import ACTION_RANK, DEFAULT_RULES
    rules = sorted([r for r in DEFAULT_RULES if r.enabled], key=lambda r: r.priority)
    items = []
    for r in rules:
        app = f"direction IN ({', '.join(_q(x) for x in r.directions)})"
        if r.target_tools:
            app += f" AND coalesce(tool_name, '') IN ({', '.join(_q(x) for x in r.target_tools)})"
        pats = "list_filter([" + ", ".join(
            f"CASE WHEN regexp_matches(t, {_q(p)}, 'i') THEN {_q(p)} END" for p in r.patterns) + "], lambda x: x IS NOT NULL)"
        kws = "list_filter([" + ", ".join(
            f"CASE WHEN contains(lower(t), {_q(k.lower())}) THEN {_q(k)} END" for k in r.keywords) + "], lambda x: x IS NOT NULL)"
        items.append((r, app, pats, kws))
    return rules, items, ACTION_RANK


def _dlp_rows_sql() -> str:
    rules, items, rank = _dlp_sql_parts()
    unions = []
    for i, (r, app, pats, kws) in enumerate(items):
        unions.append(f"""SELECT request_id, t, direction, {i} AS rule_order, {_q(r.rule_id)} AS rule_id,
       {_q(r.name)} AS rule_name, {pats} AS mp, {kws} AS mk, {_q(r.sensitivity)} AS sensitivity,
       {_q(r.action)} AS action_taken, {rank[r.action]} AS action_rank
FROM base WHERE {app}""")
    return f"""WITH {DLP_REQ_CTE.strip()},
base AS (SELECT *, coalesce(text, '') AS t FROM req),
cand AS ({' UNION ALL '.join(unions)}),
viol AS (SELECT * FROM cand WHERE len(mp) > 0 OR len(mk) > 0)"""


SQL["dlp_violations"] = _dlp_rows_sql() + """
SELECT request_id, rule_id, rule_name, sensitivity, action_taken, CAST(len(mp) AS INTEGER) AS n_patterns,
       array_to_string(mk, '|') AS keywords, substr(sha256(t), 1, 16) AS data_hash,
       CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS data_preview FROM viol"""

_DLP_DECIDE = """,
dec AS (SELECT b.request_id, b.text, b.t, b.direction, min(v.action_rank) AS best, count(v.rule_id) AS violation_count,
               list(v.rule_id) AS hit_rules
        FROM base b LEFT JOIN viol v ON v.request_id = b.request_id GROUP BY ALL),
dec2 AS (SELECT *, CASE best WHEN 0 THEN 'block' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'encrypt' WHEN 3 THEN 'mask'
                            WHEN 4 THEN 'alert' WHEN 5 THEN 'allow' ELSE 'allow' END AS dlp_action FROM dec)"""

SQL["dlp_decisions"] = _dlp_rows_sql() + _DLP_DECIDE + """
SELECT request_id, dlp_action, violation_count = 0 AS is_clean, CAST(violation_count AS INTEGER) AS violation_count
FROM dec2"""


def _dlp_apply_sql() -> str:
    rules, items, _ = _dlp_sql_parts()
    masked = "t"
    for r, *_ in items:
        rep = masked
        for p in r.patterns:
            rep = f"regexp_replace({rep}, {_q(p)}, '[REDACTED]', 'gi')"
        masked = f"CASE WHEN list_contains(hit_rules, {_q(r.rule_id)}) THEN {rep} ELSE {masked} END"
    return _dlp_rows_sql() + _DLP_DECIDE + f"""
SELECT request_id, dlp_action, CASE WHEN dlp_action = 'mask' THEN {masked} ELSE text END AS processed_text,
       NOT coalesce(direction = 'outbound' AND dlp_action IN ('block', 'quarantine'), false) AS passed FROM dec2"""


SQL["dlp_processed"] = _dlp_apply_sql()

SQL["dlp_statistics"] = _dlp_rows_sql() + """,
dist AS (SELECT 'rule' AS dimension, rule_name AS key, count(*) AS count FROM viol GROUP BY 2
         UNION ALL SELECT 'action', action_taken, count(*) FROM viol GROUP BY 2
         UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM viol GROUP BY 2),
tot AS (SELECT count(*) AS total_violations,
               CAST(sum(CASE WHEN action_taken = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS blocked_count,
               CAST(sum(CASE WHEN action_taken = 'mask' THEN 1 ELSE 0 END) AS BIGINT) AS masked_count FROM viol)
SELECT * FROM dist CROSS JOIN tot"""

SQL["violations_by_rule_action"] = _dlp_rows_sql() + """
SELECT rule_name, action_taken, sensitivity, count(*) AS violations FROM viol GROUP BY ALL"""

SQL["violations_with_actions"] = _dlp_rows_sql() + """
SELECT rule_name, sensitivity, count(*) AS violations, list_sort(list(DISTINCT action_taken)) AS actions
FROM viol GROUP BY ALL"""

SQL["dlp_burst_alert"] = _dlp_rows_sql() + """,
vt AS (SELECT v.*, b.ts FROM viol v JOIN base b USING (request_id)),
recent AS (SELECT * FROM vt WHERE ts >= (SELECT max(ts) FROM vt) - INTERVAL 10 MINUTE AND ts <= (SELECT max(ts) FROM vt)),
agg AS (SELECT count(*) AS violations FROM recent)
SELECT 'dlp_burst' AS anomaly_type, CAST(violations AS DOUBLE) AS metric_value FROM agg WHERE violations >= 10"""

SQL["violation_risk"] = _dlp_rows_sql() + """,
s AS (SELECT request_id, rule_id,
        CAST((CASE WHEN contains(upper(sensitivity), 'TOP_SECRET') THEN 60 WHEN contains(upper(sensitivity), 'RESTRICTED')
                   THEN 45 WHEN contains(upper(sensitivity), 'CONFIDENTIAL') THEN 30
                   WHEN contains(upper(sensitivity), 'INTERNAL') THEN 15 ELSE 0 END)
           + (CASE WHEN contains(upper(action_taken), 'BLOCK') THEN 30 WHEN contains(upper(action_taken), 'QUARANTINE')
                   THEN 25 WHEN contains(upper(action_taken), 'MASK') THEN 10 ELSE 0 END) AS INTEGER) AS risk_score
      FROM viol)
SELECT request_id, rule_id, risk_score,
       CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
            ELSE 'low' END AS risk_level,
       CASE WHEN risk_score >= 80 THEN 'mcp_block_user' WHEN risk_score >= 60 THEN 'mcp_quarantine_session'
            ELSE 'mcp_notify_security' END AS recommended_playbook,
       risk_score >= 60 AS requires_human_review, risk_score >= 30 AS incident FROM s"""


def _pii_risk_sql() -> str:
    from tessera.operators.protect import ENTITY_PATTERNS, HIGH_RISK, MEDIUM_RISK
    cnt = ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), {_q(p)}, 0, 'i')) AS INTEGER) AS n_{n.lower()}"
                    for n, p in ENTITY_PATTERNS)
    tot = " + ".join(f"n_{n.lower()}" for n, _ in ENTITY_PATTERNS)
    hi = " + ".join(f"n_{n.lower()}" for n in HIGH_RISK)
    me = " + ".join(f"n_{n.lower()}" for n in MEDIUM_RISK)
    return f"""SELECT *, {tot} AS entities_found,
       CASE WHEN {hi} > 0 THEN 'HIGH' WHEN {me} > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT doc_id, {cnt} FROM documents)"""


SQL["document_pii_risk"] = _pii_risk_sql()


def _pii_findings_sql() -> str:
    from tessera.operators.protect import GOVERNANCE_PII
    parts = [f"SELECT doc_id, {_q(n)} AS pii_type, regexp_extract_all(coalesce(text, ''), {_q(p)}, 0) AS m FROM documents"
             for n, p in GOVERNANCE_PII]
    return f"""SELECT doc_id, pii_type, CAST(i - 1 AS INTEGER) AS match_index, m[i] AS match
FROM ({' UNION ALL '.join(parts)}) x, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) r"""


SQL["document_pii_findings"] = _pii_findings_sql()


def _classify_sql(text_expr: str) -> str:
    from tessera.operators.protect import GOVERNANCE_PII, SENSITIVE_KEYWORDS
    pii = " OR ".join(f"regexp_matches({text_expr}, {_q(p)})" for _, p in GOVERNANCE_PII)
    kw = " OR ".join(f"contains(lower({text_expr}), {_q(k)})" for k in SENSITIVE_KEYWORDS)
    return f"CASE WHEN {pii} THEN 'PII' WHEN {kw} THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END"


SQL["document_classification"] = f"""
SELECT doc_id, {_classify_sql("concat_ws(' ', coalesce(text, ''), coalesce(source, ''))")} AS classification
FROM documents"""


def _mask_gov_sql(c: str) -> str:
    c = f"""regexp_replace({c}, '\\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}})\\b', '\\1***@\\2', 'g')"""
    c = f"regexp_replace({c}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '***-**-****', 'g')"
    c = f"regexp_replace({c}, '\\b\\d{{3}}-\\d{{3}}-\\d{{4}}\\b', '***-***-****', 'g')"
    c = f"regexp_replace({c}, '\\b\\d{{4}}[- ]?\\d{{4}}[- ]?\\d{{4}}[- ]?(\\d{{4}})\\b', '****-****-****-\\1', 'g')"
    c = f"regexp_replace({c}, '\\b\\d{{6}}[- ]?\\d{{7}}\\b', '******-*******', 'g')"
    c = f"regexp_replace({c}, '\\b01[016789]-?\\d{{3,4}}-?\\d{{4}}\\b', '010-****-****', 'g')"
    return c


SQL["protected_documents"] = f"""
WITH c AS (SELECT doc_id, text, source,
                  {_classify_sql("concat_ws(' ', coalesce(text, ''), coalesce(source, ''))")} AS classification
           FROM documents)
SELECT doc_id, CASE WHEN classification = 'PII' THEN {_mask_gov_sql('text')} ELSE text END AS text,
       CASE WHEN classification = 'PII' THEN {_mask_gov_sql('source')} ELSE source END AS source, classification FROM c"""

# --- routing and retrieval ---------------------------------------------------------------------------
PROMPTS_CTE = """
prompts AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS prompt_id, text,
         'E' || CAST(conv_id % 100 AS VARCHAR) AS employee_id,
         (['sales', 'production', 'as', 'accounting', 'manager'])[(conv_id % 100) % 5 + 1] AS role,
         lower(coalesce(text, '')) AS low,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS wc
  FROM conversations WHERE role = 'user')"""


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


def _complexity_cte() -> str:
    from tessera.operators import routing as rt
    tr, si = _any_sql("low", rt.TRIVIAL_PATTERNS), _any_sql("low", rt.SIMPLE_PATTERNS)
    co, ex = _any_sql("low", rt.COMPLEX_PATTERNS), _any_sql("low", rt.EXPERT_PATTERNS)
    return f"""{PROMPTS_CTE},
c0 AS (SELECT *, {tr} AND wc < 15 AS f_tr, {si} AS f_si, {co} AS f_co, {ex} AS f_ex FROM prompts),
c1 AS (SELECT *, CASE WHEN f_ex THEN 5 WHEN f_co THEN 4 WHEN f_si THEN 2 WHEN f_tr THEN 1 ELSE 3 END AS lv0,
              CASE WHEN f_ex THEN 0.75 WHEN f_co THEN 0.8 WHEN f_si THEN 0.8 WHEN f_tr THEN 0.85 ELSE 0.7 END AS confidence
       FROM c0),
cls AS (SELECT *, CAST(CASE WHEN wc > 100 AND lv0 < 4 THEN 4 WHEN wc <= 100 AND wc > 50 AND lv0 < 3 THEN 3 ELSE lv0 END
                        AS INTEGER) AS level FROM c1)"""


SQL["prompt_complexity"] = f"""WITH {_complexity_cte()}
SELECT prompt_id, CAST(wc AS INTEGER) AS word_count, level,
       (['TRIVIAL', 'SIMPLE', 'MODERATE', 'COMPLEX', 'EXPERT'])[level] AS complexity, CAST(confidence AS DOUBLE) AS confidence,
       CAST(least(4000, wc * 10 + 200) AS INTEGER) AS estimated_tokens,
       f_co AND (contains(low, 'code') OR contains(low, '코드')) AS requires_tools, f_ex AS requires_knowledge,
       (['gpt-4o-mini', 'gpt-4o-mini', 'claude-3.5-sonnet', 'claude-3.5-sonnet', 'claude-3-opus'])[level]
         AS recommended_model
FROM cls"""


def _task_cte() -> str:
    from tessera.operators import routing as rt
    return f"""{PROMPTS_CTE},
task AS (SELECT prompt_id, text, CASE WHEN {_any_sql('low', rt.CRITICAL_KW)} THEN 'critical'
                   WHEN {_any_sql('low', rt.COMPLEX_KW)} THEN 'complex' WHEN wc > 500 THEN 'complex'
                   WHEN wc > 100 THEN 'medium' WHEN {_any_sql('low', rt.SIMPLE_KW)} THEN 'simple'
                   ELSE 'medium' END AS task_complexity FROM prompts)"""


SQL["task_complexity"] = f"WITH {_task_cte()}\nSELECT prompt_id, task_complexity FROM task"


def _catalog_values() -> str:
    from tessera.operators.routing import MODEL_CATALOG
    rows = ", ".join(f"({_q(m)}, {_q(p)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE), {mt}, {lat}, CAST({q} AS DOUBLE), {n})"
                     for n, (m, p, i, o, mt, lat, q) in enumerate(MODEL_CATALOG))
    return (f"catalog AS (SELECT * FROM (VALUES {rows}) t(model, provider, input_cost_per_1k, output_cost_per_1k, "
            f"max_tokens, avg_latency_ms, quality_score, catalog_order))")


def _route_sql(wc: float, wq: float, ws: float, max_cost=None, max_lat=None, excluded=(), preferred=()) -> str:
    where = ["TRUE"]
    if excluded:
        where.append(f"model NOT IN ({', '.join(_q(x) for x in excluded)})")
    if max_cost is not None:
        where.append(f"0.5 * input_cost_per_1k + 0.5 * output_cost_per_1k <= {max_cost}")
    if max_lat is not None:
        where.append(f"avg_latency_ms <= {max_lat}")
    pref = "0"
    if preferred:
        pref = "CASE model " + " ".join(f"WHEN {_q(m)} THEN {i}" for i, m in enumerate(preferred)) + \
               f" ELSE {len(preferred)} END"
    strategy = ("quality_first" if wq > 0.6 else "cost_optimized" if wc > 0.5 else "speed_first" if ws > 0.4
                else "balanced")
    return f"""WITH {_complexity_cte()}, {_catalog_values()},
cat AS (SELECT * FROM catalog WHERE {' AND '.join(where)}),
pairs AS (
  SELECT c.prompt_id, c.level, k.*,
         k.quality_score / 10.0 * (CASE WHEN c.level IN (4, 5) THEN {wq} * 1.3 WHEN c.level IN (1, 2) THEN {wq} * 0.7
                                        ELSE {wq} END)
         + (1 - least(1.0, k.input_cost_per_1k / 0.02)) * (CASE WHEN c.level IN (4, 5) THEN {wc} * 0.7
                                        WHEN c.level IN (1, 2) THEN {wc} * 1.3 ELSE {wc} END)
         + (1 - least(1.0, k.avg_latency_ms / 5000.0)) * {ws} AS score, {pref} AS pref_rank
  FROM cls c CROSS JOIN cat k
  WHERE k.quality_score >= CASE c.level WHEN 1 THEN 6.0 WHEN 2 THEN 7.0 WHEN 3 THEN 7.5 WHEN 4 THEN 8.5 ELSE 9.0 END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, pref_rank, catalog_order) AS r
           FROM pairs),
best AS (SELECT prompt_id, max(CASE WHEN r = 1 THEN model END) AS selected_model,
                max(CASE WHEN r = 2 THEN model END) AS fallback_model, max(CASE WHEN r = 1 THEN score END) AS score
         FROM ranked WHERE r <= 2 GROUP BY 1),
j AS (SELECT c.prompt_id, (['TRIVIAL', 'SIMPLE', 'MODERATE', 'COMPLEX', 'EXPERT'])[c.level] AS complexity, c.level,
             coalesce(b.selected_model, 'gpt-4o-mini') AS selected_model,
             coalesce(b.fallback_model, 'gpt-3.5-turbo') AS fallback_model, b.score,
             CAST(least(4000, c.wc * 10 + 200) AS INTEGER) AS est_tokens
      FROM cls c LEFT JOIN best b USING (prompt_id))
SELECT j.prompt_id, j.complexity, j.level, j.selected_model, j.fallback_model, '{strategy}' AS strategy,
       round(j.score, 6) AS score,
       round(coalesce(floor(est_tokens / 2) / 1000.0 * k.input_cost_per_1k + floor(est_tokens / 2) / 1000.0
                      * k.output_cost_per_1k, 0.001), 8) AS cost_estimate,
       coalesce(k.avg_latency_ms, 1000) AS latency_estimate_ms
FROM j LEFT JOIN catalog k ON k.model = j.selected_model"""


SQL["model_routing"] = _route_sql(0.3, 0.5, 0.2)
SQL["model_routing_constrained"] = _route_sql(0.6, 0.3, 0.1, 0.01, 2500, ("gpt-4o",), ("claude-3.5-sonnet",))


def _strategy_sql(strategy: str) -> str:
    from tessera.operators.routing import TASK_TO_MODELS
    cand = ", ".join(f"({_q(k)}, {i}, {_q(m)})" for k, ms in TASK_TO_MODELS.items() for i, m in enumerate(ms))
    key = {"cost": "input_cost_per_1k ASC", "quality": "quality_score DESC", "speed": "avg_latency_ms ASC",
           "balanced": "(quality_score * 0.5 + (1 / (input_cost_per_1k + 0.001)) * 0.3 + (1 / (avg_latency_ms + 1)) * 0.2)"
                       " DESC"}[strategy]
    return f"""WITH {_task_cte()}, {_catalog_values()},
cand AS (SELECT * FROM (VALUES {cand}) t(task_complexity, cand_order, model)),
pairs AS (SELECT t.prompt_id, t.task_complexity, c.cand_order, k.* FROM task t JOIN cand c USING (task_complexity)
          JOIN catalog k ON k.model = c.model),
best AS (SELECT prompt_id, model AS selected_model FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {key}, cand_order ASC) AS r FROM pairs) WHERE r = 1)
SELECT t.prompt_id, t.task_complexity, coalesce(b.selected_model, 'gpt-4o-mini') AS selected_model,
       '{strategy}' AS strategy
FROM task t LEFT JOIN best b USING (prompt_id)"""


SQL["strategy_routing_balanced"] = _strategy_sql("balanced")
SQL["strategy_routing_cost"] = _strategy_sql("cost")
SQL["strategy_routing_speed"] = _strategy_sql("speed")

SQL["prompt_cost_estimates"] = _strategy_sql("quality").replace(
    "SELECT t.prompt_id, t.task_complexity, coalesce(b.selected_model, 'gpt-4o-mini') AS selected_model,\n"
    "       'quality' AS strategy\nFROM task t LEFT JOIN best b USING (prompt_id)",
    """, routed AS (SELECT t.prompt_id, t.text, coalesce(b.selected_model, 'gpt-4o-mini') AS model
                FROM task t LEFT JOIN best b USING (prompt_id))
SELECT r.prompt_id, r.model, CAST(floor(length(coalesce(r.text, '')) / 4) AS BIGINT) AS input_tokens,
       round(floor(length(coalesce(r.text, '')) / 4) / 1000.0 * k.input_cost_per_1k + 500 / 1000.0 * k.output_cost_per_1k,
             8) AS estimated_cost,
       9.99 + round(floor(length(coalesce(r.text, '')) / 4) / 1000.0 * k.input_cost_per_1k
                    + 500 / 1000.0 * k.output_cost_per_1k, 8) <= 10.0 AS within_budget
FROM routed r LEFT JOIN catalog k ON k.model = r.model""")

ACL_DOCS_CTE = """
adocs AS (
  SELECT doc_id, text, source,
         CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 WHEN 0 THEN CAST([] AS VARCHAR[])
              WHEN 1 THEN ['grp:sales'] WHEN 2 THEN ['grp:accounting'] ELSE ['grp:manager', 'usr:E7'] END AS acl
  FROM documents),
stripped AS (SELECT doc_id, acl, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM adocs),
chunks AS (
  SELECT doc_id, CAST(o AS INTEGER) AS ordinal, acl, substr(t, CAST(o * 700 + 1 AS BIGINT), 800) AS text,
         CAST(doc_id AS VARCHAR) || ':' || CAST(o AS VARCHAR) AS chunk_id
  FROM stripped, LATERAL (SELECT unnest(range(0, CAST(ceil(length(t) / 700.0) AS BIGINT))) AS o) r)"""

SQL["document_chunks"] = f"""WITH {ACL_DOCS_CTE}
SELECT doc_id, ordinal, CAST(length(text) AS INTEGER) AS chars, substr(text, 1, 40) AS head,
       array_to_string(acl, ',') AS acl FROM chunks"""


def _sparse_cte(src: str, id_col: str, name: str) -> str:
    return f"""{name}_tok AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')),
                                 '[a-z0-9가-힣]+', 0)) AS tok FROM {src}),
{name}_cnt AS (SELECT id, CAST(CAST('0x' || md5(tok) AS UHUGEINT) % 384 AS INTEGER) AS bucket,
                      CAST(count(*) AS DOUBLE) AS c FROM {name}_tok GROUP BY ALL),
{name}_w AS (SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS weight FROM {name}_cnt)"""


SQL["chunk_embedding_weights"] = f"""WITH {ACL_DOCS_CTE}, {_sparse_cte('chunks', 'chunk_id', 'ch')}
SELECT id AS chunk_id, bucket, weight FROM ch_w"""

SQL["secure_chunk_search"] = f"""WITH {ACL_DOCS_CTE}, {PROMPTS_CTE.strip()},
q AS (SELECT prompt_id AS query_id, text, list_sort(list_distinct(
  CASE role WHEN 'sales' THEN ['grp:all', 'grp:sales'] WHEN 'production' THEN ['grp:all', 'grp:production']
            WHEN 'as' THEN ['grp:all', 'grp:as'] WHEN 'accounting' THEN ['grp:all', 'grp:accounting']
            WHEN 'manager' THEN ['grp:all', 'grp:sales', 'grp:production', 'grp:as', 'grp:accounting', 'grp:manager']
            ELSE ['grp:all'] END || ['usr:' || employee_id])) AS principals FROM prompts),
{_sparse_cte('chunks', 'chunk_id', 'ch')}, {_sparse_cte('q', 'query_id', 'qq')},
dots AS (SELECT qq.id AS query_id, ch.id AS chunk_id, sum(qq.weight * ch.weight) AS sim
         FROM qq_w qq JOIN ch_w ch USING (bucket) GROUP BY ALL),
allq AS (SELECT q.query_id, q.principals, c.chunk_id, c.acl FROM q CROSS JOIN chunks c),
scored AS (SELECT a.query_id, a.chunk_id, coalesce(d.sim, 0.0) AS sim
           FROM allq a LEFT JOIN dots d USING (query_id, chunk_id)
           WHERE len(a.acl) = 0 OR len(list_intersect(a.acl, a.principals)) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, chunk_id) AS rank
           FROM scored)
SELECT query_id, chunk_id, round(sim, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""

SQL["embedding_knn"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(v, lambda y: y * y))) = 0
                                                       THEN 1.0 ELSE sqrt(list_sum(list_transform(v, lambda y: y * y)))
                                                       END) AS v FROM e),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_dot_product(b.v, e.v) AS sim
          FROM e a JOIN n e ON e.vec_id = a.vec_id CROSS JOIN e b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id) AS rank FROM pairs)
SELECT query_id, item_id, round(sim, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""

# --- recommender -------------------------------------------------------------------------------------
REC_CTE = """
ev AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_to_cart'
                         WHEN 'purchase' THEN 'purchase' END AS event_type,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         CASE WHEN user_id % 3 = 0 THEN 'desktop' ELSE 'mobile' END AS device,
         CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'day'
              ELSE 'evening' END AS hour_bucket,
         dayofweek(ts) IN (0, 6) AS is_weekend,
         CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'signup' THEN 3.0 WHEN 'purchase' THEN 5.0 END
           AS weight
  FROM events WHERE event_type <> 'error'),
items AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events),
items2 AS (SELECT item_id, 'cat' || CAST(item_id % 8 AS VARCHAR) AS category, CAST(item_id % 3 + 1 AS INTEGER) AS price_tier
           FROM items),
nitems AS (SELECT max(item_id) + 1 AS n FROM items),
train AS (SELECT * FROM ev WHERE day < 20),
val AS (SELECT * FROM ev WHERE day >= 20 AND day < 25),
pop AS (SELECT item_id, sum(weight * exp(-0.03 * ((SELECT max(day) FROM train) - day))) AS pop FROM train GROUP BY 1),
r AS (SELECT user_id, item_id, sum(weight * exp(-0.02 * ((SELECT max(day) FROM train) - day))) AS r
      FROM train GROUP BY ALL),
dfi AS (SELECT item_id, count(*) AS df FROM r WHERE r > 0 GROUP BY 1),
ulen AS (SELECT user_id, sum(r) AS ulen FROM r GROUP BY 1),
bm AS (SELECT r.user_id, r.item_id, r.r,
              ln(((SELECT max(user_id) + 1 FROM train) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) * r.r * 2.2
              / CASE WHEN 1.2 * (1 - 0.75 + 0.75 * (ulen / (SELECT avg(ulen) FROM ulen WHERE ulen > 0))) + r.r = 0 THEN 1.0
                     ELSE 1.2 * (1 - 0.75 + 0.75 * (ulen / (SELECT avg(ulen) FROM ulen WHERE ulen > 0))) + r.r END AS w
       FROM r LEFT JOIN dfi USING (item_id) JOIN ulen USING (user_id)),
dots AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS dot FROM bm a JOIN bm b USING (user_id)
         WHERE a.item_id <> b.item_id GROUP BY ALL),
norms AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM bm GROUP BY 1),
sim0 AS (SELECT d.i, d.j, d.dot / (ni.n * nj.n + 25.0) AS sim FROM dots d JOIN norms ni ON ni.item_id = d.i
         JOIN norms nj ON nj.item_id = d.j),
sim AS (SELECT i, j, sim FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY sim DESC) AS rk FROM sim0)
        WHERE rk <= 50 OR (SELECT n FROM nitems) <= 50),
truth AS (SELECT DISTINCT v.user_id, v.item_id FROM val v WHERE v.weight >= 2.0
          AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = v.user_id AND t.item_id = v.item_id)),
seen AS (SELECT DISTINCT user_id, item_id FROM train)"""


def _in_test_window(sql: str) -> str:
    """The same statement with the days from 25 on as the window that is evaluated."""
    return sql.replace("day >= 20 AND day < 25", "day >= 25")



def with_rec(body: str) -> str:
    return f"WITH {REC_CTE}\n{body}"


SQL["item_popularity"] = with_rec("SELECT item_id, round(pop, 9) AS pop FROM pop")
SQL["bm25_weights"] = with_rec("SELECT user_id, item_id, round(r, 9) AS r, round(w, 9) AS w FROM bm")
SQL["item_similarity"] = with_rec("SELECT i, j, round(sim, 9) AS sim FROM sim")
SQL["cf_scores"] = with_rec("""
SELECT b.user_id, s.i AS item_id, round(sum(s.sim * b.w), 9) AS score FROM sim s JOIN bm b ON b.item_id = s.j GROUP BY ALL""")
SQL["cf_rank_norm"] = with_rec("""
, cs AS (SELECT b.user_id, s.i AS item_id, round(sum(s.sim * b.w), 9) AS score FROM sim s JOIN bm b ON b.item_id = s.j
         GROUP BY ALL)
SELECT user_id, item_id, score,
       round((row_number() OVER (PARTITION BY user_id ORDER BY score, item_id) - 1)
             / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 9) AS rank_norm FROM cs""".replace(
    "\n, cs AS", ", cs AS", 1))
SQL["popularity_minmax"] = with_rec("""
, p AS (SELECT item_id, round(pop, 9) AS pop FROM pop)
SELECT item_id, pop, round(CASE WHEN max(pop) OVER () - min(pop) OVER () < 1e-12 THEN 0.0
                                ELSE (pop - min(pop) OVER ()) / (max(pop) OVER () - min(pop) OVER ()) END, 9) AS pop_minmax
FROM p""".replace("\n, p AS", ", p AS", 1))
SQL["content_profiles"] = with_rec("""
, f0 AS (SELECT item_id, 'cat:' || category AS feature, 1.0 AS v FROM items2
         UNION ALL SELECT item_id, 'price', price_tier / 3.0 FROM items2),
f AS (SELECT item_id, feature, v / (sqrt(sum(v * v) OVER (PARTITION BY item_id)) + 1e-12) AS v FROM f0),
p AS (SELECT t.user_id, f.feature, sum(t.weight * f.v) AS p FROM train t JOIN f USING (item_id) GROUP BY ALL),
pn AS (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY user_id)) AS n FROM p)
SELECT user_id, feature, round(CASE WHEN n > 0 THEN p / n ELSE p END, 9) AS p FROM pn""".replace("\n, f0 AS", ", f0 AS", 1))
SQL["context_lift"] = with_rec("""
, e AS (SELECT t.*, i.category FROM train t JOIN items2 i USING (item_id)),
g AS (SELECT category, sum(weight) AS g FROM e GROUP BY 1),
c AS (SELECT device, hour_bucket, is_weekend, category, sum(weight) AS c FROM e GROUP BY ALL),
ct AS (SELECT device, hour_bucket, is_weekend, sum(c) AS ct FROM c GROUP BY ALL)
SELECT c.device, c.hour_bucket, c.is_weekend, c.category,
       round((c.c / ct.ct) / (g.g / (SELECT sum(g) FROM g) + 1e-9), 9) AS lift
FROM c JOIN ct USING (device, hour_bucket, is_weekend) JOIN g USING (category)""".replace("\n, e AS", ", e AS", 1))
SQL["validation_truth"] = with_rec("SELECT user_id, item_id FROM truth")
SQL["validation_context"] = with_rec("""
SELECT user_id, device, hour_bucket, is_weekend FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, device, hour_bucket, is_weekend) AS r
  FROM (SELECT user_id, device, hour_bucket, is_weekend, count(*) AS n FROM val GROUP BY ALL)) WHERE r = 1""")
_POP_RECS = """
, users AS (SELECT DISTINCT user_id FROM ev),
cand AS (SELECT u.user_id, p.item_id, p.pop,
                row_number() OVER (PARTITION BY u.user_id ORDER BY p.pop DESC, p.item_id) AS rank
         FROM users u CROSS JOIN pop p
         WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)),
recs AS (SELECT user_id, item_id, pop AS score, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 10)"""
SQL["popularity_recommendations"] = with_rec(_POP_RECS.replace("\n, users", ", users", 1) + """
SELECT user_id, item_id, round(score, 9) AS score, rank FROM recs""")


def _eval_sql(recs_cte: str) -> str:
    return with_rec(recs_cte.replace("\n, users", ", users", 1) + """,
npos AS (SELECT user_id, count(*) AS npos FROM truth GROUP BY 1),
per AS (SELECT r.user_id, sum(CASE WHEN t.item_id IS NOT NULL THEN 1 ELSE 0 END) AS hits,
               sum(CASE WHEN t.item_id IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END) AS dcg
        FROM recs r LEFT JOIN truth t USING (user_id, item_id) GROUP BY 1),
u AS (SELECT n.user_id, coalesce(hits, 0) / least(npos, 10) AS recall,
             coalesce(dcg, 0.0) / (SELECT sum(1.0 / log2(x + 1)) FROM range(1, least(npos, 10) + 1) t(x)) AS ndcg
      FROM npos n LEFT JOIN per USING (user_id))
SELECT round(avg(recall), 6) AS "recall@10", round(avg(ndcg), 6) AS "ndcg@10", count(*) AS users,
       (SELECT count(DISTINCT item_id) FROM recs WHERE user_id IN (SELECT user_id FROM truth))
         / (SELECT CAST(n AS DOUBLE) FROM nitems) AS "coverage@10"
FROM u""")


SQL["popularity_evaluation"] = _eval_sql(_POP_RECS)
SQL["popularity_test_evaluation"] = _in_test_window(_eval_sql(_POP_RECS))

_CF_RECS = """
, users AS (SELECT DISTINCT user_id FROM ev),
cs AS (SELECT b.user_id, s.i AS item_id, sum(s.sim * b.w) AS score FROM sim s JOIN bm b ON b.item_id = s.j GROUP BY ALL),
grid AS (SELECT u.user_id, i.item_id, round(coalesce(c.score, 0.0), 9) AS score
         FROM users u CROSS JOIN items i
         LEFT JOIN cs c ON c.user_id = u.user_id AND c.item_id = i.item_id
         WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = i.item_id)),
recs AS (SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM grid)
         WHERE rank <= 10)"""
SQL["item_cf_recommendations"] = with_rec(_CF_RECS.replace("\n, users", ", users", 1) + "\nSELECT * FROM recs")
SQL["item_cf_evaluation"] = _eval_sql(_CF_RECS)

# --- cleaning and sales report ---------------------------------------------------------------------
CLEAN_CTE = """
raw AS (
  SELECT l_orderkey AS order_id,
         CASE WHEN l_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END
           AS order_date,
         CASE WHEN l_linenumber = 3 THEN ' ' || lower(p_type) || ' ' WHEN l_linenumber = 4 THEN upper(p_type)
              ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS category,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE r_name END AS customer_region,
         o_orderpriority AS channel, CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s1 AS (
  SELECT order_id,
         CAST(coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%m/%d/%Y')) AS DATE) AS order_date,
         upper(substr(trim(category), 1, 1)) || lower(substr(trim(category), 2)) AS category,
         customer_region, channel, quantity, unit_price FROM raw),
s3 AS (SELECT DISTINCT * FROM s1),
s4 AS (SELECT * FROM s3 WHERE quantity > 0),
fence AS (SELECT category, quantile_cont(unit_price, 0.75) + 3.0 * (quantile_cont(unit_price, 0.75)
                 - quantile_cont(unit_price, 0.25)) AS hi FROM s4 GROUP BY 1),
s5 AS (SELECT s4.* EXCLUDE (unit_price), unit_price AS orig, fence.hi,
              CASE WHEN unit_price > fence.hi THEN fence.hi ELSE unit_price END AS unit_price
       FROM s4 LEFT JOIN fence USING (category)),
med AS (SELECT category, median(unit_price) AS med FROM s5 GROUP BY 1),
cleaned AS (
  SELECT order_id, order_date, category, coalesce(customer_region, 'Unknown') AS customer_region, channel, quantity,
         coalesce(unit_price, med) AS unit_price, round(quantity * coalesce(unit_price, med), 2) AS revenue
  FROM s5 LEFT JOIN med USING (category))"""


def with_clean(body: str) -> str:
    return f"WITH {CLEAN_CTE}\n{body}"


SQL["cleaning_log"] = with_clean("""
, a0 AS (SELECT count(*) AS n0,
                CAST(sum(CASE WHEN category IS NOT DISTINCT FROM
                     upper(substr(trim(category), 1, 1)) || lower(substr(trim(category), 2)) THEN 0 ELSE 1 END) AS BIGINT) AS c1,
                CAST(sum(CASE WHEN contains(order_date, '/') THEN 1 ELSE 0 END) AS BIGINT) AS c2 FROM raw),
a1 AS (SELECT (SELECT count(*) FROM s3) AS n3, (SELECT count(*) FROM s4) AS n4),
a2 AS (SELECT CAST(sum(CASE WHEN orig > hi THEN 1 ELSE 0 END) AS BIGINT) AS c5,
              CAST(sum(CASE WHEN unit_price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS np,
              CAST(sum(CASE WHEN customer_region IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nr, count(*) AS n5 FROM s5),
st AS (SELECT * FROM a0, a1, a2)
SELECT 1 AS step_no, 'normalize_text' AS step, 'strip + title-case category' AS action, n0 AS rows_before,
       n0 AS rows_after, c1 AS cells_changed FROM st
UNION ALL SELECT 2, 'parse_dates', 'mixed-format strings -> date', n0, n0, c2 FROM st
UNION ALL SELECT 3, 'drop_duplicates', 'exact duplicate rows removed', n0, n3, 0 FROM st
UNION ALL SELECT 4, 'drop_invalid_qty', 'quantity <= 0 removed', n3, n4, 0 FROM st
UNION ALL SELECT 5, 'cap_outliers', 'IQR fence (k=3) per category', n4, n4, c5 FROM st
UNION ALL SELECT 6, 'impute_missing', 'price -> category median; region -> ''Unknown''', n5, n5, np + nr FROM st
UNION ALL SELECT 7, 'derive_revenue', 'revenue = quantity * unit_price', n5, n5, n5 FROM st""".replace(
    "\n, a0 AS", ", a0 AS", 1))

SQL["cleaned_orders"] = with_clean("""
SELECT order_id, order_date, category, customer_region, channel, quantity, round(unit_price, 6) AS unit_price, revenue
FROM cleaned""")

SQL["sales_kpis"] = with_clean("""
SELECT round(sum(revenue), 2) AS total_revenue, count(*) AS orders, round(avg(revenue), 4) AS aov,
       round(avg(quantity), 4) AS avg_units FROM cleaned""")

SQL["monthly_revenue"] = with_clean("""
, m AS (SELECT date_trunc('month', order_date) AS month, sum(revenue) AS rev FROM cleaned GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m)
SELECT cal.month, round(coalesce(m.rev, 0.0), 2) AS revenue FROM cal LEFT JOIN m ON m.month = cal.month""".replace(
    "\n, m AS", ", m AS", 1))

SQL["revenue_by_category"] = with_clean("""
SELECT category, round(sum(revenue), 2) AS revenue, count(order_id) AS orders FROM cleaned GROUP BY 1""")

SQL["revenue_by_weekday"] = with_clean("""
SELECT CAST((dayofweek(order_date) + 6) % 7 AS INTEGER) AS weekday_index, dayname(order_date) AS weekday,
       round(sum(revenue), 2) AS revenue FROM cleaned GROUP BY ALL""")

SQL["revenue_pivot_region_channel"] = with_clean("""
SELECT customer_region,
       coalesce(CAST(round(sum(CASE WHEN channel = '1-URGENT' THEN CAST(revenue AS DECIMAL(18, 2)) END), 0) AS DOUBLE), 0.0) AS "1-URGENT",
       coalesce(CAST(round(sum(CASE WHEN channel = '2-HIGH' THEN CAST(revenue AS DECIMAL(18, 2)) END), 0) AS DOUBLE), 0.0) AS "2-HIGH",
       coalesce(CAST(round(sum(CASE WHEN channel = '3-MEDIUM' THEN CAST(revenue AS DECIMAL(18, 2)) END), 0) AS DOUBLE), 0.0) AS "3-MEDIUM",
       coalesce(CAST(round(sum(CASE WHEN channel = '4-NOT SPECIFIED' THEN CAST(revenue AS DECIMAL(18, 2)) END), 0) AS DOUBLE), 0.0) AS "4-NOT SPECIFIED",
       coalesce(CAST(round(sum(CASE WHEN channel = '5-LOW' THEN CAST(revenue AS DECIMAL(18, 2)) END), 0) AS DOUBLE), 0.0) AS "5-LOW"
FROM cleaned GROUP BY 1""")

# --- metrics on a deterministic score ----------------------------------------------------------------
DQ_CTE = """
dq AS (SELECT d.doc_id AS id, l.quality AS label,
              length(regexp_replace(coalesce(d.text, ''), '[^\\p{L}]', '', 'g'))
              / greatest(length(coalesce(d.text, '')), 1) AS score
       FROM documents d JOIN labels l USING (doc_id))"""


def with_dq(body: str) -> str:
    return f"WITH {DQ_CTE}\n{body}"


SQL["doc_quality_metrics"] = with_dq("""
, c AS (SELECT sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS tn,
              sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS fn,
              avg((score - label) * (score - label)) AS brier, count(*) AS n FROM dq),
per AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM dq GROUP BY 1),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM per),
a AS (SELECT sum(pos * (neg_cum - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM cum)
SELECT round(auc, 6) AS auc, round((tp + tn) / n, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
                  THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END, 6) AS f1,
       round(brier, 6) AS brier, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
       CAST(fn AS BIGINT) AS fn, n FROM c, a""".replace("\n, c AS", ", c AS", 1))

SQL["doc_quality_roc"] = with_dq("""
, per AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM dq GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER w AS pos_cum, sum(neg) OVER w AS neg_cum FROM per
        WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT threshold, round(neg_cum / (SELECT sum(1 - label) FROM dq), 6) AS fpr,
       round(pos_cum / (SELECT sum(label) FROM dq), 6) AS tpr FROM cum""".replace("\n, per AS", ", per AS", 1))

SQL["doc_quality_calibration"] = with_dq("""
SELECT CAST(greatest(ceil(score * 10), 1) AS INTEGER) AS bin, round(avg(score), 6) AS mean_predicted,
       round(avg(CAST(label AS DOUBLE)), 6) AS observed_rate, count(*) AS customers FROM dq GROUP BY 1""")

SQL["doc_quality_lift"] = with_dq("""
, r AS (SELECT *, row_number() OVER (ORDER BY score ASC, id ASC) AS r, count(*) OVER () AS n FROM dq),
b AS (SELECT *, CAST(11 - CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil((r - 1) * 10 / greatest(n - 1, 1))) END AS INTEGER)
                AS decile FROM r)
SELECT decile, count(*) AS customers, CAST(sum(label) AS BIGINT) AS churners, round(avg(CAST(label AS DOUBLE)), 6) AS churn_rate,
       round(avg(CAST(label AS DOUBLE)) / (SELECT avg(CAST(label AS DOUBLE)) FROM dq), 2) AS lift
FROM b GROUP BY 1""".replace("\n, r AS", ", r AS", 1))


def _cost_sql(final: str) -> str:
    import numpy as np
    grid = ", ".join(f"({i}, CAST({repr(float(t))} AS DOUBLE))" for i, t in enumerate(np.linspace(0.01, 0.99, 99)))
    return with_dq(f""", g AS (SELECT * FROM (VALUES {grid}) t(k, threshold)),
j AS (SELECT g.k, g.threshold, coalesce(sum(CASE WHEN dq.score >= g.threshold THEN dq.label END), 0) AS tp,
             count(dq.id) AS targeted
      FROM g LEFT JOIN dq ON dq.score >= g.threshold GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, sum(label) AS P FROM dq),
curve AS (SELECT threshold,
         round((20.0 * targeted + 400.0 * ((P - tp) + tp * (1 - 0.35))) / n, 6) AS cost_per_customer,
         round(targeted / n, 6) AS targeted_pct, round(400.0 * P / n, 6) AS do_nothing,
         round(20.0 + 400.0 * P / n * (1 - 0.35), 6) AS target_all FROM j, tot)
{final}""")


SQL["doc_quality_cost_curve"] = _cost_sql("SELECT * FROM curve")
SQL["doc_quality_optimal_threshold"] = _cost_sql(
    "SELECT * FROM curve ORDER BY cost_per_customer, threshold LIMIT 1")

# --- forecasting ---------------------------------------------------------------------------------------
WEEKLY_CTE = """
ws AS (
  SELECT CAST(n_regionkey AS INTEGER) AS store,
         CAST(o_orderdate AS DATE) - 1 + CAST((5 - dayofweek(CAST(o_orderdate AS DATE) - 1) + 7) % 7 AS INTEGER)
           + CASE WHEN (5 - dayofweek(CAST(o_orderdate AS DATE) - 1) + 7) % 7 = 0 THEN 7 ELSE 0 END AS week,
         o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
series AS (SELECT store, week, sum(o_totalprice) AS weekly_sales, false AS is_holiday FROM ws GROUP BY ALL),
split AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY week DESC) <= 13 AS is_test FROM series),
naive AS (SELECT t.store, t.week, 'seasonal_naive' AS model, h.weekly_sales AS forecast, t.weekly_sales AS actual,
                 t.is_holiday
          FROM split t LEFT JOIN split h ON h.store = t.store AND NOT h.is_test AND h.week + 364 = t.week
          WHERE t.is_test)"""


def with_weekly(body: str) -> str:
    return f"WITH {WEEKLY_CTE}\n{body}"


SQL["weekly_forecast_features"] = with_weekly("""
SELECT store, week, round(weekly_sales, 2) AS weekly_sales,
       round(lag(weekly_sales, 52) OVER w, 2) AS lag_52,
       round(sin(2 * pi() * weekofyear(week) / 52.18), 9) AS sin1, round(cos(2 * pi() * weekofyear(week) / 52.18), 9) AS cos1,
       round(sin(4 * pi() * weekofyear(week) / 52.18), 9) AS sin2, round(cos(4 * pi() * weekofyear(week) / 52.18), 9) AS cos2,
       CAST(row_number() OVER w - 1 AS BIGINT) AS t, 0 AS promo
FROM series WINDOW w AS (PARTITION BY store ORDER BY week)""")

SQL["seasonal_naive_forecasts"] = with_weekly("""
SELECT store, week, model, round(forecast, 2) AS forecast, round(actual, 2) AS actual, is_holiday FROM naive""")

SQL["seasonal_naive_metrics"] = with_weekly("""
SELECT store, model, round(avg(abs((actual - forecast) / actual)) * 100, 2) AS mape,
       round(sum(CASE WHEN is_holiday THEN 5.0 ELSE 1.0 END * abs(actual - forecast))
             / sum(CASE WHEN is_holiday THEN 5.0 ELSE 1.0 END), 0) AS wmae, count(*) AS weeks
FROM naive WHERE forecast IS NOT NULL AND actual IS NOT NULL GROUP BY ALL""")

def _ridge_sql(source: str) -> str:
    """CTEs up to ``ridge`` (k, week, forecast, actual, lo, hi, folds) over the series of ``source`` (k, week, sales): standardised
    normal equations per series and fold, solved by Gauss-Jordan steps of a recursion over the matrices."""
    names = ["lag", "s1", "c1", "s2", "c2", "t"]
    size = len(names)
    stats = ", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS d_{n}" for n in names)
    scaled = ", ".join(f"(r.{n} - x.m_{n}) / x.d_{n} AS z{i}" for i, n in enumerate(names))
    rows = ", ".join("[" + ", ".join([f"sum(z{i} * z{j})" + (" + 1.0" if i == j else "") for j in range(size)] + [f"sum(z{i} * yc)"]) + "]" for i in range(size))
    line = " + ".join([f"g.m[{i + 1}][{size + 1}] * (coalesce(r.{n}, 0.0) - x.m_{n}) / x.d_{n}" for i, n in enumerate(names)])
    return f"""src AS ({source}),
span AS (SELECT k, min(week) AS lo, max(week) AS hi FROM src GROUP BY k),
weeks AS (SELECT k, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM span),
num AS (SELECT w.k, w.week, s.sales, CASE WHEN s.sales > 0 THEN ln(s.sales) END AS y,
               CAST(row_number() OVER (PARTITION BY w.k ORDER BY w.week) - 1 AS DOUBLE) AS t, count(*) OVER (PARTITION BY w.k) - 13 AS n_train
        FROM weeks w LEFT JOIN src s ON s.k = w.k AND s.week = w.week),
feat AS (SELECT *, lag(y, 52) OVER (PARTITION BY k ORDER BY t) AS lag, sin(2 * pi() * weekofyear(week) / 52.18) AS s1, cos(2 * pi() * weekofyear(week) / 52.18) AS c1,
                sin(4 * pi() * weekofyear(week) / 52.18) AS s2, cos(4 * pi() * weekofyear(week) / 52.18) AS c2 FROM num),
fit_rows AS MATERIALIZED (SELECT r.*, f.range AS fold FROM feat r, range(0, 5) f WHERE r.t < r.n_train - 13 * f.range AND r.y IS NOT NULL AND r.lag IS NOT NULL),
moments AS MATERIALIZED (SELECT k, fold, avg(y) AS my, {stats} FROM fit_rows GROUP BY k, fold),
z AS (SELECT r.k, r.fold, r.y - x.my AS yc, {scaled} FROM fit_rows r JOIN moments x ON x.k = r.k AND x.fold = r.fold),
mats AS (SELECT k, fold, [{rows}] AS m FROM z GROUP BY k, fold),
gj AS (SELECT k, fold, 1 AS step, m FROM mats
       UNION ALL
       SELECT k, fold, step + 1, list_transform(m, lambda row, i: CASE WHEN i = step THEN list_transform(row, lambda v: v / m[step][step])
                                                     ELSE list_transform(row, lambda v, j: v - row[step] * m[step][j] / m[step][step]) END)
       FROM gj WHERE step <= {size}),
solved AS MATERIALIZED (SELECT * FROM gj WHERE step = {size + 1}),
scored AS MATERIALIZED (
  SELECT r.k, r.week, r.t, r.n_train, r.sales, r.y, g.fold, x.my + {line} AS line
  FROM feat r JOIN solved g ON g.k = r.k JOIN moments x ON x.k = r.k AND x.fold = g.fold
  WHERE CASE WHEN g.fold = 0 THEN r.t >= r.n_train
             ELSE r.t >= r.n_train - 13 * g.fold AND r.t < r.n_train - 13 * (g.fold - 1) AND r.n_train - 13 * g.fold > 52 END),
q AS (SELECT k, quantile_cont(y - line, 0.05) AS q_lo, quantile_cont(y - line, 0.95) AS q_hi, CAST(count(DISTINCT fold) AS INTEGER) AS folds
      FROM scored WHERE fold > 0 AND y IS NOT NULL GROUP BY k),
ridge AS (SELECT r.k, r.week, exp(s.line) AS forecast, r.sales AS actual, exp(s.line + q_lo) AS lo, exp(s.line + q_hi) AS hi, coalesce(q.folds, 0) AS folds
          FROM feat r LEFT JOIN scored s ON s.k = r.k AND s.week = r.week AND s.fold = 0 LEFT JOIN q ON q.k = r.k WHERE r.t >= r.n_train)"""


_METRICS = """round(avg(abs((actual - forecast) / actual)) * 100, 2) AS mape, round(avg(abs(actual - forecast)), 0) AS wmae, count(*) AS weeks"""
_RIDGE = with_weekly(", " + _ridge_sql("SELECT store AS k, week, weekly_sales AS sales FROM series")).replace("WITH ", "WITH RECURSIVE ", 1)
_BACKTEST = _RIDGE + f""",
mix AS (SELECT store, model, forecast, actual FROM naive UNION ALL SELECT k, 'ridge', forecast, actual FROM ridge),
metrics AS (SELECT store, model, {_METRICS} FROM mix WHERE forecast IS NOT NULL AND actual IS NOT NULL GROUP BY ALL)"""
SQL["ridge_backtest_metrics"] = _BACKTEST + "\nSELECT * FROM metrics"
SQL["ridge_backtest_summary"] = _BACKTEST + "\nSELECT model, round(avg(mape), 2) AS mape, round(avg(wmae), 0) AS wmae, count(*) AS series FROM metrics GROUP BY model"
SQL["forecast_intervals"] = _RIDGE + """
SELECT k AS store, week, 'ridge' AS model, round(forecast, 0) AS forecast, round(actual, 0) AS actual, false AS is_holiday, round(lo, 0) AS lo, round(hi, 0) AS hi, folds
FROM ridge"""
SQL["forecast_interval_coverage"] = _RIDGE + """
SELECT round(avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, 0.9::DOUBLE AS level, count(*) AS weeks FROM ridge WHERE lo IS NOT NULL"""


_DEPT = WEEKLY_CTE.replace("SELECT CAST(n_regionkey AS INTEGER) AS store,", "SELECT CAST(n_regionkey AS INTEGER) AS store, o_orderpriority AS dept,").replace(
    "GROUP BY ALL),", "GROUP BY ALL),\ndepts AS (SELECT store, dept, week, sum(o_totalprice) AS weekly_sales FROM ws GROUP BY ALL),", 1)
_BOTTOM = f"WITH RECURSIVE {_DEPT}, " + _ridge_sql("SELECT store || '|' || dept AS k, week, weekly_sales AS sales FROM depts")
SQL["hierarchical_backtest"] = f"""WITH direct AS ({_RIDGE} SELECT k AS store, week, forecast, actual FROM ridge),
dept AS ({_BOTTOM} SELECT CAST(split_part(k, '|', 1) AS INTEGER) AS store, week, sum(forecast) AS forecast FROM ridge GROUP BY ALL),
mix AS (SELECT store, 'direct_total' AS model, forecast, actual FROM direct
        UNION ALL SELECT a.store, 'bottom_up', d.forecast, a.actual FROM direct a LEFT JOIN dept d ON d.store = a.store AND d.week = a.week),
metrics AS (SELECT store, model, {_METRICS} FROM mix WHERE forecast IS NOT NULL AND actual IS NOT NULL GROUP BY ALL)
SELECT model, round(avg(mape), 2) AS mape, round(avg(wmae), 0) AS wmae, count(*) AS series FROM metrics GROUP BY model"""

# --- more of the operations hub ---------------------------------------------------------------------------
_SCHEDULE = """
, stored AS (SELECT id AS external_id, status AS title, created_at AS updated_at FROM h_orders WHERE CAST(id AS BIGINT) % 3 <> 0),
synced AS (SELECT id AS external_id, 'synced ' || status AS title, created_at + CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL (-1) DAY END AS updated_at
           FROM h_orders WHERE CAST(id AS BIGINT) % 2 = 0)"""[1:]
SQL["schedule_sync"] = with_hub(_SCHEDULE + """
SELECT coalesce(t.external_id, s.external_id) AS external_id,
       CASE WHEN t.external_id IS NULL OR s.updated_at >= t.updated_at THEN s.title ELSE t.title END AS title,
       CASE WHEN t.external_id IS NULL THEN 'created' WHEN s.updated_at >= t.updated_at THEN 'updated' ELSE 'unchanged' END AS change
FROM stored t FULL JOIN synced s ON s.external_id = t.external_id""")
SQL["schedule_sync_counts"] = with_hub(_SCHEDULE + """
SELECT CASE WHEN t.external_id IS NULL THEN 'created' WHEN s.external_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS entries
FROM stored t FULL JOIN synced s ON s.external_id = t.external_id GROUP BY 1""")
SQL["tool_statistics"] = """
SELECT event_type AS tool_name, count(*) AS calls, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS success_rate,
       round(avg(coalesce(value, 0.0)), 6) AS avg_latency_ms
FROM events WHERE event_type IN ('click', 'signup', 'error') GROUP BY 1"""
SQL["refund_postings"] = with_hub("""
SELECT id AS order_id, 'refund' AS kind, total_amount AS amount, -total_amount AS signed_amount, 'refund ' || id AS memo
FROM h_orders WHERE status = 'in_production'""")
SQL["owner_upsert"] = with_hub("""
SELECT CASE role WHEN 'sales' THEN 'crm' WHEN 'production' THEN 'production' WHEN 'as' THEN 'as' WHEN 'accounting' THEN 'accounting' ELSE 'performance' END AS domain,
       id AS owner_employee_id, 'internal' AS classification, CAST(NULL AS VARCHAR) AS notes FROM h_employees WHERE role <> 'sales'
UNION ALL SELECT 'crm', 'E1', 'restricted', 'moved'""")
SQL["followup_approvals"] = with_hub("""
SELECT 'F-' || id AS id, CASE WHEN k % 4 = 0 OR k % 6 = 0 THEN 'sent' ELSE 'draft' END AS status, k % 12 = 0 AS already, k % 6 = 0 AND k % 4 <> 0 AS newly_sent
FROM (SELECT id, CAST(id AS BIGINT) AS k FROM h_orders WHERE status = 'delivered')""")
SQL["production_queue"] = with_hub("""
SELECT 'job-' || id AS id, CASE status WHEN 'placed' THEN 'queued' ELSE 'in_progress' END AS status, created_at FROM h_orders WHERE status IN ('placed', 'in_production')""")
SQL["followup_queue"] = with_hub("SELECT 'F-' || id AS id, id AS order_id, 'draft' AS status FROM h_orders WHERE status = 'delivered'")
SQL["recent_knowledge"] = with_hub("SELECT id, summary, created_at FROM h_tickets WHERE status = 'resolved' ORDER BY created_at DESC, id DESC LIMIT 10")
SQL["visible_documents"] = f"""WITH {ACL_DOCS_CTE}
SELECT doc_id, source FROM adocs WHERE len(acl) = 0 OR list_has_any(acl, ['grp:all', 'grp:sales', 'usr:E7'])"""

# --- streaming batch twins --------------------------------------------------------------------------
SQL["windowed_cost_by_model"] = _llm("""
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, model, round(sum(cost_usd), 6) AS cost, count(*) AS calls
FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY ALL""")



def _alerts_sql(final: str) -> str:
    dlp = _dlp_rows_sql()[len("WITH "):]
    return f"""WITH {TELEMETRY_CTE.strip()},
{dlp},
vts AS (SELECT b.ts FROM viol v JOIN base b USING (request_id)),
err AS (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) + INTERVAL 10 MINUTE AS ts, model, count(*) AS total,
               sum(CASE WHEN lower(CAST(success AS VARCHAR)) = 'false' THEN 1 ELSE 0 END) AS errors
        FROM telemetry WHERE event_type = 'mcp_llm_call' GROUP BY ALL),
burst AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS ts, count(*) AS violations FROM vts GROUP BY 1),
alerts AS (
  SELECT ts, 'error_rate_high' AS anomaly_type, round(errors / total, 4) AS metric_value, model FROM err
  WHERE round(errors / total, 4) > 0.15
  UNION ALL SELECT ts, 'dlp_burst', CAST(violations AS DOUBLE), NULL FROM burst WHERE violations >= 10)
{final}"""


SQL["windowed_alerts"] = _alerts_sql("SELECT * FROM alerts")

SQL["deduplicated_events"] = "SELECT DISTINCT ON (event_id) event_id, event_type FROM events"
SQL["dlp_risk_feed"] = SQL["violation_risk"].replace(
    """SELECT request_id, rule_id, risk_score,
       CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
            ELSE 'low' END AS risk_level,
       CASE WHEN risk_score >= 80 THEN 'mcp_block_user' WHEN risk_score >= 60 THEN 'mcp_quarantine_session'
            ELSE 'mcp_notify_security' END AS recommended_playbook,
       risk_score >= 60 AS requires_human_review, risk_score >= 30 AS incident FROM s""",
    """SELECT request_id, rule_id, risk_score,
       CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
            ELSE 'low' END AS risk_level, risk_score >= 30 AS incident FROM s""")

# --- sources, feeds and histories -------------------------------------------------------------------
SQL["envelope_roundtrip"] = _llm("""
SELECT event_type, count(*) AS events, round(sum(cost_usd), 6) AS cost_usd FROM telemetry GROUP BY 1""")

SQL["retained_events_by_day"] = _llm("""
SELECT CAST(timestamp AS DATE) AS day, count(*) AS events FROM telemetry
WHERE timestamp >= (SELECT max(timestamp) FROM telemetry) - INTERVAL 7 DAY GROUP BY 1""")

SQL["audit_trail_orders"] = with_hub("""
SELECT id, type, actor_employee_id, subject_type, subject_id, source, occurred_at FROM h_activities
WHERE type = 'order.placed'
  AND occurred_at >= (SELECT max(occurred_at) FROM h_activities WHERE type = 'order.placed') - INTERVAL 30 DAY
ORDER BY occurred_at DESC, id DESC LIMIT 100""")

SQL["email_violation_history"] = _dlp_rows_sql() + """
SELECT v.request_id || '-' || v.rule_id AS event_id, b.ts AS timestamp, v.rule_id, b.user_id
FROM viol v JOIN base b USING (request_id) WHERE v.rule_id = 'DLP-004'
ORDER BY timestamp DESC, event_id DESC LIMIT 20"""

SQL["dlp_feed"] = _dlp_rows_sql() + """
SELECT b.ts AS _time, v.rule_id, v.sensitivity, v.action_taken FROM viol v JOIN base b USING (request_id)"""

SQL["activity_audit_summary"] = with_hub("""
, parts AS (SELECT 'event_type' AS dimension, type AS key, count(*) AS count FROM h_activities GROUP BY 2
            UNION ALL SELECT 'user', actor_employee_id, count(*) FROM h_activities GROUP BY 2),
tot AS (SELECT count(*) AS total_events,
               CAST(sum(CASE WHEN type = 'security.violation' THEN 1 ELSE 0 END) AS BIGINT) AS security_violations
        FROM h_activities)
SELECT * FROM parts CROSS JOIN tot""".replace("\n, parts", ", parts", 1))

SQL["cleaned_quality_summary"] = with_clean("\n" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype,
       round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS n_unique
FROM cleaned""" for c, t in [("order_id", "bigint"), ("order_date", "date"), ("category", "string"),
                             ("customer_region", "string"), ("channel", "string"), ("quantity", "int"),
                             ("unit_price", "double"), ("revenue", "double")]))

SQL["content_recommendations"] = with_rec("""
, f0 AS (SELECT item_id, 'cat:' || category AS feature, 1.0 AS v FROM items2
         UNION ALL SELECT item_id, 'price', price_tier / 3.0 FROM items2),
f AS (SELECT item_id, feature, v / (sqrt(sum(v * v) OVER (PARTITION BY item_id)) + 1e-12) AS v FROM f0),
p AS (SELECT t.user_id, f.feature, sum(t.weight * f.v) AS p FROM train t JOIN f USING (item_id) GROUP BY ALL),
pn AS (SELECT user_id, feature, CASE WHEN n > 0 THEN p / n ELSE p END AS p
       FROM (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY user_id)) AS n FROM p)),
users AS (SELECT DISTINCT user_id FROM truth),
sc AS (SELECT u.user_id, f.item_id, sum(f.v * pn.p) AS score FROM users u JOIN pn USING (user_id)
       JOIN f USING (feature) GROUP BY ALL),
grid AS (SELECT u.user_id, i.item_id, round(coalesce(s.score, 0.0), 9) AS score
         FROM users u CROSS JOIN items i
         LEFT JOIN sc s ON s.user_id = u.user_id AND s.item_id = i.item_id
         WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = i.item_id))
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM grid) WHERE rank <= 10
""".replace("\n, f0 AS", ", f0 AS", 1))

# --- connector payloads ---------------------------------------------------------------------------------
_ADS = """
WITH g AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS cid,
                  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS impressions,
                  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
                  round(sum(value), 2) AS spend,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS conversions
           FROM events GROUP BY 1),
m AS (SELECT CAST(cid AS VARCHAR) AS campaign_id, 'campaign ' || CAST(cid AS VARCHAR) AS name, 'meta' AS channel,
             CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks, spend,
             CAST(conversions AS BIGINT) AS conversions,
             round(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0.0 END, 4) AS ctr,
             round(CASE WHEN conversions > 0 THEN spend / conversions ELSE 0.0 END, 2) AS cpa FROM g)"""

SQL["campaign_performance"] = _ADS + "\nSELECT * FROM m"
SQL["campaign_totals"] = _ADS + """
SELECT count(*) AS campaigns, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
       round(sum(spend), 2) AS spend, round(sum(conversions), 4) AS conversions,
       round(CASE WHEN sum(impressions) > 0 THEN sum(clicks) / sum(impressions) ELSE 0.0 END, 4) AS ctr,
       round(CASE WHEN sum(conversions) > 0 THEN sum(spend) / sum(conversions) ELSE 0.0 END, 2) AS cpa FROM m"""

SQL["normalized_vouchers"] = """
SELECT 'QB-' || CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       o_totalprice + CASE WHEN o_orderkey % 70 = 0 THEN 50.0 ELSE 0.0 END AS amount, 'KRW' AS currency, 'sale' AS kind
FROM orders WHERE o_orderkey % 50 <> 0"""

SQL["normalized_invoices"] = """
SELECT 'QB-' || CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       o_totalprice + CASE WHEN o_orderkey % 70 = 0 THEN 50.0 ELSE 0.0 END AS amount, 'USD' AS currency, 'sale' AS kind
FROM orders WHERE o_orderkey % 50 <> 0"""

SQL["document_permission_acl"] = """
SELECT doc_id, CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 WHEN 0 THEN ''
                    WHEN 1 THEN 'grp:sales' WHEN 2 THEN 'grp:accounting' ELSE 'grp:manager,usr:E7' END AS acl
FROM documents"""


def _remediation_sql(final: str | None = None) -> str:
    from tessera.streaming.remediation import DEFAULT_POLICIES
    pol = ", ".join(f"({_q(p.anomaly_type)}, CAST({float(p.trigger_threshold)} AS DOUBLE), {int(p.cooldown_sec)}, "
                    f"{_q(','.join(p.actions))})" for p in DEFAULT_POLICIES)
    return f"""WITH RECURSIVE wa AS ({SQL['windowed_alerts']}),
cb AS ({SQL['cost_anomaly_band']}),
lt AS ({SQL['latency_anomaly_trend']}),
alerts AS (SELECT CAST(ts AS TIMESTAMP) AS ts, anomaly_type, CAST(metric_value AS DOUBLE) AS metric_value, model FROM wa
           UNION ALL SELECT _time, 'cost_spike', cost_5m, NULL FROM cb WHERE breach
           UNION ALL SELECT _time, 'latency_spike', avg_latency, model FROM lt WHERE breach),
pol AS (SELECT * FROM (VALUES {pol}) t(anomaly_type, threshold, cooldown_sec, actions)),
ordered AS (SELECT a.*, p.threshold, p.cooldown_sec AS pcool, p.actions AS pactions,
                   row_number() OVER (PARTITION BY a.anomaly_type ORDER BY a.ts, a.model NULLS FIRST, a.metric_value) AS rn
            FROM alerts a LEFT JOIN pol p USING (anomaly_type)),
dec AS (
  SELECT o.anomaly_type, o.rn, o.ts, o.metric_value, o.model,
         o.threshold IS NOT NULL AND o.metric_value >= o.threshold AS handled, false AS skipped,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold THEN o.pactions END AS actions,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold THEN o.pcool END AS cooldown_sec,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold THEN o.ts + to_seconds(o.pcool) END
           AS cooldown_until,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold THEN o.ts + to_seconds(o.pcool) END AS state
  FROM ordered o WHERE o.rn = 1
  UNION ALL
  SELECT o.anomaly_type, o.rn, o.ts, o.metric_value, o.model,
         o.threshold IS NOT NULL AND o.metric_value >= o.threshold AS handled,
         o.threshold IS NOT NULL AND o.metric_value >= o.threshold AND d.state IS NOT NULL AND o.ts < d.state AS skipped,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold AND NOT (d.state IS NOT NULL AND o.ts < d.state)
              THEN o.pactions END,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold AND NOT (d.state IS NOT NULL AND o.ts < d.state)
              THEN o.pcool END,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold AND NOT (d.state IS NOT NULL AND o.ts < d.state)
              THEN o.ts + to_seconds(o.pcool) END,
         CASE WHEN o.threshold IS NOT NULL AND o.metric_value >= o.threshold AND NOT (d.state IS NOT NULL AND o.ts < d.state)
              THEN o.ts + to_seconds(o.pcool) ELSE d.state END
  FROM dec d JOIN ordered o ON o.anomaly_type = d.anomaly_type AND o.rn = d.rn + 1)
{final or """SELECT ts, anomaly_type, round(metric_value, 6) AS metric_value, model, handled, skipped, actions,
       CAST(cooldown_sec AS INTEGER) AS cooldown_sec, cooldown_until FROM dec"""}"""


SQL["remediation_outcomes"] = _remediation_sql()


def _suppression_sql() -> str:
    base = _remediation_sql()
    head = base[:base.index("pol AS (")].rstrip().rstrip(",")
    return head + """,
ordered AS (SELECT a.*, row_number() OVER (PARTITION BY anomaly_type ORDER BY ts, metric_value NULLS FIRST,
                                           model NULLS FIRST) AS rn FROM alerts a),
sup AS (
  SELECT anomaly_type, rn, ts, metric_value, model, true AS emitted, ts AS last_emit FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.anomaly_type, o.rn, o.ts, o.metric_value, o.model, o.ts >= s.last_emit + INTERVAL 600 SECOND,
         CASE WHEN o.ts >= s.last_emit + INTERVAL 600 SECOND THEN o.ts ELSE s.last_emit END
  FROM sup s JOIN ordered o ON o.anomaly_type = s.anomaly_type AND o.rn = s.rn + 1)
SELECT anomaly_type, metric_value, model, ts, emitted FROM sup"""


SQL["suppressed_alerts"] = _suppression_sql()

SQL["exact_cache_replay"] = """
WITH RECURSIVE req AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, ts,
         'prompt ' || json_extract_string(props, '$.k') AS prompt,
         (['gpt-4o', 'gpt-4o-mini', 'claude-3.5-sonnet', 'gemini-1.5-flash'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1]
           AS model,
         CASE WHEN event_type = 'purchase' THEN 0.7 ELSE 0.0 END AS temperature
  FROM events WHERE event_type IN ('view', 'purchase')),
keyed AS (SELECT request_id, ts, temperature > 0 AS warm,
                 sha256(model || ':' || CAST(CAST(temperature AS DOUBLE) AS VARCHAR) || ':' || prompt) AS cache_key FROM req),
ordered AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts, request_id) AS rn FROM keyed),
rep AS (
  SELECT cache_key, rn, request_id, false AS cache_hit, CASE WHEN NOT warm THEN ts END AS entry_written_at,
         CASE WHEN NOT warm THEN ts + INTERVAL 3600 SECOND END AS expires FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.cache_key, o.rn, o.request_id, r.expires IS NOT NULL AND r.expires > o.ts,
         CASE WHEN NOT (r.expires IS NOT NULL AND r.expires > o.ts) AND NOT o.warm THEN o.ts END,
         CASE WHEN r.expires IS NOT NULL AND r.expires > o.ts THEN r.expires
              WHEN NOT o.warm THEN o.ts + INTERVAL 3600 SECOND ELSE r.expires END
  FROM rep r JOIN ordered o ON o.cache_key = r.cache_key AND o.rn = r.rn + 1)
SELECT request_id, cache_key, cache_hit, entry_written_at FROM rep"""


_ANOMALY_EVENTS = """, ev_an AS (
  SELECT d.ts AS _time, d.anomaly_type, d.anomaly_type AS metric_name, d.metric_value AS current_value,
         p.threshold, d.model, d.handled AND NOT d.skipped AS remediation_triggered
  FROM dec d LEFT JOIN pol p USING (anomaly_type))
"""


def _with_anomaly_events(final: str) -> str:
    base = _remediation_sql("SELECT 1")
    body = base[:base.rindex("SELECT 1")].rstrip()
    return body + _ANOMALY_EVENTS + final


SQL["anomalies_by_type"] = _with_anomaly_events("""
SELECT anomaly_type, model, remediation_triggered, count(*) AS count FROM ev_an GROUP BY ALL""")

SQL["anomaly_feed"] = _with_anomaly_events("""
SELECT _time, anomaly_type, metric_name, current_value, threshold, remediation_triggered FROM ev_an""")

SQL["outbox_dispatch"] = with_hub("""
, routes AS (
  SELECT 'as.opened/as' AS route, count(*) AS outputs FROM h_activities WHERE type = 'as.opened' AND subject_type = 'as'
  UNION ALL SELECT 'delivery.done/order', count(*) FROM h_activities WHERE type = 'delivery.done' AND subject_type = 'order'
  UNION ALL SELECT 'as.resolved/as', count(*) FROM h_activities WHERE type = 'as.resolved' AND subject_type = 'as')
SELECT route, outputs, (SELECT count(*) FROM h_activities) AS processed FROM routes""".replace("\n, routes", ", routes", 1))

SQL["governed_document_read"] = """
WITH req AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, 'u' || CAST(conv_id % 5 AS VARCHAR) AS user_id,
                    'src' || CAST(conv_id % 20 AS VARCHAR) AS resource FROM conversations WHERE turn = 0),
grants AS (SELECT DISTINCT 'u' || CAST(n_nationkey % 5 AS VARCHAR) AS user_id, 'src' || CAST(n_nationkey AS VARCHAR) AS resource
           FROM nation),
docs AS (SELECT source AS resource, count(*) AS n FROM documents GROUP BY 1)
SELECT r.request_id, r.user_id, r.resource,
       CASE WHEN g.user_id IS NULL THEN 'forbidden' ELSE 'success' END AS status,
       CASE WHEN g.user_id IS NULL THEN 0 ELSE coalesce(d.n, 0) END AS rows_returned
FROM req r LEFT JOIN grants g USING (user_id, resource) LEFT JOIN docs d USING (resource)"""


def _tagged_union_sql() -> str:
    cost = SQL["cost_by_model"][len("WITH "):]
    lat = SQL["latency_by_model"]
    lat_body = lat[lat.index("\nSELECT"):]
    health = SQL["system_health"]
    health_body = health[health.index("\nSELECT"):]
    cost_body = cost[cost.index("\nSELECT"):]
    ctes = cost[:cost.index("\nSELECT")]
    return f"""WITH {ctes},
c AS ({cost_body}),
l AS ({lat_body}),
h AS ({health_body})
SELECT 'agents:cost' AS sourcetype,
       to_json(struct_pack(model := model, total_cost_usd := total_cost_usd, call_count := call_count,
                           total_tokens := total_tokens)) AS event FROM c
UNION ALL
SELECT 'agents:latency', to_json(struct_pack(model := model, avg_ms := avg_ms, p95_ms := p95_ms, max_ms := max_ms)) FROM l
UNION ALL
SELECT 'agents:health', to_json(struct_pack(cpu_pct := cpu_pct, mem_pct := mem_pct, disk_pct := disk_pct)) FROM h"""


SQL["tagged_metric_union"] = _tagged_union_sql()

def _blend_recs(alpha: float, users: str) -> str:
    return f"""
, f0 AS (SELECT item_id, 'cat:' || category AS feature, 1.0 AS v FROM items2
         UNION ALL SELECT item_id, 'price', price_tier / 3.0 FROM items2),
f AS (SELECT item_id, feature, v / (sqrt(sum(v * v) OVER (PARTITION BY item_id)) + 1e-12) AS v FROM f0),
allpairs AS (SELECT a.item_id AS i, b.item_id AS j FROM items a CROSS JOIN items b),
ct AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.v * b.v) AS s FROM f a JOIN f b USING (feature)
       WHERE a.item_id <> b.item_id GROUP BY ALL),
mx AS (SELECT (SELECT max(sim) FROM sim) AS cfmax, (SELECT max(s) FROM ct) AS ctmax),
blend AS (SELECT p.i, p.j, {alpha} * (coalesce(c.sim, 0.0) / ((SELECT cfmax FROM mx) + 1e-12))
                         + (1 - CAST({alpha} AS DOUBLE)) * (coalesce(t.s, 0.0) / ((SELECT ctmax FROM mx) + 1e-12)) AS b
          FROM allpairs p LEFT JOIN sim c ON c.i = p.i AND c.j = p.j LEFT JOIN ct t ON t.i = p.i AND t.j = p.j),
thr AS (SELECT i, b AS th FROM (SELECT i, b, row_number() OVER (PARTITION BY i ORDER BY b DESC) AS r FROM blend) WHERE r = 50),
pruned AS (SELECT bl.i, bl.j, CASE WHEN bl.b < thr.th THEN 0.0 ELSE bl.b END AS b FROM blend bl LEFT JOIN thr USING (i)),
users AS (SELECT DISTINCT user_id FROM {users}),
sc AS (SELECT w.user_id, p.i AS item_id, sum(p.b * w.w) AS score FROM pruned p JOIN bm w ON w.item_id = p.j
       WHERE w.user_id IN (SELECT user_id FROM users) GROUP BY ALL),
grid AS (SELECT u.user_id, i.item_id, round(coalesce(s.score, 0.0), 9) AS score
         FROM users u CROSS JOIN items i
         LEFT JOIN sc s ON s.user_id = u.user_id AND s.item_id = i.item_id
         WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = i.item_id)),
recs AS (SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM grid) WHERE rank <= 10)"""[1:]


SQL["sim_blend_recommendations"] = with_rec(_blend_recs(0.7, "ev") + "\nSELECT * FROM recs")


def _alpha_tuning() -> str:
    """The whole statement once per alpha, each with its mean NDCG."""
    each = " UNION ALL ".join(f"""SELECT CAST({a} AS DOUBLE) AS alpha, {i} AS turn, ndcg FROM ({with_rec(_blend_recs(a, "truth") + """,
npos AS (SELECT user_id, count(*) AS npos FROM truth GROUP BY 1),
per AS (SELECT r.user_id, sum(1.0 / log2(r.rank + 1)) AS dcg FROM recs r JOIN truth t USING (user_id, item_id) GROUP BY 1)
SELECT round(avg(coalesce(dcg, 0.0) / (SELECT sum(1.0 / log2(x + 1)) FROM range(1, least(npos, 10) + 1) t(x))), 9) AS ndcg
FROM npos LEFT JOIN per USING (user_id)""")})""" for i, a in enumerate((0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)))
    return f"""SELECT alpha, round(ndcg, 6) AS ndcg, row_number() OVER (ORDER BY ndcg DESC, turn) = 1 AS best FROM ({each})"""


SQL["sim_blend_alpha_tuning"] = _alpha_tuning()

# Rank-normalised components of every user and item.
_PARTS = """
, users AS (SELECT DISTINCT user_id FROM {users}),
uc AS (SELECT user_id, device, hour_bucket, is_weekend FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, device, hour_bucket, is_weekend) AS r
  FROM (SELECT user_id, device, hour_bucket, is_weekend, count(*) AS n FROM val GROUP BY ALL)) WHERE r = 1),
cs AS (SELECT b.user_id, s.i AS item_id, sum(s.sim * b.w) AS score FROM sim s JOIN bm b ON b.item_id = s.j GROUP BY ALL),
f0 AS (SELECT item_id, 'cat:' || category AS feature, 1.0 AS v FROM items2
       UNION ALL SELECT item_id, 'price', price_tier / 3.0 FROM items2),
f AS (SELECT item_id, feature, v / (sqrt(sum(v * v) OVER (PARTITION BY item_id)) + 1e-12) AS v FROM f0),
p AS (SELECT t.user_id, f.feature, sum(t.weight * f.v) AS p FROM train t JOIN f USING (item_id) GROUP BY ALL),
pn AS (SELECT user_id, feature, CASE WHEN n > 0 THEN p / n ELSE p END AS p FROM (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY user_id)) AS n FROM p)),
cts AS (SELECT pn.user_id, f.item_id, sum(pn.p * f.v) AS score FROM pn JOIN f USING (feature) GROUP BY ALL),
e AS (SELECT t.*, i.category FROM train t JOIN items2 i USING (item_id)),
g AS (SELECT category, sum(weight) AS g FROM e GROUP BY 1),
c AS (SELECT device, hour_bucket, is_weekend, category, sum(weight) AS c FROM e GROUP BY ALL),
ctt AS (SELECT device, hour_bucket, is_weekend, sum(c) AS ct FROM c GROUP BY ALL),
lift AS (SELECT c.device, c.hour_bucket, c.is_weekend, c.category, (c.c / ctt.ct) / (g.g / (SELECT sum(g) FROM g) + 1e-9) AS lift
         FROM c JOIN ctt USING (device, hour_bucket, is_weekend) JOIN g USING (category)),
raw AS (SELECT u.user_id, i.item_id, round(coalesce(cs.score, 0.0), 9) AS cf, round(coalesce(cts.score, 0.0), 9) AS ct,
               round(coalesce(pop.pop, 0.0), 9) AS pop, round(coalesce(l.lift, 0.0), 9) AS ctx
        FROM users u CROSS JOIN items2 i LEFT JOIN cs ON cs.user_id = u.user_id AND cs.item_id = i.item_id
        LEFT JOIN cts ON cts.user_id = u.user_id AND cts.item_id = i.item_id LEFT JOIN pop ON pop.item_id = i.item_id
        LEFT JOIN uc ON uc.user_id = u.user_id LEFT JOIN lift l ON l.device = uc.device AND l.hour_bucket = uc.hour_bucket
          AND l.is_weekend = uc.is_weekend AND l.category = i.category),
parts AS MATERIALIZED (SELECT user_id, item_id, EXISTS (SELECT 1 FROM seen s WHERE s.user_id = raw.user_id) AS warm,
                 EXISTS (SELECT 1 FROM seen s WHERE s.user_id = raw.user_id AND s.item_id = raw.item_id) AS old,
                 (row_number() OVER (PARTITION BY user_id ORDER BY cf, item_id) - 1) / (SELECT greatest(count(*) - 1, 1) FROM items) AS cf,
                 (row_number() OVER (PARTITION BY user_id ORDER BY ct, item_id) - 1) / (SELECT greatest(count(*) - 1, 1) FROM items) AS ct,
                 (row_number() OVER (PARTITION BY user_id ORDER BY pop, item_id) - 1) / (SELECT greatest(count(*) - 1, 1) FROM items) AS pop,
                 (row_number() OVER (PARTITION BY user_id ORDER BY ctx, item_id) - 1) / (SELECT greatest(count(*) - 1, 1) FROM items) AS ctx
          FROM raw)"""[1:]

_HYBRID_RECS = _PARTS.format(users="ev") + """,
recs AS (SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT user_id, item_id, round(CASE WHEN warm THEN 0.5 * cf + 0.2 * ct + 0.1 * pop + 0.2 * ctx ELSE 0.6 * pop + 0.4 * ctx END, 9) AS score
    FROM parts WHERE NOT old)) WHERE rank <= 10)"""
SQL["hybrid_recommendations"] = with_rec(_HYBRID_RECS + "\nSELECT * FROM recs")
SQL["hybrid_evaluation"] = _eval_sql(_HYBRID_RECS)
SQL["hybrid_test_evaluation"] = _in_test_window(_eval_sql(_HYBRID_RECS))
SQL["content_recommendations"] = with_rec(_PARTS.format(users="ev") + """
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, ct AS score, row_number() OVER (PARTITION BY user_id ORDER BY ct DESC, item_id) AS rank
  FROM raw WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = raw.user_id AND s.item_id = raw.item_id)) WHERE rank <= 10""")
SQL["hybrid_explanations"] = with_rec(_PARTS.format(users="truth") + """
SELECT user_id, item_id, round(round(0.5 * cf, 9), 4) AS cf, round(round(0.2 * ct, 9), 4) AS content, round(round(0.1 * pop, 9), 4) AS popularity,
       round(round(0.2 * ctx, 9), 4) AS context FROM parts JOIN truth USING (user_id, item_id)""")
SQL["hybrid_weight_tuning"] = with_rec(_PARTS.format(users="truth") + """,
tenth AS (SELECT range AS x FROM range(0, 11)),
points AS (SELECT CAST(row_number() OVER (ORDER BY a.x, b.x, c.x) - 1 AS INTEGER) AS grid_index, a.x * 0.1::DOUBLE AS w_cf, b.x * 0.1::DOUBLE AS w_content,
                  c.x * 0.1::DOUBLE AS w_pop, (10 - a.x - b.x - c.x) * 0.1::DOUBLE AS w_ctx
           FROM tenth a, tenth b, tenth c WHERE a.x + b.x + c.x <= 10),
scored AS (SELECT g.grid_index, q.user_id, q.item_id, round(CASE WHEN q.warm THEN g.w_cf * q.cf + g.w_content * q.ct + g.w_pop * q.pop + g.w_ctx * q.ctx
                                                              ELSE 0.6 * q.pop + 0.4 * q.ctx END, 9) AS score
           FROM points g CROSS JOIN parts q WHERE NOT q.old),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grid_index, user_id ORDER BY score DESC, item_id) AS rank FROM scored),
npos AS (SELECT user_id, count(*) AS npos FROM truth GROUP BY 1),
per AS (SELECT r.grid_index, r.user_id, sum(1.0 / log2(r.rank + 1)) AS dcg FROM ranked r JOIN truth t USING (user_id, item_id) WHERE r.rank <= 10 GROUP BY ALL),
gain AS (SELECT p.grid_index, sum(p.dcg / (SELECT sum(1.0 / log2(x + 1)) FROM range(1, least(n.npos, 10) + 1) t(x))) AS gain
         FROM per p JOIN npos n USING (user_id) GROUP BY 1),
res AS (SELECT g.*, round(coalesce(gain, 0.0) / (SELECT count(*) FROM npos), 9) AS ndcg FROM points g LEFT JOIN gain USING (grid_index))
SELECT grid_index, w_cf, w_content, w_pop, w_ctx, round(ndcg, 6) AS ndcg, row_number() OVER (ORDER BY ndcg DESC, grid_index) = 1 AS best FROM res""")

# A quarter of each class, rounded half up, by the lowest hashes.
_SPLIT = """
h AS (SELECT customer_id, churn, CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT) AS h FROM churners),
split AS (SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY h, customer_id)
                 <= CAST(floor(count(*) OVER (PARTITION BY churn) * 0.25 + 0.5) AS BIGINT) AS is_test FROM h)"""
SQL["churn_split"] = """WITH cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cut FROM orders),
churners AS (SELECT c_custkey AS customer_id,
                    CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT cut FROM cut)) THEN 0 ELSE 1 END AS churn
             FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < (SELECT cut FROM cut))),""" + _SPLIT + """
SELECT customer_id, CAST(churn AS INTEGER) AS churn, is_test FROM split"""

# One row of the line after the other, with the weights and those saved at the first cost spike.
SQL["router_weight_timeline"] = f"""WITH RECURSIVE outcomes AS ({SQL['remediation_outcomes']}),
applied AS (SELECT ts, anomaly_type AS cause FROM outcomes WHERE handled AND NOT skipped AND anomaly_type IN ('cost_spike', 'latency_spike', 'error_rate_high')),
line AS (SELECT *, row_number() OVER (ORDER BY ts, kind, cause) AS rn FROM (
  SELECT ts, 1 AS kind, cause FROM applied
  UNION ALL SELECT ts + INTERVAL 600 SECOND, 0, 'restore' FROM applied WHERE cause = 'cost_spike')),
sim AS (
  SELECT CAST(0 AS BIGINT) AS rn, 0.3::DOUBLE AS cost, 0.5::DOUBLE AS quality, 0.2::DOUBLE AS speed, NULL::DOUBLE AS c, NULL::DOUBLE AS q, NULL::DOUBLE AS s
  UNION ALL
  SELECT l.rn,
         CASE l.cause WHEN 'restore' THEN sim.c WHEN 'cost_spike' THEN sim.cost + 0.3 WHEN 'error_rate_high' THEN greatest(0.1, sim.cost - 0.1) ELSE sim.cost END,
         CASE l.cause WHEN 'restore' THEN sim.q WHEN 'cost_spike' THEN sim.quality - 0.2 WHEN 'error_rate_high' THEN least(0.7, sim.quality + 0.1) ELSE sim.quality END,
         CASE l.cause WHEN 'restore' THEN sim.s WHEN 'latency_spike' THEN least(0.6, sim.speed + 0.2) ELSE sim.speed END,
         CASE WHEN l.cause = 'cost_spike' THEN coalesce(sim.c, sim.cost) ELSE sim.c END,
         CASE WHEN l.cause = 'cost_spike' THEN coalesce(sim.q, sim.quality) ELSE sim.q END,
         CASE WHEN l.cause = 'cost_spike' THEN coalesce(sim.s, sim.speed) ELSE sim.s END
  FROM sim JOIN line l ON l.rn = sim.rn + 1)
SELECT l.ts, l.cause, round(cost, 6) AS cost_weight, round(quality, 6) AS quality_weight, round(speed, 6) AS speed_weight FROM sim JOIN line l USING (rn)"""
