"""Aggregation reports over telemetry and business frames.

Every report is one ``groupBy().agg()`` (partial + final HashAggregate), so the shuffle carries
one row per group and task, independent of the number of input rows. Event-type filters come
first and reach the parquet scan as pushed predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround, safe_div, truthy
from tessera.operators.common import checkpoint, shuffles_dropped, with_one_row_if_empty
from tessera.operators.selection import indexed, quantiles
from tessera.sources import telemetry as tel


def _of(df: DataFrame, *types: str, col: str = "event_type") -> DataFrame:
    return df.filter(F.col(col).isin(*types)) if types else df


def _is_false(c: str):
    return F.lower(F.col(c).cast("string")) == F.lit("false")


def _count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


# A01
def cost_by_model(df: DataFrame, event_type: str | None = tel.LLM_CALL, model: str = "model") -> DataFrame:
    """Sum of cost, call count and tokens by model, most expensive first."""
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(model)
            .agg(fround(F.sum("cost_usd"), 6).alias("total_cost_usd"),
                 F.count(F.lit(1)).alias("call_count"),
                 F.sum("total_tokens").cast("long").alias("total_tokens"))
            .orderBy(F.desc("total_cost_usd"), F.asc(model)))


# A02
def error_rate_by_model(df: DataFrame, event_type: str | None = tel.LLM_CALL, model: str = "model",
                        success: str = "success") -> DataFrame:
    """errors = rows whose success flag reads 'false'; rate in percent, 2 dp."""
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(model)
            .agg(F.count(F.lit(1)).alias("total"), _count_if(_is_false(success)).alias("errors"))
            .withColumn("error_rate", fround(F.col("errors") / F.col("total") * 100, 2))
            .orderBy(F.desc("error_rate"), F.asc(model)))


# A03
def violations_by_rule_action(df: DataFrame, event_type: str | None = tel.DLP_VIOLATION) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy("rule_name", "action_taken", "sensitivity")
            .agg(F.count(F.lit(1)).alias("violations"))
            .orderBy(F.desc("violations")))


# A04
def latency_by_model(df: DataFrame, event_type: str | None = tel.LLM_CALL, model: str = "model",
                     latency: str = "latency_ms", exact: bool = True) -> DataFrame:
    """avg / p95 / max latency. ``exact`` uses the interpolated percentile, found by radix selection, so that a model with
    most rows is not one task's work; otherwise ``percentile_approx``."""
    base = _of(df, *([event_type] if event_type else []))
    most = [fround(F.avg(latency), 6).alias("avg_ms"), F.max(latency).alias("max_ms")]
    if exact:
        stats, p95 = base.groupBy(model).agg(*most), quantiles(base, [model], latency, {"p95_ms": 0.95}).withColumnRenamed(model, "_model")
        out = stats.join(p95, F.col(model).eqNullSafe(F.col("_model")), "left").withColumn("p95_ms", fround("p95_ms", 6))
    else:
        out = base.groupBy(model).agg(*most, fround(F.percentile_approx(latency, 0.95, 10000), 6).alias("p95_ms"))
    return out.select(model, "avg_ms", "p95_ms", "max_ms").orderBy(F.desc("avg_ms"))


# A05
def cache_savings(df: DataFrame, event_type: str | None = tel.CACHE_HIT) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .agg(fround(F.sum("saved_cost"), 6).alias("total_saved_usd"),
                 fround(F.sum("saved_latency_ms"), 6).alias("total_saved_ms"),
                 F.count(F.lit(1)).alias("cache_hits")))


# A06
def router_decisions(df: DataFrame, by=("query_complexity", "selected_model", "strategy"),
                     event_type: str | None = tel.ROUTER_DECISION) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count")))


# A07
def agent_performance(df: DataFrame, event_type: str | tuple[str, ...] | None = (tel.AGENT_COMPLETE, tel.AGENT_ERROR)) -> DataFrame:
    """Averages and success rate over all traces that ended, failed ones included."""
    return (_of(df, *([event_type] if isinstance(event_type, str) else event_type or []))
            .agg(fround(F.avg("duration_ms"), 6).alias("avg_duration"),
                 fround(F.avg("total_cost"), 6).alias("avg_cost"),
                 fround(F.avg("total_tokens"), 6).alias("avg_tokens"),
                 _count_if(truthy("success")).alias("success_count"),
                 F.count(F.lit(1)).alias("total_count"))
            .withColumn("success_rate", fround(F.col("success_count") / F.col("total_count") * 100, 2)))


# A08
def anomalies_by_type(df: DataFrame, event_type: str | None = tel.ANOMALY) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy("anomaly_type", "model", "remediation_triggered")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count")))


# A09
def top_users(df: DataFrame, n: int = 10, user: str = "user_id", cost: str = "cost_usd") -> DataFrame:
    """Top ``n`` users by cost (ties: user id ascending). TakeOrderedAndProject keeps n rows per task."""
    return (df.groupBy(user)
            .agg(fround(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("total_cost"),
                 F.count(F.lit(1)).alias("total_calls"))
            .orderBy(F.desc("total_cost"), F.asc(user)).limit(n))


# A10
def violations_with_actions(df: DataFrame, event_type: str | None = tel.DLP_VIOLATION) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy("rule_name", "sensitivity")
            .agg(F.count(F.lit(1)).alias("violations"),
                 F.array_sort(F.collect_set("action_taken")).alias("actions"))
            .orderBy(F.desc("violations")))


# A11
def model_performance(df: DataFrame, event_type: str | None = tel.LLM_CALL, model: str = "model") -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(model)
            .agg(F.count(F.lit(1)).alias("calls"),
                 fround(F.avg("latency_ms"), 6).alias("avg_latency"),
                 fround(F.avg("cost_usd"), 9).alias("avg_cost"),
                 _count_if(truthy("success")).alias("success_count"))
            .withColumn("success_rate", fround(F.col("success_count") / F.col("calls") * 100, 1))
            .orderBy(F.desc("calls")))


# A12
def cache_hit_rate(df: DataFrame, by=("model",)) -> DataFrame:
    et = F.col("event_type")
    return (_of(df, tel.CACHE_HIT, tel.CACHE_MISS)
            .groupBy(*by)
            .agg(_count_if(et == tel.CACHE_HIT).alias("hits"), _count_if(et == tel.CACHE_MISS).alias("misses"),
                 fround(F.sum("saved_cost"), 6).alias("total_saved_usd"))
            .withColumn("hit_rate", fround(F.col("hits") / (F.col("hits") + F.col("misses")) * 100, 1)))


# A13
def kpi_tiles(df: DataFrame) -> DataFrame:
    """One pass, one row: total LLM cost, LLM calls, cache hit rate %, DLP violations."""
    et = F.col("event_type")
    is_cache = et.isin(tel.CACHE_HIT, tel.CACHE_MISS)
    out = df.agg(
        fround(F.sum(F.when(et == tel.LLM_CALL, F.col("cost_usd"))), 6).alias("total_cost"),
        _count_if(et == tel.LLM_CALL).alias("calls"),
        _count_if(et == tel.CACHE_HIT).alias("_hits"), _count_if(is_cache).alias("_cache_total"),
        _count_if(et == tel.DLP_VIOLATION).alias("violations"))
    return out.select("total_cost", "calls",
                      fround(safe_div(F.col("_hits"), F.col("_cache_total")) * 100, 1).alias("hit_rate"),
                      "violations")


def calls_by_model(df: DataFrame, event_type: str = tel.LLM_CALL, model: str = "model") -> DataFrame:
    """A13 pie tile: LLM calls by model."""
    return _of(df, event_type).groupBy(model).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


# A14
def system_health(df: DataFrame, budget: float = 12.0, event_type: str = tel.LLM_CALL) -> DataFrame:
    """Budget used % (capped at 100), success % and error %, guarded with max(total, 1)."""
    agg = _of(df, event_type).agg(F.sum("cost_usd").alias("_cost"), _count_if(_is_false("success")).alias("_err"),
                                  F.count(F.lit(1)).alias("_total"))
    tot = F.greatest(F.col("_total"), F.lit(1))
    return agg.select(
        fround(F.least(F.coalesce(F.col("_cost"), F.lit(0.0)) / budget * 100, F.lit(100.0)), 1).alias("cpu_pct"),
        fround((1 - F.col("_err") / tot) * 100, 1).alias("mem_pct"),
        fround(F.col("_err") / tot * 100, 2).alias("disk_pct"))


# Event type -> dashboard component.
COMPONENTS = [
    ([tel.LLM_CALL], "Multi-LLM Router"),
    ([tel.CACHE_HIT, tel.CACHE_MISS], "Semantic Cache"),
    ([tel.DLP_VIOLATION], "DLP Engine"),
    ([tel.ANOMALY], "Auto-Remediation"),
    ([tel.ROUTER_DECISION], "Intelligent Router"),
]
DEFAULT_COMPONENT = "HEC Telemetry"


# A15
def component_health(df: DataFrame, mapping=None) -> DataFrame:
    """Event counts per component; a single critical row when there are no events at all."""
    mapping = mapping or COMPONENTS
    comp = F.lit(DEFAULT_COMPONENT)
    for types, name in reversed(mapping):
        comp = F.when(F.col("event_type").isin(*types), F.lit(name)).otherwise(comp)
    counts = df.groupBy(comp.alias("component")).agg(F.count(F.lit(1)).alias("event_count"))
    rows = counts.select("component", F.lit(0).alias("errors"), F.lit(0).alias("warns"),
                         F.when(F.col("event_count") > 0, F.lit("ok")).otherwise(F.lit("warning")).alias("status"),
                         "event_count")
    return with_one_row_if_empty(rows, {"component": DEFAULT_COMPONENT, "errors": 1, "warns": 0,
                                        "status": "critical", "event_count": 0})


# A16
def error_rate_alert(df: DataFrame, now, threshold: float = 0.15, minutes: int = 10, ts: str = "timestamp",
                     model: str = "model") -> DataFrame:
    """Per-model error rate over the last ``minutes``; alert rows where rate > threshold."""
    recent = _of(df, tel.LLM_CALL).filter((F.col(ts) >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
                                          & (F.col(ts) <= now))
    agg = recent.groupBy(model).agg(F.count(F.lit(1)).alias("total"), _count_if(_is_false("success")).alias("errors"))
    rate = fround(F.col("errors") / F.col("total"), 4)
    return agg.filter(rate > threshold).select(F.lit("error_rate_high").alias("anomaly_type"),
                                               rate.alias("metric_value"), F.col(model).alias("model"))


# A17
def dlp_burst_alert(df: DataFrame, now, threshold: int = 10, minutes: int = 10, ts: str = "timestamp") -> DataFrame:
    recent = _of(df, tel.DLP_VIOLATION).filter((F.col(ts) >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
                                               & (F.col(ts) <= now))
    agg = recent.agg(F.count(F.lit(1)).alias("violations"))
    return agg.filter(F.col("violations") >= threshold).select(
        F.lit("dlp_burst").alias("anomaly_type"), F.col("violations").cast("double").alias("metric_value"))


def _stat_block(latency: str, cost: str, success: str, cached: str):
    return [F.count(F.lit(1)).alias("total_requests"),
            fround(_count_if(~truthy(success)) / F.count(F.lit(1)), 6).alias("error_rate"),
            fround(_count_if(truthy(cached)) / F.count(F.lit(1)), 6).alias("cache_hit_rate"),
            fround(F.avg(latency), 6).alias("latency_mean"),
            F.min(latency).alias("latency_min"), F.max(latency).alias("latency_max"),
            fround(F.sum(cost), 6).alias("cost_total"),
            fround(F.avg(cost), 9).alias("cost_mean")]


def _with_order_statistics(base: DataFrame, stats: DataFrame, by: str, latency: str, cost: str) -> DataFrame:
    """Add the medians and the p95 by the index rule sorted[int(n*0.95)] (max below 20 rows), by radix selection."""
    found = [(quantiles(base, [by], latency, {"latency_median": 0.5}, {"latency_p95": indexed(0.95, 20)}), [fround("latency_median", 6).alias("latency_median"), "latency_p95"]),
             (quantiles(base, [by], cost, {"cost_median": 0.5}), [fround("cost_median", 9).alias("cost_median")])]
    for table, columns in found:
        table = table.select(F.col(by).alias("_by"), *columns)
        stats = stats.join(table, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return stats


# A18
def model_statistics(df: DataFrame, model: str = "model", latency: str = "latency_ms", cost: str = "cost_usd",
                     success: str = "success", cached: str = "cached", event_type: str | None = tel.LLM_CALL) -> DataFrame:
    """Per-model request statistics; p95 by the index rule sorted[int(n*0.95)] (max below 20 rows)."""
    base = _of(df, *([event_type] if event_type else []))
    stats = base.groupBy(model).agg(*_stat_block(latency, cost, success, cached))
    return _with_order_statistics(base, stats, model, latency, cost)


# A19
def complexity_breakdown(df: DataFrame, complexity: str = "complexity", model: str = "model",
                         latency: str = "latency_ms", cost: str = "cost_usd",
                         event_type: str | None = tel.LLM_CALL) -> DataFrame:
    """Per complexity: count, mean latency/cost, total cost and the most used model (ties: name asc)."""
    base = _of(df, *([event_type] if event_type else []))
    stats = base.groupBy(complexity).agg(F.count(F.lit(1)).alias("count"),
                                         fround(F.avg(latency), 6).alias("avg_latency"),
                                         fround(F.avg(cost), 9).alias("avg_cost"),
                                         fround(F.sum(cost), 6).alias("total_cost"))
    per_model = base.groupBy(complexity, model).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(complexity).orderBy(F.desc("_n"), F.asc(model))
    mode = (per_model.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(complexity, F.col(model).alias("most_used_model")))
    return stats.join(mode, complexity, "left")


# A20
def overall_summary(df: DataFrame, model: str = "model", latency: str = "latency_ms", cost: str = "cost_usd",
                    success: str = "success", cached: str = "cached",
                    event_type: str | None = tel.LLM_CALL) -> DataFrame:
    base = _of(df, *([event_type] if event_type else []))
    stats = base.withColumn("_all", F.lit(1)).groupBy("_all").agg(
        *_stat_block(latency, cost, success, cached),
        F.array_sort(F.collect_set(model)).alias("models_used"))
    return _with_order_statistics(base.withColumn("_all", F.lit(1)), stats, "_all", latency, cost).drop("_all")


# A21
def daily_costs(df: DataFrame, ts: str = "timestamp", cost: str = "cost_usd",
                event_type: str | None = tel.LLM_CALL) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(F.to_date(ts).alias("day")).agg(fround(F.sum(cost), 6).alias("daily_cost")))


def model_costs(df: DataFrame, model: str = "model", cost: str = "cost_usd",
                event_type: str | None = tel.LLM_CALL) -> DataFrame:
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(model).agg(fround(F.sum(cost), 6).alias("model_cost")))


def cost_summary(df: DataFrame, budget: float = 10.0, today=None, ts: str = "timestamp", cost: str = "cost_usd",
                 input_tokens: str = "prompt_tokens", output_tokens: str = "completion_tokens",
                 cached: str = "cached", event_type: str | None = tel.LLM_CALL) -> DataFrame:
    """Totals, cached share and the budget remaining for ``today`` (defaults to the last day seen)."""
    base = _of(df, *([event_type] if event_type else []))
    day = F.to_date(ts)
    today_col = F.to_date(today) if today is not None else F.max(day)
    agg = base.agg(F.sum(cost).alias("_total"), F.count(F.lit(1)).alias("total_requests"),
                   F.sum(input_tokens).cast("long").alias("total_input_tokens"),
                   F.sum(output_tokens).cast("long").alias("total_output_tokens"),
                   _count_if(truthy(cached)).alias("_cached"), today_col.alias("_today"))
    spent_today = base.groupBy(day.alias("_today")).agg(F.sum(cost).alias("_today_cost"))
    return (agg.join(spent_today, "_today", "left")
            .select(fround(F.col("_total"), 6).alias("total_cost"), "total_requests",
                    fround(safe_div("_total", "total_requests"), 9).alias("average_cost_per_request"),
                    "total_input_tokens", "total_output_tokens",
                    fround(safe_div("_cached", "total_requests"), 6).alias("cache_hit_rate"),
                    F.col("_today").alias("today"),
                    fround(F.lit(budget) - F.coalesce(F.col("_today_cost"), F.lit(0.0)), 6).alias("budget_remaining")))


# A22
def routing_statistics(df: DataFrame, model: str = "selected_model", complexity: str = "query_complexity",
                       est_cost: str = "estimated_cost", est_latency: str = "estimated_latency_ms",
                       event_type: str | None = tel.ROUTER_DECISION) -> DataFrame:
    """Long form: (dimension, key, count) for model and complexity distributions, plus totals rows."""
    base = _of(df, *([event_type] if event_type else []))
    dist = (base.groupBy(F.lit("model").alias("dimension"), F.col(model).alias("key"))
            .agg(F.count(F.lit(1)).alias("count"))
            .unionByName(base.groupBy(F.lit("complexity").alias("dimension"), F.col(complexity).alias("key"))
                         .agg(F.count(F.lit(1)).alias("count"))))
    totals = base.agg(F.count(F.lit(1)).alias("total_routings"),
                      fround(F.coalesce(F.sum(est_cost), F.lit(0.0)), 6).alias("total_estimated_cost"),
                      fround(F.coalesce(F.avg(est_latency), F.lit(0.0)), 6).alias("avg_estimated_latency"))
    return dist.crossJoin(F.broadcast(totals))


# A23
def span_statistics(spans: DataFrame) -> DataFrame:
    """Span counts by type and status, totals and error rate (one row per (type, status))."""
    err = F.col("status") == "error"
    by = spans.groupBy("span_type", "status").agg(F.count(F.lit(1)).alias("spans"))
    tot = spans.agg(F.countDistinct("trace_id").alias("total_traces"), F.count(F.lit(1)).alias("total_spans"),
                    fround(F.sum(F.coalesce("duration_ms", F.lit(0.0))), 6).alias("total_duration_ms"),
                    fround(F.avg(F.coalesce("duration_ms", F.lit(0.0))), 6).alias("avg_span_duration_ms"),
                    F.sum("tokens_used").cast("long").alias("total_tokens"),
                    fround(F.sum("cost"), 6).alias("total_cost"), _count_if(err).alias("error_count"))
    tot = tot.withColumn("error_rate", fround(F.col("error_count") / F.col("total_spans"), 6))
    return by.crossJoin(F.broadcast(tot))


def trace_summary(spans: DataFrame, n: int | None = 20) -> DataFrame:
    """Per-trace roll-up: span count, tokens, cost, duration (newest ``n`` traces; None = all)."""
    from tessera.functions import epoch_ms
    start = epoch_ms("start_time")
    out = spans.groupBy("trace_id").agg(
        F.first("trace_name", ignorenulls=True).alias("name"), F.first("user_id", ignorenulls=True).alias("user_id"),
        F.min("start_time").alias("start_time"), F.count(F.lit(1)).alias("span_count"),
        F.sum("tokens_used").cast("long").alias("tokens"), fround(F.sum("cost"), 6).alias("cost"),
        fround(F.max(start + F.coalesce(F.col("duration_ms"), F.lit(0.0))) - F.min(start), 3).alias("duration_ms"))
    if n is not None:
        out = out.orderBy(F.desc("start_time"), F.asc("trace_id")).limit(n)
    return out


# A24
def dlp_statistics(violations: DataFrame, rule: str = "rule_name", action: str = "action_taken",
                   sensitivity: str = "sensitivity") -> DataFrame:
    """Long form (dimension, key, count) plus totals: violations, blocked, masked. The violations, each the work of all rules' patterns, are
    read once: they are counted by all three columns, and these few counts, kept, give the distributions and totals."""
    dims = {"rule": rule, "action": action, "sensitivity": sensitivity}
    counts = checkpoint(violations.groupBy(*[F.col(c).alias(d) for d, c in dims.items()]).agg(F.count(F.lit(1)).alias("n")))
    parts = [counts.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("key")).agg(F.sum("n").alias("count")) for d in dims]
    dist = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda value: F.sum(F.when(F.col("action") == value, F.col("n")).otherwise(0)).cast("long")
    tot = counts.agg(F.sum("n").alias("total_violations"), of("block").alias("blocked_count"), of("mask").alias("masked_count"))
    return dist.crossJoin(F.broadcast(tot))


# A25
def audit_summary(df: DataFrame, event_type: str = "event_type", user: str = "user_id",
                  violation_type: str = "security_violation") -> DataFrame:
    parts = [df.groupBy(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key"))
             .agg(F.count(F.lit(1)).alias("count")) for d, c in (("event_type", event_type), ("user", user))]
    tot = df.agg(F.count(F.lit(1)).alias("total_events"),
                 _count_if(F.col(event_type) == violation_type).alias("security_violations"))
    return parts[0].unionByName(parts[1]).crossJoin(F.broadcast(tot))


# A26
def cache_statistics(df: DataFrame, semantic: str | None = None) -> DataFrame:
    """hits, misses, hit rate, share of semantic hits among hits (``semantic``: boolean column)."""
    et = F.col("event_type")
    hit = et == tel.CACHE_HIT
    sem = (hit & truthy(semantic)) if semantic else F.lit(False)
    agg = _of(df, tel.CACHE_HIT, tel.CACHE_MISS).agg(
        _count_if(hit).alias("hits"), _count_if(et == tel.CACHE_MISS).alias("misses"),
        _count_if(sem).alias("semantic_hits"))
    total = F.col("hits") + F.col("misses")
    return agg.select("hits", "misses", "semantic_hits", total.alias("total_requests"),
                      fround(safe_div(F.col("hits"), total), 6).alias("hit_rate"),
                      fround(safe_div(F.col("semantic_hits"), F.col("hits")), 6).alias("semantic_hit_ratio"))


# A27
def campaign_summary(metrics: DataFrame, channel: str | None = None) -> DataFrame:
    """Totals over campaign metric rows (see S08) and overall ctr/cpa with zero guards."""
    df = metrics.filter(F.col("channel") == channel) if channel else metrics
    agg = df.agg(F.count(F.lit(1)).alias("campaigns"), F.sum("impressions").cast("long").alias("impressions"),
                 F.sum("clicks").cast("long").alias("clicks"), fround(F.sum("spend"), 2).alias("spend"),
                 fround(F.sum("conversions"), 4).alias("conversions"))
    return agg.select("*", fround(safe_div("clicks", "impressions"), 4).alias("ctr"),
                      fround(safe_div("spend", "conversions"), 2).alias("cpa"))


# Sales report over cleaned orders (order_id, order_date, category, customer_region,
# channel, quantity, unit_price, revenue)
def sales_kpis(df: DataFrame) -> DataFrame:
    return df.agg(fround(F.sum("revenue"), 2).alias("total_revenue"), F.count(F.lit(1)).alias("orders"),
                  fround(F.avg("revenue"), 4).alias("aov"), fround(F.avg("quantity"), 4).alias("avg_units"))


def monthly_revenue(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Revenue per month start; months without orders inside the observed range are 0.

    The calendar is derived from min/max (one row), expanded with ``sequence`` and joined,
    so the grid is month-sized, never row-sized.
    """
    month = F.trunc(F.col(date_col), "month")
    sums = df.groupBy(month.alias("month")).agg(F.sum("revenue").alias("_rev"))
    cal = (df.agg(F.min(month).alias("_lo"), F.max(month).alias("_hi"))
           .select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("month")))
    return cal.join(sums, "month", "left").select(
        "month", fround(F.coalesce(F.col("_rev"), F.lit(0.0)), 2).alias("revenue"))


def revenue_by_category(df: DataFrame, category: str = "category") -> DataFrame:
    return (df.groupBy(category).agg(fround(F.sum("revenue"), 2).alias("revenue"),
                                     F.count("order_id").alias("orders"))
            .orderBy(F.desc("revenue")))


def revenue_by_weekday(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Revenue by day name in Monday-first order (``weekday_index`` 0 = Monday)."""
    idx = F.weekday(F.col(date_col))
    return (df.groupBy(idx.alias("weekday_index"), F.date_format(F.col(date_col), "EEEE").alias("weekday"))
            .agg(fround(F.sum("revenue"), 2).alias("revenue")).orderBy("weekday_index"))


def revenue_pivot(df: DataFrame, index: str = "customer_region", columns: str = "channel",
                  values: list | None = None) -> DataFrame:
    """Pivot sum of revenue, rounded to 0 dp, missing = 0. Pass ``values`` to skip the
    distinct-values pre-pass; otherwise Spark computes them (bounded by the pivot cardinality).
    Cent amounts are summed as DECIMAL, so the total (and its rounding) is exact."""
    g = df.groupBy(index)
    p = g.pivot(columns, values) if values is not None else g.pivot(columns)
    out = p.agg(F.round(F.sum(F.col("revenue").cast("decimal(18,2)")), 0).cast("double"))
    return out.na.fill(0.0, [c for c in out.columns if c != index])


# A32
def quality_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: dtype, missing % (2 dp) and distinct count. Exact counts take one column after the other: a pass reads that column alone and
    shuffles its distinct values, and its shuffle files are gone before the next; all at once, each row would be spread into one per column."""
    if approx:
        seen = df.agg(*[x for c in df.columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"m__{c}"), F.approx_count_distinct(c).alias(f"d__{c}"))]).first()
        found = [(c, seen[f"m__{c}"], seen[f"d__{c}"]) for c in df.columns]
    else:
        found = []
        with shuffles_dropped(df.sparkSession):
            for c in df.columns:
                values = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
                missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")
                found.append((c, *values.agg(missing, _count_if(F.col("value").isNotNull())).first()))
    rows = [(c, df.schema[c].dataType.simpleString(), missing, int(distinct or 0)) for c, missing, distinct in found]
    out = df.sparkSession.createDataFrame(rows, "column string, dtype string, missing_pct double, n_unique long")
    return out.withColumn("missing_pct", fround(F.col("missing_pct") * 100, 2))


# A33
def tool_statistics(df: DataFrame, tool: str = "tool_name", category: str | None = None,
                    event_type: str | None = tel.TOOL_CALL) -> DataFrame:
    """Per tool (and category): calls, success rate, mean latency."""
    by = [tool] + ([category] if category else [])
    return (_of(df, *([event_type] if event_type else []))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("calls"),
                              fround(F.avg(truthy("success").cast("double")), 6).alias("success_rate"),
                              fround(F.avg("latency_ms"), 6).alias("avg_latency_ms")))
