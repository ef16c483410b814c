"""Time charts, anomaly bands, running alerts and per-group normalisations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround, truthy
from tessera.operators.common import floor_time, global_order_index, keep_ts_type, running_total


def timechart(df: DataFrame, aggs: dict, span_seconds: int = 3600, ts: str = "timestamp", by: str | None = None,
              fill: float | None = 0) -> DataFrame:
    """Fixed, epoch-aligned buckets with aggregates, optional split-by, filled over the full grid.

    The grid is (distinct series) x (bucket sequence between the global first and last bucket);
    the bounds are scalar subqueries, so no join pairs rows with rows.
    """
    b = floor_time(df, ts, span_seconds).alias("_time")
    keys = [b] + ([F.col(by)] if by else [])
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if fill is None:
        return agg
    secs = F.unix_seconds(F.col("_time").cast("timestamp"))
    bounds = agg.select(F.min(secs).alias("lo"), F.max(secs).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    series = agg.select(by).distinct() if by else df.sparkSession.range(1).select()
    grid = series.select(*([by] if by else []),
                         F.explode(F.sequence(lo, hi, F.lit(span_seconds).cast("long"))).alias("_s"))
    grid = grid.select(*([by] if by else []),
                       F.timestamp_seconds("_s").cast(df.schema[ts].dataType).alias("_time"))
    out = grid.join(agg, ["_time"] + ([by] if by else []), "left")
    return out.na.fill(fill, list(aggs))


def anomaly_band(series: DataFrame, value: str, time_col: str = "_time", by: str | None = None, history: int = 12,
                 z: float = 1.96, trend: bool = False, limit: float | None = None) -> DataFrame:
    """Expected band from the ``history`` preceding buckets (mean +- z*sd, or a linear trend
    when ``trend``); ``breach`` when the value exceeds the upper bound or the absolute ``limit``.

    Substitutes the closed LLP5 predictor. Input is a bucketed series (see ``timechart``), so
    each window partition holds one row per bucket, not per event.
    """
    w = Window.orderBy(time_col) if by is None else Window.partitionBy(by).orderBy(time_col)
    frame = w.rowsBetween(-history, -1)
    n_prev = F.count(F.col(value)).over(frame)
    if trend:
        x = F.row_number().over(w).cast("double")
        tmp = series.withColumn("_x", x)
        frame_x = frame
        slope = F.regr_slope(F.col(value), F.col("_x")).over(frame_x)
        icpt = F.regr_intercept(F.col(value), F.col("_x")).over(frame_x)
        expected = icpt + slope * F.col("_x")
        out = tmp.withColumn("expected", expected)
    else:
        out = series.withColumn("expected", F.avg(F.col(value)).over(frame))
    out = out.withColumn("sd", F.stddev_samp(F.col(value)).over(frame)).withColumn("n_prev", n_prev)
    out = out.withColumn("upper95", F.col("expected") + z * F.col("sd")) \
             .withColumn("lower95", F.col("expected") - z * F.col("sd"))
    breach = F.coalesce(F.col(value) > F.col("upper95"), F.lit(False))
    if limit is not None:
        breach = breach | (F.col(value) > limit)
    out = out.withColumn("breach", breach)
    return out.drop("_x") if trend else out


def bucket_analysis(df: DataFrame, now, interval_minutes: int = 60, lookback_hours: int = 24,
                    ts: str = "timestamp", latency: str = "latency_ms", cost: str = "cost_usd",
                    success: str = "success", cached: str = "cached") -> DataFrame:
    """Buckets anchored at now - lookback (not clock aligned); only non-empty buckets."""
    now_c = now if isinstance(now, Column) else F.lit(now)
    span_us = interval_minutes * 60 * 1_000_000
    n_buckets = math.ceil(lookback_hours * 60 / interval_minutes)
    start_us = F.unix_micros(now_c.cast("timestamp")) - F.lit(lookback_hours * 3600 * 1_000_000)
    idx = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - start_us) / span_us)
    scoped = df.withColumn("_b", idx).filter((F.col("_b") >= 0) & (F.col("_b") < n_buckets))
    agg = scoped.groupBy("_b").agg(
        F.count(F.lit(1)).alias("request_count"), fround(F.avg(latency), 6).alias("avg_latency"),
        fround(F.sum(cost), 6).alias("total_cost"),
        F.sum(F.when(~truthy(success), 1).otherwise(0)).cast("long").alias("error_count"),
        F.sum(F.when(truthy(cached), 1).otherwise(0)).cast("long").alias("cache_hit_count"))
    start = F.timestamp_micros(start_us + F.col("_b") * span_us)
    end = F.timestamp_micros(start_us + (F.col("_b") + 1) * span_us)
    return agg.select(keep_ts_type(df, ts, start).alias("start"), keep_ts_type(df, ts, end).alias("end"),
                      "request_count", "avg_latency", "total_cost", "error_count", "cache_hit_count")


def budget_alerts(df: DataFrame, budget: float = 10.0, threshold: float = 8.0, ts: str = "timestamp",
                  cost: str = "cost_usd", tie: str = "event_id") -> DataFrame:
    """Running daily cost after each usage record; 'exceeded' >= budget, 'warning' >= threshold."""
    d = df.withColumn("day", F.to_date(ts))
    run = running_total(d, ["day"], ts, tie, F.coalesce(F.col(cost), F.lit(0.0)), "daily_cost")
    level = (F.when(F.col("daily_cost") >= budget, F.lit("exceeded"))
             .when(F.col("daily_cost") >= threshold, F.lit("warning")).otherwise(F.lit("ok")))
    return run.withColumn("daily_cost", fround("daily_cost", 6)).withColumn("budget_status", level)


def performance_alerts(df: DataFrame, latency_ms: float = 5000, error_rate: float = 0.1, min_count: int = 10,
                       model: str = "model", ts: str = "timestamp", tie: str = "event_id",
                       latency: str = "latency_ms", success: str = "success") -> DataFrame:
    """Per record, high latency (> latency_ms) and the running per-model error rate
    (> error_rate once the model has min_count records)."""
    d = running_total(df, [model], ts, tie, F.lit(1), "_cnt")
    d = running_total(d, [model], ts, tie, F.when(~truthy(success), 1).otherwise(0), "_err")
    rate = F.col("_err") / F.col("_cnt")
    return (d.withColumn("running_count", F.col("_cnt").cast("long"))
            .withColumn("running_error_rate", fround(rate, 6))
            .withColumn("latency_alert", F.col(latency) > latency_ms)
            .withColumn("error_rate_alert", (F.col("_cnt") >= min_count) & (rate > error_rate))
            .drop("_cnt", "_err"))


def streamstats_count(df: DataFrame, ts: str, tie: str, by: list[str] | None = None, out: str = "row") -> DataFrame:
    """Running row number in (ts, tie) order, optionally per group (skew-safe running count)."""
    return running_total(df, list(by or []), ts, tie, F.lit(1), out).withColumn(out, F.col(out).cast("long"))


# Fourier period (weeks per year) used by the weekly forecast features.
WEEKS_PER_YEAR = 52.18


def forecast_features(df: DataFrame, series: list[str], week: str = "week", value: str = "weekly_sales",
                      holidays: list[str] | None = None, holiday_col: str = "holiday_name",
                      promo: str = "has_promo") -> DataFrame:
    """Seasonal lag 52, time index t, Fourier terms on the ISO week, holiday one-hots, promo flag.

    Window partitions are single series (one row per week), never the whole table."""
    w = Window.partitionBy(*series).orderBy(week)
    woy = F.weekofyear(week).cast("double")
    out = (df.withColumn("lag_52", F.lag(value, 52).over(w))
           .withColumn("sin1", F.sin(2 * math.pi * woy / WEEKS_PER_YEAR))
           .withColumn("cos1", F.cos(2 * math.pi * woy / WEEKS_PER_YEAR))
           .withColumn("sin2", F.sin(4 * math.pi * woy / WEEKS_PER_YEAR))
           .withColumn("cos2", F.cos(4 * math.pi * woy / WEEKS_PER_YEAR))
           .withColumn("t", (F.row_number().over(w) - 1).cast("long")))
    for h in holidays or []:
        out = out.withColumn(f"hol_{h}", (F.coalesce(F.col(holiday_col), F.lit("")) == h).cast("int"))
    if promo in df.columns:
        out = out.withColumn("promo", F.col(promo).cast("int"))
    return out


def rank_norm(df: DataFrame, by: list[str], score: str, tie: str, out: str = "rank_norm") -> DataFrame:
    """(rank - 1) / max(n - 1, 1) per group, ascending score, ties broken by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.col(score), F.col(tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))


def minmax(df: DataFrame, by: list[str], col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) per group; 0 when the range is below 1e-12. Group bounds come from
    one aggregation joined back (a scalar subquery when there is no group), not from a window."""
    name = out or f"{col}_minmax"
    if by:
        b = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        j = df.join(b, by, "left")
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        j = df
        lo, hi = df.select(F.min(col)).scalar(), df.select(F.max(col)).scalar()
    res = j.withColumn(name, F.when(hi - lo < 1e-12, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo)))
    return res.drop("_lo", "_hi") if by else res


def quantile_bins(df: DataFrame, score: str, tie: str, k: int = 10, out: str = "bin",
                  descending: bool = True) -> DataFrame:
    """Pandas ``qcut(rank(method='first'), k)`` on the ascending first-rank r (ties by ``tie``).

    j = max(1, ceil((r - 1) * k / (N - 1))); with ``descending`` the labels are reversed
    (k + 1 - j), so label 1 holds the highest scores. The rank comes from a distributed global
    order (no single-task window)."""
    idx = global_order_index(df, [F.asc(score), F.asc(tie)], out="_r0")
    n = df.select(F.count(F.lit(1))).scalar()
    r = F.col("_r0") + 1
    j = F.greatest(F.lit(1), F.ceil((r - 1) * k / F.greatest(n - 1, F.lit(1))))
    j = F.when(n <= 1, F.lit(1)).otherwise(j)
    lab = (F.lit(k + 1) - j) if descending else j
    return idx.withColumn(out, lab.cast("int")).drop("_r0")
