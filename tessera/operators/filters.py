"""Projections, filters and feeds (F01-F06). All predicates are plain column comparisons, so
they are pushed into the parquet scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import telemetry as tel

_UNITS = {"s": "SECONDS", "m": "MINUTES", "h": "HOURS", "d": "DAYS", "w": "WEEKS"}
_SNAP = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mon": "month"}


def time_range(df: DataFrame, spec: str, now, ts: str = "timestamp") -> DataFrame:
    """relative range such as ``-24h``, ``-7d`` or ``-24h@h`` (snap the start down to the unit).

    ``now`` is a literal or Column (never the wall clock implicitly)."""
    m = re.fullmatch(r"-(\d+)(s|m|h|d|w)(?:@(s|m|h|d|w|mon))?", spec.strip())
    if not m:
        raise ValueError(f"unsupported time range {spec!r}")
    n, unit, snap = int(m.group(1)), m.group(2), m.group(3)
    now_c = now if isinstance(now, F.Column) else F.lit(now)
    start = now_c - F.expr(f"INTERVAL {n} {_UNITS[unit]}")
    if snap:
        start = F.date_trunc(_SNAP[snap], start).cast(df.schema[ts].dataType)
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= now_c))


def events_of(df: DataFrame, *types: str, col: str = "event_type") -> DataFrame:
    """event-type predicate (several types = OR)."""
    return df.filter(F.col(col).isin(*types))


def audit_trail(df: DataFrame, type: str | None = None, actor: str | None = None, subject_type: str | None = None,
                source: str | None = None, since_days: int | None = None, now=None, limit: int = 100,
                ts: str = "occurred_at") -> DataFrame:
    """optional filters over the activity stream, newest first, ``limit`` rows."""
    for c, v in (("type", type), ("actor_employee_id", actor), ("subject_type", subject_type), ("source", source)):
        if v:
            df = df.filter(F.col(c) == v)
    if since_days:
        now_c = now if isinstance(now, F.Column) else (F.lit(now) if now is not None else F.current_timestamp())
        df = df.filter(F.col(ts) >= now_c - F.make_dt_interval(F.lit(since_days)))
    return df.orderBy(F.desc(ts), F.desc("id")).limit(limit)


def history(df: DataFrame, rule_id: str | None = None, user_id: str | None = None, event_type: str | None = None,
            limit: int = 100, ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """violation / audit history filtered by rule, user or event type; the newest ``limit``."""
    for c, v in (("rule_id", rule_id), ("user_id", user_id), ("event_type", event_type)):
        if v:
            df = df.filter(F.col(c) == v)
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def raw_events(df: DataFrame, n: int = 50, ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """newest ``n`` raw events."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def anomaly_feed(df: DataFrame) -> DataFrame:
    """anomaly table, newest first."""
    return (df.filter(F.col("event_type") == tel.ANOMALY)
            .select(F.col("timestamp").alias("_time"), "anomaly_type", "metric_name", "current_value", "threshold",
                    "remediation_triggered")
            .orderBy(F.desc("_time")))


def dlp_feed(df: DataFrame) -> DataFrame:
    """DLP violation table, newest first."""
    return (df.filter(F.col("event_type") == tel.DLP_VIOLATION)
            .select(F.col("timestamp").alias("_time"), "rule_id", "sensitivity", "action_taken")
            .orderBy(F.desc("_time")))
