"""Alert remediation with cooldown state and router weight timeline.

The per-anomaly-type cooldown is a sequential fold. On a stream it is keyed state
(``applyInPandasWithState``, key = anomaly type, state = cooldown end). The batch twin
finds the same decisions by list ranking (``operators.cooldown``), so that no type is one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators import cooldown
from tessera.operators.common import checkpoint


@dataclass(frozen=True)
class Policy:
    anomaly_type: str
    trigger_threshold: float
    actions: tuple
    fallback_model: str = ""
    cost_weight_boost: float = 0.0
    quality_weight_cut: float = 0.0
    cooldown_sec: int = 300


# Default remediation policies.
DEFAULT_POLICIES = [
    Policy("cost_spike", 5.0, ("switch_to_cheaper_model", "enable_aggressive_caching", "notify_admin", "emit_telemetry"),
           "gpt-4o-mini", 0.3, 0.2, 600),
    Policy("latency_spike", 5000, ("switch_to_faster_model", "reduce_max_tokens", "emit_telemetry"), "gpt-4o-mini",
           cooldown_sec=300),
    Policy("error_rate_high", 0.15, ("switch_to_stable_model", "circuit_breaker_open", "notify_admin", "emit_telemetry"),
           "claude-3.5-sonnet", cooldown_sec=900),
    Policy("dlp_burst", 10, ("increase_dlp_strictness", "notify_security", "emit_telemetry"), cooldown_sec=1800),
    Policy("token_overrun", 100000, ("reduce_max_tokens", "enable_aggressive_caching", "emit_telemetry"),
           cooldown_sec=600),
]

DECISION_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), T.StructField("anomaly_type", T.StringType()),
    T.StructField("metric_value", T.DoubleType()), T.StructField("model", T.StringType()),
    T.StructField("handled", T.BooleanType()), T.StructField("skipped", T.BooleanType()),
    T.StructField("reason", T.StringType()), T.StructField("actions", T.StringType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("cooldown_sec", T.IntegerType()),
    T.StructField("cooldown_until", T.TimestampNTZType())])
STATE_SCHEMA = T.StructType([T.StructField("cooldown_until_us", T.LongType())])


def _decide(rows: pd.DataFrame, policies: dict, cooldown_us: int | None):
    """Fold one anomaly type's alerts (sorted by ts) from a cooldown state; returns (decisions, state)."""
    out = []
    for ts, typ, val, model in zip(rows["ts"], rows["anomaly_type"], rows["metric_value"], rows["model"]):
        pol = policies.get(typ)
        t_us = pd.Timestamp(ts).value // 1000
        base = {"ts": ts, "anomaly_type": typ, "metric_value": float(val) if val is not None else None, "model": model,
                "handled": False, "skipped": False, "reason": None, "actions": None, "threshold": None,
                "cooldown_sec": None, "cooldown_until": None}
        if pol is None:
            base["reason"] = f"unknown anomaly_type: {typ}"
        elif val is None or float(val) < pol.trigger_threshold:
            base.update(reason=f"value {val} < threshold {pol.trigger_threshold}", threshold=float(pol.trigger_threshold))
        elif cooldown_us is not None and t_us < cooldown_us:
            base.update(handled=True, skipped=True, threshold=float(pol.trigger_threshold),
                        reason=f"cooldown active ({(cooldown_us - t_us) // 1_000_000}s remaining)")
        else:
            cooldown_us = t_us + pol.cooldown_sec * 1_000_000
            base.update(handled=True, actions=",".join(pol.actions), threshold=float(pol.trigger_threshold),
                        cooldown_sec=int(pol.cooldown_sec),
                        cooldown_until=pd.Timestamp(cooldown_us * 1000).to_pydatetime())
        out.append(base)
    return pd.DataFrame(out, columns=[f.name for f in DECISION_SCHEMA.fields]), cooldown_us


def _prepare(alerts: DataFrame, ts: str) -> DataFrame:
    return alerts.select(F.col(ts).cast("timestamp_ntz").alias("ts"), F.col("anomaly_type").cast("string"),
                         F.col("metric_value").cast("double"), F.col("model").cast("string"))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def remediate(alerts: DataFrame, policies=None, ts: str = "ts") -> DataFrame:
    """T05 batch twin: per alert, unknown type / below threshold / cooldown skip / handled with actions.
    Alerts: (ts, anomaly_type, metric_value, model).

    Which alerts run their actions is found by ``cooldown.fired`` over the distinct times of each type, so a type
    with all alerts is spread over all tasks. Alerts of one type and time are ordered by model, then value, and the first
    one runs; the others are skipped. Without a cooldown every alert runs. An alert without a time is never handled."""
    policies = list(policies or DEFAULT_POLICIES)
    types = [T.StructField("anomaly_type", T.StringType()), T.StructField("threshold", T.DoubleType()), T.StructField("limit", T.StringType()),
             T.StructField("seconds", T.IntegerType()), T.StructField("steps", T.StringType())]
    table = alerts.sparkSession.createDataFrame(
        [(p.anomaly_type, float(p.trigger_threshold), str(p.trigger_threshold), int(p.cooldown_sec), ",".join(p.actions)) for p in policies],
        T.StructType(types))
    prepared = _prepare(alerts, ts).join(F.broadcast(table), "anomaly_type", "left")
    numbered = checkpoint(prepared.withColumn("t", _micros("ts")).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("ts").isNotNull() & (F.col("metric_value") >= F.col("threshold"))
    order = F.struct(F.col("model").isNotNull().alias("named"), "model", "metric_value", "row")
    times = (numbered.filter(able & (F.col("seconds") > 0)).groupBy("anomaly_type", "t")
             .agg((F.first("seconds").cast("long") * 1_000_000).alias("cooldown"), F.min(order).alias("lead")))
    times = checkpoint(times)
    marks = cooldown.fired(times, "anomaly_type").join(times.select("anomaly_type", "t", "lead"), ["anomaly_type", "t"])
    marks = marks.select(F.col("anomaly_type").alias("_type"), F.col("t").alias("_t"), F.when(F.col("fires"), F.col("lead.row")).alias("runs"), "last")
    judged = numbered.join(marks, (F.col("anomaly_type") == F.col("_type")) & (F.col("t") == F.col("_t")), "left")
    handled = able & F.col("threshold").isNotNull()
    runs = handled & ((F.col("seconds") <= 0) | F.coalesce(F.col("runs") == F.col("row"), F.lit(False)))
    until = F.col("last") + F.col("seconds").cast("long") * 1_000_000
    value = F.coalesce(F.col("metric_value").cast("string"), F.lit("None"))
    reason = (F.when(F.col("threshold").isNull(), F.concat(F.lit("unknown anomaly_type: "), F.coalesce("anomaly_type", F.lit("None"))))
              .when(F.col("metric_value").isNull() | (F.col("metric_value") < F.col("threshold")),
                    F.concat(F.lit("value "), value, F.lit(" < threshold "), F.col("limit")))
              .when(F.col("ts").isNull(), F.lit("no time"))
              .when(~runs, F.concat(F.lit("cooldown active ("), F.floor((until - F.col("t")) / 1_000_000).cast("string"), F.lit("s remaining)"))))
    state = judged.select("*", F.coalesce(handled, F.lit(False)).alias("handled"), F.coalesce(runs, F.lit(False)).alias("run"), reason.alias("reason"))
    return state.select(
        "ts", "anomaly_type", "metric_value", "model", "handled", (F.col("handled") & ~F.col("run")).alias("skipped"), "reason",
        F.when(F.col("run"), F.col("steps")).alias("actions"), "threshold", F.when(F.col("run"), F.col("seconds")).alias("cooldown_sec"),
        F.when(F.col("run"), F.timestamp_micros(F.col("t") + F.col("seconds").cast("long") * 1_000_000).cast("timestamp_ntz")).alias("cooldown_until"))


def remediate_stream(alerts: DataFrame, policies=None, ts: str = "ts") -> DataFrame:
    """T05 streaming: keyed state per anomaly type (cooldown end), ``applyInPandasWithState``.
    Within a micro-batch alerts are ordered by ts before folding."""
    pol = {p.anomaly_type: p for p in (policies or DEFAULT_POLICIES)}

    def fn(key, pdfs, state):
        cooldown = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(
            ["ts", "model", "metric_value"], kind="stable", na_position="first")
        dec, cooldown = _decide(rows, pol, cooldown)
        state.update((cooldown,))
        yield dec

    return _prepare(alerts, ts).groupBy("anomaly_type").applyInPandasWithState(
        fn, DECISION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


SUPPRESS_SCHEMA_STATE = T.StructType([T.StructField("last_emit_us", T.LongType())])


def _suppress_fold(rows: pd.DataFrame, seconds: int, last_us: int | None):
    keep = []
    for ts in rows["ts"]:
        t_us = pd.Timestamp(ts).value // 1000
        if last_us is None or t_us >= last_us + seconds * 1_000_000:
            keep.append(True)
            last_us = t_us
        else:
            keep.append(False)
    return rows.assign(emitted=keep), last_us


def suppress(alerts: DataFrame, key: str = "anomaly_type", seconds: int = 600, ts: str = "ts") -> DataFrame:
    """T04 batch twin: an alert is emitted only if no alert of the same key was emitted in the
    preceding ``seconds``; adds ``emitted``.

    Found by ``cooldown.fired`` over the distinct times of each key; a null key is a key. Alerts of one key and time are ordered by
    the remaining columns, nulls first, and only the first can be emitted (all, if ``seconds`` is 0). An alert without a time is not emitted."""
    others = [c for c in alerts.columns if c not in (key, ts)]
    numbered = checkpoint(alerts.select(
        F.col(key).alias("_key"), F.col(key), *others, F.col(ts).cast("timestamp_ntz").alias("ts"), F.monotonically_increasing_id().alias("_row"))
        .withColumn("_t", _micros("ts")))
    if seconds <= 0:
        return numbered.select(*[c for c in alerts.columns if c != ts], "ts", F.col("ts").isNotNull().alias("emitted"))
    times = checkpoint(numbered.filter("_t is not null").groupBy("_key", F.col("_t").alias("t"))
                          .agg(F.min(F.struct(*others, "_row")).getField("_row").alias("lead")).withColumn("cooldown", F.lit(seconds * 1_000_000)))
    marks = cooldown.fired(times, "_key").filter("fires").select(F.col("_key").alias("_of"), F.col("t").alias("_at"))
    leads = times.join(marks, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("t") == F.col("_at"))).select(F.col("lead").alias("_lead"))
    return (numbered.join(leads.withColumn("emitted", F.lit(True)), F.col("_row") == F.col("_lead"), "left")
            .select(*[c for c in alerts.columns if c != ts], "ts", F.coalesce("emitted", F.lit(False)).alias("emitted")))


def suppress_stream(alerts: DataFrame, key: str = "anomaly_type", seconds: int = 600, ts: str = "ts") -> DataFrame:
    """T04 streaming: keyed state = time of the last emitted alert; suppressed rows are dropped."""
    prepared = alerts.withColumn("ts", F.col(ts).cast("timestamp_ntz"))
    schema = prepared.schema

    def fn(k, pdfs, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values("ts", kind="stable")
        res, last = _suppress_fold(rows, seconds, last)
        if last is not None:
            state.update((last,))
        yield res[res["emitted"]].drop(columns=["emitted"])

    return prepared.groupBy(key).applyInPandasWithState(fn, schema, SUPPRESS_SCHEMA_STATE, "append",
                                                        GroupStateTimeout.NoTimeout)


def weight_timeline(decisions: DataFrame, base=(0.3, 0.5, 0.2), policies=None) -> DataFrame:
    """Router weights after every applied remediation and every restore: ts, cause, cost_weight, quality_weight, speed_weight.

    A cost spike shifts weight from quality to cost and is followed, after its cooldown, by a restore of the weights that held before the
    first cost spike; a latency spike adds 0.2 to speed, up to 0.6; a high error rate moves 0.1 from cost (down to 0.1) to quality (up
    to 0.7). Between restores each weight is a sum of steps reflected at its limit, and such a sum is
    ``S + max(0, max(limit - S))`` over the running sums S, so running sums and running maxima give the whole line. Restores come
    before alerts of the same time. The cooldowns bound the rows: a type is applied once per cooldown at most."""
    steps = {}
    for p in policies or DEFAULT_POLICIES:
        if p.anomaly_type == "cost_spike" and p.fallback_model:
            steps[p.anomaly_type] = (p.cost_weight_boost, -p.quality_weight_cut, 0.0, p.cooldown_sec)
        elif p.anomaly_type == "latency_spike":
            steps[p.anomaly_type] = (0.0, 0.0, 0.2, None)
        elif p.anomaly_type == "error_rate_high" and p.fallback_model:
            steps[p.anomaly_type] = (-0.1, 0.1, 0.0, None)
    table = decisions.sparkSession.createDataFrame([(k, *v) for k, v in steps.items()], "cause string, cost double, quality double, speed double, after int")
    alerts = (decisions.filter(F.col("handled") & ~F.col("skipped")).select("ts", F.col("anomaly_type").alias("cause")).join(F.broadcast(table), "cause")
              .withColumn("kind", F.lit(1)))
    back = alerts.filter("after is not null").select(
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("after"))).alias("ts"), F.lit("restore").alias("cause"),
        *[F.lit(0.0).alias(c) for c in ("cost", "quality", "speed")], F.lit(0).alias("kind"))
    line = alerts.drop("after").unionByName(back)
    order = [F.asc("ts"), F.asc("kind"), F.asc("cause")]
    upto = Window.orderBy(*order)  # few rows, see above
    line = (line.withColumn("part", F.sum(1 - F.col("kind")).over(upto))
            .withColumn("spikes", F.sum((F.col("cause") == "cost_spike").cast("int")).over(upto)))
    within = Window.partitionBy("part").orderBy(*order)
    names = ("cost", "quality", "speed")
    limits = {"cost": (0.1, 1), "quality": (0.7, -1), "speed": (0.6, -1)}  # fixed values: limit, and whether it is a lower (1) or an upper one (-1)
    line = line.select("*", *[F.sum(n).over(within).alias(f"{n}_sum") for n in names])

    def weights(rows: DataFrame, start: dict) -> DataFrame:
        out = []
        for n in names:
            limit, sign = limits[n]
            over = F.max(sign * (F.lit(limit) - start[n] - F.col(f"{n}_sum"))).over(within)
            out.append((start[n] + F.col(f"{n}_sum") + sign * F.greatest(F.lit(0.0), over)).alias(f"{n}_weight"))
        return rows.select("ts", "kind", "cause", "part", "spikes", *out)

    first = {n: F.lit(float(b)) for n, b in zip(names, base)}
    before = weights(line, first).filter("spikes = 0 and part = 0").agg(
        F.max(F.struct("ts", "kind", "cause", *[f"{n}_weight" for n in names])).alias("saved"))
    later = {n: F.when(F.col("part") == 0, first[n]).otherwise(F.coalesce(F.col(f"saved.{n}_weight"), first[n])) for n in names}
    return (weights(line.crossJoin(before), later)
            .select("ts", "cause", *[F.round(f"{n}_weight", 6).alias(f"{n}_weight") for n in names]))
