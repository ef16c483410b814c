"""Streaming ingest, windowed time charts and alerts, dedupe, DLP feed, outbox dispatch and
progress metrics (T01-T03, T07-T10).

Every streaming operator has a batch twin with the same semantics (a plain DataFrame in, same
columns out), which is what the SQL oracle checks; tests compare stream and batch results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import truthy
from tessera.sources import telemetry as tel


def telemetry_stream(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream of telemetry events with an explicit schema (Kafka sources carry the
    same JSON in ``value``; parse it with ``from_json(value, TELEMETRY_SCHEMA)``)."""
    r = spark.readStream.schema(schema or tel.TELEMETRY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(path)


def start_sink(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "2 seconds", fmt: str = "parquet",
               partition_by: list[str] | None = None, output_mode: str = "append", query_name: str | None = None):
    """Append to files with a checkpoint (exactly-once file sink). ``trigger``: a processing-time
    interval, or ``None`` for availableNow (drain what is there, then stop)."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(output_mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()


def event_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast in the session time zone (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_timechart(df: DataFrame, span: str = "5 minutes", delay: str = "10 minutes", by: str | None = None,
                     aggs: dict | None = None, ts: str = "timestamp") -> DataFrame:
    """Tumbling-window aggregates with a watermark (append mode emits each window once, after
    the watermark passes its end). Batch twin: the same expression on a static frame."""
    aggs = aggs or {"cost": F.sum("cost_usd"), "avg_latency": F.avg("latency_ms"), "calls": F.count(F.lit(1))}
    d = event_time(df, ts)
    if d.isStreaming:
        d = d.withWatermark(ts, delay)
    keys = [F.window(ts, span).alias("w")] + ([F.col(by)] if by else [])
    out = d.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *([by] if by else []), *aggs.keys())


def stream_alerts(df: DataFrame, window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes",
                  error_threshold: float = 0.15, dlp_threshold: int = 10, ts: str = "timestamp") -> DataFrame:
    """Per window, error rate per model (> threshold -> error_rate_high) and DLP violations
    (>= threshold -> dlp_burst), as alert rows (ts = window end, anomaly_type, metric_value, model)."""
    d = event_time(df, ts)
    if d.isStreaming:
        d = d.withWatermark(ts, delay)
    win = F.window(ts, window, slide) if slide else F.window(ts, window)
    et = F.col("event_type")
    llm = d.filter(et == tel.LLM_CALL).groupBy(win.alias("w"), "model").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.lower(F.col("success").cast("string")) == "false", 1).otherwise(0)).alias("errors"))
    rate = F.round(F.col("errors") / F.col("total"), 4)
    err = llm.filter(rate > error_threshold).select(
        F.col("w.end").cast("timestamp_ntz").alias("ts"), F.lit("error_rate_high").alias("anomaly_type"),
        rate.cast("double").alias("metric_value"), "model")
    dlp = d.filter(et == tel.DLP_VIOLATION).groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("violations"))
    burst = dlp.filter(F.col("violations") >= dlp_threshold).select(
        F.col("w.end").cast("timestamp_ntz").alias("ts"), F.lit("dlp_burst").alias("anomaly_type"),
        F.col("violations").cast("double").alias("metric_value"), F.lit(None).cast("string").alias("model"))
    return err.unionByName(burst)


def dedupe_events(df: DataFrame, id_col: str = "event_id", delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Drop repeated event ids; on a stream, state is kept only within the watermark delay."""
    if df.isStreaming:
        return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])
    return df.dropDuplicates([id_col])


def stream_dlp(df: DataFrame, rules=None, **cols) -> DataFrame:
    """Stateless DLP scan + risk scoring per record (D01 + D11), usable on a stream."""
    from tessera.operators.protect import dlp_scan, score_violations
    return score_violations(dlp_scan(df, rules, **cols))


def ingest_metrics(query) -> DataFrame:
    """Per micro-batch counters from ``StreamingQuery.recentProgress``."""
    spark = SparkSession.getActiveSession()
    rows = [(int(p.get("batchId", -1)), int(p.get("numInputRows", 0)), float(p.get("inputRowsPerSecond") or 0.0),
             float(p.get("processedRowsPerSecond") or 0.0), str(p.get("timestamp")))
            for p in (query.recentProgress or [])]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, input_rows_per_second double, "
                                       "processed_rows_per_second double, timestamp string")


# --- outbox dispatch ------------------------------------------------------------------------------
DEFAULT_ROUTES = [("as.opened", "as"), ("delivery.done", "order"), ("as.resolved", "as")]


def dispatch_batch(activities: DataFrame, processed: DataFrame | None, handlers: dict):
    """T07 batch twin: undispatched activities (anti join on processed ids), routed to the handler
    of their (type, subject_type); returns ({route: handler output}, newly processed ids).
    Handlers are ``DataFrame -> DataFrame`` functions; a route without handler output still marks
    its activities processed."""
    todo = activities if processed is None else activities.join(processed.select("id"), "id", "left_anti")
    outputs = {}
    for (typ, subject), fn in handlers.items():
        sel = todo.filter((F.col("type") == typ) & (F.col("subject_type") == subject))
        outputs[(typ, subject)] = fn(sel)
    return outputs, todo.select("id", F.lit(True).alias("dispatched"))


def _written(out: DataFrame, path: str) -> None:
    out.write.mode("overwrite").parquet(path)


def _isolated(events: DataFrame, handler, path: str, attempts: int, part: tuple[int, int] = (1, 0)) -> list[tuple[DataFrame, str]]:
    """Run a route's handler and write its output under ``path``, one folder per part that succeeds.

    When a part fails, it is split in halves by the hash of the ids and each half runs by itself, so that after a logarithmic number
    of steps only the failing events are left; each is tried ``attempts`` times. Returns them with their errors."""
    size, number = part
    own = events.filter(F.pmod(F.xxhash64("id"), F.lit(size)) == number)
    few = own.limit(2).count()
    if not few:
        return []
    error = ""
    for _ in range(attempts if few == 1 else 1):
        try:
            _written(handler(own), f"{path}/part={size}-{number}")
            return []
        except Exception as exc:  # whatever a handler raises concerns its events only
            error = str(exc)[:500]
    if few == 1 or size >= 1 << 40:  # equal ids can't be told apart
        return [(own, error)]
    return [bad for half in (number, number + size) for bad in _isolated(events, handler, path, attempts, (2 * size, half))]


def dispatch_stream(activities: DataFrame, handlers: dict, processed_path: str, output_root: str,
                    dead_letter_path: str, checkpoint: str, trigger: str | None = None, ts: str | None = None,
                    late: str = "1 day", attempts: int = 2):
    """Outbox worker over a stream of activities (id, type, subject_type, ...).

    Once: repeated ids are dropped by keyed state, with ``ts`` only for as long as repeats can be ``late``, so no log of processed
    ids is read again. Every output of a micro-batch goes to folders named by its epoch and replaces what an interrupted run of the same
    epoch left there, so a restart at any point, also between outputs and ids, repeats the epoch without doubling it.
    Isolated: handlers are called and run per route; where one raises, only the events that fail by themselves go to
    ``dead_letter_path`` with the error, after ``attempts`` tries, and all others are handled (see ``redeliver``).

    Layout: ``output_root/<type>__<subject>/epoch=N/part=...``, ``processed_path/epoch=N``, ``dead_letter_path/epoch=N/route=...``."""
    once = (activities.dropDuplicates(["id"]) if ts is None
            else activities.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"]))

    def process(batch: DataFrame, epoch_id: int):
        batch = batch.persist()
        try:
            for (typ, subject), handler in handlers.items():
                route = f"{typ}__{subject}"
                own = batch.filter((F.col("type") == typ) & (F.col("subject_type") == subject))
                for k, (bad, error) in enumerate(_isolated(own, handler, f"{output_root}/{route}/epoch={epoch_id}", attempts)):
                    _written(bad.withColumn("error", F.lit(error)), f"{dead_letter_path}/epoch={epoch_id}/route={route}/n={k}")
            _written(batch.select("id"), f"{processed_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    w = once.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()


def redeliver(dead_letters: DataFrame, handlers: dict, output_root: str, dead_letter_path: str, run: str, attempts: int = 1) -> None:
    """Hand dead letters (activities with ``error``) to their handlers again, later: outputs and what fails again are named by ``run``."""
    for (typ, subject), handler in handlers.items():
        route = f"{typ}__{subject}"
        own = dead_letters.filter((F.col("type") == typ) & (F.col("subject_type") == subject)).drop("error", "epoch", "route", "n")
        for k, (bad, error) in enumerate(_isolated(own, handler, f"{output_root}/{route}/epoch={run}", attempts)):
            _written(bad.withColumn("error", F.lit(error)), f"{dead_letter_path}/epoch={run}/route={route}/n={k}")
