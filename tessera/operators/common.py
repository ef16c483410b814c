"""Building blocks shared by several operators."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder that ``spark.checkpoint.dir`` names, so that several uses see the same rows."""
    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark removes the shuffle files of an execution that began under this setting when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a task holds before it writes a part of a file of a compressed copy.
GROUP_BYTES = 1 << 24


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Executions planned in here leave no shuffle files: for copies and collected results, whose plans are not used again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def packed_copy(df: DataFrame) -> DataFrame:
    """A copy as compressed Parquet in the shared folder: several times smaller than a checkpoint, and later passes read only the columns
    they use. Rows of types that Parquet doesn't know are checkpointed."""
    if re.search("void|interval", df.schema.simpleString()):
        return checkpoint(df)
    from tessera.session import checkpoint_dir
    root = checkpoint_dir(df.sparkSession)
    folder = f"{root if '://' in root else 'file://' + root.removeprefix('file:')}/copy-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def keep_ts_type(df: DataFrame, ts: str, expr: Column) -> Column:
    """Cast a derived timestamp back to the type of ``df[ts]`` (TIMESTAMP or TIMESTAMP_NTZ)."""
    return expr.cast(df.schema[ts].dataType)


def floor_time(df: DataFrame, ts: str, seconds: int) -> Column:
    """Bucket start of a fixed-width, epoch-aligned bucket; keeps the input timestamp type."""
    secs = F.unix_seconds(F.col(ts).cast("timestamp"))
    return keep_ts_type(df, ts, F.timestamp_seconds(F.floor(secs / seconds) * seconds))


def with_one_row_if_empty(df: DataFrame, row: dict, schema: T.StructType | None = None) -> DataFrame:
    """Append ``row`` only when ``df`` is empty (lazy; no driver-side count)."""
    spark = df.sparkSession
    schema = schema or df.schema
    fallback = spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)
    present = df.limit(1).select(F.lit(1).alias("_present"))
    extra = fallback.join(present, how="left_anti", on=F.lit(True))
    return df.unionByName(extra)


def global_order_index(df: DataFrame, order_cols: list, out: str = "_idx",
                       num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in a total order over ``order_cols`` (include a unique key).

    A plain ``row_number()`` without ``partitionBy`` moves every row into one task. Here the rows
    are range-partitioned and sorted in parallel; each partition's offset is the prefix sum of
    the partition sizes (one row per partition, broadcast). The ranged frame is checkpointed to
    the shared checkpoint folder so sizes and positions come from one materialisation.
    """
    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + local).drop("_pid", "_mid", "_off"))


def running_total(df: DataFrame, partition_by: list[str], ts: str, tie: str, value, out: str,
                  chunk_seconds: int = 3600) -> DataFrame:
    """Running sum of ``value`` per partition in (ts, tie) order, rows frame.

    Skew-safe two-level prefix sum: rows are split into time chunks; a window runs inside each
    (partition, chunk) and adds the prefix of the earlier chunks' totals, which comes from a
    window over one row per chunk. No task ever holds a whole partition.
    """
    v = value if not isinstance(value, str) else F.col(value)
    chunk = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / chunk_seconds)
    base = df.withColumn("_chunk", chunk).withColumn("_v", v)
    totals = base.groupBy(*partition_by, "_chunk").agg(F.sum("_v").alias("_ct"))
    w_prev = Window.partitionBy(*partition_by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition_by, "_chunk", F.coalesce(F.sum("_ct").over(w_prev), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*partition_by, "_chunk").orderBy(F.col(ts), F.col(tie)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = base.withColumn("_in", F.sum("_v").over(w_in))
    return (inner.join(offsets, [*partition_by, "_chunk"])
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_chunk", "_v", "_in", "_off"))


def prefix_sums(df: DataFrame, order_cols: list, value_cols: list[str], suffix: str = "_cum",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` over a total order (include a unique key), without a
    single-task window: range partitions are summed in parallel and shifted by the prefix of the
    earlier partitions' totals (one row per partition)."""
    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    w_in = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.select("*", *[F.sum(c).over(w_in).alias(f"_in_{c}") for c in value_cols])
    tot = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w_p = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w_p), F.lit(0)).alias(f"_o_{c}") for c in value_cols])
    out = inner.join(F.broadcast(offs), "_pid")
    for c in value_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_in_{c}") + F.col(f"_o_{c}"))
    return out.drop("_pid", *[f"_in_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Rebalance input for CPU-heavy row-wise work (regex scans, tokenisers, Python kernels) when it
    arrives in fewer partitions than the cluster has cores, e.g. a few large files with one row group
    each. Large inputs already have more partitions than cores, so this is a no-op at scale."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # plans that cannot be inspected cheaply are left as they are
        return df
    return df.repartition(target) if n < target else df
