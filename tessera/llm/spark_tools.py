"""Helpers on the Spark side: reliable checkpoints, partition counts, a membership bitmap of fixed size."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership bitmap: 4 MB whatever the data.
BITMAP_BITS = 1 << 25
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark removes the shuffle files of a finished execution; a later use of its plan computes them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the session leaves the rows of an Arrow batch at Spark's default, they are lowered, since rows are whole texts.
    Shuffle files of finished executions go at once, since every execution of these operators ends in a copy or on the driver.
    """
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    spark.conf.set(CLEAN_UP, "true")
    if spark.sparkContext.getCheckpointDir() is None:
        from tessera.session import checkpoint_dir
        checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


#: Rows of a file of a small table's copy.
FILE_ROWS = 200_000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives executors.

    Where the number of rows is known, a small table takes few files instead of one per shuffle partition, since every file starts a
    process on file systems without native code.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(4 + rows // FILE_ROWS)).checkpoint(eager=True)


def new_folder(df: DataFrame, name: str) -> str:
    """A folder of its own in the shared one, as a URI."""
    root = shared_dir(df.sparkSession)
    return f"{root if '://' in root else 'file://' + root.removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


#: Bytes that a task holds before it writes a part of a file of a compressed copy.
GROUP_BYTES = 1 << 24


def packed_copy(df: DataFrame, name: str) -> DataFrame:
    """A compressed copy in the shared folder, which stays there."""
    folder = new_folder(df, name)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(df: DataFrame, column: str, size: int = BITMAP_BITS) -> Broadcast:
    """Bitmap of the long ids in ``column``, of ``size`` bits (a power of two) whatever the size of ``df``.

    It only skips work early: ids not in it are certainly absent, ids in it are decided by a join. The driver gets
    at most ``size / 32`` words, merged on the executors.
    """
    words = (df.select(F.col(column).cast("long").alias("id")).dropna()
             .selectExpr(f"cast(shiftright(id & {size - 1}L, 5) as int) as word", "shiftleft(1L, cast(id & 31L as int)) as bits")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")))
    table = words.toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id (int64), whether its bit is set."""
    bit = ids & np.int64(32 * len(words) - 1)
    return (words[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0


def numbered(docs: DataFrame, column: str = "_row") -> DataFrame:
    """Add a number of its own to each row, in a copy, since the partitions of a table read from files may change between executions.

    The rows are whole texts, so the copy is compressed, unless they have a type that Parquet doesn't know.
    """
    rows = docs.withColumn(column, F.monotonically_increasing_id())
    return checkpoint(rows) if re.search("void|interval", rows.schema.simpleString()) else packed_copy(rows, "rows")


def parted(docs: DataFrame, ids: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose long id is certainly not in ``ids`` (one column), which stay where they are, and the others."""
    words = bitmap(ids, ids.columns[0])

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(words.value, ids.to_numpy().astype(np.int64)))

    asked = docs.withColumn("_maybe", maybe(F.col(id)))
    return asked.filter(~F.col("_maybe")).drop("_maybe"), asked.filter("_maybe").drop("_maybe")


def without(docs: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """Rows of ``docs`` whose number is not in ``gone`` (one column of distinct numbers)."""
    clear, asked = parted(docs, gone, id)
    return clear.unionByName(asked.join(gone.toDF("_gone"), asked[id] == F.col("_gone"), "left_anti"))
