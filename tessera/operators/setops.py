"""Set operations and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """Append rows of frames with different schemas (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def drop_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Exact-duplicate removal (over ``cols`` when given)."""
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()


def difference(df: DataFrame, other: DataFrame, keys: list[str] | None = None, multiset: bool = False) -> DataFrame:
    """Rows of ``df`` not in ``other``: by keys (anti join), by whole row (EXCEPT DISTINCT), or
    as a multiset (EXCEPT ALL)."""
    if keys:
        return df.join(other.select(*keys).distinct(), keys, "left_anti")
    return df.exceptAll(other) if multiset else df.subtract(other)


def top_k(df: DataFrame, k: int, order: list, by: list[str] | None = None, rank_col: str | None = None) -> DataFrame:
    """Top ``k`` rows by ``order`` (include a unique tie-break), overall or per ``by`` group.

    Per group Spark plans a WindowGroupLimit on both sides of the shuffle, so each task forwards at
    most k rows per group; overall it is TakeOrderedAndProject."""
    if not by:
        out = df.orderBy(*order).limit(k)
        return out
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return out.withColumnRenamed("_rk", rank_col) if rank_col else out.drop("_rk")
