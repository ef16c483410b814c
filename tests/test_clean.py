"""Cleaning helpers."""

from pyspark.sql import functions as F

from tessera.operators import clean
from tessera.operators.clean import _title


def test_title_case_capitalises_each_letter_run(spark):
    df = spark.createDataFrame([("  home-garden ",), ("3d print",), ("TOYS",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(_title(F.col("c"))).collect()] == ["Home-Garden", "3D Print", "Toys", None, ""]


def test_duplicates_dropped_after_rows_are_dealt(spark, monkeypatch):
    """As many partitions as rows ask for, one exchange, and no comparison before it."""
    monkeypatch.setattr(clean, "TASK_ROWS", 10, raising=False)
    df = spark.createDataFrame([(k % 300, "x", None if k % 3 else 0.0 * (-1) ** k) for k in range(900)], "order_id long, category string, unit_price double")
    got = clean.distinct_rows(df)
    assert got.rdd.getNumPartitions() == 90
    assert sorted((r[0], r[1], r[2]) for r in got.collect() if r[2] is not None) == [(k, "x", 0.0) for k in range(0, 300, 3)]
    assert got.count() == 300
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange")


def test_quality_summary_takes_columns_one_by_one(spark):
    """F8: exact counts of distinct values without a row per column and row; nulls, NaN, signed zeros and copies."""
    from tessera.operators.reports import quality_summary
    rows = [(1, 0.0, "a"), (1, -0.0, None), (2, float("nan"), "b"), (None, float("nan"), "b"), (2, None, "a"), (3, 1.5, "a")]
    got = quality_summary(spark.createDataFrame(rows, "k long, x double, t string"))
    assert "Expand" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [("k", "bigint", 16.67, 3), ("x", "double", 16.67, 3), ("t", "string", 16.67, 2)]
    empty = quality_summary(spark.createDataFrame([], "k long"))
    assert [tuple(r) for r in empty.collect()] == [("k", "bigint", None, 0)]


def test_rows_are_computed_once_before_they_are_compared(spark):
    """F8: the count of the rows comes from a copy, not from the joins behind them once more."""
    from tessera.operators.clean import distinct_rows
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    rows = [(k % 7, f"t{k % 3}") for k in range(60)] + [(None, None)] * 3
    got = distinct_rows(spark.createDataFrame(rows, "k long, t string").repartition(3).filter(seen("t"))).collect()
    assert read.value == len(rows) and sorted(map(str, got)) == sorted({str(r) for r in got}) and {tuple(r) for r in got} == set(rows)
