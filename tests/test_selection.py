"""Radix selection against sorting: awkward doubles, null groups, one group with all rows, bounded counts."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import selection as S

ODD = [0.0, -0.0, 1.0, -1.0, 1.5, 2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3), 3.0, 0.1, 1e308, 1.7976931348623157e308, -1e308, 5e-324, -5e-324,
       2.2250738585072014e-308, 1e-310, float("inf"), float("-inf"), 1024.0, math.nextafter(1024.0, 0), 2.0 ** 52, 2.0 ** 53 + 2, 1e-300, -7.25, 123456.789]


def _unsigned(v):
    b = struct.unpack("<Q", struct.pack("<d", v + 0.0))[0]
    return b ^ ((1 << 64) - 1) if b >> 63 else b | 1 << 63


def test_bits_are_those_of_the_doubles(spark):
    rng = np.random.default_rng(1)
    values = ODD + [float(x) for x in rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)] + [2.0 ** k for k in range(-1074, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", S.ordered_bits(F.col("v")).alias("b"), S.double_of(S.ordered_bits(F.col("v"))).alias("back")).collect():
        assert r["b"] % (1 << 64) == _unsigned(0.0 if r["v"] == 0 else r["v"]) and r["back"] == r["v"]
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(S.ordered_bits(F.col("v")).alias("b"), S.double_of(S.ordered_bits(F.col("v"))).alias("back")).first()
    assert nan["b"] % (1 << 64) > _unsigned(float("inf")) and math.isnan(nan["back"])


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None], [None]])
def test_ranks_by_sorting(spark, groups):
    rnd = random.Random(len(groups))
    rows = [(rnd.choice(groups), rnd.choice([rnd.gauss(0, 100), float(round(rnd.gauss(0, 3))), rnd.choice(ODD)])) for _ in range(900)] + [(groups[0], None)] * 20
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = S.selected(df, ["g"], "v", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95),
                                      "high": lambda n: n - 1, "none": lambda n: n + 5}).collect()
    expected = {}
    for g in groups:
        v = sorted(x for h, x in rows if h == g and x is not None)
        expected[g] = (len(v), v[0], v[len(v) // 2], v[int(len(v) * 0.95)], v[-1], None)
    assert {r["g"]: tuple(r)[1:] for r in got} == expected


def test_quantiles_like_percentile(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.randrange(4), rnd.randrange(3), rnd.choice([rnd.random(), 0.5, None])) for _ in range(500)], "a int, b int, v double")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in S.quantiles(df, ["a", "b"], "v", {"q1": 0.25, "m": 0.5, "p": 0.95}).collect()}
    for r in df.groupBy("a", "b").agg(F.percentile("v", [0.25, 0.5, 0.95]).alias("q")).collect():
        assert got[r["a"], r["b"]] == pytest.approx(tuple(r["q"]), rel=1e-12)
    assert S.quantiles(df.limit(0), ["a"], "v", {"m": 0.5}).count() == 0
    assert S.quantiles(df.filter("v is null"), [], "v", {"m": 0.5}).count() in (0, 1)


def test_one_group_is_counted_by_many_tasks(spark):
    """A model that holds every row: each pass aggregates partially before its shuffle, and no operator sorts or gathers the rows of a group."""
    df = spark.range(0, 20000, 1, 8).select(F.lit("m").alias("g"), (F.col("id") * 37 % 20011).cast("double").alias("v"))
    out = S.selected(df, ["g"], "v", {"p95": lambda n: F.floor(n * 0.95)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("partial_count") >= S.PASSES
    values = sorted(k * 37 % 20011 for k in range(20000))
    assert out.first()["p95"] == values[19000]


def test_passes_read_bits_that_are_computed_once(spark):
    """the arithmetic of the bits stands in no pass, so its cost does not come back with every key and digit that uses them."""
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5), ("b", None), (None, 4.0)], "g string, v double")
    out = S.quantiles(df, ["g"], "v", {"m": 0.5})
    assert {(r["g"], r["m"]) for r in out.collect()} == {("a", 2.0), (None, 4.0)}
    assert "LOG2" not in out._jdf.queryExecution().optimizedPlan().toString().upper()
