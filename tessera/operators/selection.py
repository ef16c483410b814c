"""Exact order statistics per group by radix selection: no sort, no buffer of values, no task per group.

A double's 64 bits, taken so that their unsigned order is the order of the doubles, are read 16 at a time from the top. Each of
four passes counts, with partial aggregation, how many values of a group fall under each next digit of the prefixes still
wanted; the digit that holds the wanted rank extends the prefix. So a pass shuffles at most 65,536 counts per group, wanted
prefix and task, however many rows one group has, and after the last one the prefix is the value.

Nulls take no part; NaN is greater than all other values; -0.0 counts as 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import packed_copy

DIGIT = 16
PASSES = 4
ONE = 1 << 52
LOWEST = float.fromhex("0x1p-1022")
HALF = float.fromhex("0x1p537")
#: Unsigned order of signed longs: all bits of negatives are inverted, the sign bit of the others is set.
SIGN = -(1 << 63)
NAN_BITS = 0x7FF8 << 48
INF_BITS = 0x7FF0 << 48


def ordered_bits(value: Column) -> Column:
    """Long whose unsigned order is the order of the doubles, by exact arithmetic: exponent and mantissa of IEEE 754."""
    size = F.abs(value)
    near = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    mantissa = ((size / power(exponent) - 1.0) * float(ONE)).cast("long")
    bits = (F.when(F.isnan(value), F.lit(NAN_BITS)).when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(INF_BITS))
            .when(size < LOWEST, (size * HALF * HALF).cast("long")).otherwise((exponent + 1023).cast("long") * F.lit(ONE) + mantissa))
    return F.when((value < 0) & ~F.isnan(value), F.bitwise_not(bits).bitwiseAND(F.lit(~SIGN))).otherwise(bits.bitwiseOR(F.lit(SIGN)))


def double_of(bits: Column) -> Column:
    """The double whose ordered bits these are."""
    negative = bits >= 0  # the sign bit is clear
    raw = F.when(negative, F.bitwise_not(bits)).otherwise(bits).bitwiseAND(F.lit(~SIGN))
    exponent = F.shiftrightunsigned(raw, 52)
    part = raw.bitwiseAND(F.lit(ONE - 1)).cast("double")
    size = (F.when(raw >= NAN_BITS, F.lit(float("nan"))).when(raw == INF_BITS, F.lit(float("inf")))
            .when(exponent == 0, part / HALF / HALF).otherwise((1.0 + part / float(ONE)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))))
    return F.when(negative, -size).otherwise(size)


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def selected(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group with a value: ``by``, n (values), and for each name of ``ranks`` the value of that 0-based rank, which is a function of n."""
    groups = [f"_g{i}" for i in range(len(by))]
    # kept, as each pass reads them: Catalyst would put the whole arithmetic of the bits into every key, filter and digit that uses them
    keys = packed_copy(df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups)],
                                                                  ordered_bits(F.col(value).cast("double")).alias("_bits")))
    within = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    state = None
    for turn in range(PASSES):
        shift = 64 - DIGIT * (turn + 1)
        digit = F.shiftrightunsigned("_bits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("_digit")
        if turn == 0:  # the counts of the first digits also give the size of a group
            counts = keys.groupBy(*groups, digit).agg(F.count(F.lit(1)).alias("_c"))
            every, upto = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("_digit")  # at most 2 ** DIGIT counts
            counts = counts.withColumn("_n", F.sum("_c").over(every)).withColumn("_upto", F.sum("_c").over(upto))
            held = counts.withColumn("_w", F.explode(wanted)).withColumn("_rank", F.col("_w.rank")).withColumn("_name", F.col("_w.name")).withColumn(
                "_prefix", F.lit(0).cast("long"))
        else:
            above = F.shiftrightunsigned("_bits", shift + DIGIT)
            asked = state.select([F.col(c).alias(f"_o{c}") if c in groups else F.col(c) for c in state.columns])
            rows = keys.select(*groups, above.alias("_above"), digit).join(
                asked, _same(groups, [f"_o{g}" for g in groups]) & (F.col("_above") == F.col("_prefix")) if groups else F.col("_above") == F.col("_prefix"))
            counts = rows.groupBy(*groups, "_n", "_prefix", "_name", "_rank", "_digit").agg(F.count(F.lit(1)).alias("_c"))
            held = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*groups, "_name").orderBy("_digit")))
        state = held.filter(within).select(*groups, "_n", F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit")).alias("_prefix"), "_name",
                                           (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
    found = double_of(F.col("_prefix"))
    out = state.groupBy(*groups).agg(F.first("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, found)).alias(name) for name in ranks])
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, by)], "n", *ranks)


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float],
              also: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per group with a value: ``by``, the interpolated quantile for each name (as the exact ``percentile``) and the ranks of ``also``."""
    ranks = dict(also or {})
    for name, q in wanted.items():
        ranks[f"_{name}_lo"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"_{name}_hi"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    found = selected(df, by, value, ranks)

    def between(name, q):
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return found.select(*by, *[between(n, q) for n, q in wanted.items()], *(also or {}))


def indexed(q: float, least: int) -> Callable[[Column], Column]:
    """The rank int(n * q) of n sorted values, the last one below ``least`` values."""
    return lambda n: F.when(n >= least, F.floor(n * F.lit(q))).otherwise(n - 1)
