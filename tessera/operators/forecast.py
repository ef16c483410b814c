"""Weekly forecasting: seasonal naive, log-space ridge per series, conformal intervals, backtests
and hierarchical comparison (C09-C14).

A ridge fit needs only sums over its training weeks (counts, moments and products of the features and the target). These are
added up per series and segment of weeks between the fold origins, so the sums of every rolling-origin fold are prefixes
over the segments and all folds of all series come out of one aggregation; only the small normal equations are solved in Python,
a batch at a time. The seasonal-naive baseline and all metrics are plain joins and aggregations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround

WEEKS_PER_YEAR = 52.18


def holdout_split(df: DataFrame, series: list[str], horizon: int = 13, week: str = "week") -> DataFrame:
    """Flag the last ``horizon`` weeks of every series as test (``is_test``)."""
    w = Window.partitionBy(*series).orderBy(F.desc(week))
    return df.withColumn("is_test", F.row_number().over(w) <= horizon)


def seasonal_naive(df: DataFrame, series: list[str], horizon: int = 13, week: str = "week",
                   value: str = "weekly_sales") -> DataFrame:
    """Forecast of each holdout week = the value 52 weeks (364 days) earlier; beyond a year of holdout, as many
    times 52 weeks earlier as lead back to the history."""
    s = holdout_split(df, series, horizon, week)
    order = Window.partitionBy(*series).orderBy(week)
    test = s.filter("is_test").withColumn("_years", F.ceil(F.row_number().over(order) / 52).cast("int"))
    test = test.withColumn("_from", F.date_sub(F.col(week), F.col("_years") * 364))
    hist = s.filter(~F.col("is_test")).select(*series, F.col(week).alias("_from"), F.col(value).alias("forecast"))
    return test.join(hist, [*series, "_from"], "left").select(
        *series, week, F.lit("seasonal_naive").alias("model"), "forecast", F.col(value).alias("actual"), "is_holiday")


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _grid(df: DataFrame, series: list[str], horizon: int, holidays: list[str]) -> tuple[DataFrame, list[str]]:
    """Every week between a series' first and last, numbered t, with the features and the target y = ln(sales) (null without sales
    above zero), n_train and the names of the features."""
    keys = [f"_k{i}" for i in range(len(series))]
    base = df.select(*[F.col(c).alias(k) for c, k in zip(series, keys)], F.col("week").cast("date").alias("week"), F.col("weekly_sales").cast("double").alias("sales"),
                     F.col("is_holiday").alias("is_holiday"), "holiday_name", "has_promo")
    span = base.groupBy(*keys).agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    weeks = F.sequence("lo", "hi", F.expr("interval 7 days"))
    grid = span.select(*keys, (F.size(weeks) - horizon).alias("n_train"), F.posexplode(weeks).alias("t", "week"))
    own = base.select(*[F.col(k).alias(f"o{k}") for k in keys], F.col("week").alias("_week"), "sales", "is_holiday", "holiday_name", "has_promo")
    rows = grid.join(own, _same(keys, [f"o{k}" for k in keys]) & (F.col("week") == F.col("_week")), "left").drop("_week", *[f"o{k}" for k in keys])
    rows = rows.withColumn("y", F.when(F.col("sales") > 0, F.log("sales")))
    past = rows.select(*[F.col(k).alias(f"p{k}") for k in keys], (F.col("t") + 52).alias("_t"), F.col("y").alias("lag_52"))
    rows = rows.join(past, _same(keys, [f"p{k}" for k in keys]) & (F.col("t") == F.col("_t")), "left").drop("_t", *[f"p{k}" for k in keys])
    turn = F.weekofyear("week") * F.lit(2 * math.pi / WEEKS_PER_YEAR)
    named = {"sin1": F.sin(turn), "cos1": F.cos(turn), "sin2": F.sin(2 * turn), "cos2": F.cos(2 * turn)}
    named |= {f"hol_{i}": F.coalesce(F.col("holiday_name") == h, F.lit(False)).cast("double") for i, h in enumerate(holidays)}
    named |= {"promo": F.coalesce("has_promo", F.lit(False)).cast("double"), "trend": F.col("t").cast("double")}
    rows = rows.select(*keys, "week", "t", "n_train", "sales", F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"), "y", "lag_52",
                       *[c.alias(n) for n, c in named.items()])
    return rows, ["lag_52", *named]


def _solved(size: int, alpha: float):
    """Intercept and coefficients of a ridge on standardised features (population deviation, 1 where it is 0), from the upper
    triangle of the sums of products of (1, features, target); null with fewer than two rows."""
    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        upper = np.triu_indices(size)
        out = []
        for s in sums:
            m = np.zeros((size, size))
            m[upper] = s
            n = m[0, 0]
            if n < 2:
                out.append(None)
                continue
            mean = m[0, 1:] / n
            moments = (m + np.triu(m, 1).T)[1:, 1:]
            spread = moments - n * np.outer(mean, mean)
            width = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0) / n)
            width[np.diag(spread)[:-1] <= 1e-12 * np.diag(moments)[:-1]] = 1.0
            a = spread[:-1, :-1] / np.outer(width, width) + alpha * np.eye(size - 2)
            w = np.linalg.solve(a, spread[:-1, -1] / width) / width
            out.append([mean[-1] - w @ mean[:-1], *w])
        return pd.Series(out)

    return solve


def ridge_forecast(df: DataFrame, series: list[str], horizon: int = 13, holidays: list[str] | None = None,
                   alpha: float = 1.0, level: float | None = None, n_folds: int = 4, fold_weeks: int = 13) -> DataFrame:
    """Per series, direct log-space ridge on lag-52 / Fourier / holiday / promo / trend features
    for the last ``horizon`` weeks; with ``level`` a conformal interval from ``n_folds`` rolling-origin
    refits of ``fold_weeks`` weeks (residual quantiles in log space). Weeks lacking lag_52 or with
    non-positive sales are left out of training.

    Returns the series columns, week, model, forecast, actual, is_holiday, lo, hi and folds: how many folds the interval rests on (origins
    without a year of history before them and fits of fewer than two weeks give none). A forecast is null where no fit is possible,
    and lo and hi where no fold is; no series and no week is dropped."""
    rows, names = _grid(df, series, horizon, list(holidays or []))
    keys = [f"_k{i}" for i in range(len(series))]
    folds = n_folds if level is not None else 0
    # fold k ends k * fold_weeks before the holdout; fold 0 is the fit for the holdout itself
    segment = F.greatest(F.lit(0), F.least(F.lit(folds), F.floor((F.col("t") - F.col("n_train")) / F.lit(fold_weeks)) + folds + 1))
    fit_rows = rows.filter((F.col("t") < F.col("n_train")) & F.col("y").isNotNull() & F.col("lag_52").isNotNull())
    vector = [F.lit(1.0), *[F.col(n) for n in names], F.col("y")]
    sums = [F.sum(vector[i] * vector[j]).alias(f"s{i}_{j}") for i in range(len(vector)) for j in range(i, len(vector))]
    parts = fit_rows.groupBy(*keys, "n_train", segment.alias("segment")).agg(*sums)
    labels = [c for c in parts.columns if c.startswith("s") and "_" in c]
    # sums up to each segment, for series whose last segments have no rows as well
    every = rows.select(*keys, "n_train").distinct().withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    parts = every.join(parts.select(*[F.col(k).alias(f"q{k}") for k in keys], F.col("segment").alias("_segment"), *labels),
                       _same(keys, [f"q{k}" for k in keys]) & (F.col("segment") == F.col("_segment")), "left")
    upto = Window.partitionBy(*keys).orderBy("segment")  # a row per fold
    fits = parts.select(*[F.col(k).alias(f"f{k}") for k in keys], (F.lit(folds) - F.col("segment")).alias("fold"),
                        F.array(*[F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in labels]).alias("sums"))
    fits = fits.withColumn("w", _solved(len(vector), alpha)("sums")).drop("sums")
    own = F.when(F.col("t") >= F.col("n_train"), 0).otherwise(F.ceil((F.col("n_train") - F.col("t")) / F.lit(fold_weeks)))
    asked = rows.withColumn("own", own.cast("int")).filter((F.col("own") <= folds) & ((F.col("own") == 0) | (F.col("n_train") - F.col("own") * fold_weeks > 52)))
    scored = asked.join(fits, _same(keys, [f"f{k}" for k in keys]) & (F.col("own") == F.col("fold")), "left").drop(*[f"f{k}" for k in keys])
    line = F.col("w")[0]
    for i, n in enumerate(names):
        line = line + F.col("w")[i + 1] * F.coalesce(F.col(n), F.lit(0.0))
    scored = scored.withColumn("line", line)
    out = scored.filter("own = 0")
    if folds:
        tail = (1 - level) / 2
        spread = (scored.filter("own > 0").withColumn("miss", F.col("y") - F.col("line")).filter("miss is not null")
                  .groupBy(*[F.col(k).alias(f"r{k}") for k in keys]).agg(
                      F.percentile("miss", [tail, 1 - tail]).alias("q"), F.count_distinct("own").cast("int").alias("folds")))
        out = out.join(spread, _same(keys, [f"r{k}" for k in keys]), "left")
        low, high = F.exp(F.col("line") + F.col("q")[0]), F.exp(F.col("line") + F.col("q")[1])
    else:
        out = out.withColumn("folds", F.lit(None).cast("int"))
        low = high = F.lit(None).cast("double")
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, series)], "week", F.lit("ridge").alias("model"), F.exp("line").alias("forecast"),
                      F.col("sales").alias("actual"), "is_holiday", low.alias("lo"), high.alias("hi"), F.coalesce("folds", F.lit(0)).alias("folds"))


def mape(y, yhat):
    return F.avg(F.abs((y - yhat) / y)) * 100


def wmae(y, yhat, holiday):
    w = F.when(holiday, 5.0).otherwise(1.0)
    return F.sum(w * F.abs(y - yhat)) / F.sum(w)


def backtest_metrics(forecasts: DataFrame, series: list[str]) -> DataFrame:
    """Per series and model MAPE (2 dp) and holiday-weighted MAE (0 dp) over rows with a forecast."""
    f = forecasts.filter(F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    return f.groupBy(*series, "model").agg(fround(mape(F.col("actual"), F.col("forecast")), 2).alias("mape"),
                                           fround(wmae(F.col("actual"), F.col("forecast"), F.col("is_holiday")), 0)
                                           .alias("wmae"), F.count(F.lit(1)).alias("weeks"))


def backtest_summary(metrics: DataFrame) -> DataFrame:
    """Mean of the per-series metrics by model (MAPE 2 dp, WMAE 0 dp)."""
    return metrics.groupBy("model").agg(fround(F.avg("mape"), 2).alias("mape"), fround(F.avg("wmae"), 0).alias("wmae"),
                                        F.count(F.lit(1)).alias("series"))


def pi_coverage(forecasts: DataFrame, level: float = 0.9) -> DataFrame:
    """Share of holdout actuals inside [lo, hi]."""
    f = forecasts.filter(F.col("lo").isNotNull())
    return f.agg(fround(F.avg((F.col("actual").between(F.col("lo"), F.col("hi"))).cast("double")), 6)
                 .alias("coverage"), F.lit(level).alias("level"), F.count(F.lit(1)).alias("weeks"))


def hier_backtest(df: DataFrame, horizon: int = 13, holidays: list[str] | None = None) -> DataFrame:
    """C14: store total forecast directly vs the sum of department forecasts (bottom-up). The total
    series sums departments per week, promo = any department on promo, holiday = first flag."""
    total = df.groupBy("store", "week").agg(F.sum("weekly_sales").alias("weekly_sales"),
                                            F.first("is_holiday").alias("is_holiday"),
                                            F.first("holiday_name").alias("holiday_name"),
                                            F.bool_or("has_promo").alias("has_promo"))
    direct = ridge_forecast(total, ["store"], horizon, holidays).withColumn("model", F.lit("direct_total"))
    dept = ridge_forecast(df, ["store", "dept"], horizon, holidays)
    bottom = dept.groupBy("store", "week").agg(F.sum("forecast").alias("forecast"))
    actual = direct.select("store", "week", "actual", "is_holiday")
    bu = actual.join(bottom, ["store", "week"], "left").select(
        "store", "week", F.lit("bottom_up").alias("model"), "forecast", "actual", "is_holiday")
    return direct.select("store", "week", "model", "forecast", "actual", "is_holiday").unionByName(bu)
