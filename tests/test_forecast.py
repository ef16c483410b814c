"""Ridge forecasts against a plain dense fit per series and fold; seasonal naive beyond a year; series without fits."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import forecast as FC

HOLIDAYS = ["xmas", "easter"]
SCHEMA = "store string, week date, weekly_sales double, is_holiday boolean, holiday_name string, has_promo boolean"


def _rows(stores=3, weeks=150, seed=5):
    rng = np.random.default_rng(seed)
    start, out = dt.date(2021, 1, 8), []
    for s in range(stores):
        for k in range(weeks - 9 * s):
            day = start + dt.timedelta(days=7 * k)
            if (k * 7 + s) % 41 == 3:
                continue  # a missing week
            name = "xmas" if day.isocalendar()[1] == 51 else "easter" if day.isocalendar()[1] == 14 else None
            promo = bool(rng.random() < 0.2)
            value = float(np.exp(8 + s + 0.002 * k + 0.3 * np.sin(k / 8) + 0.4 * (name == "xmas") + 0.1 * promo + 0.05 * rng.normal()))
            out.append((f"s{s}", day, 0.0 if (k + s) % 53 == 7 else value, name is not None, name, promo))
    return out


def _dense(rows, horizon, alpha, level, folds, fold_weeks):
    """(week -> forecast, lo, hi) and the folds used, for one series, with full matrices."""
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    weeks = [first + dt.timedelta(days=7 * k) for k in range((last - first).days // 7 + 1)]
    by = {r[1]: r for r in rows}
    y = np.array([np.log(by[w][2]) if w in by and by[w][2] > 0 else np.nan for w in weeks])
    n, cut = len(weeks), len(weeks) - horizon
    angle = 2 * np.pi * np.array([w.isocalendar()[1] for w in weeks]) / FC.WEEKS_PER_YEAR
    x = np.column_stack([np.concatenate([np.full(52, np.nan), y])[:n], np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle),
                         *[[float(w in by and by[w][4] == h) for w in weeks] for h in HOLIDAYS], [float(w in by and by[w][5]) for w in weeks], np.arange(n)])

    def fit(upto, at):
        ok = (np.arange(n) < upto) & np.isfinite(y) & np.isfinite(x).all(axis=1)
        if ok.sum() < 2:
            return None
        sd = x[ok].std(axis=0)
        sd[sd < 1e-9] = 1
        z = np.column_stack([(x[ok] - x[ok].mean(axis=0)) / sd])
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y[ok] - y[ok].mean()))
        return y[ok].mean() + ((np.nan_to_num(x[at]) - x[ok].mean(axis=0)) / sd) @ w

    miss, used = [], 0
    for k in range(folds, 0, -1):
        c = cut - k * fold_weeks
        at = np.arange(c, c + fold_weeks)
        p = fit(c, at) if c > 52 else None
        if p is not None:
            r = (y[at] - p)[np.isfinite(y[at])]
            miss += list(r)
            used += len(r) > 0
    p = fit(cut, np.arange(cut, n))
    tail = (1 - level) / 2
    q = np.quantile(miss, [tail, 1 - tail]) if miss else (None, None)
    return {weeks[cut + i]: (float(np.exp(v)), *(float(np.exp(v + e)) if e is not None else None for e in q)) for i, v in enumerate(p)}, used


def test_ridge_and_intervals_like_dense_fits(spark):
    rows = _rows()
    got = FC.ridge_forecast(spark.createDataFrame(rows, SCHEMA).repartition(4), ["store"], 13, HOLIDAYS, level=0.9).collect()
    for s in ("s0", "s1", "s2"):
        expected, used = _dense([r for r in rows if r[0] == s], 13, 1.0, 0.9, 4, 13)
        mine = {r["week"]: (r["forecast"], r["lo"], r["hi"]) for r in got if r["store"] == s}
        assert set(mine) == set(expected) and {r["folds"] for r in got if r["store"] == s} == {used}
        for w, v in expected.items():
            assert mine[w] == pytest.approx(v, rel=1e-7)


def test_no_series_is_dropped(spark):
    """A series of half a year has no fit, one of 70 weeks a fit but no fold; both keep their weeks."""
    long = _rows(1, 150)
    rows = long + [("half", *r[1:]) for r in long[:26]] + [("some", *r[1:]) for r in long[:72]] + [(None, *r[1:]) for r in long]
    got = FC.ridge_forecast(spark.createDataFrame(rows, SCHEMA), ["store"], 13, HOLIDAYS, level=0.9).orderBy("week").collect()
    by = {}
    for r in got:
        by.setdefault(r["store"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"s0": 13, "half": 13, "some": 13, None: 13}
    assert all(r["forecast"] is None and r["lo"] is None and r["folds"] == 0 for r in by["half"])
    assert all(r["forecast"] is not None and r["lo"] is None and r["folds"] == 0 for r in by["some"])
    assert [r["forecast"] for r in by[None]] == pytest.approx([r["forecast"] for r in by["s0"]])
    assert FC.ridge_forecast(spark.createDataFrame([], SCHEMA), ["store"]).count() == 0


def test_seasonal_naive_beyond_a_year(spark):
    start = dt.date(2020, 1, 3)
    rows = [("s", start + dt.timedelta(days=7 * k), float(k), False, None, False) for k in range(200)]
    got = {r["actual"]: r["forecast"] for r in FC.seasonal_naive(spark.createDataFrame(rows, SCHEMA), ["store"], 60).collect()}
    assert got == {float(k): float(k - 52 if k < 192 else k - 104) for k in range(140, 200)}


def test_hierarchy_sums_departments(spark):
    rows = [("s", d, *r[1:]) for d in ("a", "b") for r in _rows(1, 120, seed=ord(d))]
    df = spark.createDataFrame(rows, "store string, dept string, " + SCHEMA.split(", ", 1)[1])
    out = FC.hier_backtest(df, 13, HOLIDAYS).collect()
    dept = FC.ridge_forecast(df, ["store", "dept"], 13, HOLIDAYS).collect()
    total = {}
    for r in dept:
        total[r["week"]] = total.get(r["week"], 0.0) + r["forecast"]
    assert {r["week"]: r["forecast"] for r in out if r["model"] == "bottom_up"} == pytest.approx(total)
    assert len([r for r in out if r["model"] == "direct_total"]) == 13
