"""Operator 11 against brute force: given table, nulls, ties, hot vectors, parts and blocks of a few rows, odd lengths, large components."""

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import rows_of  # noqa: E402

from tessera.llm import hard_negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def by_force(rows, every=100):
    rows = [(d, [math.floor(256.0 * x) for x in v], c) for d, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = sorted(((sum(len(w) == n for _, w, _ in rows), n) for n in {len(v) for _, v, _ in rows}), reverse=True)
    rows = [r for r in rows if len(r[1]) == sizes[0][1]] if sizes else []
    out = []
    for a, (d, v, c) in enumerate(rows):
        if d is None or d % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), e is None, e or 0, b) for b, (e, w, _) in enumerate(rows) if b != a)
        for s, none, e, _ in [x for x in scores if rows[x[3]][2] == c][:5]:
            window = [x for x in scores if rows[x[3]][2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(d, None if none else e, k + 1, None if n else f, -s, -t) for k, (t, n, f, _) in enumerate(window)]
    return sorted(out, key=repr)


def check(spark, rows, **more):
    got = [tuple(r[n] for n in NAMES) for r in rows_of(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **more))]
    expected = by_force(rows)
    assert sorted(got, key=repr) == expected
    return expected


def around(seed, n, dim, groups, spread):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(groups, dim))
    return [(k, [float(x) for x in centre[k % groups] + spread * rnd.normal(size=dim)], k % 7 % 4) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PART_ROWS", 50), ("BLOCK_ANCHORS", 2), ("SEED_ROWS", 20), ("CENTRES", 5), ("SAMPLE", 100), ("PRODUCT", 64)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_given_table_is_certified(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = sorted((tuple(r[n] for n in NAMES) for r in rows_of(hard_negatives.mine(table))), key=repr)
    assert got == by_force(rows) and len(got) > 100


def test_small_parts_and_blocks(spark, small):
    assert check(spark, around(1, 700, 8, 6, 0.2))
    assert check(spark, around(2, 400, 5, 3, 0.05))


def test_pruning_leaves_cells_out(spark, monkeypatch):
    """On clustered vectors a certified visit reads few of the cells."""
    monkeypatch.setattr(hard_negatives, "SEED_ROWS", 50)
    rows = around(3, 3000, 16, 30, 0.02)
    assert check(spark, rows)
    table = spark.createDataFrame(rows, SCHEMA)
    taken = hard_negatives.usable(table, "vec_id", "embedding", "label").cache()
    largest = max(abs(math.floor(256 * x)) for _, v, _ in rows for x in v)
    cells, index = hard_negatives.filed(taken, 16, largest)
    v = np.array([[math.floor(256 * x) for x in rows[0][1]]])
    upper, _ = index.bounds(v)
    scores = sorted(int(v[0] @ [math.floor(256 * x) for x in w]) for k, w, c in rows if k and c == rows[0][2])
    read = sum(index.rows[i, j] for b, i, j in hard_negatives.in_order(upper[0][0], upper[1][0]) if b >= scores[-5])
    assert read < 0.5 * len(rows)


def test_heap_visits_by_falling_bounds():
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=9), np.repeat(rnd.normal(size=4), 2)
    seen = list(hard_negatives.in_order(a, b))
    assert [s for s, _, _ in seen] == sorted((x + y for x in a for y in b), reverse=True) and len({(i, j) for _, i, j in seen}) == 72


def test_bounds_hold(spark):
    rows = around(9, 500, 10, 8, 0.3)
    table = hard_negatives.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").cache()
    cells, index = hard_negatives.filed(table, 10, max(abs(math.floor(256 * x)) for _, v, _ in rows for x in v))
    got = rows_of(cells)
    v = np.array([np.frombuffer(bytes(r["v"]), index.kind) for r in got]).astype(np.int64)
    upper, lower = index.bounds(v[:20])
    i, j = np.divmod(np.array([r["cell"] for r in got]), index.rows.shape[1])
    s = v[:20] @ v.T
    assert (s <= upper[0][:, i] + upper[1][:, j]).all() and (s >= lower[0][:, i] + lower[1][:, j]).all()


def test_awkward_rows(spark, small):
    rows = around(4, 300, 6, 4, 0.3)
    rows += [(None, rows[3][1], 1), (None, rows[0][1], 0), (100, rows[5][1], 2), (200, rows[200][1], rows[200][2]), (200, rows[200][1], rows[200][2])]
    rows += [(900, None, 1), (901, rows[1][1], None), (902, [None] + rows[1][1][1:], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 1)]
    rows += [(1000, [0.5, 0.25], 1), (1100, [], 1), (1200, [0.0] * 6, 1), (1300, [-x for x in rows[7][1]], 9)]
    rows += [(2000 + k, rows[100][1], k % 2) for k in range(150)]  # a hot vector: more than a part
    check(spark, rows)


def test_nothing_to_find(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]) == []
    assert check(spark, [(0, [], 1), (1, [], 1), (2, [], 2), (100, [], 1)])  # scores of zero
    assert check(spark, [(100 * k, [float(k)], k % 2) for k in range(9)])


def test_large_components_are_exact(spark):
    rows = [(k, [2.0 ** 18 + k / 256, float(k % 5), 3.0], k % 3) for k in range(120)]
    assert check(spark, rows)
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA))


def test_clashing_columns(spark):
    rows = around(6, 150, 4, 3, 0.2)
    names = ["row", "id", "cell", "v", "lo", "hi", "part", "block", "score", "window", "anchor", "rank"]
    table = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names))
    got = sorted((tuple(r[n] for n in NAMES) for r in rows_of(hard_negatives.mine(table))), key=repr)
    assert got == by_force(rows)
