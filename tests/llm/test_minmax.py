"""Operator 12 against brute force: the awkward cases, given tables, chains, and a group without a hub cut into small blocks."""

import os
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import empty, odd, prose, rows_of  # noqa: E402

from tessera.llm import meeting, minmax_dedup  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def by_force(pairs, percent=85):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(k)] = min(d, low.get(find(k), d))
    out = []
    for k, (d, _) in enumerate(pairs):
        component = low.get(find(k)) if sets[k] else d
        out.append((d, len(sets[k]), component, d == component))
    return out


def check(df):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(minmax_dedup.near_duplicates(df))]
    expected = by_force([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_awkward_rows_and_given_table(spark):
    check(odd(spark).cache())
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table_and_clashing_columns(spark):
    assert minmax_dedup.near_duplicates(empty(spark)).count() == 0
    names = ["node", "key", "bands", "g", "hub", "comp", "component_id", "_of", "rep"]
    rows = [(k, prose(1, 40) if k < 3 else prose(k, 30), *["x"] * len(names)) for k in range(6)]
    check(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)))


def near_copies(n):
    """Copies of one text with an edit each, all linked with the original, few with each other, and a chain beside them."""
    words = prose(70, 60).split()
    rows = [(0, " ".join(words))]
    for k in range(1, n):
        w = list(words)
        w[(7 * k) % 60] = f"edit{k}"
        rows.append((k, " ".join(w)))
    chain = prose(71, 120).split()
    return rows + [(1000 + k, " ".join(chain[:4 * k] + [f"z{j}" for j in range(k)] + chain[4 * k:])) for k in range(12)]


@pytest.mark.parametrize("rounds", [1, 3])
def test_places_in_small_blocks(spark, monkeypatch, rounds):
    monkeypatch.setattr(meeting, "BLOCK", 4)
    monkeypatch.setattr(meeting, "COLUMNS", 8)
    monkeypatch.setattr(meeting, "HUB_ROUNDS", rounds)
    check(spark.createDataFrame(near_copies(60), "doc_id long, text string").repartition(5))


def test_long_text(spark):
    base = " ".join(f"w{k % 7919}x{k % 31}" for k in range(1_500_000))
    assert len(base) > 12_000_000
    rows = [(1, base), (2, base + " and more"), (3, prose(5, 50))]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signatures_are_unbiased():
    """Mean agreement of the minima and maxima estimates the Jaccard similarity; halves of one evaluation agree alike."""
    rng = np.random.default_rng(3)
    low = high = 0.0
    for _ in range(60):
        x = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
        a, b = np.unique(x[:170]), np.unique(x[30:])  # 140 of 200
        lo, hi = minmax_dedup.min_max(np.concatenate([a, b]), np.array([0, len(a)]))
        low += (lo[:, 0] == lo[:, 1]).mean() / 60
        high += (hi[:, 0] == hi[:, 1]).mean() / 60
    assert abs(low - 0.7) < 0.04 and abs(high - 0.7) < 0.04


def test_recall_at_the_limit(spark):
    """Pairs just at 85 %: every one is found."""
    rows = []
    for k in range(150):
        w = prose(2000 + k, 37).split()[:37]
        w = [f"{x}{k}" for x in w]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-3], "p", "q", "r"]))]  # 32 of 38
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    linked = minmax_dedup.near_duplicates(df).filter("not kept").count()
    assert linked == sum(not r[3] for r in by_force(rows))
