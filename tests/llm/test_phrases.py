"""Operator 13 against brute force: awkward rows, a given table, small blocks and a crowded bitmap, ties, very long texts."""

import collections
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import empty, odd, prose, rows_of  # noqa: E402

from tessera.llm import kernel as K  # noqa: E402
from tessera.llm import phrases  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(pairs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for p in range(len(w) - m + 1):
                    f[lang, tuple(w[p:p + m])] += 1
    f = {k: c for k, c in f.items() if c >= least}
    covered = set()
    for (lang, w), c in f.items():
        for m in range(2, len(w)):
            for p in range(len(w) - m + 1):
                if 100 * c >= 100 * f[lang, w[p:p + m]]:
                    covered.add((lang, w[p:p + m]))
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def check(df, least, top=2000):
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
                 for r in rows_of(phrases.collocations(df, least=least, top=top)))
    expected = by_force([(r["lang"], r["text"]) for r in df.select("lang", "text").collect()], least, top)
    assert got == expected
    return got


@pytest.mark.parametrize("block", [1 << 19, 37])
def test_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 500)
    assert check(odd(spark).cache(), 2)


def test_given_table_by_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(check(df, 5)) > 50
    check(df, 5, top=7)


def test_crowded_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITMAP_BITS", 1 << 6)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 8)


def test_languages_ties_and_bytes(spark):
    rows = [("a b c d e f. A B c d\te f", "xx"), ("a b c d e f", None), ("a b c d e f", None), ("a b c d e f", "und"),
            ("z z z z z z z", "xx"), ("ß é. ß é. é ß. é ß. x\x1fy q, x\x1fy q", "yy"), (None, "xx"), ("", None), (" \t\n.,;", "zz")] * 2
    assert check(spark.createDataFrame(rows, "text string, lang string").repartition(4), 2)


def test_empty_table_and_clashing_columns(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    names = ["word", "gram", "f", "n", "first", "last", "cut", "salt", "rank", "heads"]
    rows = [(prose(k % 3, 50), "en", *["x"] * len(names)) for k in range(9)]
    assert check(spark.createDataFrame(rows, "text string, lang string, " + ", ".join(f"`{n}` string" for n in names)), 2)


def test_long_texts(spark, monkeypatch):
    """A text of many slices, cut between pieces, and one without a break that is longer than a slice."""
    monkeypatch.setattr(K, "SLICE_BYTES", 1000)
    rows = [(". ".join(prose(k % 40, 15).replace("\n", "") for k in range(300)), "en"), (" ".join(prose(k % 7, 30).replace("\n", " ") for k in range(40)), "en")]
    assert max(len(t) for t, _ in rows) > 20_000
    check(spark.createDataFrame(rows, "text string, lang string"), 3)


def test_very_long_text(spark):
    text = " ".join(f"w{k % 97} of{',' if k % 11 == 0 else ''}" for k in range(2_500_000))
    assert len(text) > 15_000_000
    got = rows_of(phrases.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), top=5))
    assert len(got) == 5 and got[0]["n"] == 5_000_000
