"""Each operator against brute force, exact round trips or held-out accuracy, on the awkward cases and on sf0.001."""

import collections
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import empty, odd, odd_rows, prose, rows_of  # noqa: E402

from tessera.llm import (decontaminate, jaccard_join, kneser_ney, licenses, line_frequency, materialise, packing,  # noqa: E402
                         suffix_dedup, token_counts, url_filters)

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
START = object()
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", params=["odd", "sf0.001"])
def docs(request, spark):
    return odd(spark).cache() if request.param == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, expected):
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(expected)


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    got = rows_of(packing.pack(packing.token_pieces(docs, BPE), block=64))
    expected = []
    for d, text in pairs_of(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            expected.append((d, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at += n
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    least = max(-(-sum(r["length"] for r in got) // 1024), sum(2 * r["length"] > 1024 for r in got))
    assert len(bins) <= 1.1 * least + 1


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked_by_force(pairs):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(k)] = min(d, low.get(find(k), d))
    return [(d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(pairs)]


def test_jaccard_join(spark, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.linked(docs))]
    same(got, linked_by_force(pairs_of(docs)))


def test_jaccard_chain_and_rounds(spark):
    """A long chain of near copies, where many nodes meet without being linked directly, beside sets below and above the boundary."""
    words = prose(50, 130).split()
    pairs = []
    for k in range(60):
        pairs.append((k, " ".join(words[:2 * k % 40] + [f"edit{k}"] + words[2 * k % 40:])))
    pairs += [(100 + k, " ".join([*words[:7], f"z{k // 2}"])) for k in range(6)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.linked(df))]
    same(got, linked_by_force(pairs))


def test_materialise(spark, docs, tmp_path):
    rows = materialise.records(docs, BPE, shard_size=16).cache()
    got = rows_of(rows)
    n = len(got)
    assert sorted(r["slot"] for r in got) == list(range(n))
    for r in got:
        ids = np.frombuffer(bytes(r["record"]), "<u2")
        assert len(ids) == 1024 and zlib.crc32(ids[:r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] and not ids[r["length"]:].any()
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 16, r["slot"] % 16 * 2048)
    files = rows_of(materialise.write_shards(rows, f"file://{tmp_path}/out"))
    assert sum(f["records"] for f in files) == n
    for r in got[:20]:
        with open(f"{tmp_path}/out/shard-{r['shard']:08d}.bin", "rb") as f:
            f.seek(r["byte_offset"])
            assert f.read(2048) == bytes(r["record"])


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(materialise.slot_of(np.arange(n), n, 5).tolist()) == list(range(n))


def test_decontaminate(spark):
    items = [(k, prose(900 + k, 25)) for k in range(8)] + [(8, None), (9, ""), (8, prose(901, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    reworded = items[2][1].split()
    reworded[3], reworded[9] = "other", "words"
    texts = odd_rows()
    extra = [(200, prose(20, 90) + " " + items[0][1].upper() + " " + prose(21, 90)), (201, prose(22, 45) + " " + " ".join(reworded)),
             (202, items[3][1][:40] + " " + prose(23, 60)), (203, prose(24, 300))]
    df = spark.createDataFrame([r[:2] for r in texts] + extra, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.leaks(df, bench))}
    assert got == {(200, 0), (201, 2)}


def test_decontaminate_recall(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.leaks(docs, bench))}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    exact = {(d, i) for d, t in pairs_of(docs) for i, x in items if x in t}
    assert len(exact) > 10 and exact <= got


def test_line_frequency(spark, docs):
    got = rows_of(line_frequency.quality(docs))
    expected = []
    for d, text in pairs_of(docs):
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        expected.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)))
    same([(r["doc_id"], *(r[f] for f in line_frequency.FIELDS)) for r in got], expected)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_line_frequency_verdict(spark):
    """A line on 30 texts of a host goes; texts of little else are depleted; copies of one text count once."""
    rows = [(k, "Common  LINE 1 of the site\n" + prose(k, 40), "a") for k in range(28)]
    rows += [(50, "\n".join(["common line 2 of the site"] * 5) + "\n" + prose(61, 8), "a"), (51, "common line 3 of the site\n" * 6, "a")]
    rows += [(100 + k, prose(70, 50), "b") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows_of(line_frequency.quality(df))}
    assert got[3]["removed_words"] == 6 and got[3]["kept"]
    assert got[50]["removed_words"] == 30 and not got[50]["kept"]
    assert all(got[100 + k]["removed_words"] == 0 and got[100 + k]["kept"] for k in range(40))


def test_url_filters(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    urls = ["http://www.Example.com/en/a?q", "http://blog.example.com/en/a", "http://example.com", "http://x.net/es/1", "http://other.org/fr/2#x",
            "notcom/", None, "", "https://cheappills.net/de/buy", "https://goodbooks.com/buy", "http://cheappills.net/fr/3"]
    texts = spark.createDataFrame([("<p>cheap pills</p> good books " * 20,), ("cheap books",), (None,)], "html string")
    pages = spark.createDataFrame([(k, u, "w") for k, u in enumerate(urls)], "page_id long, url string, word string")
    got = {r["page_id"]: r for r in rows_of(url_filters.judge(pages, rules, texts, "html"))}
    assert [got[k]["rule"] for k in range(len(urls))] == ["www.example.com/en/", "example.com/en/", None, "net/es/", None, None, None, None, None, "com/", "net/fr/"]
    assert (got[0]["host"], got[0]["path"], got[2]["path"], got[6]["host"]) == ("www.example.com", "/en/a", "", "")
    assert got[8]["host_words"] == ["cheap", "pills", "net"] and got[8]["verdict"] == "block"
    assert rows_of(url_filters.judge(pages.limit(0), rules, texts, "html")) == []


def test_best_split_by_force():
    counts = {"cheap": 5, "pills": 4, "che": 1, "app": 2, "ills": 1, "a": 9}
    name, total = "cheappills", sum(counts.values())
    known = {(a, b): counts[name[a:b]] for a in range(10) for b in range(a + 1, 11) if name[a:b] in counts}

    def score(parts):
        return sum(math.log10(counts[p] / total) if p in counts else 1 - math.log10(total) - len(p) for p in parts)

    def splits(s):
        return [[s]] + [[s[:k], *r] for k in range(1, len(s)) for r in splits(s[k:])]

    assert score(url_filters.best_split(name, known, total)) == pytest.approx(max(map(score, splits(name))))


def test_suffix_dedup_units_of_like_keys(spark):
    """Two units under one anchor whose keys agree in 32 bits: their shared 50 bytes must go all the same."""
    passage = "the quick brown fox jumps over one lazy dog at daw"
    rows = [(1, f"uatzehwhuoyk{passage}tdymituvtpud"), (2, f"nxbxepvvrzzx{passage}jkgytnblgcyg")]
    for pairs in (rows, [(2, rows[0][1]), (1, rows[1][1])]):
        got = {r["doc_id"]: r["n_removed"] for r in rows_of(suffix_dedup.removed(spark.createDataFrame(pairs, "doc_id long, text string")))}
        assert got == {1: 0, 2: 50}


def test_suffix_dedup(spark, docs):
    pairs = [((1 << 62) if d is None else d, (t or "").encode(), d) for d, t in pairs_of(docs)]
    low = {}
    for d, b, _ in pairs:
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            low[w] = min(d, low.get(w, d))
    expected = []
    for d, b, shown in pairs:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - 49):
            if low[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[i] and not gone[i - 1] for i in range(1, len(b))) + bool(gone[0])
        expected.append((shown, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffix_dedup.removed(docs))]
    same(got, expected)


def test_suffix_dedup_hot_anchors(spark, docs):
    """Strings ordered in buckets of anchors and over the whole cluster give the same bytes."""
    table = docs.selectExpr("coalesce(cast(doc_id as long), 9223372036854775807) as ord", "coalesce(text, '') as text")
    found = [{(r["row"], i) for r in rows_of(suffix_dedup.repeated_spans(table, hot=hot)) for i in range(r["start"], r["end"])}
             for hot in (0, 1_000_000)]
    assert found[0] == found[1] and found[0]


def test_token_counts(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows_of(token_counts.token_budget(token_counts.prefix_counts(docs, PIECES), 50))
    expected = [(d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 50) for d, t in pairs_of(docs)]
    same([(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got], expected)
    counter = token_counts.counter_of(PIECES)
    for _, t in pairs_of(docs)[:12]:
        sums = np.cumsum(np.frombuffer(counter.steps(t or ""), np.int8).astype(int))
        assert [len(sp.encode(t[:k])) for k in range(1, min(len(t or ""), 60) + 1)] == sums[:60].tolist()


def test_kneser_ney(spark, docs):
    got = rows_of(kneser_ney.scored(docs))
    pairs = pairs_of(docs)
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in pairs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in pairs]
    one, two = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            one.update(t), two.update(zip([START, *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    before = collections.Counter(w for _, w in two)
    after = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in two.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1
    count = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(count(two.values())), kneser_ney.discounts(count(before.values()))
    rest = sum(e[min(c, 3)] for c in before.values()) / len(two)

    def p(a, w):
        low = (before[w] - e[min(before[w], 3)]) / len(two) + rest / (v + 1)
        f = after.get(a)
        return low if not f else (two[a, w] - d[min(two[a, w], 3)]) / f[0] + sum(d[k] * f[k] for k in (1, 2, 3)) / f[0] * low

    expected = [(i, h, len(t), sum(w in one for w in t), n, round(sum(math.log10((one[w] + .1) / (n + .1 * (v + 1))) for w in t), 4),
                 round(sum(math.log10(p(a, w)) for a, w in zip([START, *t[:-1]], t)), 4)) for (i, _), t, h in zip(pairs, tokens, held)]
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got],
         expected)
    # all next words of a context, and the unknown one, add up to one
    context = next(iter(after))
    unknown = p(context, "never seen")
    assert sum(p(context, w) for w in one) + unknown == pytest.approx(1.0, abs=1e-9)


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.txt", prose(1, 30)), (3, "a/b/LICENSE.md", apache), (4, "a/c/y.txt", "text\n" + apache + "\nmore"),
            (5, "d/z.txt", prose(2, 30)), (6, None, mit), (7, None, None), (8, "a/b/c/d/w", None), (8, "a/b/c/d/w", None), (9, "top", ""), (10, "a/q", "")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, path string, text string, word string, row int")
    got = sorted(((r["doc_id"], r["license"], r["origin"], r["from_directory"]) for r in rows_of(licenses.scan(df))), key=repr)
    assert got == sorted([(1, "MIT", "file", None), (2, "Apache-2.0", "directory", "a/b"), (3, "Apache-2.0", "file", None), (4, "Apache-2.0", "file", None),
                          (5, None, None, None), (6, "MIT", "file", None), (7, None, None, None), (8, "Apache-2.0", "directory", "a/b"),
                          (8, "Apache-2.0", "directory", "a/b"), (9, None, None, None), (10, "MIT", "directory", "a")], key=repr)


def test_empty_tables(spark):
    docs = empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    path = F.lit("a/b").alias("path")
    for df in (packing.pack(packing.token_pieces(docs, BPE)), jaccard_join.linked(docs), materialise.records(docs, BPE), decontaminate.leaks(docs, bench),
               line_frequency.quality(docs), suffix_dedup.removed(docs), kneser_ney.scored(docs), licenses.scan(docs.select("doc_id", "text", path)),
               token_counts.token_budget(token_counts.prefix_counts(docs, PIECES), 9)):
        assert df.count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on the awkward cases, written and read again: what goes is what its operator says, the rest keeps its columns."""
    import corpus_pipeline
    docs = odd(spark)
    spark.createDataFrame([(0, prose(2, 2000)[100:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert {10, 11, 12, 9, 14} <= ids[0] and not ids[0] & {2, 4, 5, 7, 8}
    assert 1 not in ids[1] and 13 not in ids[1] and 0 in ids[1] and ids[1] == ids[2]
    assert ids[2] - ids[3] == {9} and ids[4] == ids[3]
    assert docs.count() >= len(ids[3])
