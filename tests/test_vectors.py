"""Retrieval invariants: trimming before ranking, exact-first semantic cache, chunk counts."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import routing as RT
from tessera.operators import vector_index
from tessera.operators import vectors as V


def test_chunk_count_and_overlap(spark):
    df = spark.createDataFrame([(1, "  " + "x" * 1500 + "  "), (2, "   ")], "doc_id long, text string")
    ch = V.chunk_documents(df).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["ordinal"], len(r["text"])) for r in ch] == [(1, 0, 800), (1, 1, 800), (1, 2, 100)]


def test_trimmed_items_never_returned(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0], ["grp:accounting"]), ("b", [0.9, 0.1], []),
                                   ("c", [0.0, 1.0], ["grp:sales"])], "chunk_id string, embedding array<double>, acl array<string>")
    q = spark.createDataFrame([("q1", [1.0, 0.0], ["grp:all", "grp:sales"])],
                              "query_id string, embedding array<double>, principals array<string>")
    got = [r["chunk_id"] for r in V.search(items, q, k=2).orderBy("rank").collect()]
    assert got == ["b", "c"]  # the closest item (a) is not visible to a sales principal


def test_semantic_cache_exact_first_and_threshold(spark):
    now = dt.datetime(2024, 1, 2)
    e = V.embed_signed(spark.createDataFrame([("e1", "what is the refund policy"), ("e2", "how to reset a password")],
                                             "entry_id string, text string"))
    entries = e.select("entry_id", F.col("text").alias("query"), F.lit(None).cast("string").alias("model"),
                       F.lit(now - dt.timedelta(hours=1)).alias("created_at"), "embedding")
    q = V.embed_signed(spark.createDataFrame([("q1", "what is the refund policy"), ("q2", "completely unrelated words")],
                                             "query_id string, text string"))
    queries = q.select("query_id", F.col("text").alias("query"), F.lit(None).cast("string").alias("model"), "embedding")
    got = {r["query_id"]: (r["hit_type"], r["entry_id"]) for r in RT.semantic_lookup(queries, entries, now=now).collect()}
    assert got["q1"] == ("exact", "e1") and got["q2"][0] == "miss"


def _clustered(seed, n, dim=12, groups=25, spread=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


def _frames(spark, x, q, acls=None, whos=None):
    items = spark.createDataFrame([(f"i{k:04d}", v.tolist(), acls[k] if acls else []) for k, v in enumerate(x)],
                                  "item_id string, embedding array<double>, acl array<string>").repartition(4)
    queries = spark.createDataFrame([(k, v.tolist(), whos[k] if whos else []) for k, v in enumerate(q)],
                                    "query_id long, embedding array<double>, principals array<string>").repartition(3)
    return items, queries


def _by_force(x, q, k, acls=None, whos=None):
    out = []
    for a, v in enumerate(q):
        length = np.sqrt(v @ v) or 1.0
        s = [(-round(float(w @ v / length), 9), f"i{b:04d}") for b, w in enumerate(x)
             if acls is None or not acls[b] or set(acls[b]) & set(whos[a])]
        out += [(a, i, r + 1) for r, (_, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PART_ROWS", 60), ("BLOCK_QUERIES", 20), ("SEED_ROWS", 15), ("PRODUCT", 500)):
        monkeypatch.setattr(vector_index, name, value)


def test_exact_over_parts_and_blocks(spark, small):
    x = np.concatenate([_clustered(1, 500), np.tile(_clustered(2, 1), (130, 1))])  # a vector that fills more than a part
    q = np.concatenate([_clustered(3, 50), x[-1:], np.zeros((1, 12))])
    got = V.top_k_similar(*reversed(_frames(spark, x, q)), 4).collect()
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got) == _by_force(x, q, 4)


def test_trimming_before_ranking_by_force(spark, small):
    rnd = random.Random(5)
    x, q = _clustered(6, 400), _clustered(7, 40)
    acls = [rnd.choice([None, [], ["a"], ["b"], ["a", "c"]]) for _ in x]
    whos = [rnd.choice([[], ["a"], ["b", "c"], ["z"]]) for _ in q]
    items, queries = _frames(spark, x, q, acls, whos)
    got = V.search(items, queries, k=5, item_id="item_id").collect()
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got) == _by_force(x, q, 5, [a or [] for a in acls], whos)


def test_bounds_leave_cells_out(spark):
    x = _clustered(8, 3000, spread=0.05)
    items, _ = _frames(spark, x, x[:1])
    index = vector_index.build(items, "item_id")
    q = x[:200] / np.linalg.norm(x[:200], axis=1)[:, None]
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    visited = ((q @ index.centres.T + index.radius >= kth[:, None]) * index.rows).sum() / (200 * 3000)
    assert visited < 0.2


def test_ivf_recall_and_no_query_vanishes(spark):
    """Recall of at least 0.9 against brute force on under 5 % of the pairs; queries that see few items still get all they can."""
    x = _clustered(9, 4000, dim=16, groups=100)
    q = _clustered(9, 4000, dim=16, groups=100)[:300]
    items, queries = _frames(spark, x, q)
    index = vector_index.build(items, "item_id")
    asked = vector_index._prepared(queries, index, "query_id", "embedding", None)
    probes = vector_index.calibrated(index, asked, 5)
    got = {(r["qid"], r["iid"]) for r in vector_index.probed(index, asked, 5, probes).collect()}
    truth = {r[:2] for r in _by_force(x, q, 5)}
    unit = q / np.linalg.norm(q, axis=1)[:, None]
    order = np.argsort(-(unit @ index.centres.T), axis=1)[:, :probes]
    assert len(got & truth) >= 0.9 * len(truth) and len(got) == 1500
    assert index.rows[order].sum() < 0.05 * 300 * 4000


def test_ivf_widens_for_trimmed_queries(spark):
    x = _clustered(10, 600)
    acls = [["rare"] if k % 100 == 0 else ["other"] for k in range(600)]
    q = _clustered(11, 10)
    items, queries = _frames(spark, x, q, acls, [["rare"]] * 10)
    got = V.search_ivf(items, queries, 4, probes=1, principals="principals", acl="acl").collect()
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got) == _by_force(x, q, 4, acls, [["rare"]] * 10)


def test_unusable_vectors(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [None, 1.0]), ("e", [0.0, 2.0])], "item_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 3.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["item_id"], r["similarity"]) for r in V.top_k_similar(queries, items, 5).orderBy("rank").collect()]
    assert got == [(1, "e", 2.0), (1, "a", 0.0)]
    assert V.top_k_similar(queries, items.limit(0), 5).count() == 0
    assert V.top_k_similar(queries.limit(0), items, 5).count() == 0


def test_hash_weights_of_repeated_ids_and_shuffled_rows(spark):
    """Rows of one id are one text; the shuffle carries a row per text, not one per token."""
    df = spark.createDataFrame([("a", "one two Two"), ("a", "two three"), ("b", None), (None, "lost"), ("c", "!!")], "id string, text string")
    got = {(r["id"], r["bucket"]): r["weight"] for r in V.hash_weights(df, dim=64).collect()}
    want = {}
    for word, n in (("one", 1), ("two", 3), ("three", 1)):
        bucket = int(hashlib.md5(word.encode()).hexdigest(), 16) % 64
        want["a", bucket] = want.get(("a", bucket), 0) + n
    norm = np.sqrt(sum(n * n for n in want.values()))
    assert got == {k: n / norm for k, n in want.items()}
    plan = V.hash_weights(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate(keys=[id" in plan and "bucket" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]


def _shuffled_rows(spark, n):
    """Rows of the items' side that a search of n vectors against themselves sends through exchanges or explodes: plans hold no generator."""
    x = _clustered(12, n)
    items, queries = _frames(spark, x, x)
    index = vector_index.build(items, "item_id")
    blocks = vector_index._blocks(vector_index._prepared(queries, index, "query_id", "embedding", None), index)
    return blocks.count(), index.parts.count()


def test_search_sends_each_side_once(spark, small):
    """Blocks and parts are a copy of each side each: their number grows with the rows, not with the pairs."""
    blocks, parts = _shuffled_rows(spark, 300)
    more_blocks, more_parts = _shuffled_rows(spark, 600)
    assert 8 <= blocks <= 16 and blocks < more_blocks <= 31 and 5 <= parts < more_parts <= 4 * parts
