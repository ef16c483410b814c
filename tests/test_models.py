"""Churn model: exact stratified split, named features, a model that learns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M


def _rows(n, seed=3):
    rnd = random.Random(seed)
    return [(k, rnd.choice([0, 0, 0, 1, None])) for k in range(n)]


def test_split_is_exact_per_class(spark):
    for n, share in ((403, 0.25), (10, 0.25), (77, 0.5), (3, 0.01), (20, 1.0)):
        rows = _rows(n)
        got = {(r["id"], r["y"]): r["is_test"] for r in M.stratified_split(spark.createDataFrame(rows, "id long, y int").repartition(5), "y", "id", share).collect()}
        assert len(got) == n
        for c in (0, 1, None):
            order = sorted((hashlib.md5(f"{k}:42".encode()).hexdigest()[:13], k) for k, y in rows if y == c)
            quota = int(len(order) * share + 0.5)
            assert {k for (k, y), t in got.items() if y == c and t} == {k for _, k in order[:quota]}


def test_split_with_equal_keys_keeps_the_quota(spark):
    df = spark.createDataFrame([(7, 1)] * 9 + [(8, 1)] * 3, "id long, y int")
    got = M.stratified_split(df, "y", "id", 0.25)
    assert got.count() == 12 and got.filter("is_test").count() == 3
    assert M.stratified_split(df.limit(0), "y", "id").count() == 0


def test_churn_features_have_names_and_the_model_learns(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(600):
        tickets, contract = rnd.randrange(9), rnd.choice(["monthly", "yearly"])
        churn = int(tickets + 3 * (contract == "monthly") + rnd.gauss(0, 1) > 6)
        rows.append((k, rnd.randrange(1, 60), rnd.randrange(1, 5), 20 + 60 * rnd.random(), tickets, rnd.gauss(0, 1), contract, rnd.choice(["card", "check"]), churn))
    df = spark.createDataFrame(rows, "customer_id long, tenure_months int, num_services int, monthly_charges double, support_tickets int, "
                                     "usage_trend double, contract string, payment_method string, churn int")
    models, test = M.fit_churn(df)
    assert test.count() == sum(int(sum(r[-1] == c for r in rows) * 0.25 + 0.5) for c in (0, 1))
    for name, fitted in models.items():
        found = M.feature_importance(fitted, df).collect()
        names = [r["feature"] for r in found]
        assert set(M.CHURN_NUM) < set(names) and "contract=monthly" in names and "payment_method=card" in names
        assert names[0] in ("support_tickets", "contract=monthly", "contract=yearly")
        assert M.binary_metrics(test, label="churn", prob=f"p_{name}").first()["auc"] > 0.9
    assert M.score(df, models["logistic"]).filter(F.col("proba").between(0, 1)).count() == 600


def test_sentiment_model_and_its_explanations(spark):
    """Clear words decide; the contributions of a document add up to its logit; misclassified rows are those on the wrong side."""
    rnd = random.Random(4)
    rows = []
    for k in range(240):
        good = k % 2
        words = [rnd.choice(["great", "lovely", "fine"] if good else ["awful", "broken", "bad"]) for _ in range(4)] + [rnd.choice(["box", "thing", "day", "house"]) for _ in range(6)]
        rnd.shuffle(words)
        rows.append((k, " ".join(words), good if k % 40 else 1 - good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model, vocab, pred, n_docs = M.fit_sentiment(docs)
    pred = pred.cache()
    assert pred.count() == sum(int(sum(r[2] == c for r in rows) * 0.25 + 0.5) for c in (0, 1))
    clean = pred.filter(F.col("doc_id") % 40 != 0)
    assert clean.filter("pred = label").count() >= 0.95 * clean.count()
    wrong = {r["doc_id"] for r in M.misclassified(pred).collect()}
    assert wrong == {r["doc_id"] for r in pred.collect() if (r["proba"] >= 0.5) != bool(r["label"])}
    top = {(r["direction"], r["term"]) for r in M.top_ngrams(model, vocab, 3).collect()}
    assert {t for d, t in top if d == "positive"} == {"great", "lovely", "fine"} and {t for d, t in top if d == "negative"} == {"awful", "broken", "bad"}
    parts = M.explain_sentiment(model, vocab, pred.select("doc_id", "text"), n_docs, top=10_000).groupBy("doc_id").agg(F.sum("contribution").alias("s"))
    for r in parts.join(pred, "doc_id").collect():
        logit = math.log(r["proba"] / (1 - r["proba"]))
        assert abs(r["s"] + model.intercept - logit) < 1e-3


def _newton(x, y, penalty):
    """Coefficients and intercept of the penalised logistic regression by dense Newton steps."""
    xb, reg = np.c_[x, np.ones(len(x))], np.r_[np.full(x.shape[1], penalty), 0.0]
    w = np.zeros(xb.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(xb.T @ (xb * (p * (1 - p))[:, None]) + np.diag(reg), xb.T @ (p - y) + reg * w)
    return w[:-1], w[-1]


def test_sentiment_fit_is_the_dense_solution_without_vectors_on_the_driver(spark, monkeypatch):
    """The coefficients are a table; columns in many small blocks and tasks, ids that repeat and documents without words give the plain solution."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(rnd.choices(words[:40] if k % 2 else words[20:], k=rnd.randrange(0, 9))), int(rnd.random() < (0.8 if k % 2 else 0.3))) for k in range(160)]
    rows += [(k, t, 1 - y) for k, t, y in rows[:12]] + [(None, "w1 w2", 1), (None, "w3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    monkeypatch.setattr(M, "BLOCK_VALUES", 50)
    monkeypatch.setattr(M, "TASK_VALUES", 100)
    monkeypatch.setattr(M, "SCORE_ROWS", 32)
    model, vocab, pred, n_docs = M.fit_sentiment(docs)
    train = M.stratified_split(docs, "label", "doc_id").filter("not is_test")
    size = vocab.count()
    weights = {}
    for r in M.tfidf_weights(train, vocab, n_docs).collect():
        weights.setdefault(r["doc_id"], np.zeros(size))[r["index"]] = r["w"]
    kept = train.collect()
    assert n_docs == len(kept) and len({r["doc_id"] for r in kept}) < len(kept)
    w, b = _newton(np.array([weights.get(r["doc_id"], np.zeros(size)) for r in kept]), np.array([r["label"] for r in kept], dtype=float), 0.25)
    got = {r["index"]: r["coef"] for r in model.coefficients.collect()}
    assert sorted(got) == list(range(size)) and abs(model.intercept - b) < 1e-4
    assert max(abs(got[i] - w[i]) for i in got) < 1e-4
    assert pred.count() == len(rows) - len(kept) and pred.filter("proba is null or (pred = 1) <> (proba >= 0.5)").count() == 0


def test_sentiment_fit_with_one_label(spark):
    """All rows of one label: no coefficients, and that label for every text."""
    docs = spark.createDataFrame([(k, "red green blue", 1) for k in range(12)], "doc_id long, text string, label int")
    model, _, pred, _ = M.fit_sentiment(docs)
    assert [r["proba"] for r in pred.collect()] == [1.0] * 3 and model.coefficients.filter("coef <> 0").count() == 0
    with pytest.raises(ValueError):
        M.fit_sentiment(docs.withColumn("label", F.lit(2)))


def test_terms_are_counted_before_they_travel(spark, monkeypatch):
    """columns of counts from many slices, buckets and blocks are those of a plain count, with ids that repeat, without ids
    and without words; nothing is spread into a row per term before it is counted."""
    for name, value in (("COUNT_TOKENS", 40), ("COUNT_ROWS", 7), ("BUCKET_LEAST", 20), ("BLOCK_VALUES", 30)):
        monkeypatch.setattr(M, name, value)
    rnd = random.Random(11)
    words = ["Ärger", "été", "x", "a_b", "tea", "to", "2024", "go", "so", "it"]
    rows = [(rnd.choice([k, k, 3, 4, -1]), " ".join(rnd.choices(words, k=rnd.randrange(0, 12))) + rnd.choice(["", ".", "!!"])) for k in range(90)] + [(5, None), (6, "")]
    df, counts = {}, {}
    for no, text in rows:
        toks = re.findall(r"\b\w\w+\b", (text or "").lower())
        counts.setdefault(no, Counter()).update(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
    for c in counts.values():
        for t in c:
            df[t] = df.get(t, 0) + 1
    docs = spark.createDataFrame(rows, "no long, text string").repartition(4)
    got, blocks = {}, M.term_columns(docs, "no", "text").collect()
    for r in blocks:
        length, no, tf = (np.frombuffer(r[x], np.int32) for x in ("length", "no", "tf"))
        ends = np.cumsum(length)
        for t, d, b, e in zip(r["term"], r["df"], ends - length, ends):
            assert t not in got
            got[t] = (d, dict(zip(no[b:e].tolist(), tf[b:e].tolist())))
    assert len(blocks) > 8
    assert got == {t: (d, {no: c[t] for no, c in counts.items() if no >= 0 and t in c}) for t, d in df.items() if d >= 2}
    vocab, n = M.tfidf_vocabulary(docs, id_col="no", columns=M.term_columns(docs, "no", "text"))
    assert n == len(rows) and [(r["term"], r["df"]) for r in vocab.orderBy("index").collect()] == sorted((t, d) for t, d in df.items() if d >= 2)
    weights = M.tfidf_weights(docs, vocab, n, id_col="no")
    assert "explode" not in weights._jdf.queryExecution().optimizedPlan().toString()
    sums = weights.groupBy("no").agg(F.sum(F.col("w") * F.col("w")).alias("s"), F.count("w").alias("n")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums) and {r["no"]: r["n"] for r in sums} == {no: m for no, c in counts.items() if (m := sum(df[t] >= 2 for t in c))}
