"""Churn and sentiment classifiers, binary metrics, calibration, lift and cost curves
(C03-C08, C15-C17, W11).

Metrics are aggregations over (label, score) rows: AUC comes from per-score counts and an
ordered prefix sum (average ranks for ties), never from a driver-side sort; the cost curve is
one histogram over the threshold grid plus cumulative sums, not one pass per threshold.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fround
from tessera.operators.common import checkpoint, global_order_index, packed_copy, prefix_sums, shuffles_dropped, spread
from tessera.operators.selection import selected
from tessera.operators.timeseries import quantile_bins


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Exact, deterministic stratified split: of each class, ``test_fraction`` of its rows (rounded half up) go to test, those of the
    lowest hash of key and seed, in the order of the key where hashes agree. Adds ``is_test``.

    The hash up to which a class goes to test is found by radix selection, so no class is ranked in one task; only rows of
    exactly that hash are, and the rows stay where they are: the limits, a row per class, go to them. A null label is a class."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = df.withColumn("_h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("double"))  # 52 bits, exact in a double
    quota = F.floor(F.col("n") * F.lit(test_fraction) + 0.5)
    limit = (selected(rows, [label], "_h", {"_at": lambda n: F.greatest(F.floor(n * F.lit(test_fraction) + 0.5) - 1, F.lit(0))})
             .select(F.col(label).alias("_label"), "_at", quota.alias("_quota")))
    rows = rows.join(F.broadcast(limit), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    below = (rows.filter("_h < _at").groupBy(label).agg(F.count(F.lit(1)).alias("_below")).select(F.col(label).alias("_label"), "_below"))
    edge = rows.filter("_h = _at").join(F.broadcast(below), F.col(label).eqNullSafe(F.col("_label")), "left")
    order = Window.partitionBy(label).orderBy(F.asc(key))  # rows of one class and one hash
    edge = edge.withColumn("is_test", F.row_number().over(order) <= F.col("_quota") - F.coalesce("_below", F.lit(0)))
    rest = rows.filter("_h != _at").withColumn("is_test", F.col("_h") < F.col("_at"))
    return rest.unionByName(edge.select(rest.columns)).drop("_h", "_at", "_quota")


# Churn feature names.
CHURN_NUM = ["tenure_months", "num_services", "monthly_charges", "support_tickets", "usage_trend"]
CHURN_CAT = ["contract", "payment_method"]


def fit_churn(df: DataFrame, label: str = "churn", key: str = "customer_id", seed: int = 42):
    """Scale numerics, one-hot categoricals (unknown kept), logistic (C=1 -> regParam 1/n) and
    gradient-boosted trees on a stratified 75/25 split. Returns (models dict, test predictions)."""
    split = checkpoint(stratified_split(df, label, key, 0.25, seed))
    train = split.filter(~F.col("is_test"))
    n_train = train.count()
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in CHURN_CAT]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CHURN_CAT], outputCols=[f"{c}_oh" for c in CHURN_CAT],
                        dropLast=False, handleInvalid="keep")
    num = VectorAssembler(inputCols=CHURN_NUM, outputCol="num_raw")
    scaler = StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True, withStd=True)
    feats = VectorAssembler(inputCols=["num_scaled"] + [f"{c}_oh" for c in CHURN_CAT], outputCol="features")
    prep = [*idx, ohe, num, scaler, feats]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n_train, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=200)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, maxIter=100, maxDepth=3, stepSize=0.1)
    models = {"logistic": Pipeline(stages=prep + [lr]).fit(train), "gboost": Pipeline(stages=prep + [gbt]).fit(train)}
    test = split.filter(F.col("is_test"))
    out = test.select(key, label)
    for name, m in models.items():
        p = m.transform(test).select(key, vector_to_array("probability")[1].alias(f"p_{name}"))
        out = out.join(p, key)
    return models, out


def score(df: DataFrame, model, out: str = "proba") -> DataFrame:
    """C17: batch scoring with a fitted pipeline (probability of the positive class)."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def feature_names(model, df: DataFrame, features: str = "features") -> list[str]:
    """Names of the assembled features, from the attributes that the fitted stages attach to their column."""
    attributes = model.transform(df.limit(0)).schema[features].metadata["ml_attr"]["attrs"]
    named = {a["idx"]: a.get("name", f"f{a['idx']}") for kind in attributes.values() for a in kind}
    plain = {f"num_scaled_{i}": name for i, name in enumerate(CHURN_NUM)}
    return [plain.get(named[i], named[i].replace("_oh_", "=")) for i in sorted(named)]


def feature_importance(model, df: DataFrame) -> DataFrame:
    """Feature, importance: tree importances or |coefficients| of the last pipeline stage, largest first (model-sized)."""
    clf = model.stages[-1]
    vals = clf.featureImportances.toArray() if hasattr(clf, "featureImportances") else np.abs(clf.coefficients.toArray())
    rows = sorted(zip(feature_names(model, df), [float(v) for v in vals], strict=True), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def binary_metrics(df: DataFrame, label: str = "label", prob: str = "score", threshold: float = 0.5) -> DataFrame:
    """AUC (average ranks for ties), accuracy, precision, recall, F1 at ``threshold``, Brier score and
    the confusion counts, in one row."""
    y = F.col(label).cast("double")
    pred = (F.col(prob) >= threshold).cast("double")
    conf = df.agg(F.sum(y * pred).alias("tp"), F.sum((1 - y) * pred).alias("fp"), F.sum((1 - y) * (1 - pred)).alias("tn"),
                  F.sum(y * (1 - pred)).alias("fn"), F.avg((F.col(prob) - y) ** 2).alias("brier"),
                  F.count(F.lit(1)).alias("n"))
    per = df.groupBy(F.col(prob).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cum = prefix_sums(per, [F.asc("s")], ["neg"])
    auc = cum.agg((F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + 0.5 * F.col("neg")))
                   / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return conf.crossJoin(auc).select(
        fround("auc", 6).alias("auc"), fround((tp + tn) / F.col("n"), 6).alias("accuracy"),
        fround(prec, 6).alias("precision"), fround(rec, 6).alias("recall"), fround(f1, 6).alias("f1"),
        fround("brier", 6).alias("brier"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")], "n")


def roc_curve(df: DataFrame, label: str = "label", prob: str = "score") -> DataFrame:
    """ROC points (fpr, tpr) at every distinct score, thresholds descending, from prefix sums."""
    y = F.col(label).cast("double")
    per = df.groupBy(F.col(prob).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cum = prefix_sums(per, [F.desc("threshold")], ["pos", "neg"])
    tot = df.agg(F.sum(y).alias("P"), F.sum(1 - y).alias("N"))
    return cum.crossJoin(tot).select("threshold", fround(F.col("neg_cum") / F.col("N"), 6).alias("fpr"),
                                     fround(F.col("pos_cum") / F.col("P"), 6).alias("tpr"))


def calibration_table(df: DataFrame, label: str = "label", prob: str = "score", n_bins: int = 10) -> DataFrame:
    """Equal-width bins, right-closed, the first including 0; non-empty bins only."""
    b = F.greatest(F.ceil(F.col(prob) * n_bins), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(fround(F.avg(prob), 6).alias("mean_predicted"),
                                          fround(F.avg(F.col(label).cast("double")), 6).alias("observed_rate"),
                                          F.count(F.lit(1)).alias("customers"))


def lift_table(df: DataFrame, label: str = "label", prob: str = "score", key: str = "id", n_bins: int = 10) -> DataFrame:
    """Deciles of the first-rank (decile 1 = highest scores), churners, rate and lift (2 dp)."""
    binned = quantile_bins(df, prob, key, n_bins, out="decile", descending=True)
    base = df.select(F.avg(F.col(label).cast("double"))).scalar()
    return binned.groupBy("decile").agg(F.count(F.lit(1)).alias("customers"),
                                        F.sum(F.col(label)).cast("long").alias("churners"),
                                        F.avg(F.col(label).cast("double")).alias("_rate")) \
        .select("decile", "customers", "churners", fround("_rate", 6).alias("churn_rate"),
                fround(F.col("_rate") / base, 2).alias("lift"))


def threshold_grid(start: float = 0.01, stop: float = 0.99, num: int = 99) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, num)]


def cost_curve(df: DataFrame, label: str = "label", prob: str = "score", offer_cost: float = 20.0,
               churn_loss: float = 400.0, save_rate: float = 0.35, n_grid: int = 99) -> DataFrame:
    """Expected cost per customer at every grid threshold t (score >= t gets the offer):
    offer*(tp+fp) + loss*(fn + tp*(1-save)), over n. One histogram pass: each row's number of
    thresholds <= score, then cumulative counts from the top; do-nothing / target-all references."""
    grid = threshold_grid(0.01, 0.99, n_grid)
    passed = sum((F.when(F.col(prob) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    y = F.col(label).cast("long")
    hist = df.groupBy(passed.alias("passed")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    spark = df.sparkSession
    g = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "k int, threshold double")
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("P"))
    # threshold k is passed by rows with passed >= k + 1
    j = g.join(F.broadcast(hist), F.col("passed") >= F.col("k") + 1, "left") \
        .groupBy("k", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"),
                                        F.coalesce(F.sum("cnt"), F.lit(0)).alias("targeted"))
    j = j.crossJoin(tot).withColumn("fp", F.col("targeted") - F.col("tp")).withColumn("fn", F.col("P") - F.col("tp"))
    cost = offer_cost * F.col("targeted") + churn_loss * (F.col("fn") + F.col("tp") * (1 - save_rate))
    return j.select("threshold", fround(cost / F.col("n"), 6).alias("cost_per_customer"),
                    fround(F.col("targeted") / F.col("n"), 6).alias("targeted_pct"),
                    fround(churn_loss * F.col("P") / F.col("n"), 6).alias("do_nothing"),
                    fround(offer_cost + churn_loss * F.col("P") / F.col("n") * (1 - save_rate), 6).alias("target_all"))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest threshold (first one on ties) with its cost and the reference costs."""
    w = Window.orderBy(F.asc("cost_per_customer"), F.asc("threshold"))
    return curve.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# --- sentiment ----------------------------------------------------------------------------------
#: Tokens whose terms a worker counts at once, about, and texts of one slice.
COUNT_TOKENS = 1 << 20
COUNT_ROWS = 1000
#: Pairs of a document and a term in one bucket of terms, about and at least (where fewer would do for the tasks); a term is never cut.
BUCKET_VALUES = 1 << 21
BUCKET_LEAST = 50_000


def _tokens(text: str):
    """Lower-cased tokens of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)


def _terms(tokens: pa.Array, lengths: np.ndarray, doc: np.ndarray, n_max: int):
    """Terms of lists of tokens, with ``n_max`` 2 also adjacent pairs: their strings, the codes of their words (-1: no second word), the words, and
    (term, document, count) in the order of terms and documents. ``doc`` tells the document of each list."""
    coded = tokens.dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(lengths)), lengths)
    first, second, term, at = np.arange(len(words)), np.full(len(words), -1), code, row
    if n_max >= 2:
        left = np.flatnonzero(row[1:] == row[:-1])
        pair, which = np.unique(code[left] * max(1, len(words)) + code[left + 1], return_inverse=True)
        first, second = np.r_[first, pair // max(1, len(words))], np.r_[second, pair % max(1, len(words))]
        words_and_pairs = pa.concat_arrays([words, pc.binary_join_element_wise(words.take(pa.array(first[len(words):])), words.take(pa.array(second[len(words):])), " ")])
        term, at = np.r_[code, len(words) + which], np.r_[row, row[left]]
    else:
        words_and_pairs = words
    docs, place = np.unique(doc, return_inverse=True)
    key, count = np.unique(term * max(1, len(docs)) + place[at], return_counts=True)
    return words_and_pairs, (first, second, words), key // max(1, len(docs)), docs[key % max(1, len(docs))], count


def _term_counts(docs: DataFrame, id_col: str, text: str, n_max: int = 2) -> DataFrame:
    """(id, term, tf) rows, one per term of an id; rows of one id are one text. Only tokens travel to their id, the terms are counted there."""
    rows = spread(docs).select(id_col, _tokens(text).alias("_tok")).groupBy(id_col).agg(F.collect_list("_tok").alias("_tok"))

    def run(batches):
        for whole in batches:
            for b in (whole.slice(k, COUNT_ROWS) for k in range(0, whole.num_rows, COUNT_ROWS)):
                lists = b.column(1).flatten()
                doc = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                strings, _, term, at, tf = _terms(lists.flatten(), lists.value_lengths().to_numpy(), doc, n_max)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), strings.take(pa.array(term)), pa.array(tf)], [id_col, "term", "tf"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, term string, tf long")


@F.udf(VectorUDT())
def _sparse(size, idx, vals):
    order = sorted(range(len(idx)), key=lambda i: idx[i])
    return SparseVector(size, [idx[i] for i in order], [vals[i] for i in order])


def tfidf_weights(docs: DataFrame, vocab: DataFrame, n_docs, id_col: str = "doc_id", text: str = "text",
                  n_max: int = 2, also: tuple = ()) -> DataFrame:
    """Long-form (doc, term, index, weight) TF-IDF rows against a fitted vocabulary (see tfidf_features), with the columns ``also`` of the vocabulary."""
    x = _term_counts(docs.filter(F.col(id_col).isNotNull()), id_col, text, n_max).join(vocab.select("term", "index", "idf", *also), "term")
    x = x.withColumn("v", (1 + F.log(F.col("tf"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))  # the terms of one text
    return x.select(id_col, "term", "index", (F.col("v") / norm).alias("w"), *also)


def tfidf_vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_df: int = 2, n_max: int = 2, columns: DataFrame | None = None):
    """(term, df, index, idf) of the terms with document frequency >= ``min_df``, and the number of documents. ``columns`` are the documents'
    terms, if they were counted before (``term_columns``)."""
    n_docs = docs.count()
    if columns is None:
        dfs = _term_counts(docs, id_col, text, n_max).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        dfs = columns.select(F.explode(F.arrays_zip("term", "df")).alias("e")).select("e.term", "e.df")
    vocab = global_order_index(dfs.filter(F.col("df") >= min_df), [F.asc("term")], out="index").withColumn(
        "index", F.col("index").cast("int")).withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    return vocab, n_docs


def tfidf_features(docs: DataFrame, vocab: DataFrame | None = None, n_docs=None, id_col: str = "doc_id",
                   text: str = "text", min_df: int = 2, n_max: int = 2):
    """Word 1-2 grams (tokens of >= 2 word characters), vocabulary with document frequency >= min_df,
    sublinear tf (1 + ln tf), smooth idf ln((1 + n) / (1 + df)) + 1, L2-normalised sparse vectors.
    Computed in long form (doc, term) with aggregations; returns (features, vocab, n_docs)."""
    if vocab is None:
        vocab, n_docs = tfidf_vocabulary(docs, id_col, text, min_df, n_max)
    size = vocab.count()
    x = tfidf_weights(docs, vocab, n_docs, id_col, text, n_max).withColumnRenamed("w", "v")
    vec = x.groupBy(id_col).agg(F.collect_list("index").alias("_i"), F.collect_list("v").alias("_v"))
    feats = docs.join(vec, id_col, "left").withColumn(
        "features", _sparse(F.lit(size), F.coalesce("_i", F.array().cast("array<int>")),
                            F.coalesce("_v", F.array().cast("array<double>")))).drop("_i", "_v")
    return feats, vocab, n_docs


#: Values of the term matrix in one packed block, about; a term's column is never cut.
BLOCK_VALUES = 1 << 18
#: Values of the term matrix that one task reads per pass, at least.
TASK_VALUES = 1 << 20
#: Bytes of texts or packed blocks that go to a worker at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
AT_ONCE = 1 << 26
#: Training documents whose scores travel in one row.
SCORE_ROWS = 1 << 16
#: Pairs of steps and gradient changes that the solver remembers.
MEMORY = 6


@contextmanager
def _few_bytes(spark):
    """Packed blocks are large rows: a batch of Arrow ends by its bytes."""
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


@dataclass(frozen=True)
class SentimentModel:
    """A fitted logistic regression: ``coefficients`` (index long, coef double, term, idf), one row per term of the vocabulary, and the intercept."""

    coefficients: DataFrame
    intercept: float


def expit(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


_COLUMNS = pa.schema([("term", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("length", pa.binary()), ("no", pa.binary()), ("tf", pa.binary())])


def term_columns(docs: DataFrame, no: str, text: str, min_df: int = 2, n_max: int = 2) -> DataFrame:
    """The term counts of documents by columns, as a packed copy: rows of whole columns, with the terms found in at least ``min_df`` documents, their
    document frequencies and lengths, and the documents' numbers and counts as bytes. Documents without a number (-1) count for the frequencies only.

    A worker counts the terms of many texts at once and sends them to buckets of terms, packed, so that each pair of a document and a
    term is shuffled once, in some bytes; a bucket puts its terms together in one task."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # two terms for a token, a token for three characters at least
    most = (docs.agg(F.sum(F.length(text))).first()[0] or 0) * 2 // 3
    buckets = int(max(1, min(tasks, most // BUCKET_LEAST), most // BUCKET_VALUES))
    rows = docs.select(F.col(no).cast("long").alias("no"), _tokens(text).alias("tok"))
    packed = ("text", "size", "length", "no", "tf")
    kind = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in packed], ("bytes", pa.list_(pa.int64()))])

    def dealt(no, lists):
        strings, (first, second, words), term, doc, tf = _terms(lists.flatten(), lists.value_lengths().to_numpy(), no, n_max)
        hashed = np.r_[np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint64, len(words)), np.uint64(7)]
        mixed = hashed[first] * np.uint64(0x9E3779B97F4A7C15) + hashed[second] * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        length = np.bincount(term, minlength=len(strings))
        by_term, by_value = np.argsort(bucket, kind="stable"), np.argsort(bucket[term], kind="stable")
        found, begins = np.unique(bucket[by_term], return_index=True)
        value_begins = np.searchsorted(bucket[term][by_value], found)
        doc, tf = doc[by_value].astype(np.int32), tf[by_value].astype(np.int32)
        out = {c: [] for c in kind.names}
        for k, t0, t1, v0, v1 in zip(found.tolist(), begins, [*begins[1:], len(by_term)], value_begins, [*value_begins[1:], len(by_value)]):
            some = strings.take(pa.array(by_term[t0:t1]))
            size = pc.binary_length(some).to_numpy().astype(np.int32)
            plain = (some.buffers()[2].slice(0, int(size.sum())).to_pybytes(), size.tobytes(), length[by_term[t0:t1]].astype(np.int32).tobytes(),
                     doc[v0:v1].tobytes(), tf[v0:v1].tobytes())
            for c, x in zip(kind.names, (k, *[pa.compress(x, "zstd", asbytes=True) for x in plain], [len(x) for x in plain])):
                out[c].append(x)
        return pa.RecordBatch.from_pydict(out, kind)

    def counted(batches):
        held, size = [], 0
        for whole in batches:
            for b in (whole.slice(k, COUNT_ROWS) for k in range(0, whole.num_rows, COUNT_ROWS)):
                held.append((b.column(0).to_numpy(), b.column(1)))
                size += len(b.column(1).flatten())
                if size >= COUNT_TOKENS:
                    yield dealt(np.concatenate([n for n, _ in held]), pa.concat_arrays([x for _, x in held]))
                    held, size = [], 0
        if size:
            yield dealt(np.concatenate([n for n, _ in held]), pa.concat_arrays([x for _, x in held]))

    def merged(table):
        sizes = np.array(table.column("bytes").to_pylist(), np.int64).T
        plain = {c: b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(table.column(c).to_pylist(), m.tolist())) for c, m in zip(packed, sizes)}
        of = lambda c: np.frombuffer(plain[c], np.int32)
        ends = np.r_[0, np.cumsum(of("size"), dtype=np.int64)]
        strings = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(plain["text"]))
        coded = strings.dictionary_encode()
        term, no, tf = np.repeat(coded.indices.to_numpy().astype(np.int64), of("length")), of("no"), of("tf")
        order = np.argsort(term << 32 | (no + 1), kind="stable")
        term, no, tf = term[order], no[order], tf[order]
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (no[1:] != no[:-1])])  # rows of one document
        term, no, tf = term[at], no[at], np.add.reduceat(tf, at)
        df = np.bincount(term, minlength=len(coded.dictionary))
        kept = (df[term] >= min_df) & (no >= 0)
        term, no, tf = term[kept], no[kept], tf[kept]
        each, begins, length = np.unique(term, return_index=True, return_counts=True)
        cuts = np.flatnonzero(np.r_[True, begins[1:] // BLOCK_VALUES != begins[:-1] // BLOCK_VALUES])[:len(each)]
        out = {c: [] for c in _COLUMNS.names}
        for t0, t1 in zip(cuts, [*cuts[1:], len(each)]):
            v0, v1 = begins[t0], begins[t1 - 1] + length[t1 - 1]
            for c, x in zip(_COLUMNS.names, (coded.dictionary.take(pa.array(each[t0:t1])).cast(pa.string()).to_pylist(), df[each[t0:t1]],
                                             length[t0:t1].astype(np.int32).tobytes(), no[v0:v1].tobytes(), tf[v0:v1].astype(np.int32).tobytes())):
                out[c].append(x)
        return pa.table(out, _COLUMNS)

    with _few_bytes(spark):
        sent = rows.mapInArrow(counted, "bucket int, text binary, size binary, length binary, no binary, tf binary, bytes array<long>")
        return packed_copy(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
            merged, "term array<string>, df array<long>, length binary, no binary, tf binary"))


def _columns_of(batch, n_docs: int):
    """Blocks of columns: places where they begin, numbers of the documents and values before these are scaled to length one."""
    at = {c: batch.schema.get_field_index(c) for c in ("df", "length", "no", "tf")}
    for r in range(batch.num_rows):
        length, no, tf = (np.frombuffer(batch.column(at[c])[r].as_buffer(), np.int32) for c in ("length", "no", "tf"))
        idf = np.log((1.0 + n_docs) / (1.0 + batch.column(at["df"])[r].values.to_numpy())) + 1.0
        v = (1.0 + np.log(np.arange(1, tf.max() + 1)))[tf - 1] * np.repeat(idf, length)
        yield length, np.r_[0, np.cumsum(length)[:-1]], no, v


def _added(blocks: DataFrame, n_docs: int, size: int, of, tasks: int) -> np.ndarray:
    """Sums per document of ``of(length, at, no, v)`` over the columns: each task adds up those of its blocks, and the tasks' are added up by ranges of documents."""
    rows = SCORE_ROWS
    kind = pa.schema([("part", pa.int64()), ("score", pa.binary())])

    def through(batches):
        out, held, n = np.zeros(size), [], 0
        for batch in batches:
            for length, at, no, v in _columns_of(batch, n_docs):
                held.append((no, of(length, at, no, v)))
                n += no.size
                if n >= size:  # a sum by documents costs as much as there are documents
                    out += np.bincount(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), size)
                    held, n = [], 0
        if n:
            out += np.bincount(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), size)
        yield pa.RecordBatch.from_pydict({"part": list(range(0, size, rows)), "score": [out[k:k + rows].tobytes() for k in range(0, size, rows)]}, kind)

    def added(table):
        total = sum(np.frombuffer(x, np.float64) for x in table.column("score").to_pylist())
        return pa.table({"part": [table.column("part")[0].as_py()], "score": [total.tobytes()]}, kind)

    with _few_bytes(blocks.sparkSession), shuffles_dropped(blocks.sparkSession):
        partial = blocks.drop("term").mapInArrow(through, "part long, score binary")
        found = (partial.groupBy("part").applyInArrow(added, "part long, score binary") if tasks > 1 else partial).collect()
    return np.concatenate([np.frombuffer(r["score"], np.float64) for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(size)


def _scores_of(blocks: DataFrame, n_docs: int, value: np.ndarray, tasks: int) -> np.ndarray:
    """V V' value for the columns V: each task sends the values of the documents through its columns and back."""
    sent = blocks.sparkSession.sparkContext.broadcast(value)
    out = _added(blocks, n_docs, value.size, lambda length, at, no, v: v * np.repeat(np.add.reduceat(v * sent.value[no], at), length), tasks)
    sent.unpersist()
    return out


def _coefficients(blocks: DataFrame, n_docs: int, value: np.ndarray) -> DataFrame:
    """V' value in long form (term, coef)."""
    sent = blocks.sparkSession.sparkContext.broadcast(value)

    def through(batches):
        for batch in batches:
            for r, (_, at, no, v) in enumerate(_columns_of(batch, n_docs)):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("term"))[r].values, pa.array(np.add.reduceat(v * sent.value[no], at))], ["term", "coef"])

    return blocks.mapInArrow(through, "term string, coef double")


def _best_step(pos, neg, z, along, b, linear, square):
    """Step t along a direction and the intercept that minimise the (convex) loss: Newton's method in two variables, halved where it overshoots."""
    def loss(t, b):
        m = z + t * along + b
        return float(pos @ np.logaddexp(0, -m) + neg @ np.logaddexp(0, m)) + t * linear + 0.5 * t * t * square

    t, now = 0.0, loss(0.0, b)
    for _ in range(50):
        p = expit(z + t * along + b)
        r, d = (pos + neg) * p - pos, (pos + neg) * p * (1 - p)
        grad = np.array([along @ r + linear + t * square, r.sum()])
        hess = np.array([[along @ (d * along) + square, along @ d], [along @ d, d.sum()]])
        move = np.linalg.lstsq(hess, -grad, rcond=None)[0]
        share = 1.0
        while (after := loss(t + share * move[0], b + share * move[1])) > now and share > 1e-9:
            share /= 2
        if after > now:
            break
        t, b, done = t + share * move[0], b + share * move[1], now - after <= 1e-15 * abs(now)
        now = after
        if done:
            break
    return t, b


def fit_logistic(scores, pos: np.ndarray, neg: np.ndarray, penalty: float, max_iter: int = 200, tolerance: float = 2.5e-6):
    """Logistic regression with an L2 penalty on the coefficients, none on the intercept, by L-BFGS. All coefficient vectors it meets are
    X' a for values a of the documents, so it holds a and X X' a (``scores``, one pass over the data per step) and never a coefficient.
    ``pos`` and ``neg`` count the rows of either label per document. Ends when the gradient, divided by the penalty a bound of the
    error of the coefficients, is at most ``tolerance``. Returns (a, intercept)."""
    n = pos.size
    a, z = np.zeros(n), np.zeros(n)
    b = float(np.log(pos.sum() / neg.sum()))
    g = (pos + neg) * expit(z + b) - pos
    kg = scores(g)
    pairs: list[tuple] = []
    for _ in range(max_iter):
        if np.sqrt(max(g @ kg, 0.0)) <= tolerance:
            break
        q, kq, shares = -g, -kg, []
        for s, ks, y, ky, sy in reversed(pairs):
            shares.append(share := (s @ kq) / sy)
            q, kq = q - share * y, kq - share * ky
        if pairs:
            s, ks, y, ky, sy = pairs[-1]
            q, kq = q * (sy / (y @ ky)), kq * (sy / (y @ ky))
        for (s, ks, y, ky, sy), share in zip(pairs, reversed(shares), strict=True):
            back = share - (y @ kq) / sy
            q, kq = q + back * s, kq + back * ks
        t, b = _best_step(pos, neg, z, kq, b, penalty * (a @ kq), penalty * (q @ kq))
        s, ks = t * q, t * kq
        a, z = a + s, z + ks
        r = (pos + neg) * expit(z + b) - pos
        new, knew = r + penalty * a, scores(r) + penalty * z
        y, ky = new - g, knew - kg
        g, kg = new, knew
        sy = s @ ky
        if not sy > 0:  # nothing left to gain in double precision
            break
        pairs = [*pairs, (s, ks, y, ky, sy)][-MEMORY:]
    return a, b


def sentiment_logits(docs: DataFrame, model: SentimentModel, vocab: DataFrame, n_docs, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, logit without the intercept) of the documents with terms in the vocabulary."""
    x = _term_counts(docs.filter(F.col(id_col).isNotNull()), id_col, text).join(model.coefficients, "term")
    x = x.select(id_col, ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("v"), "coef")
    return x.groupBy(id_col).agg((F.sum(F.col("v") * F.col("coef")) / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("_logit"))


def fit_sentiment(df: DataFrame, label: str = "label", id_col: str = "doc_id", text: str = "text", c: float = 4.0,
                  seed: int = 42):
    """TF-IDF (fit on the training split only) + logistic regression with C=4 (regParam 1/(C n)).
    Returns (model, vocab, test predictions with ``proba`` and ``pred``, n_docs).

    The term counts lie packed by columns in the checkpoint folder. The solver works on values per training document: the driver holds some
    40 numbers for each of them, nothing as long as the vocabulary, and the coefficients are a table."""
    split = packed_copy(stratified_split(packed_copy(df.select(id_col, text, label)), label, id_col, 0.25, seed))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    y = F.col(label).cast("double")
    if train.filter(y.isNull() | ~y.isin(0.0, 1.0)).limit(1).count():
        raise ValueError("labels must be 0 or 1")
    counted = train.groupBy(id_col).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    counted = checkpoint(global_order_index(counted, [F.asc(id_col)], out="_no"))
    known = counted.select("_no", "pos", "neg").toArrow()
    if not known.num_rows:
        raise ValueError("no labelled rows to train on")
    order = np.argsort(known.column("_no").to_numpy())
    pos, neg = (known.column(x).to_numpy()[order] for x in ("pos", "neg"))
    # dealt by number, not left to what the join makes of its sizes, as tokenising takes longer than reading
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    numbers = counted.select(F.col(id_col).alias("_id"), "_no").repartition(parts, "_id")
    numbered = train.select(id_col, text).repartition(parts, id_col).join(numbers, F.col(id_col) == F.col("_id")).select("_no", text)
    numbered = numbered.unionByName(train.filter(F.col(id_col).isNull()).select(F.lit(-1).cast("long").alias("_no"), text))
    columns = term_columns(numbered, "_no", text)
    vocab, n_docs = tfidf_vocabulary(train, id_col=id_col, text=text, columns=columns)
    values = columns.agg(F.sum(F.length("no"))).first()[0] or 0
    # at most two tasks a core: each sends back sums of all documents
    tasks = int(max(1, min(2 * df.sparkSession.sparkContext.defaultParallelism, values // 4 // TASK_VALUES)))
    blocks = columns.coalesce(tasks)
    norm = np.sqrt(_added(blocks, n_docs, pos.size, lambda length, at, no, v: v * v, tasks))
    scale = np.divide(1.0, norm, out=np.zeros(pos.size), where=norm > 0)
    if pos.sum() and neg.sum():
        a, intercept = fit_logistic(lambda v: scale * _scores_of(blocks, n_docs, scale * v, tasks), pos, neg, 1.0 / c)
    else:  # one label only
        a, intercept = np.zeros(pos.size), float("inf") if pos.sum() else float("-inf")
    fitted = packed_copy(vocab.join(_coefficients(columns, n_docs, scale * a), "term"))
    model = SentimentModel(fitted.select(F.col("index").cast("long").alias("index"), "coef", "term", "idf"), intercept)
    logit = F.coalesce(F.col("_logit"), F.lit(0.0)) + F.lit(intercept)
    pred = test.join(sentiment_logits(test, model, vocab, n_docs, id_col, text), id_col, "left") \
        .withColumn("proba", 1.0 / (1.0 + F.exp(-logit))).withColumn("pred", (F.col("proba") >= 0.5).cast("int"))
    return model, fitted.drop("coef"), pred.select(id_col, text, label, "proba", "pred"), n_docs


def top_ngrams(model: SentimentModel, vocab: DataFrame, n: int = 12) -> DataFrame:
    """Strongest positive and negative n-gram coefficients; their table holds the terms of the vocabulary."""
    j = model.coefficients.select(F.col("index").cast(vocab.schema["index"].dataType).alias("index"), "term", "coef")
    pos = j.orderBy(F.desc("coef"), F.asc("term")).limit(n).withColumn("direction", F.lit("positive"))
    neg = j.orderBy(F.asc("coef"), F.asc("term")).limit(n).withColumn("direction", F.lit("negative"))
    return pos.unionByName(neg)


def explain_sentiment(model: SentimentModel, vocab: DataFrame, docs: DataFrame, n_docs, id_col: str = "doc_id", text: str = "text",
                      top: int = 5) -> DataFrame:
    """Per document, the n-grams contributing most (tf-idf weight x coefficient), from the long-form
    weights (no dense vocabulary-sized arrays)."""
    contrib = tfidf_weights(docs, model.coefficients, n_docs, id_col, text, also=("coef",)).filter("coef != 0") \
        .withColumn("contribution", F.col("w") * F.col("coef"))
    wdw = Window.partitionBy(id_col).orderBy(F.desc(F.abs("contribution")), F.asc("term"))
    return contrib.withColumn("rank", F.row_number().over(wdw)).filter(F.col("rank") <= top) \
        .select(id_col, "rank", "term", fround("contribution", 6).alias("contribution"))


def misclassified(pred: DataFrame, label: str = "label") -> DataFrame:
    """Test rows whose predicted class differs from the label."""
    return pred.filter(F.col("pred") != F.col(label).cast("int"))
