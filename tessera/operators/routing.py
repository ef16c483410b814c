"""Complexity classification, model routing, cost estimates and cache replay.

The model catalog is configuration (tens of rows): candidates are the prompts x catalog product
with the catalog broadcast after a size check, and the best/second model per prompt is a
row_number over a partition of at most |catalog| rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import cooldown
from tessera.operators.common import checkpoint, prefix_sums
from tessera.functions import fround, word_count
from tessera.operators.common_join import broadcast_if_small

# 5-level complexity keyword lists (checked in this order, later lists override).
TRIVIAL_PATTERNS = ["translate", "번역", "what is", "define", "뭐야", "언제"]
SIMPLE_PATTERNS = ["summarize", "요약", "list", "how to", "어떻게"]
COMPLEX_PATTERNS = ["analyze", "분석", "compare", "비교", "code", "코드", "implement", "구현", "design", "설계",
                    "algorithm"]
EXPERT_PATTERNS = ["architecture", "아키텍처", "system design", "research", "optimize", "최적화", "strategic", "전략",
                   "investment", "투자"]
LEVELS = {1: "TRIVIAL", 2: "SIMPLE", 3: "MODERATE", 4: "COMPLEX", 5: "EXPERT"}
RECOMMENDED = {1: "gpt-4o-mini", 2: "gpt-4o-mini", 3: "claude-3.5-sonnet", 4: "claude-3.5-sonnet", 5: "claude-3-opus"}


def _any(text: Column, words: list[str]) -> Column:
    c = F.lit(False)
    for w in words:
        c = c | text.contains(w)
    return c


def classify_complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Level 1-5 and name, confidence, estimated tokens min(4000, 10*words + 200), tool/knowledge
    flags, recommended model. Keyword checks run in order TRIVIAL (< 15 words) -> SIMPLE ->
    COMPLEX -> EXPERT, each overriding the last; then > 100 words lifts to >= 4, > 50 words to >= 3."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    wc = word_count(F.col(text))
    triv = _any(low, TRIVIAL_PATTERNS) & (wc < 15)
    simp, comp, expe = _any(low, SIMPLE_PATTERNS), _any(low, COMPLEX_PATTERNS), _any(low, EXPERT_PATTERNS)
    level = (F.when(expe, 5).when(comp, 4).when(simp, 2).when(triv, 1).otherwise(3))
    conf = (F.when(expe, 0.75).when(comp, 0.8).when(simp, 0.8).when(triv, 0.85).otherwise(0.7))
    adjusted = (F.when((wc > 100) & (level < 4), 4).when((wc <= 100) & (wc > 50) & (level < 3), 3).otherwise(level))
    out = df.withColumn("word_count", wc).withColumn("level", adjusted.cast("int"))
    lv_name = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    rec = F.create_map(*[x for k, v in RECOMMENDED.items() for x in (F.lit(k), F.lit(v))])
    return (out.withColumn("complexity", lv_name[F.col("level")])
            .withColumn("confidence", conf)
            .withColumn("estimated_tokens", F.least(F.lit(4000), F.col("word_count") * 10 + 200).cast("int"))
            .withColumn("requires_tools", comp & (low.contains("code") | low.contains("코드")))
            .withColumn("requires_knowledge", expe)
            .withColumn("recommended_model", rec[F.col("level")]))


# 4-level task keywords.
CRITICAL_KW = ["결정", "판단", "의사결정", "critical", "decision", "중요한", "법적", "의료", "금융", "투자"]
COMPLEX_KW = ["코드", "프로그래밍", "알고리즘", "분석", "추론", "code", "programming", "algorithm", "analyze", "reason",
              "설계", "아키텍처", "최적화"]
SIMPLE_KW = ["뭐야", "무엇", "언제", "어디", "누가", "what", "when", "where", "who", "define", "번역", "translate", "요약",
             "summarize"]


def analyze_task(df: DataFrame, text: str = "text", out: str = "task_complexity") -> DataFrame:
    """First match of critical -> complex -> > 500 words complex / > 100 medium -> simple -> medium."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    wc = word_count(F.col(text))
    c = (F.when(_any(low, CRITICAL_KW), "critical").when(_any(low, COMPLEX_KW), "complex")
         .when(wc > 500, "complex").when(wc > 100, "medium").when(_any(low, SIMPLE_KW), "simple").otherwise("medium"))
    return df.withColumn(out, c)


# Model catalog (provider, prices per 1k tokens, max tokens, mean latency, quality 1-10).
MODEL_CATALOG = [
    ("gpt-4-turbo", "openai", 0.01, 0.03, 4096, 3000, 9.5),
    ("gpt-4o", "openai", 0.005, 0.015, 4096, 2000, 9.3),
    ("gpt-4o-mini", "openai", 0.00015, 0.0006, 4096, 1000, 8.0),
    ("gpt-3.5-turbo", "openai", 0.0005, 0.0015, 4096, 800, 7.5),
    ("claude-3-opus", "anthropic", 0.015, 0.075, 4096, 3500, 9.8),
    ("claude-3-sonnet", "anthropic", 0.003, 0.015, 4096, 2000, 8.5),
    ("claude-3-haiku", "anthropic", 0.00025, 0.00125, 4096, 500, 7.0),
    ("claude-3.5-sonnet", "anthropic", 0.003, 0.015, 4096, 1500, 9.2),
    ("gemini-pro", "google", 0.00025, 0.0005, 2048, 1200, 8.0),
    ("gemini-2.0-flash", "google", 0.0, 0.0, 8192, 800, 8.5),
]
CATALOG_SCHEMA = ("model string, provider string, input_cost_per_1k double, output_cost_per_1k double, "
                  "max_tokens int, avg_latency_ms int, quality_score double")
# Candidates per 4-level task complexity, in preference order.
TASK_TO_MODELS = {
    "simple": ["gpt-4o-mini", "claude-3-haiku", "gemini-2.0-flash", "gpt-3.5-turbo"],
    "medium": ["claude-3.5-sonnet", "gpt-4o", "claude-3-sonnet", "gemini-pro"],
    "complex": ["gpt-4-turbo", "claude-3.5-sonnet", "gpt-4o"],
    "critical": ["claude-3-opus", "gpt-4-turbo", "claude-3.5-sonnet"],
}
MIN_QUALITY = {1: 6.0, 2: 7.0, 3: 7.5, 4: 8.5, 5: 9.0}


def catalog_table(spark) -> DataFrame:
    return spark.createDataFrame(MODEL_CATALOG, CATALOG_SCHEMA).withColumn("catalog_order", F.monotonically_increasing_id())


def candidates(levels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every level (a handful of rows) paired with every catalog model; prompts never are, as a ranking depends on the level only."""
    return levels.crossJoin(catalog)


def route(df: DataFrame, catalog: DataFrame, weights=(0.3, 0.5, 0.2), max_cost: float | None = None,
          max_latency_ms: float | None = None, excluded=(), preferred=(), id_col: str = "prompt_id",
          text: str = "text") -> DataFrame:
    """Weighted routing after R01. Candidates pass excluded / max cost (500+500 tokens) / max latency /
    minimum quality per level; score = q/10*wq + (1 - min(1, in_cost/0.02))*wc + (1 - min(1, lat/5000))*ws
    with wq*1.3, wc*0.7 for levels 4-5 and wq*0.7, wc*1.3 for levels 1-2. Best = selected, second =
    fallback; no candidate -> gpt-4o-mini. Preferred models only break score ties."""
    wc, wq, ws = weights
    cls = classify_complexity(df, text)
    cat = catalog
    if excluded:
        cat = cat.filter(~F.col("model").isin(*excluded))
    if max_cost is not None:
        cat = cat.filter(0.5 * F.col("input_cost_per_1k") + 0.5 * F.col("output_cost_per_1k") <= max_cost)
    if max_latency_ms is not None:
        cat = cat.filter(F.col("avg_latency_ms") <= max_latency_ms)
    minq = F.create_map(*[x for k, v in MIN_QUALITY.items() for x in (F.lit(k), F.lit(v))])
    levels = df.sparkSession.createDataFrame([(k,) for k in MIN_QUALITY], "level int")
    pairs = candidates(levels, cat).filter(F.col("quality_score") >= minq[F.col("level")])
    hi, lo = F.col("level").isin(4, 5), F.col("level").isin(1, 2)
    aq = F.when(hi, wq * 1.3).when(lo, wq * 0.7).otherwise(wq)
    ac = F.when(hi, wc * 0.7).when(lo, wc * 1.3).otherwise(wc)
    score = (F.col("quality_score") / 10.0 * aq + (1 - F.least(F.lit(1.0), F.col("input_cost_per_1k") / 0.02)) * ac
             + (1 - F.least(F.lit(1.0), F.col("avg_latency_ms") / 5000.0)) * ws)
    pref_rank = F.lit(0)
    if preferred:
        pm = F.create_map(*[x for i, m in enumerate(preferred) for x in (F.lit(m), F.lit(i))])
        pref_rank = F.coalesce(pm[F.col("model")], F.lit(len(preferred)))
    w = Window.partitionBy("level").orderBy(F.desc("score"), pref_rank, "catalog_order")
    ranked = pairs.withColumn("score", score).withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    best = ranked.groupBy("level").agg(
        F.max(F.when(F.col("_r") == 1, F.col("model"))).alias("selected_model"),
        F.max(F.when(F.col("_r") == 2, F.col("model"))).alias("fallback_model"),
        F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("score"))
    strategy = ("quality_first" if wq > 0.6 else "cost_optimized" if wc > 0.5 else "speed_first" if ws > 0.4
                else "balanced")
    out = cls.join(F.broadcast(best), "level", "left")  # a row per level
    cat_cost = catalog.select(F.col("model").alias("selected_model"), "input_cost_per_1k", "output_cost_per_1k",
                              "avg_latency_ms")
    out = (out.withColumn("selected_model", F.coalesce(F.col("selected_model"), F.lit("gpt-4o-mini")))
           .withColumn("fallback_model", F.coalesce(F.col("fallback_model"), F.lit("gpt-3.5-turbo")))
           .withColumn("strategy", F.lit(strategy))
           .join(broadcast_if_small(cat_cost), "selected_model", "left"))
    half = F.floor(F.col("estimated_tokens") / 2)
    est = F.coalesce(half / 1000.0 * F.col("input_cost_per_1k") + half / 1000.0 * F.col("output_cost_per_1k"),
                     F.lit(0.001))
    return out.select(id_col, "complexity", "level", "selected_model", "fallback_model", "strategy",
                      fround("score", 6).alias("score"), fround(est, 8).alias("cost_estimate"),
                      F.coalesce(F.col("avg_latency_ms"), F.lit(1000)).alias("latency_estimate_ms"))


def route_by_strategy(df: DataFrame, catalog: DataFrame, strategy: str = "balanced", available=None,
                      id_col: str = "prompt_id", text: str = "text") -> DataFrame:
    """Candidates of the 4-level task complexity (R02), ranked by cost / quality / speed / balanced
    (quality*0.5 + 0.3/(in_cost+0.001) + 0.2/(latency+1)); ties keep the candidate order."""
    spark = df.sparkSession
    t = analyze_task(df, text)
    cand = spark.createDataFrame([(k, i, m) for k, ms in TASK_TO_MODELS.items() for i, m in enumerate(ms)],
                                 "task_complexity string, cand_order int, model string")
    if available is not None:
        cand = cand.filter(F.col("model").isin(*available))
    pairs = cand.join(catalog.drop("catalog_order"), "model")
    if strategy == "cost":
        key = [F.asc("input_cost_per_1k")]
    elif strategy == "quality":
        key = [F.desc("quality_score")]
    elif strategy == "speed":
        key = [F.asc("avg_latency_ms")]
    elif strategy == "balanced":
        bal = (F.col("quality_score") * 0.5 + (1 / (F.col("input_cost_per_1k") + 0.001)) * 0.3
               + (1 / (F.col("avg_latency_ms") + 1)) * 0.2)
        key = [F.desc(bal)]
    else:
        raise ValueError("strategy must be cost, quality, speed or balanced")
    w = Window.partitionBy("task_complexity").orderBy(*key, F.asc("cand_order"))
    best = pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("task_complexity", F.col("model").alias("selected_model"))
    # a row per task complexity
    return t.select(id_col, "task_complexity").join(F.broadcast(best), "task_complexity", "left").withColumn(
        "selected_model", F.coalesce(F.col("selected_model"), F.lit("gpt-4o-mini"))).withColumn(
        "strategy", F.lit(strategy))


def estimate_cost(df: DataFrame, catalog: DataFrame, text: str = "text", model: str = "model",
                  expected_output_tokens: int = 500, daily_budget: float = 10.0, spent_today=None) -> DataFrame:
    """Input tokens = len(text) // 4, estimated cost with the catalog prices, and whether the
    day's spend plus the estimate stays within budget."""
    cat = catalog.select(F.col("model").alias(model), "input_cost_per_1k", "output_cost_per_1k")
    out = df.join(broadcast_if_small(cat), model, "left")
    tokens = F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")
    cost = tokens / 1000.0 * F.col("input_cost_per_1k") + expected_output_tokens / 1000.0 * F.col("output_cost_per_1k")
    spent = spent_today if isinstance(spent_today, Column) else F.lit(float(spent_today or 0.0))
    return (out.withColumn("input_tokens", tokens).withColumn("estimated_cost", fround(cost, 8))
            .withColumn("within_budget", (spent + F.col("estimated_cost")) <= daily_budget)
            .drop("input_cost_per_1k", "output_cost_per_1k"))


def exact_cache_replay(df: DataFrame, ttl_seconds: int = 3600, id_col: str = "request_id", ts: str = "ts",
                       prompt: str = "prompt", model: str = "model", temperature: str = "temperature") -> DataFrame:
    """Which requests of a stream find a live entry of an exact-match cache. key = sha256("model:temp:prompt"); an entry is
    written at a miss with temperature 0, lives ``ttl_seconds`` and is not refreshed by hits.

    The writes of a key are a cooldown chain over the times of its requests with temperature 0 (``cooldown.fired``); every other
    request takes the last write before it, found by counting writes along one sorted order of all keys. No key is
    replayed in one task. Requests of one key and time are ordered by id; one without a time neither hits nor writes."""
    tf = F.coalesce(F.col(temperature).cast("double"), F.lit(0.0))
    key = F.sha2(F.concat_ws(":", F.col(model), F.format_string("%s", _py_float_text(tf)), F.col(prompt)), 256)
    life = int(ttl_seconds * 1_000_000)
    rows = checkpoint(df.select(F.col(id_col).cast("string").alias("request_id"), F.col(ts).alias("ts"), key.alias("cache_key"),
                                (tf > 0).alias("warm"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))
    times = checkpoint(rows.filter("not warm and t is not null").groupBy("cache_key", "t").agg(F.min("request_id").alias("writer"))
                       .withColumn("cooldown", F.lit(life)))
    writes = cooldown.fired(times, "cache_key").filter("fires").join(times.drop("cooldown"), ["cache_key", "t"]).select("cache_key", "t", "writer")
    order = ["cache_key", "t", "request_id", "write"]
    asked = rows.select("request_id", "ts", "cache_key", "t", F.lit(0).alias("write")).unionByName(
        writes.select(F.col("writer").alias("request_id"), "cache_key", "t", F.lit(1).alias("write")), allowMissingColumns=True)
    counted = checkpoint(prefix_sums(asked, order, ["write"]))  # a request comes before its own write
    entries = counted.filter("write = 1").select(F.col("write_cum").alias("_number"), F.col("cache_key").alias("_key"), F.col("t").alias("_t"), F.col("request_id").alias("_writer"))
    found = counted.filter("write = 0").join(entries, F.col("write_cum") == F.col("_number"), "left")
    hit = F.coalesce((F.col("cache_key") == F.col("_key")) & (F.col("t") < F.col("_t") + life), F.lit(False))
    own = entries.select(F.col("_key").alias("_own"), F.col("_writer").alias("_by"), F.col("_t").alias("_at"))
    marked = found.select("request_id", "ts", "cache_key", "t", hit.alias("cache_hit")).join(
        own, (F.col("cache_key") == F.col("_own")) & (F.col("request_id") == F.col("_by")) & (F.col("t") == F.col("_at")), "left")
    return marked.select("request_id", "cache_key", "cache_hit", F.when(F.col("_at").isNotNull(), F.col("ts").cast("timestamp_ntz")).alias("entry_written_at"))


def _py_float_text(c: Column) -> Column:
    """Python's str(float) for the common cases (0.0, 0.7, 1.0): Spark casts 0.0 to '0.0' as well."""
    return c.cast("string")


def semantic_lookup(queries: DataFrame, entries: DataFrame, threshold: float = 0.92, ttl_hours: float = 24.0,
                    top_k: int = 3, now=None, qid: str = "query_id") -> DataFrame:
    """Exact hit first (same normalised query and model, entry alive), else the ``top_k`` nearest
    cached entries by cosine over all entries; the first of them with similarity >= threshold, the
    query's model (null model = any) and a live entry is a semantic hit.

    queries: (query_id, query, model, embedding); entries: (entry_id, query, model, created_at, embedding).
    Embeddings are L2-normalised arrays (see ``vectors.embed_hash``); the entry side is broadcast only
    after a size check, otherwise a shuffle-based pairing of the two sides is used."""
    from tessera.operators.vectors import top_k_similar
    now_c = now if isinstance(now, Column) else (F.lit(now) if now is not None else F.current_timestamp())
    alive = F.col("created_at") > now_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_hours * 3600.0))
    e = entries.withColumn("_alive", alive)
    exact = (queries.alias("q").join(e.alias("e"), (F.col("q.query") == F.col("e.query"))
                                     & (F.col("q.model").isNull() | (F.col("q.model") == F.col("e.model"))))
             .filter(F.col("_alive"))
             .groupBy(F.col(f"q.{qid}").alias(qid)).agg(F.min("e.entry_id").alias("entry_id"))
             .withColumn("similarity", F.lit(1.0)).withColumn("hit_type", F.lit("exact")))
    rest = queries.join(exact.select(qid), qid, "left_anti")
    near = top_k_similar(rest.select(qid, "embedding"), e.select("entry_id", "embedding"), top_k, qid, "entry_id")
    near = (near.join(rest.select(qid, F.col("model").alias("_qm")), qid)
            .join(e.select("entry_id", F.col("model").alias("_em"), "_alive"), "entry_id"))
    ok = (F.col("similarity") >= threshold) & (F.col("_qm").isNull() | (F.col("_qm") == F.col("_em"))) & F.col("_alive")
    w = Window.partitionBy(qid).orderBy("rank")
    sem = (near.filter(ok).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
           .select(qid, "entry_id", "similarity", F.lit("semantic").alias("hit_type")))
    hits = exact.unionByName(sem)
    return queries.select(qid).join(hits, qid, "left").withColumn(
        "hit_type", F.coalesce(F.col("hit_type"), F.lit("miss")))
