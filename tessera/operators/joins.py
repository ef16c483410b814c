"""Lookup and relationship joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround
from tessera.operators.common_join import broadcast_if_small

# Model price list (USD per 1k tokens), wildcard patterns.
MODEL_PRICES = [
    ("claude-3-opus*", 0.015, 0.075, "anthropic", "premium"),
    ("claude-3.5-sonnet*", 0.003, 0.015, "anthropic", "standard"),
    ("claude-3-haiku*", 0.00025, 0.00125, "anthropic", "economy"),
    ("gpt-4o*", 0.005, 0.015, "openai", "standard"),
    ("gpt-4o-mini*", 0.00015, 0.0006, "openai", "economy"),
    ("gpt-3.5-turbo*", 0.0005, 0.0015, "openai", "economy"),
    ("gemini-1.5-pro*", 0.0035, 0.0105, "google", "standard"),
    ("gemini-1.5-flash*", 0.00035, 0.00105, "google", "economy"),
]
PRICE_SCHEMA = "model string, input_cost_per_1k double, output_cost_per_1k double, provider string, tier string"


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(MODEL_PRICES, PRICE_SCHEMA)


def lookup_model_cost(df: DataFrame, prices: DataFrame, model: str = "model", input_tokens: str = "prompt_tokens",
                      output_tokens: str = "completion_tokens") -> DataFrame:
    """Price by wildcard pattern (``*`` suffix = prefix match, else exact); the longest
    matching pattern wins. The theta join runs on the distinct model names only, and the result
    is joined back on equality, so event rows never meet the pattern list."""
    pat = prices.select(F.col("model").alias("_pattern"), "input_cost_per_1k", "output_cost_per_1k",
                        F.col("provider").alias("price_provider"), F.col("tier").alias("price_tier"))
    prefix = F.regexp_replace(F.col("_pattern"), r"\*$", "")
    is_wild = F.col("_pattern").endswith("*")
    models = df.select(F.col(model).alias("_m")).distinct()
    cand = models.join(broadcast_if_small(pat),
                       F.when(is_wild, F.col("_m").startswith(prefix)).otherwise(F.col("_m") == F.col("_pattern")))
    w = Window.partitionBy("_m").orderBy(F.desc(F.length(prefix)), F.asc("_pattern"))
    best = cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    out = df.join(best, df[model] == best["_m"], "left").drop("_m")
    cost = (F.coalesce(F.col(input_tokens), F.lit(0)) / 1000.0 * F.col("input_cost_per_1k")
            + F.coalesce(F.col(output_tokens), F.lit(0)) / 1000.0 * F.col("output_cost_per_1k"))
    return out.withColumn("price_cost_usd", fround(cost, 8)).withColumnRenamed("_pattern", "price_pattern")


def lookup_with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str = "unknown",
                        lookup_key: str | None = None) -> DataFrame:
    """Left equi lookup with a default for keys the lookup does not know."""
    lk = lookup_key or key
    lu = lookup.select(F.col(lk).alias("_lk"), F.col(value).alias("_lv")).dropDuplicates(["_lk"])
    out = df.join(broadcast_if_small(lu), df[key] == F.col("_lk"), "left")
    return out.withColumn(value, F.coalesce(F.col("_lv"), F.lit(default))).drop("_lk", "_lv")


def related_entities(edges: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """One-hop neighbours of the given entity names. Outgoing edges keep the relation,
    incoming edges are labelled ``inverse_<relation>``. Edges: (src, relation, dst)."""
    n = names.select(F.col(name).alias("entity")).distinct()
    out_e = edges.join(n, edges["src"] == n["entity"]).select("entity", "relation", F.col("dst").alias("neighbour"))
    in_e = edges.join(n, edges["dst"] == n["entity"]).select(
        "entity", F.concat(F.lit("inverse_"), F.col("relation")).alias("relation"), F.col("src").alias("neighbour"))
    return out_e.unionByName(in_e)
