"""Operator 6: URL filters by rules and by segmented host names.

``judge`` splits each url into host and path, applies allow and block rules, and lets a classifier judge the rest.

Method. Host labels are runs of joined words ("bestbooks"); a unigram Viterbi splits them: the split of greatest
product of word probabilities, where words and counts come from a text column over all rows, and an unknown word of
k letters has probability 10 / (N * 10^k). Only distinct labels are split, and each label is joined with the counts of its own
substrings, so that no worker holds the vocabulary. A multinomial naive Bayes with add-one smoothing, learnt from all urls
that a rule decides, scores the host's words and the path's words (kept apart); digits count as one word. A url is blocked
if block scores higher than allow; on a tie, or without examples of both, it is allowed if allow has examples or none has.

Defined cases: a null url, or one without ``://``, has an empty host and path, and is judged by the classes' shares
alone. Repeated rows and ids are judged alike, row by row. Among rules of equal length the first fits. Empty tables give no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spark_tools import checkpoint

LONGEST_WORD = 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # the last one added is tested first
        of, slash, rest = r.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, count) of the a-z words of a column, mark-up left out."""
    plain = F.regexp_replace(F.col(text), "<[^>]*>", " ")
    words = F.explode(F.split(ascii_lower(plain), "[^a-z]+"))
    return (texts.select(words.alias("word")).filter((F.col("word") != "") & (F.length("word") <= LONGEST_WORD))
            .groupBy("word").agg(F.count("*").alias("count")))


def best_split(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Unigram Viterbi; ``known`` has counts of name[a:b]."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            c = known.get((start, end))
            p = math.log10(c / total) if c else 1 - math.log10(max(total, 1)) - (end - start)
            options.append((best[start][0] + p, -start))
        p, start = max(options)
        best.append((p, -start))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct a-z names."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    parts = (names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("a"))
             .select("name", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("a") + 1))).alias("k"))
             .select("name", "a", "k", F.substr("name", F.col("a"), F.col("k")).alias("word")))
    found = (parts.join(counts, "word").groupBy("name").agg(
        F.collect_list(F.struct((F.col("a") - 1).alias("start"), (F.col("a") - 1 + F.col("k")).alias("end"), "count")).alias("known")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_split(name, {(x["start"], x["end"]): x["count"] for x in known or ()}, total)
                   for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], texts: DataFrame, text: str, url: str = "url",
          id: str = "page_id") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, host_words (array), block_score (log odds; null by rule).

    ``rules`` are (allow or block, host/path prefix); ``texts[text]`` teaches the words.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")))
    hosts = rows.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.expr("regexp_extract_all(host, '[a-z]+|[0-9]+|[^a-z0-9.-]+', 0)")).alias("at", "name"))
    names = labels.select("name").filter(F.col("name").rlike("^[a-z]")).distinct()
    words = segment(names, word_counts(texts, text))
    split = (labels.join(words, "name", "left")
             .withColumn("words", F.coalesce("words", F.array(F.when(F.col("name").rlike("^[0-9]"), F.lit("0")).otherwise(F.col("name")))))
             .groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words")))
    hosts = checkpoint(hosts.join(split, "host", "left").withColumn("host_words", F.coalesce("host_words", F.expr("cast(array() as array<string>)"))))
    path_words = F.expr("transform(filter(split(lower(path), '[^a-z0-9]+'), x -> x != ''), "
                        "x -> concat('/', regexp_replace(x, '[0-9]+', '0')))")
    bags = checkpoint(rows.select("row", "host", "by_rule", path_words.alias("path_words")).join(hosts, "host")
                      .select("row", "by_rule", F.explode(F.concat("host_words", "path_words")).alias("word"))
                      .groupBy("row", "by_rule", "word").agg(F.count("*").alias("n")))
    n = lambda v: F.sum(F.when(F.col("by_rule") == v, F.col("n")).otherwise(0))
    model = checkpoint(bags.filter("by_rule is not null").groupBy("word").agg(n("allow").alias("a"), n("block").alias("b")))
    sums = model.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("v")).first()
    prior = {r["by_rule"]: r["count"] for r in rows.filter("by_rule is not null").groupBy("by_rule").count().collect()}
    allow, block = prior.get("allow", 0), prior.get("block", 0)
    odds = math.log(block / allow) if allow and block else 0.0
    word_odds = F.log((F.coalesce("b", F.lit(0)) + 1.0) / (sums["b"] + sums["v"] + 1.0)) - F.log(
        (F.coalesce("a", F.lit(0)) + 1.0) / (sums["a"] + sums["v"] + 1.0))
    scores = (bags.filter("by_rule is null").join(model, "word", "left").select("row", (F.col("n") * word_odds).alias("s"))
              .groupBy("row").agg(F.sum("s").alias("s")))
    score = F.when(F.col("by_rule").isNull(), F.coalesce("s", F.lit(0.0)) + odds)
    blocked = (score > 1e-9) if allow and block else F.lit(bool(block))
    return (rows.join(scores, "row", "left").join(hosts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "host_words", F.round(score, 6).alias("block_score")))
