"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
``documents``. The filtering stages hold each row as one struct beside its number and decide row by row. Defined cases: rows of equal
or null ids are rows of their own, and near-duplicate removal takes one of them only if it is linked with a row that stays; a null id
comes after all others; null texts count as empty; other columns ride along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_frequency, packing, suffix_dedup
from tessera.llm.spark_tools import checkpoint, numbered, parted, without

#: Its stages run models and graph searches that SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def held(docs: DataFrame) -> DataFrame:
    """(row, doc): a number for each row, and all its columns as one struct, so that no name of theirs can clash."""
    return numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "row")


def columns(rows: DataFrame, docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` from the struct, some of them replaced."""
    return [new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns]


def asked(rows: DataFrame, *names: str) -> DataFrame:
    """The row number and the named columns, as the operators read them."""
    return rows.select("row", *[F.col("doc").getField(n).alias(n) for n in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go, and from the others the lines found too frequent; n_chars follows."""
    rows = held(docs)
    judged = checkpoint(line_frequency.quality(asked(rows, "text", "source"), id="row").filter("not kept or removed_lines is not null")
                        .select(F.col("doc_id").alias("judged"), "kept", F.col("removed_lines").alias("lines")))
    clear, maybe = parted(rows, judged.select("judged"), "row")
    maybe = maybe.join(judged, F.col("row") == F.col("judged"), "left").filter("kept is null or kept")
    same = maybe.filter("lines is null").select("row", "doc")
    less = line_frequency.without_lines(maybe.filter("lines is not null").select("doc", F.col("doc.text").alias("text"), "lines"), "lines")
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clear.unionByName(same).select(columns(rows, docs)).unionByName(less.select(columns(less, docs, text=F.col("text"), n_chars=chars)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked rows the one of the smallest id stays, the first row of equal ids."""
    rows = held(docs)
    found = jaccard_join.linked(asked(rows, "text"), id="row").select(F.col("doc_id").alias("of"), "component_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    groups = checkpoint(rows.select("row", order.alias("order")).join(found, F.col("row") == F.col("of")).select("component_id", "row", "order"))
    first = groups.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias("first"))
    gone = checkpoint(groups.select("row").join(first, F.col("row") == F.col("first"), "left_anti"))
    return without(rows, gone, "row").select(columns(rows, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: bytes of passages that a document of a smaller id holds go from the text; n_chars follows."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    out = suffix_dedup.removed(docs, with_text=True, carry=rest)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    chars = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select([text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"doc_id.`{c}`").alias(c)
                       for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    rows = held(docs)
    leaks = decontaminate.leaks(asked(rows, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="row")
    return without(rows, checkpoint(leaks.select("doc_id").distinct()), "row").select(columns(rows, docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: all that is left, as pieces in sequences of at most 1024 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
