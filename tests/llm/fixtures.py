"""Small tables with the awkward cases that every operator defines."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, token string, rule string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 8))) + ("\n" if rnd.random() < 0.05 else "")
                    for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows and ids, ties, short, long and non-Latin texts, shared passages."""
    shared = prose(1000, 70)
    texts = [prose(1, 60), prose(1, 60), None, "", "  \n\t ", "one", "Ünïcode ß 日本語 😀 " * 5, "a" * 400, "x y " * 300, prose(2, 2000),
             prose(3, 40) + " " + shared, prose(4, 30) + "\n" + shared + "\n" + prose(5, 30), shared, prose(1, 59) + " changed",
             "Released under the MIT License.\n" + prose(6, 30), "<|endoftext|> <s> ▁▁ \x0b \xa0", "the end. " * 40]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, prose(8, 30)), (0, texts[0]), (None, prose(9, 30)), (None, None)]
    return [(d, t, "en", f"src{(d or 0) % 2}" if d != 5 else None, len(t or ""), "r", "k", "t", "u") for d, t in rows]


def odd(spark: SparkSession):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
