"""Operator 10: licence scan with inheritance along directories, in DataFrame operations only.

``scan`` finds the licence of each file from its header lines, or else from the nearest directory above it that has
a licence file.

Method. A unit is a line of a file; a licence file (by its name) has its sentences, across lines, and its whole text as units, too. Units and templates are sparse
TF-IDF vectors over their words (a-z and digits, stop words left out): tf * (1 + ln((1 + units) / (1 + units with the word))),
counted over all units that share a word with a template; any other unit has cosine 0 with each template. A unit takes
the licence of the template of greatest cosine, the first by name of equals, if that is at least ``threshold``; a file
takes its best unit. A
directory takes the best of its licence files. A file without a licence of its own inherits from the nearest directory on its path, the
file's own included, by joining its ancestors with the directories that have one.

The templates are a small table of notices given as an argument. Words, units and directories only meet in joins and aggregations that combine
before the shuffle.

Defined cases: a null text has no units; a null path is a file without directories. Repeated rows stay rows of their
own. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.spark_tools import checkpoint

# Notices by which files and licence files name their licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part of this work may be reproduced without written permission."),
]
# Words that say nothing about a licence.
STOP_WORDS = ["a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "except", "for", "from", "has", "in",
              "is", "it", "may", "no", "not", "of", "on", "or", "part", "that", "the", "this", "to", "use", "was", "with",
              "without", "you"]
#: Between sentences, and around blank lines.
SENTENCE_END = r"(?<=[.:;!?])\s+|\n[ \t]*\n\s*"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"


def words_of(text: Column) -> Column:
    """Words of a text without stop words; A-Z are lower-cased, other letters separate words."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def template_vectors(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """(notice, license, word, tf)."""
    rows = F.array(*[F.struct(F.lit(k).alias("notice"), F.lit(n).alias("license"), F.lit(t).alias("text"))
                     for k, (n, t) in enumerate(notices)])
    return (spark.range(1).select(F.explode(rows).alias("t"))
            .select("t.notice", "t.license", F.explode(words_of(F.col("t.text"))).alias("word"))
            .groupBy("notice", "license", "word").agg(F.count("*").alias("tf")))


def first() -> Column:
    """Of several, the greatest cosine (to 9 digits), then the first licence by name."""
    return F.min_by(F.struct("license", "cosine"), F.struct(-F.round("cosine", 9), F.col("license")))


def similar(units: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(row, license, cosine) of the best unit and template of each row that has one."""
    df = units.groupBy("word").agg(F.count("*").alias("df"))
    n = units.select("row", "unit").distinct().count()
    idf = 1 + F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0))))
    unit = units.join(df, "word").select("row", "unit", "word", (F.col("tf") * idf).alias("w"))
    template = vectors.join(df, "word", "left").select("notice", "license", "word", (F.col("tf") * idf).alias("tw"))
    lengths = template.groupBy("notice").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    norms = unit.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("un"))
    dots = (unit.join(template, "word").groupBy("row", "unit", "notice", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")))
    return (dots.join(norms, ["row", "unit"]).join(lengths, "notice")
            .withColumn("cosine", F.col("dot") / (F.col("un") * F.col("tn"))).filter(F.col("cosine") >= threshold)
            .groupBy("row").agg(first().alias("best")).select("row", "best.license", "best.cosine"))


def scan(files: DataFrame, path: str = "path", text: str = "text", id: str = "doc_id", threshold: float = 0.6,
         notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, path, license, cosine, origin (file or directory), from_directory.

    ``cosine`` belongs to the file's own unit, or to the licence file that it inherits from.
    """
    notices = notices or NOTICES
    terms = sorted({w for _, t in notices for w in re.split("[^a-z0-9]+", t.lower()) if w and w not in STOP_WORDS})
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_NAME), F.lit(False))
    split = F.split("text", "\n")
    parts = F.when(F.col("named"), F.array_distinct(F.concat(F.array("text"), split, F.split("text", SENTENCE_END)))).otherwise(split)
    known = F.array(*map(F.lit, terms))
    # one pass over the texts: the first line of each file stands for its row, other lines are kept if they are units
    lines = checkpoint(files.select(F.col(id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
                       .select(F.monotonically_increasing_id().alias("row"), "*", folder.alias("folder"), named.alias("named"))
                       .select("row", "doc_id", "path", "folder", "named", F.posexplode_outer(parts).alias("unit", "part"))
                       .select("row", "doc_id", "path", "folder", "named", F.coalesce("unit", F.lit(0)).alias("unit"), F.explode(F.array(words_of(F.col("part")))).alias("words"))
                       .withColumn("known", F.coalesce(F.arrays_overlap("words", known), F.lit(False))).filter("unit = 0 or known"))
    rows = lines.filter("unit = 0").drop("unit", "words", "known")
    units = checkpoint(lines.filter("known").select("row", "unit", F.explode("words").alias("word")).groupBy("row", "unit", "word").agg(F.count("*").alias("tf")))
    own = checkpoint(similar(units, template_vectors(files.sparkSession, notices), threshold))
    folders = rows.filter("named").join(own, "row").groupBy(F.col("folder").alias("above")).agg(first().alias("best"))
    lost = rows.join(own, "row", "left_anti").filter("path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = lost.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above"))
    near = (ancestors.join(folders, "above").groupBy("folder").agg(F.max_by(F.struct("above", "best"), F.length("above")).alias("near")))
    return (rows.join(own, "row", "left").join(near, "folder", "left").select(
        "doc_id", "path", F.coalesce("license", "near.best.license").alias("license"),
        F.round(F.coalesce("cosine", "near.best.cosine"), 9).alias("cosine"),
        F.when(F.col("license").isNotNull(), "file").when(F.col("near").isNotNull(), "directory").alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.above")).alias("from_directory")))
