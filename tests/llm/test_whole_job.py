"""Cases in which an operator once did less than its whole job."""

import collections
import glob
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import prose, rows_of  # noqa: E402

from tessera.llm import decontaminate, jaccard_join, kneser_ney, licenses, line_frequency, materialise, packing, queries, spark_tools, suffix_dedup  # noqa: E402


@pytest.mark.parametrize("n", range(1, 9))
def test_slice_of_few_words(n):
    """A slice may hold fewer words in all than a shingle or a window."""
    text = prose(n, n).encode()
    assert [len(s) for s in jaccard_join.sets_of([text], 5)] == [max(1, n - 4)]
    assert line_frequency.measure([text])[0]["n_words"].tolist() == [n]


@pytest.mark.parametrize("n", (2, 3, 6))
def test_table_of_one_short_document(spark, n):
    df = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(n)), "s")], "doc_id long, text string, source string").coalesce(1)
    assert [(r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.linked(df))] == [(max(1, n - 4), 7)]
    assert [(r["n_words"], r["kept"]) for r in rows_of(line_frequency.quality(df))] == [(n, False)]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_long_licence_files(spark):
    """A licence file's lines and sentences count like those of any other file, and its folder inherits."""
    line = "Licensed under the Apache License, Version 2.0."
    wrapped = "This work is licensed\nunder the GNU General\nPublic License,\nversion 3."
    rows = [("a/LICENSE", MIT), ("a/b/c.txt", prose(2, 40)), ("d/LICENSE", prose(3, 300) + "\n" + line + "\n" + prose(4, 300)), ("d/e.txt", prose(5, 40)),
            ("f/g.txt", prose(3, 300) + "\n" + line + "\n" + prose(4, 300)), ("h/COPYING", prose(6, 200) + ".\n" + wrapped + "\n" + prose(7, 200)),
            ("i/LICENSE", prose(8, 200)), ("i/j.txt", prose(9, 40))]
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: (r["license"], r["origin"], r["cosine"]) for r in rows_of(licenses.scan(df))}
    assert [got[p][:2] for p, _ in rows] == [("MIT", "file"), ("MIT", "directory"), ("Apache-2.0", "file"), ("Apache-2.0", "directory"), ("Apache-2.0", "file"),
                                            ("GPL-3.0", "file"), (None, None), (None, None)]
    assert got["d/LICENSE"] == got["f/g.txt"]


def test_near_copies_with_null_ids(spark):
    """A null-id near copy has the component of its neighbour; two texts linked only through it are one component."""
    words = prose(30, 100).split()
    chain = [(1, " ".join(words)), (None, " ".join(["x", "y", *words[2:]])), (2, " ".join(["x", "y", *words[2:-9], *"abcdefghi"]))]
    other = prose(31, 60)
    df = spark.createDataFrame([*chain, (5, other), (None, other + " more"), (None, prose(32, 60))], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows_of(jaccard_join.linked(df))), key=repr)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (5, 5), (None, 5), (None, None)], key=repr)


def test_model_without_training_texts(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "some words here"), (held, None)], "doc_id long, text string")
    got = [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows_of(kneser_ney.scored(df))]
    assert sorted(got) == [(True, 1, 0, 0, 0.0, 0.0), (True, 4, 0, 0, 0.0, 0.0)]


def test_materialise_writes_its_shards(spark):
    """The registered query leaves all shards in the shared folder, and its digests are those of the files' records."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folders = lambda: set(glob.glob(f"{shared.removeprefix('file:').replace('//', '/')}/**/shards-*", recursive=True))
    before = folders()
    got = rows_of(queries.op3_materialise(spark, "/root/testdata/sf0.001"))
    (new,) = folders() - before
    files = {}
    for p in glob.glob(f"{new}/*"):
        with open(p, "rb") as f:
            files[os.path.basename(p)] = f.read()
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and sum(map(len, files.values())) == 2048 * len(got)
    for r in got:
        data = files[f"shard-{r['shard']:08d}.bin"][r["byte_offset"]:][:2048]
        assert zlib.crc32(data) == r["record_crc32"]
        assert zlib.crc32(b"".join(data[k:k + 2] + b"\0\0" for k in range(0, 2 * r["length"], 2))) == r["ids_crc32"]
    # a file cut short is noticed
    rows = materialise.stored(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), queries.public_tokenizers.path("byte_bpe_50k.json"), shard_size=64)
    (last,) = folders() - before - {new}
    os.truncate(f"{last}/shard-00000000.bin", 100)
    with pytest.raises(Exception, match="within a record"):
        rows.collect()


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


@pytest.mark.parametrize("size", ("sf0.01", "sf0.1"))
def test_reworded_copies(spark, size):
    """Copies with 30 to 50 % of the words replaced are found if the subsequence covers half of the item."""
    rnd = random.Random(5)
    docs, bench = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text")
    other = re.findall("[a-z]+", " ".join(r["text"] or "" for r in docs.limit(300).collect()).lower())
    planted, expected = [], set()
    for n, r in enumerate(r for r in sorted(bench.collect(), key=lambda r: r["item_id"])[:60] if len(r["text"].split()) > 12):
        words = re.findall(r"\w+", r["text"].lower())
        for k, share in enumerate((0.3, 0.4, 0.5)):
            copy = list(words)
            for at in rnd.sample(range(len(words)), int(share * len(words))):
                copy[at] = rnd.choice(other)
            planted.append((10_000_000 + 10 * n + k, " ".join([*rnd.choices(other, k=60), *copy, *rnd.choices(other, k=60)])))
            if 2 * subsequence(words, copy) >= len(words):
                expected.add((planted[-1][0], r["item_id"]))
    table = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.leaks(table, bench)) if r["doc_id"] >= 10_000_000}
    missed = expected - got
    print(size, len(expected), "planted,", len(missed), "missed", collections.Counter(d % 10 for d, _ in missed), len(got - expected), "more")
    assert len(expected) > 80 and len(missed) <= 0.05 * len(expected)


SCHEMA = "doc_id long, text string, source string, n_chars long"


def stage_texts(spark, stage, rows, folder=""):
    import corpus_pipeline
    out = dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame([(d, t, "s", len(t)) for d, t in rows], SCHEMA).repartition(3), folder)
    assert out.columns == ["doc_id", "text", "source", "n_chars"]
    got = rows_of(out)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return sorted(((r["doc_id"], r["text"]) for r in got), key=repr)


def test_stages_decide_by_row(spark, tmp_path):
    """Clean rows that share an id, or have none, stay; rejected and linked ones of the same id go."""
    alone = [(d, prose(40 + k, 60)) for k, d in enumerate([None, None, None, 7, 7])]
    copy = prose(60, 80)
    expect = lambda rows: sorted(rows, key=repr)
    assert stage_texts(spark, "quality_rules", [*alone, (7, "too short"), (None, "short, too")]) == expect(alone)
    assert stage_texts(spark, "near_duplicates", [*alone, (None, copy), (3, copy), (7, copy + " more"), (3, copy)]) == expect([*alone, (3, copy)])
    item = prose(70, 40)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaking = [(None, prose(71, 50) + " " + item), (7, item + " " + prose(72, 50))]
    assert stage_texts(spark, "benchmark_leaks", [*alone, *leaking], str(tmp_path)) == expect(alone)


def test_frequent_lines_leave_the_text(spark):
    """The stage takes frequent lines out of the documents that stay, wherever they stand; all other lines stay as they are."""
    plain = [(k, prose(200 + k, 40).replace("\n", "")) for k in range(30)]
    rows = [(d, ["Common  LINE 1 of the site\n" + t, t[:60] + "\n\n common line 2 of the site\n" + t[60:], t + "\nCOMMON line 3 of the site"][d % 3]) for d, t in plain]
    expected = [(d, [t, t[:60] + "\n\n" + t[60:], t][d % 3]) for d, t in plain]
    rare = [(100, "Rare line of the site\n" + prose(300, 40))]
    assert stage_texts(spark, "quality_rules", rows + rare) == sorted(expected + rare, key=repr)


CLASHES = ["_row", "row", "doc", "_kept", "kept", "_lines", "lines", "_judged", "judged", "_maybe", "_gone", "of", "order", "component_id", "text_hash", "a.b"]


@pytest.mark.parametrize("stage", ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks"])
def test_stages_carry_columns_of_any_name(spark, tmp_path, stage):
    import corpus_pipeline
    spark.createDataFrame([(0, prose(70, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, prose(400 + k, 50), "en", "s", 0, *[f"{n}{k}" for n in CLASHES]) for k in range(6)]
    rows.append((6, rows[0][1], "en", "s", 0, *["x"] * len(CLASHES)))
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in CLASHES))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == names
    got = {r[0]: tuple(r)[5:] for r in out.collect()}
    assert all(got[k] == tuple(f"{n}{k}" for n in CLASHES) for k in range(6)) and (6 in got) == (stage != "near_duplicates")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    from fixtures import empty
    spark.createDataFrame([(0, prose(70, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_latent_basis_from_all_blocks(spark, monkeypatch):
    """The basis of the method comes from every block of every text, however many there are."""
    import numpy as np
    monkeypatch.setattr(decontaminate, "SAMPLE_BLOCKS", 20, raising=False)
    texts = [prose(k, 100 + k) for k in range(60)] + ["", "same " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, prose(5, 30))], "item_id long, text string")
    features = decontaminate.features_of(docs)
    frequency, blocks = decontaminate.block_frequencies(features)
    idf = np.log((1.0 + blocks) / (1.0 + frequency)) + 1e-3
    got = decontaminate.latent_basis(features.unionByName(decontaminate.features_of(items)), idf)
    _, feature, first, _ = decontaminate.blocks_of([t.encode() for t in [*texts, prose(5, 30)]])
    a = np.zeros((len(first), decontaminate.FEATURES))
    np.add.at(a, (np.searchsorted(first, np.arange(len(feature)), side="right") - 1, feature), idf[feature])
    a /= np.sqrt([np.square(idf[feature[x:y]]).sum() for x, y in zip(first, np.append(first[1:], len(feature)))])[:, None]
    q, _ = np.linalg.qr(a.T @ (a @ np.random.default_rng(11).standard_normal((decontaminate.FEATURES, decontaminate.RANK + decontaminate.EXTRA))))
    _, w = np.linalg.eigh(q.T @ (a.T @ (a @ q)))
    plain = q @ w[:, ::-1][:, :decontaminate.RANK]
    assert np.linalg.svd(got.T @ plain)[1][:10].min() > 0.999


def test_sums_of_runs():
    import numpy as np
    rng = np.random.default_rng(3)
    matrix, at = rng.standard_normal((50, 4)), rng.integers(0, 50, 5000)
    end = np.cumsum([1, 31, 32, 33, 0, 3000, 7, 1100])
    first = np.append(0, end[:-1])
    plain = [matrix[at[a:b]].sum(axis=0) for a, b in zip(first, end)]
    assert np.allclose(decontaminate.sums(matrix, at, first, end), plain)


def test_new_plain_words_are_merged_together(spark):
    """The ids are the library's on awkward chunks, and words of letters that are new don't go to it one by one."""
    from tessera.llm.tokens import Encoder
    encoder = Encoder(queries.public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("etaoinshrdluETAéößñ", k=rnd.randint(1, 14)))
    odd = ["don't", "'s", "it's.", "a1b2", "2024,", "x==y", "ﬁn", "日本", "ǅ", "ɐ", "...", "-", "🙂", "×", "÷a", "one\ttwo", "\r", "a" * 90, "é" * 40, "<|endoftext|>", "\x0b", "l'été!"]
    texts = ["".join((word() if rnd.random() < 0.8 else rnd.choice(odd)) + rnd.choice([" ", " ", " ", ". ", "\n", ", ", "  ", " \n", "\n\n"]) for _ in range(60)) for _ in range(150)]
    texts += ["", " ", "\n", "a", " a", "\na", "a\n", "a ", *odd, *[" ".join(word() for _ in range(30)) for _ in range(150)]]
    whole = lambda t: np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    expected = [whole(t) for t in texts]
    assert encoder.encode_all(texts) == expected and encoder.encode_all(texts) == expected and [encoder.encode(t) for t in texts] == expected
    encoder.clear()

    class Counted:
        asked = 0

        def __getattr__(self, name, of=encoder.tokenizer):
            def call(texts, **options):
                Counted.asked += 1 if isinstance(texts, str) else len(texts)
                return getattr(of, name)(texts, **options)
            return call

    encoder.tokenizer = Counted()
    plain = [" ".join("".join(rnd.choices("abcdefghijkl", k=9)) + rnd.choice(["", "", ".", ","]) for _ in range(200)) for _ in range(20)]
    encoder.encode_all(plain)
    assert Counted.asked <= 10


def test_materialise_writes_in_passes(spark, monkeypatch):
    """No pass holds more than its share of the shards in shuffle files, and the copy of the pieces is compressed."""
    written = []

    def write(rows, folder, write=materialise.write_shards):
        written.append(sorted({r["shard"] for r in rows.select("shard").collect()}))
        return write(rows, folder)

    monkeypatch.setattr(materialise, "write_shards", write)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    copies = lambda: set(glob.glob(f"{shared.removeprefix('file:').replace('//', '/')}/**/pieces-*", recursive=True))
    before = copies()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(materialise.stored(docs, queries.public_tokenizers.path("byte_bpe_50k.json"), shard_size=16))
    shards = sorted({r["shard"] for r in got})
    assert len(shards) > 8 and sorted(sum(written, [])) == shards and max(map(len, written)) <= -(-len(shards) // 4)
    (copy,) = copies() - before
    assert sum(os.path.getsize(p) for p in glob.glob(f"{copy}/*.parquet")) < 2 * sum(r["length"] for r in got)


def test_workers_forget_the_words_of_a_task(spark):
    """Workers outlive their task: the words that it looked up don't stay in memory beside the next stage's."""
    from tessera.llm import packing
    path = queries.public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(k, " ".join(f"word{j}x" for j in range(k, k + 50))) for k in range(40)], "doc_id long, text string").coalesce(1)

    class Held:  # what the task is given, called here, as in a worker
        def select(self, *columns):
            return self

        schema = df.schema

        def mapInArrow(self, run, schema):
            return run

    run = packing.token_pieces(Held(), path)
    import pyarrow as pa
    from tessera.llm.tokens import encoder_of
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words", "more words"])], ["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2
    assert len(encoder_of(path)) == 0


def test_numbered_copy_is_compressed(spark):
    """Numbered texts lie in the shared folder compressed, row by row as they were; types that Parquet doesn't know go as they are."""
    rows = [(k // 2, None if k % 7 == 3 else " ".join([f"line {k % 5} of a text that comes again"] * 40), ("x", k)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` struct<c: string, d: long>").repartition(3)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    files = lambda: {p: os.path.getsize(p) for p in glob.glob(f"{shared.removeprefix('file:').replace('//', '/')}/**/*part-*", recursive=True)}
    before = files()
    got = spark_tools.numbered(docs, "row")
    assert sum(n for p, n in files().items() if p not in before) < sum(len(t or "") for _, t, _ in rows) / 4
    again = got.collect()
    assert len({r["row"] for r in again}) == len(rows)
    key = lambda x: (x[2][1],)
    assert sorted(((r["doc_id"], r["text"], tuple(r["a.b"])) for r in again), key=key) == sorted(rows, key=key)
    void = spark_tools.numbered(spark.createDataFrame([(1,), (2,)], "doc_id long").withColumn("none", F.lit(None)))
    assert sorted((r["doc_id"], r["none"]) for r in void.collect()) == [(1, None), (2, None)]


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_pieces_are_narrowed_where_they_are_made(spark):
    """Texts go through one Python worker on their way to the copy, which holds ids of the width asked for."""
    docs = spark.createDataFrame([(1, "some words " * 900), (2, None)], "doc_id long, text string")
    path = queries.public_tokenizers.path("byte_bpe_50k.json")
    wide, short = (packing.token_pieces(docs, path, with_ids=True, width=w) for w in (4, 2))
    assert python_steps(short) == 1
    ids = lambda df, kind: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"], np.frombuffer(r["ids"], kind).tolist()) for r in df.collect())
    got = ids(short, "<u2")
    assert got == ids(wide, "<u4") and all(len(x[4]) == x[2] for x in got) and len(got) == 3


def test_passages_are_found_in_two_passes(spark):
    """Units and anchors are counted in one pass; texts that nothing is cut from never go to Python again."""
    copy = prose(500, 200)
    rows = [(k, prose(501 + k, 60)) for k in range(5)] + [(9, copy), (6, copy), (7, copy + " and more"), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = docs.selectExpr("coalesce(doc_id, 9223372036854775807) as ord", "0L as row", "text")
    found = suffix_dedup.counted(table, 50, 3).collect()
    units = [r for r in found if r["key"] is not None]
    assert units and {r["low"] for r in units} == {6} and len({r["key"] for r in units}) == len(units)
    assert all(r["token"] is None and int.from_bytes(r["key"][:8], "little", signed=True) == r["head"] for r in units)
    out = suffix_dedup.removed(docs)
    assert python_steps(out) == 1
    assert {r["doc_id"]: r["n_removed"] for r in out.collect() if r["n_removed"]} == {k: len(copy) for k in (9, 7, None)}
