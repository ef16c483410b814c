"""Operator 5: quality rules with cross-document line frequency.

``quality`` computes per-text measures and finds lines that too many documents of a host hold; ``without_lines`` takes them out of the texts.

Method. Each line is normalised (A-Z lower-cased, runs of separators as one space, digits as 0) and hashed. For each host
the distinct documents that hold a line are counted, exact copies of a text as one document, since a copied text is a matter of
deduplication and not boilerplate. A line of more than ``max(min_documents, share * documents of the host)`` documents
is removed; a document that keeps fewer than ``min_words`` words, or less than ``min_left`` of its words, is depleted
and rejected. Lines are counted in two aggregations, over (host, line, text) and then (host, line), both combined
before the shuffle, so that a hot host or line is no hot task; only lines above the limit are joined back.

Defined cases: a null or empty text has no words and fails the base rules. A null host is a host of its own. Rows with
equal ids stay rows of their own. Hash equality stands for equality of lines (64 bits within a host).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.spark_tools import checkpoint

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LETTER_START = (np.arange(256) & 0xC0) != 0x80
NORMAL = K.LOWER.copy()
NORMAL[48:58] = 48
WINDOW = 8

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_text(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of flagged bytes of each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[end] - total[start]


def repeated_words(t: K.Texts, window: int = WINDOW) -> np.ndarray:
    """Words per text that lie in a window of words found twice or more in that text."""
    n = len(t.word_hash)
    owner = np.repeat(np.arange(len(t.start)), np.diff(t.word_off))
    starts = np.flatnonzero(np.arange(n) + window <= t.word_off[owner + 1]) if n else np.zeros(0, np.int64)
    h, who = t.grams(window)[starts] if n else np.zeros(0, np.uint64), owner[starts]
    key = K.mix(h ^ K.mix(who.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first, size = K.runs(key[order])
    twice = starts[order[np.repeat(size > 1, size)]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + window, n), -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return total[t.word_off[1:]] - total[t.word_off[:-1]]


def line_spans(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: first word, one past the last word, text number."""
    if not len(t.word_start):
        z = np.zeros(0, np.int64)
        return z, z, z
    feeds = np.concatenate([[0], np.cumsum(t.data == 10)])  # the feed after each text separates texts, too
    line = feeds[t.word_start]
    first, size = K.runs(line)
    owner = np.searchsorted(t.word_off, first, side="right") - 1
    return first, first + size, owner


def normal_hashes(t: K.Texts, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hash of the normal form of each line: the words' normal hashes in order."""
    normal = K.rolling(NORMAL[t.data])
    words = K.span_hash(normal, t.word_start, t.word_end)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * K.powers(0xBF58476D1CE4E5B9, len(words)), out=sums[1:])
    inv = K.powers(pow(0xBF58476D1CE4E5B9, -1, 1 << 64), len(words) + 1)
    return K.mix((sums[past] - sums[first]) * inv[first] + (past - first).astype(np.uint64))


def measure(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Measures per text; per text the distinct hashes of its normal lines and their words; hash of the whole text."""
    t = K.Texts(blobs)
    t.words()
    out = {"n_words": np.diff(t.word_off),
           "word_chars": per_text(LETTER_START[t.data] & ~K.SEPARATOR[t.data], t.start, t.end),
           "n_symbols": per_text(SYMBOLS[t.data], t.start, t.end),
           "n_repeat_words": repeated_words(t)}
    first, past, owner = line_spans(t)
    # a line as it stands: from the byte after the last feed to the next feed
    feed = np.flatnonzero(t.data == 10)
    starts = np.concatenate([[0], feed + 1])[np.searchsorted(feed, t.word_start[first])] if len(first) else first
    ends = feed[np.searchsorted(feed, t.word_start[first])] if len(first) else first
    raw = K.span_hash(t.prefix, starts, ends)
    key = K.mix(raw ^ K.mix(owner.astype(np.uint64)))
    order = np.lexsort((np.arange(len(key)), key))
    begin, size = K.runs(key[order])
    again = np.ones(len(key), bool)
    again[order[begin]] = False
    out["n_dup_lines"] = np.bincount(owner, again, len(blobs)).astype(np.int64)
    line = normal_hashes(t, first, past)
    bounds = np.searchsorted(owner, np.arange(len(blobs) + 1))
    hashes, counts = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        u, at = np.unique(line[a:b], return_inverse=True)
        hashes.append(u.view(np.int64))
        counts.append(np.bincount(at, (past - first)[a:b], len(u)).astype(np.int64))
    return out, hashes, counts, K.long_of(K.span_hash(t.prefix, t.start, t.end))


def line_table(df: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source") -> DataFrame:
    """One row per input row: doc_id, host, measures, text_hash, lines (distinct normal lines: hash and words)."""
    cols = df.select(F.col(id).alias("doc_id"), F.col(host).cast("string").alias("host"),
                     F.col(text).cast("string").alias("text"))
    kind = cols.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, host string, {', '.join(f'{f} long' for f in FIELDS)}, text_hash long, "
              "line_hashes array<long>, line_words array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches):
            out, hashes, counts, whole = measure(blobs)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (hashes, counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(out[f], pa.int64()) for f in FIELDS), pa.array(whole), *lists],
                ["doc_id", "host", *FIELDS, "text_hash", "line_hashes", "line_words"])

    return cols.mapInArrow(run, schema)


def quality(df: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", min_documents: int = 20,
            share: float = 0.002, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """doc_id, the measures, base_failed, removed_words, removed_lines (hashes), kept; one row per input row."""
    rows = checkpoint(line_table(df, text, id, host).withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", "host", "text_hash",
                        F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select(
        "row", "host", "text_hash", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"))
    texts = rows.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("texts"))
    counts = (lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one"))
              .groupBy("host", "line").agg(F.count("one").alias("documents")).filter(F.col("documents") > min_documents))
    limit = F.greatest(F.lit(min_documents), F.col("texts") * share)
    frequent = (counts.join(texts, counts["host"].eqNullSafe(texts["host"])).filter(F.col("documents") > limit)
                .select(counts["host"].alias("f_host"), F.col("line").alias("f_line")))
    removed = (lines.join(frequent, lines["host"].eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
               .groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines")))
    left = F.col("n_words") - F.col("removed_words")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (rows.drop("line_hashes", "line_words").join(removed, "row", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
            .withColumn("base_failed", base)
            .withColumn("kept", ~base & (left >= min_words) & (left >= min_left * F.col("n_words")))
            .select("doc_id", "host", *FIELDS, "base_failed", "removed_words", "removed_lines", "kept"))


def without_lines(df: DataFrame, lines: str = "removed_lines", text: str = "text") -> DataFrame:
    """Rows of ``df`` without the column ``lines`` and without the lines of ``text`` whose normal hashes it holds.

    The other lines, blank ones too, stay as they are.
    """
    names = df.columns
    at = names.index(lines)
    others = [c for c in names if c != lines]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches, text):
            t = K.Texts(blobs)
            t.words()
            first, past, owner = line_spans(t)
            line = normal_hashes(t, first, past).view(np.int64)
            feeds = np.cumsum(t.data == 10)
            place = feeds[t.word_start[first]] - np.concatenate([[0], feeds])[t.start[owner]] if len(first) else first
            bounds = np.searchsorted(owner, np.arange(len(blobs) + 1))
            kept = []
            for blob, some, a, z in zip(blobs, b.column(at).to_pylist(), bounds[:-1], bounds[1:]):
                gone = set(place[a:z][np.isin(line[a:z], np.array(some or [], np.int64))].tolist())
                kept.append(b"\n".join(x for k, x in enumerate(blob.split(b"\n")) if k not in gone) if gone else blob)
            column = pa.array([x if v else None for x, v in zip(kept, b.column(names.index(text)).is_valid().to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([column.view(pa.string()) if c == text else b.column(names.index(c)) for c in others], others)

    return df.mapInArrow(run, df.drop(lines).schema)
