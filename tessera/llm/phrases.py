"""Operator 13: phrase collocations by relational mining of occurrences (SETM).

``collocations`` gives for each language the best phrases of 2 to 5 words by an exact lift score.

Method.
1. Words are counted per language. An occurrence relation of length 1 holds every occurrence of a frequent word, sorted by piece
   and position; it is stored in the shared folder, cut into blocks of about ``BLOCK_WORDS`` words at texts (or pieces of very
   long texts), so every piece lies in one block.
2. A relation of length k is joined with itself by merging along its order: two occurrences at adjacent positions of a piece make
   one of length k + 1, since their overlap agrees. Each block groups and counts its own; Spark deals these counts by hash ranges
   and adds them up. Groups below ``least`` go.
3. The next relation keeps the occurrences whose group is frequent (semi-join) and is stored in turn. The semi-join asks a bitmap of
   fixed size, which may keep an occurrence too many: of a group too rare, whose extensions are too rare as well, so that all
   counts and the groups found are exact whatever the bitmap lets through.
4. Groups know the group of their first and of their last k - 1 words; joins along these give the words and the frequencies of
   all cuts. Scores are exact in decimals of 38 digits. A phrase is dropped if an extension by one word is as frequent (a
   longer phrase that holds it as often implies such an extension).

Words and groups are keyed by 64-bit hashes of their language and content. A block sends each of its groups once, so the most
frequent one reaches a range at most once per block.

Defined cases: a null text is empty; a null language is ``und``; repeated rows and ids count as often as they occur; ids are not
looked at, and neither are other columns, whatever their names. Ties of score and frequency are ordered by the bytes of the phrase.
An empty table gives no rows. A piece is handled whole by one task, which needs about sixty times its bytes; texts are cut between pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import kernel as K
from tessera.llm.spark_tools import bitmap, checkpoint, in_bitmap

LONGEST = 5
#: Words of a block of an occurrence relation, about.
BLOCK_WORDS = 1 << 19
#: Occurrences per hash range in which groups are counted together.
RANGE_WORDS = 2_000_000
#: Bits of the bitmap of frequent groups: 8 MB whatever the data.
BITMAP_BITS = 1 << 26
#: Parts of a language that find their own best phrases first.
SALTS = 16
#: A step to the next occurrence that is stored as this is as long or longer; steps of 1 are adjacent.
FAR = 255

BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = np.zeros(256, bool)
BREAK[list(BREAKS)] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True

RELATION = "grams binary, code binary, step binary"
EMPTY = np.zeros(0, np.uint64)


@lru_cache(1024)
def salt_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the group whose first words are of group ``left`` and whose last words are of group ``right``."""
    return K.mix(left * np.uint64(0x9E3779B97F4A7C15) + K.mix(right ^ np.uint64(0x632BE59BD9B4E019)))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text) of each row; texts above the size of a slice are cut after the last break before it, or the first after it."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for k, text in enumerate(batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            while len(text) > K.SLICE_BYTES:
                cut = max(text.rfind(c, 0, K.SLICE_BYTES) for c in BREAKS_OF)
                if cut < 0:
                    later = [c for c in (text.find(c, K.SLICE_BYTES) for c in BREAKS_OF) if c >= 0]
                    cut = min(later, default=len(text) - 1)
                yield langs[k], text[:cut + 1]
                text = text[cut + 1:]
            if text:
                yield langs[k], text


BREAKS_OF = [bytes([c]) for c in BREAKS]


def sliced(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Gather rows up to the size of a slice."""
    langs, texts, size = [], [], 0
    for lang, text in rows:
        if texts and size + len(text) > K.SLICE_BYTES:
            yield langs, texts
            langs, texts, size = [], [], 0
        langs.append(lang), texts.append(text)
        size += len(text) + 1
    if texts:
        yield langs, texts


class Block:
    """Words of some slices in order: key, step from the word before (1: adjacent in its piece), language, and where its bytes are."""

    def __init__(self, slices: list[tuple[list[str], K.Texts]]):
        key, step, lang, start, size, self.langs, at = [], [], [], [], [], [], 0
        for langs, t in slices:
            n = len(t.word_hash)
            owner = np.repeat(np.arange(len(langs)), np.diff(t.word_off))
            salt = np.array([salt_of(x) for x in langs], np.uint64)
            key.append(K.mix(t.word_hash ^ salt[owner]))
            breaks = np.cumsum(BREAK[t.data], dtype=np.int32)[t.word_start] if n else np.zeros(0, np.int32)
            apart = np.full(n, 2, np.uint8)
            apart[1:] -= breaks[1:] == breaks[:-1]
            step.append(apart), lang.append(owner + len(self.langs)), start.append(t.word_start + at), size.append(t.word_end - t.word_start)
            self.langs += langs
            at += len(t.data)
        self.key, self.step, self.lang, self.start, self.size = map(np.concatenate, (key, step, lang, start, size))
        self.slices = slices

    def bytes_of(self, words: np.ndarray) -> list[bytes]:
        data = b"".join(t.data.tobytes() for _, t in self.slices)
        return [data[a:a + n] for a, n in zip(self.start[words].tolist(), self.size[words].tolist())]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, words = [], 0
    for langs, texts in sliced(parts(batches)):
        t = K.Texts(texts, lower=True)
        t.words(SEPARATOR)
        del t.prefix
        held.append((langs, t))
        words += len(t.word_hash)
        if words >= BLOCK_WORDS:
            yield Block(held)
            held, words = [], 0
    if words:
        yield Block(held)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, gram, f) of the frequent words; the row of a null word has the number of all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            gram, at, count = np.unique(b.key, return_index=True, return_counts=True)
            names, number = np.unique(b.langs, return_inverse=True)
            of = number[b.lang]
            total = np.bincount(of, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names[of[at]].tolist(), *names.tolist()]), pa.array([*b.bytes_of(at), *[None] * len(names)], pa.binary()),
                 pa.array([*K.long_of(gram).tolist(), *[0] * len(names)], pa.int64()), pa.array([*count.tolist(), *total.tolist()], pa.int64())],
                ["lang", "word", "gram", "f"])

    counted = docs.mapInArrow(run, "lang string, word binary, gram long, f long")
    return counted.groupBy("lang", "word", "gram").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("word").isNull())


def stored(gram: np.ndarray, code: np.ndarray, step: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A block of a relation: its groups, and for each occurrence in order the number of its group and the step from the one before."""
    return gram.tobytes(), code.astype(np.uint16 if len(gram) <= 1 << 16 else np.uint32).tobytes(), step.tobytes()


def read_back(gram: bytes, code: bytes, step: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = np.frombuffer(step, np.uint8)
    kind = np.uint32 if len(code) == 4 * len(step) and len(step) else np.uint16
    return np.frombuffer(gram, np.uint64), np.frombuffer(code, kind).astype(np.int64), step


def thinned(position: np.ndarray) -> np.ndarray:
    """Steps between sorted positions."""
    return np.minimum(np.diff(position, prepend=position[:1] - FAR), FAR).astype(np.uint8)


def batch_of(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(3)], ["grams", "code", "step"])


def first_relation(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of frequent words, one row per block."""
    wanted = bitmap(frequent, "gram", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            gram, code = np.unique(b.key, return_inverse=True)
            held = in_bitmap(wanted.value, K.long_of(gram))
            at = np.flatnonzero(held[code])
            position = np.cumsum(b.step, dtype=np.int64)[at]
            yield batch_of([stored(gram[held], (np.cumsum(held) - 1)[code[at]], thinned(position))])

    return docs.mapInArrow(run, RELATION)


def adjacent(gram: np.ndarray, code: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge-join of a block with itself at adjacent positions: place of each pair, number of its group, and of the groups left, right, how many."""
    at = np.flatnonzero(step[1:] == 1)
    pair, number, count = np.unique(code[at] * max(1, len(gram)) + code[at + 1], return_inverse=True, return_counts=True)
    left, right = np.divmod(pair, max(1, len(gram)))
    return at, number, gram[left], gram[right], count


def groups(relation: DataFrame, least: int, ranges: int) -> DataFrame:
    """(gram, first, last, f) of the frequent groups one word longer than the relation's; first and last are groups of the relation."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                _, _, left, right, count = adjacent(*read_back(*row))
                sent = [(r, a.tobytes(), b.tobytes(), c.astype(np.uint32).tobytes())
                        for r, a, b, c in K.split_by(K.range_of(joined(left, right), ranges), ranges, left, right, count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s[0] for s in sent], pa.int32()), *[pa.array([s[i] for s in sent], pa.binary()) for i in (1, 2, 3)]],
                    ["range", "first", "last", "counts"])

    def add(t: pa.Table) -> pa.Table:
        left, right, count = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
                              for c, kind in (("first", np.uint64), ("last", np.uint64), ("counts", np.uint32)))
        gram, at, number = np.unique(joined(left, right), return_index=True, return_inverse=True)
        f = np.bincount(number, count, len(gram)).astype(np.int64)
        keep = f >= least
        return pa.table({"gram": K.long_of(gram[keep]), "first": K.long_of(left[at[keep]]), "last": K.long_of(right[at[keep]]), "f": f[keep]})

    sent = relation.mapInArrow(send, "range int, first binary, last binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "gram long, first long, last long, f long")


def next_relation(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences one word longer, of frequent groups (semi-join)."""
    wanted = bitmap(frequent, "gram", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                gram, code, step = read_back(*row)
                at, number, left, right, _ = adjacent(gram, code, step)
                longer = joined(left, right)
                held = in_bitmap(wanted.value, K.long_of(longer))
                kept = held[number]
                if kept.any():
                    position = np.cumsum(step, dtype=np.int64)[at[kept]]
                    rows.append(stored(longer[held], (np.cumsum(held) - 1)[number[kept]], thinned(position)))
            if rows:
                yield batch_of(rows)

    return relation.mapInArrow(run, RELATION)


def described(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """gram, f, lang, phrase, heads and tails (frequencies of its first and of its last 1, 2, ... words) of groups one word longer."""
    first = shorter.select(F.col("gram").alias("first"), "lang", F.col("phrase").alias("head"), F.array_append("heads", F.col("f")).alias("heads"))
    last = shorter.select(F.col("gram").alias("last"), F.substring_index("phrase", " ", -1).alias("word"), F.array_append("tails", F.col("f")).alias("tails"))
    return (longer.join(first, "first").join(last, "last")
            .select("gram", "f", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "heads", "tails"))


def best_cut() -> F.Column:
    """(score, k, l, r) of the cut of the lowest score, the smallest k among equals."""
    wide = lambda c: c.cast("decimal(38,0)")

    def cut(k):
        left, right = F.element_at("heads", k), F.element_at("tails", F.size("heads") - k + 1)
        score = F.call_function("div", wide(F.lit(1000)) * wide(F.col("f")) * wide(F.col("n")), wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads")), cut))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language, by score, a and phrase."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = checkpoint(word_counts(docs, least))
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    words = counts.filter("word is not null")
    ranges = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS
    none = F.array().cast("array<bigint>")
    shorter = words.select("gram", "f", "lang", F.col("word").cast("string").alias("phrase"), none.alias("heads"), none.alias("tails"))
    relation = checkpoint(first_relation(docs, words))
    found = []
    for k in range(2, longest + 1):
        frequent = checkpoint(groups(relation, least, ranges))
        if k < longest:
            relation = checkpoint(next_relation(relation, frequent))
        shorter = checkpoint(described(frequent, shorter))
        held = frequent.select(F.col("first").alias("_in"), F.col("f").alias("_f")).unionByName(frequent.select(F.col("last").alias("_in"), F.col("f").alias("_f")))
        if found:
            found[-1] = found[-1].join(held, (F.col("gram") == F.col("_in")) & (F.col("f") == F.col("_f")), "left_anti")
        found.append(shorter)
    if not found:
        raise ValueError("phrases have two words at least")
    cut = reduce(DataFrame.unionByName, found).join(totals, "lang").withColumn("cut", best_cut())
    scored = cut.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
