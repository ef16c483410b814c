"""Operator 9: interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by the scoring workers.

``scored`` learns from the texts that are not held out and gives the log10 probability of every text.

Method. Tokens are the words (A-Z lower-cased) and one end per text; a text starts in the context of a start mark. Slices
of texts send their distinct words, and then their distinct bigrams with counts, to hash ranges; each range is sorted and merged
in one task and stored in the shared folder as sorted arrays: word hashes (a word's number is its place), bigrams
(numbers of both words), and per word its count, its followers (how often, and how many followers are seen once, twice and
more often) and its number of distinct predecessors. Scoring workers map the arrays and look words and bigrams up by binary
search; nothing is broadcast but the sizes of the ranges.

  p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v.) + g(v) * p(w),   p(w) = max(N(.w) - E(N(.w)), 0) / N(..) + h / (V + 1)

with the three discounts D, and E for the lower order, from the counts of counts (a missing count of counts gives no discount
beyond 1/2), g and h so that all adds up to one, N the numbers of distinct predecessors. A context that was never seen
uses p(w). An empty training set gives p = 1 / (V + 1) = 1.

Word identity is a 64-bit hash; word numbers have 32 bits. Array files are written under temporary names and renamed,
so a task that runs twice leaves the same files.

Defined cases: a null or empty text is its end token. A null id is not held out. Repeated ids are scored row by row. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.spark_tools import checkpoint, shared_dir

END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of text whose words or bigrams are merged before they are sent.
MERGE_BYTES = 12 << 20
RANGE_WORDS = 1_500_000
RANGE_BIGRAMS = 4_000_000


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array to the shared folder under a temporary name, then rename it."""
    fs, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        np.lib.format.write_array(f, array, allow_pickle=False)
    fs.move(part, f"{path}/{name}")


@lru_cache(512)
def get(folder: str, name: str) -> np.ndarray:
    """Map an array; a copy is made only where the shared folder can't be mapped."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(f"{path}/{name}", mmap_mode="r")
    import tempfile
    with fs.open_input_stream(f"{path}/{name}") as f, tempfile.TemporaryFile() as copy:
        while piece := f.read(1 << 22):
            copy.write(piece)
        copy.seek(0)
        np.lib.format.read_magic(copy)
        shape, _, kind = np.lib.format.read_array_header_1_0(copy)
        return np.memmap(copy, kind, "r", copy.tell(), shape) if shape[0] else np.zeros(shape, kind)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses sorted differences well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def token_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and the place of each text's end."""
    t = K.Texts(blobs, lower=True)
    t.words()
    ends = t.word_off[1:] + np.arange(len(blobs))
    out = np.empty(len(t.word_hash) + len(blobs), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = t.word_hash
    return out, ends


def merged(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values of ``make(blobs)`` with counts, over about MERGE_BYTES of text at a time."""
    held, size = [], 0
    for _, blobs in K.slices(batches):
        held.append(np.unique(make(blobs), return_counts=True))
        size += sum(map(len, blobs))
        if size >= MERGE_BYTES:
            yield add_up([u for u, _ in held], [c for _, c in held])
            held, size = [], 0
    if held:
        yield add_up([u for u, _ in held], [c for _, c in held])


def add_up(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal values; sorted."""
    v, c = np.concatenate(values), np.concatenate(counts).astype(np.int64)
    order = np.argsort(v, kind="stable")
    v = v[order]
    first, _ = K.runs(v)
    return v[first], np.add.reduceat(c[order], first) if len(v) else c


class Words:
    """Number of a word: its place in the sorted hash arrays of all ranges, -1 if there is none."""

    def __init__(self, folder: str, starts: list[int]):
        self.folder, self.starts = folder, starts

    def numbers(self, h: np.ndarray) -> np.ndarray:
        u, back = np.unique(h, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        n = len(self.starts) - 1
        bounds = np.searchsorted(K.range_of(u, n), np.arange(n + 1))  # ranges are by the high bits, so sorted alike
        for r in range(n):
            a, b = bounds[r], bounds[r + 1]
            if a < b and self.starts[r] < self.starts[r + 1]:
                known = get(self.folder, f"words-{r}.npy")
                at = np.minimum(np.searchsorted(known, u[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == u[a:b], at + self.starts[r], -1)
        return out[back]


def pairs(numbers: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the token before each token; the start mark before a text's first."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = start
    return before, numbers


def count_words(train: DataFrame, folder: str, ranges: int) -> tuple[list[int], int]:
    """Store the sorted hashes and counts of each range; the first number of each range, and the number of tokens."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, c in merged(batches, lambda blobs: token_hashes(blobs)[0]):
            for r, uu, cc in K.split_by(K.range_of(u, ranges), ranges, u, c):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([uu.tobytes()]), pa.array([planes(cc.astype(np.uint32))])],
                                                 ["range", "values", "counts"])

    def store(table: pa.Table) -> pa.Table:
        u, c = add_up([np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()],
                      [unplanes(x, np.uint32) for x in table.column("counts").to_pylist()])
        r = table.column("range")[0].as_py()
        put(folder, f"words-{r}.npy", u)
        put(folder, f"counts-{r}.npy", c)
        return pa.table({"range": pa.array([r], pa.int32()), "words": pa.array([len(u)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    rows = train.mapInArrow(send, "range int, values binary, counts binary").groupBy("range").applyInArrow(
        store, "range int, words long, tokens long").collect()
    size = {r["range"]: r["words"] for r in rows}
    return [0, *np.cumsum([size.get(r, 0) for r in range(ranges)]).tolist()], sum(r["tokens"] for r in rows)


def count_bigrams(train: DataFrame, folder: str, starts: list[int], ranges: int) -> DataFrame:
    """Store the sorted bigrams of each range; per word range what they say about followers and predecessors."""
    total = starts[-1]
    edges = np.array(starts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(folder, starts)

        def make(blobs: list[bytes]) -> np.ndarray:
            h, ends = token_hashes(blobs)
            v, w = pairs(words.numbers(h), ends, total)
            return (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)

        for u, c in merged(batches, make):
            for r, uu, cc in K.split_by(K.range_of(K.mix(u), ranges), ranges, u, c):
                v, w = (uu >> np.uint64(32)).astype(np.uint32), uu.astype(np.uint32)
                many = np.flatnonzero(cc > 1).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([planes(np.diff(v, prepend=np.uint32(0)))]), pa.array([planes(w)]),
                     pa.array([many.tobytes()]), pa.array([cc[many].astype(np.uint32).tobytes()])], ["range", "v", "w", "many", "counts"])

    def store(table: pa.Table) -> pa.Table:
        values, counts = [], []
        for v, w, many, c in zip(*(table.column(k).to_pylist() for k in ("v", "w", "many", "counts"))):
            v = np.cumsum(unplanes(v, np.uint32), dtype=np.uint64)
            values.append((v << np.uint64(32)) | unplanes(w, np.uint32))
            one = np.ones(len(v), np.uint32)
            one[np.frombuffer(many, np.uint32)] = np.frombuffer(c, np.uint32)
            counts.append(one)
        u, c = add_up(values, counts)
        r = table.column("range")[0].as_py()
        put(folder, f"once-{r}.npy", u[c == 1])
        put(folder, f"more-{r}.npy", u[c > 1])
        put(folder, f"times-{r}.npy", c[c > 1])
        rows = [(-1, b"", np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64).tobytes(), len(u))]
        v, w = (u >> np.uint64(32)).astype(np.int64), (u & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first, _ = K.runs(v)
        seen = np.stack([c, c == 1, c == 2, c > 2], 1).astype(np.int64)
        sums = np.add.reduceat(seen, first, axis=0) if len(v) else seen
        for part, x, s in K.split_by(np.searchsorted(edges, v[first], side="right") - 1, len(edges), v[first].astype(np.uint32), sums):
            rows.append((2 * part, x.tobytes(), s.tobytes(), 0))
        x, n = np.unique(w, return_counts=True)
        for part, x, s in K.split_by(np.searchsorted(edges, x, side="right") - 1, len(edges), x.astype(np.uint32), n.astype(np.int64)):
            rows.append((2 * part + 1, x.tobytes(), s.tobytes(), 0))
        return pa.table({"part": pa.array([x[0] for x in rows], pa.int32()), "numbers": pa.array([x[1] for x in rows], pa.binary()),
                         "sums": pa.array([x[2] for x in rows], pa.binary()), "bigrams": pa.array([x[3] for x in rows], pa.int64())})

    return train.mapInArrow(send, "range int, v binary, w binary, many binary, counts binary").groupBy("range").applyInArrow(
        store, "part int, numbers binary, sums binary, bigrams long")


def store_statistics(parts: DataFrame, folder: str, starts: list[int]) -> list[int]:
    """Store followers (4 columns) and predecessors of each word range; counts of counts of the predecessors, and their sum."""
    edges = [*starts, starts[-1] + 1]  # the start mark has a range of its own

    def store(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        k, kind = divmod(part, 2)
        width = 1 if kind else 4
        out = np.zeros((edges[k + 1] - edges[k], width), np.int64)
        for x, s in zip(table.column("numbers").to_pylist(), table.column("sums").to_pylist()):
            out[np.frombuffer(x, np.uint32).astype(np.int64) - edges[k]] += np.frombuffer(s, np.int64).reshape(-1, width)
        put(folder, f"{'predecessors' if kind else 'followers'}-{k}.npy", out.astype(np.uint32 if kind else np.int64))
        found = np.bincount(np.minimum(out[:, 0], 5), minlength=6)[1:5].tolist() + [int(out.sum())] if kind else [0] * 5
        return pa.table({f"n{i}": pa.array([x], pa.int64()) for i, x in enumerate(found)})

    rows = parts.filter("part >= 0").groupBy("part").applyInArrow(store, ", ".join(f"n{i} long" for i in range(5))).agg(
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(5)]).first()
    return list(rows)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the counts of counts 1 to 4."""
    if not n[0]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.0), k + 0.0) if x > 0 else 0.5 for k, x in zip((1, 2, 3), d))])


class Model:
    """Sizes and discounts; the arrays stay in the shared folder."""

    def __init__(self, folder: str, starts: list[int], tokens: int, ranges: int, bigram_n: list[int], word_n: list[int]):
        self.folder, self.starts, self.tokens, self.ranges = folder, starts, tokens, ranges
        self.words = starts[-1]
        self.d, self.e = discounts(bigram_n), discounts(word_n[:4])
        self.types = word_n[4]
        seen = [*word_n[:2], self.words - word_n[0] - word_n[1]]
        self.spread = float(np.dot(self.e[1:], seen)) / self.types if self.types else 1.0

    def rows(self, name: str, numbers: np.ndarray, width: int, edges: list[int]) -> np.ndarray:
        """Rows of a dense array of all word ranges; zeros for unknown words."""
        out = np.zeros((len(numbers), width), np.int64)
        if not self.tokens:  # nothing was stored
            return out
        part = np.searchsorted(edges, numbers, side="right") - 1
        for k in np.unique(part[numbers >= 0]):
            at = np.flatnonzero((part == k) & (numbers >= 0))
            out[at] = np.asarray(get(self.folder, f"{name}-{k}.npy")[numbers[at] - edges[k]]).reshape(len(at), width)
        return out

    def times(self, u: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        out = np.zeros(len(u), np.int64)
        part = K.range_of(K.mix(u), self.ranges)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.ranges + 1))
        for r in range(self.ranges):
            at = order[bounds[r]:bounds[r + 1]]
            if len(at):
                for name in ("once", "more"):
                    known = get(self.folder, f"{name}-{r}.npy")
                    if len(known):
                        k = np.minimum(np.searchsorted(known, u[at]), len(known) - 1)
                        hit = known[k] == u[at]
                        out[at[hit]] = 1 if name == "once" else get(self.folder, f"times-{r}.npy")[k[hit]]
        return out

    def logs(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: whether it is known, its base log and its model log, both to base 10."""
        numbers = Words(self.folder, self.starts).numbers(h)
        u, back = np.unique(numbers, return_inverse=True)
        count = self.rows("counts", u, 1, self.starts)[:, 0]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        n = self.rows("predecessors", u, 1, self.starts)[:, 0]
        low = (n - self.e[np.minimum(n, 3)]) / max(1, self.types) + self.spread / (self.words + 1)
        v, w = pairs(numbers, ends, self.words)
        both = (v >= 0) & (w >= 0)
        key = (v[both].astype(np.uint64) << np.uint64(32)) | w[both].astype(np.uint64)
        x, place = np.unique(key, return_inverse=True)
        c = np.zeros(len(h), np.int64)
        c[both] = self.times(x)[place]
        y, at = np.unique(v, return_inverse=True)
        f = self.rows("followers", y, 4, [*self.starts, self.words + 1])
        total = np.maximum(f[:, 0], 1)
        left = np.where(f[:, 0] > 0, f[:, 1:] @ self.d[1:] / total, 1.0)
        p = (c - self.d[np.minimum(c, 3)]) / total[at] + left[at] * low[back]
        return count[back] > 0, base[back], np.log10(p)


def learn(train: DataFrame, folder: str, text_bytes: int) -> Model:
    ranges = 1 + text_bytes // (RANGE_WORDS * 40)
    starts, tokens = count_words(train, folder, ranges)
    ranges = 1 + tokens // RANGE_BIGRAMS
    parts = checkpoint(count_bigrams(train, folder, starts, ranges))
    n = np.zeros(4, np.int64)
    for r in parts.filter("part = -1").select("sums").toLocalIterator():
        n += np.frombuffer(r[0], np.int64)
    if not tokens:
        return Model(folder, starts, 0, 0, [0] * 4, [0] * 5)
    return Model(folder, starts, tokens, ranges, n.tolist(), store_statistics(parts, folder, starts))


def scored(df: DataFrame, text: str = "text", id: str = "doc_id", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row."""
    spark = df.sparkSession
    fold = F.coalesce(F.crc32(F.col(id).cast("string")) % folds, F.lit(1))
    docs = df.select(F.col(id).alias("doc_id"), (fold == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = docs.filter("not held_out").select("text")
    root = shared_dir(spark)
    folder = f"{root if '://' in root else 'file://' + root.removeprefix('file:')}/kneser-ney-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = learn(train, folder, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches):
            h, ends = token_hashes(blobs)
            known, base, score = model.logs(h, ends)
            first = np.concatenate([[0], ends[:-1] + 1])
            n = ends + 1 - first
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                 pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(np.add.reduceat(base, first)),
                 pa.array(np.add.reduceat(score, first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
