"""Operator 4: benchmark decontamination by latent semantic retrieval.

``leaks`` finds the texts that hold a benchmark item, word for word or reworded.

Method. Texts are cut into blocks of ``BLOCK`` words; two neighbouring blocks are a passage. Words are hashed to ``FEATURES``
TF-IDF features, weighted by how many blocks of all texts hold them. A randomised SVD of the block-feature matrix
(Gaussian range finder with one power iteration; partial products summed in Spark) is fitted on the blocks of all texts
and of the items; every passage of every text is then projected and
compared by cosine with the projected parts of the items, except passages that hold none of the words that stand for an item: the
rarest ones, without which the exact check below can't pass. Candidates are checked exactly: longest common subsequence of
the item's words with the words around the passage. An item leaks if the subsequence covers ``direct`` of it, or ``reworded`` of it
and the answer stands there, too: the words of the answer column in a row if there is one, else ``ANSWER_WEIGHT`` of the
weight of the item's rare words. Those are the rarest of its words, one more than a reworded copy may lack.

The items are the stated query set; they go against all rows in blocks of ``QUERY_BLOCK`` items. Model size is fixed
(FEATURES x RANK), whatever the data.

Defined cases: a null or empty text holds no item; a null or wordless item leaks nowhere. Repeated items and repeated
rows are reported one by one. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.spark_tools import checkpoint

BLOCK = 24
FEATURES = 1 << 15
RANK = 48
EXTRA = 8
QUERY_BLOCK = 4000
ANSWER_WEIGHT = 0.25
COSINE = 0.15
#: Columns of the features that are summed together in one group.
STRIPE = 1024
#: Rows that are added one after the other; longer runs are cut and their parts added up.
RUN = 32
SEPARATOR = ~np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def blocks_of(blobs: list[bytes]) -> tuple[K.Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts; feature of each word; first word of each block; text of each block."""
    t = K.Texts(blobs, lower=True)
    t.words(SEPARATOR)
    counts = -(-np.diff(t.word_off) // BLOCK)
    owner = np.repeat(np.arange(len(blobs)), counts)
    first = t.word_off[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return t, (t.word_hash % np.uint64(FEATURES)).astype(np.int32), first, owner


def features_of(texts: DataFrame) -> DataFrame:
    """(words, sizes, held, blocks): for each slice of texts the features of their words and the words of each block, two bytes each;
    for each task a row more: the number of blocks that hold each feature, and of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(FEATURES, np.int64), 0

        def row(*values) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["words", "sizes", "held", "blocks"])

        for _, blobs in K.slices(batches):
            _, feature, first, _ = blocks_of(blobs)
            if len(first):
                size = np.diff(np.append(first, len(feature)))
                once = np.unique(np.repeat(np.arange(len(first)), size) * FEATURES + feature)
                total += np.bincount(once % FEATURES, minlength=FEATURES)
                blocks += len(first)
                yield row(feature.astype(np.uint16).tobytes(), size.astype(np.uint16).tobytes(), None, None)
        yield row(None, None, total.tobytes(), blocks)

    return texts.select("text").mapInArrow(run, "words binary, sizes binary, held binary, blocks long")


def block_frequencies(features: DataFrame) -> tuple[np.ndarray, int]:
    """Number of blocks that hold each feature, and of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for held, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[:FEATURES] += np.frombuffer(held, np.int64)
                total[FEATURES] += blocks
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    table = (features.filter("held is not null").select("held", "blocks").mapInArrow(run, "feature long, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(FEATURES + 1, np.int64)
    out[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def sums(matrix: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of the matrix's rows ``at[first:end]`` for each run [first, end), a row of all runs at a time."""
    size = end - first
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        stop = np.cumsum(parts)
        start = np.repeat(first, parts) + RUN * (np.arange(stop[-1]) - np.repeat(stop - parts, parts))
        part = sums(matrix, at, start, np.minimum(start + RUN, np.repeat(end, parts)))
        return sums(part, np.arange(len(part)), stop - parts, stop)
    longest = np.argsort(-size, kind="stable")
    begin, size = first[longest], size[longest]
    total = np.zeros((len(size), matrix.shape[1]), matrix.dtype)
    for k in range(size[0] if len(size) else 0):
        n = np.searchsorted(-size, -k, side="left")  # runs of more than k rows
        total[:n] += matrix.take(at[begin[:n] + k], axis=0)
    out = np.empty_like(total)
    out[longest] = total
    return out


def gram_product(features: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A^T (A right) for the matrix A of unit TF-IDF blocks; partial products are summed by stripes of features."""
    sc = features.sparkSession.sparkContext
    shared = sc.broadcast((idf.astype(np.float32), right.astype(np.float32)))
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = shared.value
        scaled = right * idf[:, None]
        out = np.zeros((FEATURES, width), np.float32)
        for words, sizes in ((w, s) for b in batches for w, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            feature, size = np.frombuffer(words, np.uint16), np.frombuffer(sizes, np.uint16).astype(np.int64)
            end = np.cumsum(size)
            first = end - size
            owner = np.repeat(np.arange(len(first)), size)
            norm = np.add.reduceat(idf[feature] ** 2, first)
            y = sums(scaled, feature, first, end) / norm[:, None]
            order = np.argsort(feature, kind="stable")
            start, n = K.runs(feature[order])
            f = feature[order[start]]
            out[f] += sums(y, owner[order], start, start + n) * idf[f][:, None]
        for k in range(0, FEATURES, STRIPE):
            part = out[k:k + STRIPE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()])], ["stripe", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("part").to_pylist())
        return pa.table({"stripe": table.column("stripe").slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()])})

    table = features.filter("words is not null").select("words", "sizes").mapInArrow(run, "stripe long, part binary").groupBy("stripe").applyInArrow(add, "stripe long, part binary").toArrow()
    out = np.zeros((FEATURES, width))
    for k, part in zip(table.column("stripe").to_pylist(), table.column("part").to_pylist()):
        out[k:k + STRIPE] = np.frombuffer(part, np.float32).reshape(-1, width)
    shared.unpersist()
    return out


def latent_basis(features: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """Right singular vectors (FEATURES x RANK) of the blocks of all texts and items, by a randomised range finder."""
    guess = np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA))
    q, _ = np.linalg.qr(gram_product(features, idf, guess))
    z = gram_product(features, idf, q)
    _, w = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return q @ w[:, ::-1][:, :RANK]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence with an item of ``size`` words given as word -> bit mask of its places."""
    full = (1 << size) - 1
    s = full
    for w in words:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def follows(words: list[int], answer: list[int]) -> bool:
    return any(words[k:k + len(answer)] == answer for k in range(len(words) - len(answer) + 1))


class Items:
    """One block of benchmark items, ready for search."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, basis: np.ndarray, direct: float, reworded: float):
        blobs = [(r[1] or "").encode() for r in rows]
        t, feature, first, owner = blocks_of(blobs)
        self.ids = [r[0] for r in rows]
        words = [t.word_hash[a:b] for a, b in zip(t.word_off[:-1], t.word_off[1:])]
        weight = [idf[feature[a:b]] for a, b in zip(t.word_off[:-1], t.word_off[1:])]
        self.size = [len(w) for w in words]
        self.masks: list[dict[int, int]] = []
        for w in words:
            masks: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)
        given = K.Texts([(r[2] or "").encode() for r in rows], lower=True)
        given.words(SEPARATOR)
        self.answer = [given.word_hash[a:b].tolist() for a, b in zip(given.word_off[:-1], given.word_off[1:])]
        # rarest first
        rarest = [np.lexsort((w, -i)) for w, i in zip(words, weight)]
        spare = lambda share, n: n - int(np.ceil(share * n)) + 1
        self.rare = [dict(zip(w[o[:spare(reworded, len(w))]].tolist(), i[o[:spare(reworded, len(w))]].tolist())) for w, i, o in zip(words, weight, rarest)]
        # a last block of less than half the words joins the words before it
        first = np.array([max(f, t.word_off[o]) if t.word_off[o + 1] - f >= BLOCK // 2 else max(t.word_off[o], t.word_off[o + 1] - BLOCK)
                          for f, o in zip(first, owner)], np.int64)
        parts = [feature[f:min(f + BLOCK, t.word_off[o + 1])] for f, o in zip(first, owner)]
        weighted = (basis * idf[:, None]).astype(np.float32)
        # A passage can only pass the check if it holds one of an item's rarest words: of n words, those that may all
        # be missing are fewer; of rare words, the last ones together are less than the weight asked for. An answer's first
        # word stands for the item, too.
        # ``need`` is the least weight of rare words around a passage that passes: that asked for, or what a direct copy keeps.
        word, of, stands, weighs = [], [], [], []
        self.need = np.zeros(len(rows))
        for k, (w, o) in enumerate(zip(words, rarest)):
            rare = list(self.rare[k])
            after = np.cumsum(list(self.rare[k].values())[::-1])[::-1]  # weight of each and all later ones
            rare = [x for x, v in zip(rare, after) if v >= ANSWER_WEIGHT * after[0]]
            stand = {*w[o[:spare(direct, len(w))]].tolist(), *(self.answer[k][:1] or rare)} if len(w) else set()
            for x in stand | self.rare[k].keys():
                word.append(x), of.append(k), stands.append(x in stand), weighs.append(self.rare[k].get(x, 0.0))
            if len(w) and not self.answer[k]:
                self.need[k] = min(ANSWER_WEIGHT * after[0], sum(list(self.rare[k].values())[spare(direct, len(w)) - 1:])) - 1e-6
        order = np.argsort(np.array(word, np.uint64), kind="stable")
        self.word, self.of = np.array(word, np.uint64)[order], np.array(of, np.int64)[order]
        self.known = np.zeros(FEATURES, bool)
        self.known[(self.word % np.uint64(FEATURES)).astype(np.int64)] = True
        self.stands, self.weighs = np.array(stands, bool)[order], np.array(weighs, np.float64)[order]
        self.first_part = np.searchsorted(owner, np.arange(len(rows)))
        self.has_part = np.bincount(owner, minlength=len(rows)) > 0
        self.vectors = unit(np.array([weighted[p].sum(axis=0) for p in parts], np.float32).reshape(len(parts), RANK))

    def hits(self, words: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of rare words and of words that stand for an item; the items, whether they stand for them, and their weights."""
        at = np.flatnonzero(self.known[feature])
        lo, hi = np.searchsorted(self.word, words[at], side="left"), np.searchsorted(self.word, words[at], side="right")
        held = hi > lo
        at, lo, n = at[held], lo[held], (hi - lo)[held]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.of[entry], self.stands[entry], self.weighs[entry]

    def closeness(self, passage: np.ndarray) -> np.ndarray:
        """Greatest cosine of each passage with a part of each item."""
        out = np.full((len(passage), len(self.ids)), -1.0, np.float32)
        at = self.first_part[self.has_part]
        for a in range(0, len(passage), 2048):
            out[a:a + 2048, self.has_part] = np.maximum.reduceat(passage[a:a + 2048] @ self.vectors.T, at, axis=1)
        return out

    def answered(self, k: int, words: list[int]) -> bool:
        if self.answer[k]:
            return follows(words, self.answer[k])
        rare = self.rare[k]
        return sum(rare[x] for x in rare.keys() & words) >= ANSWER_WEIGHT * sum(rare.values())


def passages(weighted: np.ndarray, feature: np.ndarray, first: np.ndarray, owner: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the passages that start with the given blocks."""
    after = np.minimum(some + 1, len(first) - 1)
    paired = (after > some) & (owner[after] == owner[some])
    ends = np.append(first, len(feature))
    out = np.empty((len(some), weighted.shape[1]), np.float32)
    for k, (a, b) in enumerate(zip(first[some], ends[np.where(paired, after, some) + 1])):
        out[k] = weighted[feature[a:b]].sum(axis=0)
    return unit(out)


def search(docs: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, direct: float, reworded: float, id_kind: str,
           item_kind: str, cosine: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, (basis * idf[:, None]).astype(np.float32)))
    fields = f"doc_id {id_kind}, item_id {item_kind}, lcs long, item_words long, cosine double, answered boolean"
    item_type = pa.int64() if item_kind in ("bigint", "long") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weighted = shared.value
        size = np.array(q.size, np.int64)
        for b, blobs in K.slices(batches):
            t, feature, first, owner = blocks_of(blobs)
            at, which, stands, weighs = q.hits(t.word_hash, feature)
            key = which * (len(t.word_hash) + 1) + at
            order = np.argsort(key, kind="stable")
            key, weight = key[order], np.concatenate([[0.0], np.cumsum(weighs[order])])
            at, which = at[stands], which[stands]
            if not len(at):
                continue
            block = np.searchsorted(first, at, side="right") - 1
            # the passages that hold the word: of its block and the next one, and of the block before and its own
            before = (block > 0) & (owner[block - 1] == owner[block])
            pairs = np.unique(np.concatenate([block * len(q.ids) + which, (block[before] - 1) * len(q.ids) + which[before]]))
            window, item = pairs // len(q.ids), pairs % len(q.ids)
            # of these, the ones with enough weight of rare words around them (repeated words count again)
            reach, place = size[item], item * (len(t.word_hash) + 1)
            lo = np.maximum(t.word_off[owner[window]], first[window] - reach)
            hi = np.minimum(t.word_off[owner[window] + 1], first[window] + 2 * BLOCK + reach)
            able = weight[np.searchsorted(key, place + hi)] - weight[np.searchsorted(key, place + lo)] >= q.need[item]
            window, item = window[able], item[able]
            if not len(window):
                continue
            some, place = np.unique(window, return_inverse=True)
            close = q.closeness(passages(weighted, feature, first, owner, some))[place, item]
            best: dict[tuple[int, int], tuple] = {}
            for w, k, c in zip(window.tolist(), item.tolist(), close.tolist()):
                if c < cosine:
                    continue
                doc = int(owner[w])
                reach = q.size[k]
                lo = max(t.word_off[doc], first[w] - reach)
                hi = min(t.word_off[doc + 1], first[w] + 2 * BLOCK + reach)
                words = t.word_hash[lo:hi].tolist()
                n = lcs(q.masks[k], reach, words)
                if n < reworded * reach:
                    continue
                said = q.answered(k, words)
                if n >= direct * reach or said:
                    found = (n, c, said)
                    if found > best.get((doc, k), (0,)):
                        best[doc, k] = found
            if best:
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([d for d, _ in keys])), pa.array([q.ids[k] for _, k in keys], item_type),
                     pa.array([best[x][0] for x in keys], pa.int64()), pa.array([q.size[k] for _, k in keys], pa.int64()),
                     pa.array([best[x][1] for x in keys], pa.float64()), pa.array([best[x][2] for x in keys], pa.bool_())],
                    ["doc_id", "item_id", "lcs", "item_words", "cosine", "answered"])

    return docs.mapInArrow(run, fields)


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id", answer: str | None = None, direct: float = 0.75, reworded: float = 0.5,
          cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, lcs, item_words, cosine, answered): each text that holds an item, with each item that it holds."""
    docs = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"),
                             (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))
    features = checkpoint(features_of(docs))
    frequency, blocks = block_frequencies(features)
    idf = np.log((1.0 + blocks) / (1.0 + frequency)) + 1e-3
    basis = latent_basis(features.unionByName(features_of(items)), idf)
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    out, rows = None, []

    def flush() -> None:
        nonlocal out, rows
        found = search(docs, Items(rows, idf, basis, direct, reworded), idf, basis, direct, reworded, id_kind, item_kind, cosine)
        out = found if out is None else out.unionByName(found)
        rows = []

    for r in items.toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == QUERY_BLOCK:
            flush()
    if rows or out is None:
        flush()
    return out
