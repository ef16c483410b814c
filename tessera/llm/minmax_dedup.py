"""Operator 12: near duplicates by min-max hashing.

``near_duplicates`` gives one row per text with the size of its shingle set, its component under the relation
``100 * intersection >= percent * union`` and whether it stays.

Method.
1. Texts with the same set form one class (128-bit hash of the sorted shingle hashes); a class is one node from here.
2. A permutation of the 64-bit numbers (an odd multiple plus a shift) is evaluated once per shingle, and both its least and
   its greatest value over the set are kept. Each equals that of another set with a probability of the Jaccard similarity,
   so ``PERMUTATIONS`` evaluations give twice as many signature values, whose mean agreement is unbiased.
3. A band is the minima and maxima of two permutations (four values); nodes that agree in a band meet. With 20 bands a pair at
   the limit of 85 % is missed with a probability of (1 - 0.85 ** 4) ** 20 = 4e-7, a closer one less often.
4. Nodes that meet are confirmed on their full sets. Within a meeting place not all pairs are looked at: each node is compared
   with the place's hub, the node that meets most others over all bands, and what links is merged into components. In places that
   still hold several components, blocks of the largest one are then compared with blocks of all other nodes, and these with one
   another, inside tasks; only links leave a task. While that would send entries too often, such places take another hub instead.

Sets are of 64-bit hashes. Nothing is capped: a place of any size is cut into blocks, and each pair of blocks is a group of its own
(``meeting``).

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component. Rows with equal ids are
separate texts under one id: they may link, and a component's number is the smallest id in it (null only if all its ids are
null). ``kept`` is whether the id is that number; null ids count as equal to null. Other columns are not looked at, whatever
their names. An empty table gives no rows. A text is handled whole by one task, which needs about thirty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.jaccard_join import key_of, node_of, sets_of
from tessera.llm.meeting import met, node_components
from tessera.llm.spark_tools import bitmap, checkpoint, in_bitmap

BANDS = 20
#: Permutations of a band; each gives a minimum and a maximum.
ROWS = 2
PERMUTATIONS = BANDS * ROWS

MULTIPLIER = K.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
SHIFT = K.mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def min_max(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each permutation (rows) over each set (columns); ``first`` is where each set, not empty, begins in h."""
    low, high = np.empty((2, PERMUTATIONS, len(first)), np.uint64)
    for k in range(PERMUTATIONS):
        v = h * MULTIPLIER[k] + SHIFT[k]
        np.minimum.reduceat(v, first, out=low[k])
        np.maximum.reduceat(v, first, out=high[k])
    return low, high


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Key of each band (columns) of each set (rows); sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    low, high = min_max(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sets), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = K.mix(K.mix(x ^ low[k]) ^ high[k])
        out[:, b] = x
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, key (binary, null for an empty set), node (long form of the key), bands (binary); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches, size=K.SMALL_SLICE):
            sets = sets_of(blobs, words)
            n = np.array([len(s) for s in sets])
            keys = [key_of(s) for s in sets]
            some = np.flatnonzero(n)
            bands: list[bytes | None] = [None] * len(sets)
            if len(some):
                for k, row in zip(some, band_keys([sets[k] for k in some])):
                    bands[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([k if m else None for k, m in zip(keys, n)], pa.binary()),
                 pa.array(node_of(keys), mask=n == 0), pa.array(bands, pa.binary())], ["doc_id", "n_shingles", "key", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, node long, bands binary")


def entries_of(classes: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """(g, node): each node in the places of its bands; with a bitmap only in those in it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                g = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                if wanted is not None:
                    held = in_bitmap(wanted.value, g)
                    g, node = g[held], node[held]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(node)], ["g", "node"])

    return classes.select("node", "bands").mapInArrow(spread, "g long, node long")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, tokens (binary: sorted hashes) of the listed nodes, read again from one text of each."""
    wanted = bitmap(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches, size=K.SMALL_SLICE):
            sets = sets_of(blobs, words)
            at = node_of([key_of(s) for s in sets])
            keep = np.flatnonzero(in_bitmap(wanted.value, at) & (np.array([len(s) for s in sets]) > 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(at[keep]), pa.array([sets[k].tobytes() for k in keep], pa.binary())],
                ["doc_id", "node", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, tokens binary")
    named = classes.join(nodes, "node", "left_semi").select(F.col("node").alias("_of"), "n", "rep")
    same = (F.col("node") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    return found.join(named, same).select("node", "n", "tokens").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (whether it is the row's own); one row per input row."""
    docs = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = checkpoint(signed(docs, words))
    classes = checkpoint(rows.filter("n_shingles > 0").groupBy("key", "node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    meet = met(lambda wanted: entries_of(classes, wanted))
    if not meet.isEmpty():
        nodes = checkpoint(meet.select("node").distinct())
        sets = checkpoint(full_sets(docs, classes.select("node", "n", "rep"), nodes, words))
        comp = node_components(meet, nodes, sets, percent)
        lowest = comp.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("low"))
        named = comp.join(lowest, "comp").select("node", "low")
        classes = classes.join(named, "node", "left").withColumn("rep", F.coalesce("low", "rep"))
    component = F.coalesce("component_id", "doc_id")
    return (rows.join(classes.select("key", F.col("rep").alias("component_id")), "key", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
