"""Operator 2: n-gram Jaccard join, size-aware with a heavy-light boundary.

``linked`` gives one row per text with the size of its shingle set and its component under the relation
``100 * intersection >= percent * union``.

Method.
1. Texts with the same set form one class (128-bit hash of the sorted shingle hashes); a class is one node from here.
2. A node can only link if ``percent`` of its shingles occur in another class. Shingles are counted by hash ranges, which get
   each one with its class (8 bytes in all) and give back how many of each class's shingles are shared. Counting uses 32 bits of the
   shingle within a range and 32 bits of the class; agreement of two classes in these bits besides a shared shingle is ignored (2^-32).
3. The nodes that are left are ordered shingle by shingle: rarest first, by the number of nodes that hold it.
4. With overlap at least T(n) = ceil(percent * n / 100), two linked sets share k of their first n - T(n) + k shingles.
   Small sets enumerate the 2-subsets of that beginning (k = 2) and meet where they share one; sets from a boundary
   size on, and those small ones that can reach them, stand in inverted lists of single shingles (k = 1). The boundary
   is the size at which the sum of subsets enumerated and list entries scanned is least, from a table of costs by size.
5. Nodes that meet are compared exactly, by ``meeting``: with the hub of each place first, then blocks of the place's largest
   component with blocks of what is left, so that no link between components is lost and not all pairs of a place are looked at.

Sets are of 64-bit hashes of the words, so two texts are compared wrongly only if two of their own shingles collide.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component. Rows with equal
ids are separate texts under one id: they may link, and a component's number is the smallest id in it. Other columns
are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.meeting import met, node_components
from tessera.llm.spark_tools import bitmap, checkpoint, in_bitmap

#: Shingles counted in one group of a hash range.
RANGE_TOKENS = 500_000
#: Shingles that a task gathers before it sends them to their ranges.
SENT_TOKENS = 1 << 20
#: Nodes whose shingles are counted and answered together.
BATCH_NODES = 1500
READS = 5


def sets_of(blobs: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = K.Texts(blobs, lower=True)
    t.words()
    grams = t.grams(words) if len(t.word_hash) else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(t.word_off[:-1], t.word_off[1:]):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            h = np.uint64(b - a)
            for w in t.word_hash[a:b]:
                h = K.mix(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(keys: list[bytes]) -> np.ndarray:
    """First 8 bytes of each key as a signed number."""
    return np.frombuffer(b"".join(keys), "<i8")[::2]


def digests(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, key (binary, null for an empty set), node (long form of the key); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches, size=K.SMALL_SLICE):
            sets = sets_of(blobs, words)
            keys = [key_of(s) for s in sets]
            n = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([k if m else None for k, m in zip(keys, n)], pa.binary()),
                 pa.array(node_of(keys), mask=n == 0)], ["doc_id", "n_shingles", "key", "node"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, node long")


def shared_counts(df: DataFrame, words: int, ranges: int, parts: int) -> DataFrame:
    """(low, shared): low 32 bits of a node -> how many of its shingles occur in another class (at least; see step 2)."""
    half = np.uint64(32)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Per distinct class of some slices, its shingles; (hash, low bits of the node)."""
        held, size = {}, 0
        for _, blobs in K.slices(batches, size=K.SMALL_SLICE):
            for s in sets_of(blobs, words):
                if len(s) and (key := key_of(s)) not in held:
                    held[key] = s
                    size += len(s)
            if size >= SENT_TOKENS:
                yield held
                held, size = {}, 0
        if held:
            yield held

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in pairs(batches):
            h = np.concatenate(list(held.values()))
            low = np.repeat(node_of(list(held)).view(np.uint64) & np.uint64(0xFFFFFFFF), [len(s) for s in held.values()])
            sent = list(K.split_by(K.range_of(h, ranges), ranges, h << half | low))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in sent], pa.int32()), pa.array([x.tobytes() for _, x in sent], pa.binary())], ["range", "pairs"])

    def count(table: pa.Table) -> pa.Table:
        pair = np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.uint64).copy()
        pair.sort()
        pair = pair[K.runs(pair)[0]]  # copies of a class in several batches
        _, size = K.runs(pair >> half)
        low, shared = np.unique((pair & np.uint64(0xFFFFFFFF))[np.repeat(size > 1, size)], return_counts=True)
        sent = list(K.split_by((low % np.uint64(parts)).astype(np.int64), parts, low.astype(np.uint32), shared.astype(np.uint32)))
        return pa.table({"part": pa.array([p for p, _, _ in sent], pa.int64()), "nodes": pa.array([a.tobytes() for _, a, _ in sent], pa.binary()),
                         "shared": pa.array([b.tobytes() for _, _, b in sent], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        get = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32)
        low, at = np.unique(get("nodes"), return_inverse=True)
        return pa.table({"low": pa.array(low.astype(np.int64)), "shared": pa.array(np.bincount(at, get("shared"), len(low)).astype(np.int64))})

    counted = df.select("text").mapInArrow(send, "range int, pairs binary").groupBy("range").applyInArrow(count, "part long, nodes binary, shared binary")
    return counted.groupBy("part").applyInArrow(add, "low long, shared long")


def node_sets(df: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, tokens (binary: sorted hashes), read again from one text of each node."""
    wanted = bitmap(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in K.slices(batches, size=K.SMALL_SLICE):
            sets = sets_of(blobs, words)
            at = node_of([key_of(s) for s in sets])
            keep = np.flatnonzero(in_bitmap(wanted.value, at))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(at[keep]), pa.array([sets[k].tobytes() for k in keep], pa.binary())],
                ["doc_id", "node", "tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    found = df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, tokens binary")
    named = nodes.select(F.col("node").alias("of"), "n", "rep")
    same = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))  # a class of null ids only has a null rep
    return found.join(named, same).select("node", "doc_id", "tokens", "n").dropDuplicates(["node"])


def beginnings(sets: DataFrame, percent: int, batches: int, ranges: int) -> DataFrame:
    """Per node: n, shared (binary: hashes of shingles that other nodes hold, sorted) and begin (hashes of the shared ones
    among the first n - T + 2 in order of rarity), with their places in that order."""
    dealt = sets.select(F.pmod(F.xxhash64("node"), F.lit(batches)).alias("batch"), "node", "n", "tokens")
    dealt = checkpoint(dealt.repartition("batch"))

    def ask(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        u, c = np.unique(h, return_counts=True)
        rows = [(r, hh.tobytes(), cc.astype(np.uint32).tobytes()) for r, hh, cc in K.split_by(K.range_of(u, ranges), ranges, u, c)]
        return pa.table({"range": pa.array([r for r, _, _ in rows], pa.int32()),
                         "batch": pa.array([table.column("batch")[0].as_py()] * len(rows), pa.int64()),
                         "tokens": pa.array([x for _, x, _ in rows], pa.binary()),
                         "counts": pa.array([x for _, _, x in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        u, at = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(at, counts, len(u)).astype(np.int64)
        out, done = [], 0
        for t in tokens:
            c = total[at[done:done + len(t)]]
            done += len(t)
            out.append((t[c > 1].tobytes(), c[c > 1].tobytes()))
        return pa.table({"batch": table.column("batch"), "known": pa.array([a for a, _ in out], pa.binary()),
                         "frequency": pa.array([b for _, b in out], pa.binary())})

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(x, np.uint64) for x in right.column("known").to_pylist()])
        often = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x, np.int64) for x in right.column("frequency").to_pylist()])
        turn = np.argsort(known)
        known, often = known[turn], often[turn]
        out = {k: [] for k in ("node", "n", "shared", "begin", "places")}
        for node, n, tokens in zip(*(left.column(c).to_pylist() for c in ("node", "n", "tokens"))):
            t = np.frombuffer(tokens, np.uint64)
            at = np.searchsorted(known, t)
            held = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == t) if len(known) else np.zeros(len(t), bool)
            s, f = t[held], often[at[held]]
            rare = np.lexsort((s, f))
            place = len(t) - len(s) + np.arange(len(s))
            inside = place < n - least(n, percent) + 2
            out["node"].append(node), out["n"].append(n), out["shared"].append(s.tobytes())
            out["begin"].append(K.long_of(s[rare][inside])), out["places"].append(place[inside])
        kinds = (pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 2)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    asked = dealt.groupBy("batch").applyInArrow(ask, "range int, batch long, tokens binary, counts binary")
    told = asked.groupBy("range").applyInArrow(answer, "batch long, known binary, frequency binary")
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        order, "node long, n long, shared binary, begin array<long>, places array<long>")


def least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def boundary(nodes: DataFrame) -> int:
    """The size from which sets use inverted lists: least sum of 2-subsets below it and list entries scanned above.

    A 2-subset is nearly always met once; an entry of a list is read again in each round of comparisons (``READS`` in all).

    The costs are summed by logarithm of the size, at most a few hundred rows.
    """
    m = F.size("begin")
    costs = (nodes.select(F.floor(F.log(F.col("n").cast("double")) * 8).alias("bin"), "n", (m * (m - 1) / 2).alias("subsets"),
                          (m * READS).alias("entries"))
             .groupBy("bin").agg(F.min("n").alias("n"), F.sum("subsets").alias("subsets"), F.sum("entries").alias("entries"))
             .orderBy("bin").collect())
    choices = [(sum(c["subsets"] for c in costs[:k]) + sum(c["entries"] for c in costs[k:]), costs[k]["n"] if k < len(costs) else 1 << 60)
               for k in range(len(costs) + 1)]
    return max(2, min(choices)[1]) if choices else 2


def places(nodes: DataFrame, bound: int, percent: int, wanted: Broadcast | None = None) -> DataFrame:
    """Meeting places (g, node); with a bitmap only those in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                g, node = [], []
                part = b.slice(at, 512)
                for k, n, begin, place in zip(*(part.column(i).to_pylist() for i in range(4))):
                    tokens = np.array(begin, np.int64).view(np.uint64)
                    if n < bound and len(tokens) > 1:
                        pair = np.array(list(combinations(range(len(tokens)), 2)))
                        g.append(K.mix(tokens[pair[:, 0]] ^ K.mix(tokens[pair[:, 1]])))
                        node.append(np.full(len(pair), k))
                    if 100 * n >= percent * bound:
                        g.append(tokens[np.array(place, np.int64) < n - least(n, percent) + 1])
                        node.append(np.full(len(g[-1]), k))
                if g:
                    met, who = K.long_of(np.concatenate(g)), np.concatenate(node)
                    if wanted is not None:
                        held = in_bitmap(wanted.value, met)
                        met, who = met[held], who[held]
                    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(who)], ["g", "node"])

    return nodes.select("node", "n", "begin", "places").mapInArrow(run, "g long, node long")


def linked(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links); one row per input row."""
    docs = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = checkpoint(digests(docs, words))
    classes = checkpoint(rows.filter("n_shingles > 0").groupBy("key", "node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(docs, words, 1 + total // RANGE_TOKENS, 1 + total // (100 * RANGE_TOKENS))
    able = checkpoint(classes.join(shared, F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("low")).filter(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n")).select("node", "n", "rep"))
    size = able.agg(F.count("*"), F.sum("n")).first()
    if size[0]:
        sets = node_sets(docs, able, words)
        nodes = checkpoint(beginnings(sets, percent, 1 + size[0] // BATCH_NODES, 1 + size[1] // RANGE_TOKENS))
        bound = boundary(nodes)
        meet = met(lambda wanted: places(nodes, bound, percent, wanted))
        comp = node_components(meet, checkpoint(meet.select("node").distinct()), nodes.select("node", "n", F.col("shared").alias("tokens")), percent)
    else:
        comp = None
    if comp is not None:
        lowest = comp.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("low"))
        named = comp.join(lowest, "comp").select("node", "low")
        classes = classes.join(named, "node", "left").withColumn("rep", F.coalesce("low", "rep"))
    return (rows.join(classes.select("key", F.col("rep").alias("component_id")), "key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
