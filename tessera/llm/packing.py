"""Operator 1: best-fit packing by a grouping genetic algorithm on islands.

``token_pieces`` tokenises whole texts and cuts the longer ones into pieces; ``pack`` groups pieces into sequences of
at most ``capacity`` tokens.

Method. Pieces of full length are sequences of their own. The others are dealt at random into blocks of bounded size.
Each block is an instance that several islands evolve: an island keeps a population of packings; a crossover injects
the best-filled bins of one parent into the other, empties the bins that now hold a piece twice, and puts their
displaced pieces back by best fit, largest first; a packing's fitness is the mean square fill. After each epoch the
elite of an island migrates, through a shuffle, to the next island of its block. The best packing of a block is kept,
its loosely filled bins are opened, and their pieces, from all blocks, form the blocks of the next round.

Work per task is bounded by the block size; nothing but counts reaches the driver. Random choices are seeded by block,
island and epoch, so a lost task is repeated alike.

Defined cases: a null or empty text is the end token alone. Rows with equal ids are pieces of their own (the digest
repeats their ids). An empty input gives no rows. Input columns other than id and text are not looked at.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.spark_tools import checkpoint
from tessera.llm.tokens import encoder_of

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a text of n ids: full ones, of which the first may be shorter."""
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text",
                 id: str = "doc_id", with_ids: bool = False, width: int = 4) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian, of ``width`` bytes)."""
    cols = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = cols.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id=kind) + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, data in enumerate(encoder.encode_all([t or "" for t in b.column(1).to_pylist()])):
                    data += end
                    form = data if width == 4 or not with_ids else np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes()
                    done = 0
                    for j, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                        part = data[4 * done:4 * (done + n)]
                        of.append(k), piece.append(j), start.append(done), length.append(n)
                        crc.append(zlib.crc32(part)), ids.append(form[width * done:width * (done + n)] if with_ids else None)
                        done += n
                out = [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)
        encoder.clear()  # the worker lives on, beside those of later stages
        K.release()

    return cols.mapInArrow(run, schema)


class Packing:
    """Bins of one instance: lists of item numbers, with their loads."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.loads = [sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> None:
        """Put each item, largest first, into the bin that it fills best, else into a new one."""
        room = sorted((self.capacity - load, k) for k, load in enumerate(self.loads) if load < self.capacity)
        for i in sorted(items, key=self.sizes.__getitem__, reverse=True):
            size = self.sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(i)
                self.loads[k] += size
            else:
                left, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.loads.append(size)
            if left > size:
                insort(room, (left - size, k))

    def fitness(self) -> float:
        return sum((load / self.capacity) ** 2 for load in self.loads) / max(1, len(self.loads))

    def without(self, gone: set[int]) -> tuple[list[list[int]], list[int]]:
        """Bins that hold none of ``gone``, and the other items of the bins that do."""
        kept, displaced = [], []
        for b in self.bins:
            if gone.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced.extend(i for i in b if i not in gone)
        return kept, displaced


def crossover(a: Packing, b: Packing, rnd: random.Random, share: float = 0.3) -> Packing:
    """Child of ``a`` with well-filled bins of ``b`` injected whole."""
    order = sorted(range(len(b.bins)), key=lambda k: (-b.loads[k], rnd.random()))
    injected = [list(b.bins[k]) for k in order[:max(1, int(share * len(order)))] if rnd.random() < 0.7]
    kept, displaced = a.without({i for bin_ in injected for i in bin_})
    child = Packing(a.sizes, a.capacity, kept + injected)
    child.best_fit(displaced)
    return child


def mutate(p: Packing, rnd: random.Random, opened: int = 4) -> Packing:
    """Open the loosest bins and a few others, and put their items back."""
    order = sorted(range(len(p.bins)), key=p.loads.__getitem__)
    gone = set(order[:opened]) | {rnd.randrange(len(p.bins)) for _ in range(opened)}
    child = Packing(p.sizes, p.capacity, [list(b) for k, b in enumerate(p.bins) if k not in gone])
    items = [i for k in gone for i in p.bins[k]]
    child.best_fit(items)
    return child


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int,
           generations: int) -> list[Packing]:
    """One epoch of one island; the population, best first."""
    rnd = random.Random(seed)
    pool = [Packing(sizes, capacity, [list(b) for b in e]) for e in elites]
    while len(pool) < population:
        p = Packing(sizes, capacity)
        items = list(range(len(sizes)))
        if pool:  # a random share first, so that the individuals differ
            rnd.shuffle(items)
            head = items[:len(items) // 8]
            p.best_fit(head)
            items = items[len(items) // 8:]
        p.best_fit(items)
        pool.append(p)
    bound = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    for _ in range(generations):
        pool.sort(key=lambda p: (len(p.bins), -p.fitness()))
        if len(pool[0].bins) <= bound:
            break
        a, b = rnd.choice(pool), rnd.choice(pool)
        child = crossover(a, b, rnd) if a is not b else mutate(a, rnd)
        if len(child.bins) <= len(pool[-1].bins):
            pool[-1] = child
    pool.sort(key=lambda p: (len(p.bins), -p.fitness()))
    return pool


def to_rows(p: Packing) -> list[int]:
    """The bin number of each item."""
    out = [0] * len(p.sizes)
    for k, b in enumerate(p.bins):
        for i in b:
            out[i] = k
    return out


def from_rows(bins: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(bins):
        out.setdefault(k, []).append(i)
    return list(out.values())


def pack(pieces: DataFrame, capacity: int = 1024, block: int = 4096, islands: int = 2, epochs: int = 2,
         population: int = 4, generations: int = 12, rounds: int = 3, tight: float = 0.995, seed: int = 7) -> DataFrame:
    """Add sequence_id (long, any numbers) and offset (long, gapless from 0) to rows that have a ``length``."""
    rows = checkpoint(pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.filter(F.col("length") >= capacity).select("_row", F.col("_row").alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    done = [full]
    open_items = rows.filter(F.col("length") < capacity).select("_row", "length")
    for r in range(rounds):
        n = open_items.count()
        if not n:
            break
        blocks = -(-n // block)
        items = open_items.withColumn("block", F.pmod(F.xxhash64("_row", F.lit(seed + r)), F.lit(blocks)))
        instance = checkpoint(items.groupBy("block").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("length", "_row"))),
                        lambda x: x["_row"]).alias("rows"),
            F.array_sort(F.collect_list("length")).alias("sizes")))
        best = _islands(instance, capacity, islands, epochs, population, generations, seed + 1000 * r)
        last = r == rounds - 1 or blocks == 1
        placed = checkpoint(best.select("block", F.posexplode(F.arrays_zip("rows", "sizes", "bins")).alias("_at", "x"))
                            .select("block", "x.rows", "x.sizes", "x.bins")
                            .groupBy("block", "bins").agg(
                                F.array_sort(F.collect_list(F.struct("rows", "sizes"))).alias("members"),
                                F.sum("sizes").alias("load"))
                            .withColumn("closed", F.lit(last) | (F.col("load") >= tight * capacity)))
        closed = placed.filter("closed").withColumn("sequence_id", F.expr("members[0].rows"))
        done.append(closed.select(
            "sequence_id", F.posexplode("members").alias("at", "m"), "members")
            .select(F.col("m.rows").alias("_row"), "sequence_id",
                    F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("long"),
                                lambda s, m: s + m["sizes"]).alias("offset")))
        if last:
            break
        open_items = placed.filter(~F.col("closed")).select(F.explode("members").alias("m")).select(
            F.col("m.rows").alias("_row"), F.col("m.sizes").alias("length"))
    where = done[0]
    for d in done[1:]:
        where = where.unionByName(d)
    return rows.join(where, "_row").drop("_row")


def _islands(instance: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int,
             seed: int) -> DataFrame:
    """The best packing of each block: block, rows, sizes, bins (bin number of each item)."""
    n = instance.count()
    state = (instance.select("block", "rows", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
             .repartition(max(1, min(n * islands, 4 * instance.sparkSession.sparkContext.defaultParallelism)),
                          "block", "island")
             .withColumn("elites", F.lit(None).cast("array<array<int>>")))
    schema = "block long, island int, rows array<long>, sizes array<long>, elites array<array<int>>, bins_used int"
    for epoch in range(epochs):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for f in frames:
                for x in f.itertuples(index=False):
                    sizes = [int(s) for s in x.sizes]
                    elites = [from_rows(e) for e in x.elites] if x.elites is not None else []
                    pool = evolve(sizes, capacity, hash((seed, int(x.block), int(x.island), epoch)), elites,
                                  population, generations)
                    yield pd.DataFrame({"block": [x.block], "island": [x.island], "rows": [x.rows],
                                        "sizes": [x.sizes], "elites": [[to_rows(p) for p in pool[:2]]],
                                        "bins_used": [len(pool[0].bins)]})

        state = checkpoint(state.select("block", "island", "rows", "sizes", "elites").mapInPandas(run, schema))
        if epoch < epochs - 1:  # the best of each island goes to the next one of its block
            moved = state.select("block", ((F.col("island") + 1) % islands).alias("island"),
                                 F.slice("elites", 1, 1).alias("guests"))
            state = (state.join(moved, ["block", "island"])
                     .withColumn("elites", F.concat("elites", "guests")))
    return state.groupBy("block").agg(F.min_by(F.struct("rows", "sizes", F.col("elites")[0].alias("bins")),
                                               F.struct("bins_used", "island")).alias("s")).select(
        "block", "s.rows", "s.sizes", "s.bins")
