"""Operator 11: hard-negative mining over an inverted multi-index.

``mine`` gives for each anchor and each of its positives (its best rows of the same label) the best rows of other labels whose
score lies in a window below the positive's. Scores are integer inner products.

Method.
1. A codebook is fitted for each half of the vectors (k-means on at most ``SAMPLE`` rows, those of the smallest id hashes); each row is
   filed in the cell of its two nearest centres. Over all rows, each centre gets its radius: the largest distance of a half filed under it.
2. A row's score is the sum of two half scores, each at most ``half . centre + |half| * radius``. Per anchor, a heap over the two lists
   of half bounds, each sorted, visits the cells in the order of their summed bounds (multi-sequence order).
3. A first visit stops after ``SEED_ROWS`` rows and gives each anchor a score it can count on; a second one takes all cells whose bound
   reaches that score and stops there: no row outside can be better, so the result is certified (recall 1). This is done for
   the positives and then for the windows of negatives, where the lower end of a window serves as well, and cells whose rows all lie
   above the windows are left out.
4. Cells are dealt to parts of about ``PART_ROWS`` rows, large cells to several; a task scores one part for at most about
   ``BLOCK_ANCHORS`` anchors, cell by cell, and keeps for each anchor and window the best few. These are merged by anchor.

The driver holds the codebooks, radii and the number of rows of each cell, all bounded by ``CENTRES``.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, and neither do vectors whose
length is not the most frequent one (the longer among equals), as they have no inner product with the others. A null id is never an
anchor by the default rule and comes after all others in ties. Rows with equal ids are rows of their own; an anchor is not its own
positive, another row of its id may be. Anchors without positives, and positives without negatives in their window, have no
rows. Other columns are not looked at, whatever their names. An empty table gives no rows. Scores must fit 63 bits, else
OverflowError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.spark_tools import checkpoint

#: Centres of each half; the square of it bounds the cells.
CENTRES = 32
#: Rows on which the codebooks are fitted, at most. The index holds every row.
SAMPLE = 8192
PASSES = 8
SEED_ROWS = 512
PART_ROWS = 1 << 16
BLOCK_ANCHORS = 20_000
#: Scores of one matrix product, at most (or one anchor's).
PRODUCT = 1 << 21


def centres_of(points: np.ndarray, k: int) -> np.ndarray:
    """k-means, started from points at even steps of their order by a fixed projection."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    turn = np.argsort(points @ np.cos(np.arange(points.shape[1]) * 1.7), kind="stable")
    centres = np.unique(points[turn[np.linspace(0, len(points) - 1, k).astype(int)]], axis=0)
    for _ in range(PASSES):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * (points @ centres.T), axis=1)


@dataclass
class Index:
    """Codebooks and radii of both halves; for each cell its rows, its first part and its number of parts."""
    dim: int
    kind: str
    exact: type
    centres: tuple[np.ndarray, np.ndarray]
    radius: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    part: np.ndarray
    pieces: np.ndarray

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, :self.dim // 2], v[:, self.dim // 2:]

    def bounds(self, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of the half scores, per half, of vectors (rows) with what is filed under each centre (columns)."""
        upper, lower = [], []
        for half, centres, radius in zip(self.halves(v.astype(np.float64)), self.centres, self.radius):
            middle = half @ centres.T
            length = np.sqrt((half * half).sum(1))[:, None]
            reach = length * radius[None, :]
            slack = 1e-9 * (1 + np.abs(middle) + reach + length * np.sqrt((centres * centres).sum(1))[None, :])
            upper.append(middle + reach + slack), lower.append(middle - reach - slack)
        return upper, lower


def in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs, by falling sum of the two half bounds: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, met = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, p, q = heapq.heappop(heap)
        yield -bound, int(a[p]), int(b[q])
        for step in ((p + 1, q), (p, q + 1)):
            if step[0] < len(x) and step[1] < len(y) and step not in met:
                met.add(step)
                heapq.heappush(heap, (-(x[step[0]] + y[step[1]]), *step))


def usable(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """row, id, label and v (array of longs) of the rows that take part, but for their length."""
    kind = df.schema[label].dataType.simpleString()
    one = F.col(vector)
    bad = F.exists(one, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(one, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return (df.filter(F.col(label).isNotNull() & one.isNotNull()).filter(~bad)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(label).cast(kind).alias("label"), v.alias("v")))


def vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(column), dim)


def filed(rows: DataFrame, dim: int, largest: int) -> tuple[DataFrame, Index]:
    """Rows (row, id, label, cell, v as bytes) and the index of their cells."""
    if dim * largest * largest >= 1 << 63:
        raise OverflowError("inner products may exceed 63 bits")
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow()
    points = vectors(sample.column("v"), dim).astype(np.float64) if sample.num_rows else np.zeros((0, dim))
    centres = (centres_of(points[:, :dim // 2], CENTRES), centres_of(points[:, dim // 2:], CENTRES))
    width = len(centres[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(b.column(3), dim)
            x = v.astype(np.float64)
            near, apart = [], []
            for half, c in zip((x[:, :dim // 2], x[:, dim // 2:]), centres):
                near.append(nearest(half, c))
                apart.append(np.sqrt(((half - c[near[-1]]) ** 2).sum(1)))
            stored = v.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array((near[0] * width + near[1]).astype(np.int32)), pa.array([r.tobytes() for r in stored], pa.binary()),
                 pa.array(apart[0]), pa.array(apart[1])], ["row", "id", "label", "cell", "v", "apart1", "apart2"])

    label = rows.schema["label"].dataType.simpleString()
    cells = checkpoint(rows.mapInArrow(run, f"row long, id long, label {label}, cell int, v binary, apart1 double, apart2 double"))
    counted = cells.groupBy("cell").agg(F.count("*").alias("c"), F.max("apart1").alias("a"), F.max("apart2").alias("b")).collect()
    held = np.zeros((len(centres[0]), width), np.int64)
    radius = (np.zeros(len(centres[0])), np.zeros(width))
    for r in counted:
        i, j = divmod(r["cell"], width)
        held[i, j] = r["c"]
        radius[0][i], radius[1][j] = max(radius[0][i], r["a"]), max(radius[1][j], r["b"])
    pieces = np.maximum(1, -(-held.ravel() // PART_ROWS))
    part, now, room = np.zeros(held.size, np.int64), 0, 0
    for c in range(held.size):  # cells one after the other into parts; a large cell gets parts of its own
        size = int(held.ravel()[c])
        if room and room + size > PART_ROWS:
            now, room = now + 1, 0
        part[c] = now
        now, room = (now + int(pieces[c]), 0) if pieces[c] > 1 else (now, room + size)
    radius = tuple(r * (1 + 1e-9) + 1e-9 for r in radius)
    exact = np.float64 if dim * largest * largest < 1 << 53 else np.longdouble
    return cells.drop("apart1", "apart2"), Index(dim, kind, exact, centres, radius, held, part, pieces)


def visits(anchors: DataFrame, index: Index, blocks: int, seed: bool) -> DataFrame:
    """(part, block, row, label, v, lo, hi, cells) per anchor and part: the cells visited, for the anchor's windows lo..hi.

    ``lo`` and ``hi`` are arrays of the ends of the windows. A seed visit ends after ``SEED_ROWS`` rows, a certified one below the least lo.
    """
    width = index.rows.shape[1]
    columns = ["row", "label", "v", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                v = np.frombuffer(b"".join(b.column(2).to_pylist()), index.kind).reshape(b.num_rows, index.dim)
                upper, lower = index.bounds(v)
                who, part, cells = [], [], []
                for k, (lo, hi) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                    least, most, rows, found = min(lo), max(hi), 0, {}
                    for bound, i, j in in_order(upper[0][k], upper[1][k]):
                        if bound < least or seed and rows >= SEED_ROWS:
                            break
                        if index.rows[i, j] and lower[0][k][i] + lower[1][k][j] <= most:
                            cell = i * width + j
                            rows += index.rows[i, j]
                            for p in range(index.part[cell], index.part[cell] + index.pieces[cell]):
                                found.setdefault(int(p), []).append(cell)
                    for p, c in found.items():
                        who.append(k), part.append(p), cells.append(np.array(c, np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[c.take(pa.array(who, pa.int64())) for c in b.columns],
                                                  pa.array(cells, pa.binary())], ["part", *columns, "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}
    out = anchors.select(*columns).mapInArrow(run, "part int, " + ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cells binary")
    return out.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))


def dealt(cells: DataFrame, index: Index, blocks: int) -> DataFrame:
    """Rows with their part, once per block of anchors. The list of parts is bounded by the number of cells."""
    places = cells.sparkSession.createDataFrame([(c, int(p), int(n)) for c, (p, n) in enumerate(zip(index.part, index.pieces)) if index.rows.ravel()[c]],
                                                "cell int, part0 int, pieces int")
    part = (F.col("part0") + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")
    return (cells.join(F.broadcast(places), "cell").withColumn("part", part).drop("part0", "pieces")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))


def best(scores: np.ndarray, keep: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per line the ``count`` best kept scores, the first among equals: (line, column) of the best, the second best, ..."""
    left = np.where(keep, scores, -np.inf)
    for _ in range(min(count, scores.shape[1])):
        at = np.argmax(left, axis=1)
        line = np.flatnonzero(left[np.arange(len(left)), at] > -np.inf)
        if not len(line):
            return
        yield line, at[line]
        left[line, at[line]] = -np.inf


def scored(requests: DataFrame, places: DataFrame, index: Index, same: bool, count: int) -> DataFrame:
    """(anchor, window, score, id, row): the ``count`` best rows of each anchor and window within a part, of its label or of others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        ids = left.column("id").to_pandas()
        order = np.lexsort((left.column("row").to_numpy(), ids.fillna(0).to_numpy(np.int64) if ids.hasnans else ids.to_numpy(np.int64), ids.isna().to_numpy()))
        cell, row = left.column("cell").to_numpy()[order], left.column("row").to_numpy()[order]
        labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], left.schema.field("label").type)
        codes = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in labels.dictionary_encode().unify_dictionaries().chunks]])
        label, asked = codes[:left.num_rows][order], codes[left.num_rows:]
        get = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), index.kind).reshape(t.num_rows, index.dim)
        v, q = get(left)[order], get(right)
        anchor = right.column("row").to_numpy()
        lo, hi = (right.column(c).to_pylist() for c in ("lo", "hi"))
        windows = np.array([len(x) for x in lo])
        bounds = np.zeros((2, len(lo), max(windows, default=0)), index.exact)
        for k, (a, b) in enumerate(zip(lo, hi)):
            bounds[0, k, :len(a)], bounds[1, k, :len(b)] = np.array(a, np.int64), np.array(b, np.int64)
        wanted = [np.frombuffer(c, np.int32) for c in right.column("cells").to_pylist()]
        visited, visitor = np.concatenate(wanted) if wanted else np.zeros(0, np.int32), np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        turn = np.argsort(visited, kind="stable")
        visited, visitor = visited[turn], visitor[turn]
        by_cell = np.argsort(cell, kind="stable")  # within a cell by id
        for c in np.unique(visited):
            rows = by_cell[np.searchsorted(cell[by_cell], c):np.searchsorted(cell[by_cell], c, "right")]
            who = visitor[np.searchsorted(visited, c):np.searchsorted(visited, c, "right")]
            step = max(1, PRODUCT // max(1, len(rows)))
            for at in range(0, len(who) if len(rows) else 0, step):
                w = who[at:at + step]
                s = q[w].astype(index.exact) @ v[rows].astype(index.exact).T
                alike = asked[w][:, None] == label[rows][None, :]
                fit = alike & (anchor[w][:, None] != row[rows][None, :]) if same else ~alike
                for k in range(bounds.shape[2]):
                    inside = fit & (s >= bounds[0][w, k][:, None]) & (s <= bounds[1][w, k][:, None]) & (windows[w] > k)[:, None]
                    for line, column in best(s, inside, count):
                        out.append((w[line], np.full(len(line), k), s[line, column].astype(np.int64), rows[column]))
        if not out:
            return pa.table({"anchor": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "score": pa.array([], pa.int64()),
                             "id": pa.array([], pa.int64()), "row": pa.array([], pa.int64())})
        who, window, score, place = map(np.concatenate, zip(*out))
        turn = np.lexsort((place, -score, window, who))  # places are in the order of ids
        who, window, score, place = who[turn], window[turn], score[turn], place[turn]
        key = who * (bounds.shape[2] + 1) + window
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        k = rank < count
        return pa.table({"anchor": pa.array(anchor[who[k]]), "window": pa.array(window[k].astype(np.int32)), "score": pa.array(score[k]),
                         "id": left.column("id").combine_chunks().take(pa.array(order[place[k]])), "row": pa.array(row[place[k]])})

    found = places.groupBy("part", "block").cogroup(requests.groupBy("part", "block")).applyInArrow(
        run, "anchor long, window int, score long, id long, row long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def searched(anchors: DataFrame, places: DataFrame, index: Index, blocks: int, same: bool, count: int) -> DataFrame:
    """The ``count`` best rows of each anchor and window, certified: a seed visit, then one down to the scores found."""
    seed = scored(visits(anchors, index, blocks, True), places, index, same, count)
    sure = (seed.filter(F.col("rank") == count).groupBy("anchor")
            .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("sure")))  # one entry per window
    higher = F.expr("transform(lo, (x, k) -> greatest(x, coalesce(try_element_at(sure, k), x)))")
    raised = (anchors.join(sure, F.col("row") == F.col("anchor"), "left").withColumn("lo", F.when(F.col("sure").isNull(), F.col("lo")).otherwise(higher))
              .drop("sure", "anchor"))
    return checkpoint(scored(visits(checkpoint(raised), index, blocks, False), places, index, same, count))


def mine(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: Column | None = None,
         positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` is a condition on ``id`` (default: divisible by 100).

    A negative's score must be within ``percent`` of the positive's.
    """
    rows = checkpoint(usable(df, id, vector, label))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("c"), F.max(F.coalesce(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))), F.lit(0))).alias("largest"))
    most = sizes.orderBy(F.desc("c"), F.desc("dim")).first()
    dim, largest = (most["dim"], most["largest"]) if most else (0, 0)
    cells, index = filed(rows.filter(F.size("v") == dim), dim, largest)
    asked = cells.filter(F.pmod("id", F.lit(100)) == 0 if anchors is None else anchors)
    wide = F.array(F.lit(-(1 << 63)).cast("long")), F.array(F.lit((1 << 63) - 1).cast("long"))
    asked = checkpoint(asked.select("row", "id", "label", "v", wide[0].alias("lo"), wide[1].alias("hi")))
    blocks = 1 + asked.count() // BLOCK_ANCHORS
    places = dealt(cells, index, blocks)
    good = searched(asked, places, index, blocks, True, positives)
    low, high = percent
    exact = F.col("score").cast("decimal(20,0)")
    ends = exact * F.lit(low), exact * F.lit(high)
    windows = (good.filter(ends[0] <= ends[1])  # a negative score has an empty window where low < high
               .groupBy(F.col("anchor").alias("_anchor")).agg(F.array_sort(F.collect_list(F.struct(
                   "rank", F.ceil(ends[0] / 100).cast("long").alias("lo"),
                   F.floor(ends[1] / 100).cast("long").alias("hi")))).alias("w")))
    narrow = (asked.drop("lo", "hi").join(windows, F.col("row") == F.col("_anchor"))
              .select("row", "id", "label", "v", F.col("w.rank").alias("ranks"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    narrow = checkpoint(narrow)
    bad = searched(narrow.select("row", "label", "v", "lo", "hi"), places, index, blocks, False, negatives)
    named = narrow.select(F.col("row").alias("_row"), F.col("id").alias("anchor_id"), "ranks")
    bad = (bad.join(named, F.col("anchor") == F.col("_row"))
           .select("anchor", "anchor_id", F.expr("ranks[window]").alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    return (bad.join(good.select(F.col("anchor").alias("_of"), F.col("rank").alias("_at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                     (F.col("anchor") == F.col("_of")) & (F.col("at") == F.col("_at")))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
