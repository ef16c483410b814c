"""Nearest items over pivot cells (J09, V03, V04, R07): exact by bounds, or approximate by probing a few cells.

Items are filed under the nearest of a bounded number of centres, which are fitted on a bounded sample; each cell knows its radius, the
largest distance of its items from the centre. A query q of length one scores an item x of the cell c with
``q . x = q . c + q . (x - c) <= q . c + radius``. So once a query has seen k items, the k-th best of them gives a score that its results
reach at least, and cells whose bound stays below it are left out: the result is exact. The approximate search
probes as many of the cells with the nearest centres as a sample of queries needs for ``RECALL`` of its exact results, scores their items
exactly, and visits all cells for a query that got fewer than k items.

Cells are dealt to parts of at most about ``PART_ROWS`` items and ``PART_BYTES`` (fewer where tasks would be idle), large cells to several, and
queries to blocks of about ``BLOCK_QUERIES``. A part or block is one row of packed vectors, shuffled and written once; all blocks meet all
parts in a Cartesian product, which reads these copies and shuffles nothing. A task meets some blocks with one partition of
parts (``PARTITION_BYTES``), keeps the best k items of each query among those the query may see, and these are merged by
query. Neither side is collected or broadcast; the driver holds the centres, radii and counts of at most ``CELLS`` cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import checkpoint

CELLS = 2048
#: Items on which the centres are fitted, at most; the index files every item.
SAMPLE = 16_384
PASSES = 6
#: Items of a part in whose best cells a query without k items looks first, so that bounds can leave out others.
SEED_ROWS = 512
PART_ROWS = 1 << 15
PART_BYTES = 1 << 25
#: Packed parts of one partition of the product, which a task holds.
PARTITION_BYTES = 1 << 27
#: Bytes of blocks and parts that go to a worker at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
AT_ONCE = 1 << 26
BLOCK_QUERIES = 4096
#: Queries on which the number of probes is set, at most, and the share of their exact results to reach.
CALIBRATION = 256
RECALL = 0.95
#: Scores of one matrix product, at most (or one query's).
PRODUCT = 1 << 21


@dataclass
class Index:
    parts: DataFrame
    dim: int
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    acl: bool

    def __getstate__(self) -> dict:
        """Tasks get the small arrays only."""
        return {**self.__dict__, "parts": None}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def _as_bytes(df: DataFrame, embedding: str, keep: list) -> DataFrame:
    """Rows with a usable vector, as the bytes of its doubles in column v, and its length in size."""
    names = [c if isinstance(c, str) else None for c in keep]
    base = df.select(*keep, F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    base = base.select(*[n if n else base.columns[i] for i, n in enumerate(names)], F.size("v").alias("size"), "v")

    def run(batches):
        for b in batches:
            v = b.column(b.num_columns - 1)
            flat, ends = v.flatten().to_numpy(), np.cumsum(b.column(b.num_columns - 2).to_numpy())
            packed = [flat[e - n:e].tobytes() for e, n in zip(ends.tolist(), b.column(b.num_columns - 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packed, pa.binary())], names=[*b.schema.names[:-1], "v"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, kinds + ", v binary")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def _fitted(points: np.ndarray, cells: int) -> np.ndarray:
    """k-means centres, started from points at even steps of their order along one direction."""
    turn = np.argsort(points @ np.cos(np.arange(points.shape[1]) * 1.7), kind="stable")
    centres = np.unique(points[turn[np.linspace(0, len(points) - 1, cells).astype(int)]], axis=0)
    for _ in range(PASSES):
        near = _nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def build(items: DataFrame, item_id: str, embedding: str = "embedding", acl: str | None = None) -> Index | None:
    """File every item; None if no item has a vector. Items whose vectors have not the most frequent length are left out."""
    keep = [F.col(item_id).alias("iid")] + ([F.col(acl).cast("array<string>").alias("acl")] if acl else [])
    rows = checkpoint(_as_bytes(items, embedding, keep))
    size = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return None
    dim = size["size"]
    rows = rows.filter(F.col("size") == dim).drop("size")
    sample = rows.orderBy(F.xxhash64("iid", "v")).limit(SAMPLE).select("v").toArrow()
    cells = int(np.clip(size["n"] // 16, 1, min(CELLS, max(1, sample.num_rows // 4))))
    centres = _fitted(_matrix(sample.column("v").combine_chunks(), dim), cells)

    def near(batches):
        held, far = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for b in batches:
            x = _matrix(b.column(0), dim)
            cell = _nearest(x, centres)
            held += np.bincount(cell, minlength=len(centres))
            np.maximum.at(far, cell, np.sqrt(((x - centres[cell]) ** 2).sum(1)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at]), pa.array(far[at])], ["cell", "n", "far"])

    held, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    counts = rows.select("v").mapInArrow(near, "cell long, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    for r in counts.collect():
        held[r["cell"]], radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-9) + 1e-9
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room_for = max(1, min(PART_ROWS, PART_BYTES // max(1, 8 * dim)))
    most = int(np.clip(held.sum() // (2 * tasks), min(512, room_for), room_for))
    pieces = np.maximum(1, -(-held // most))
    part, now, room = np.zeros(len(held), np.int64), 0, 0
    for c, n in enumerate(held.tolist()):
        if room and room + n > most:
            now, room = now + 1, 0
        part[c] = now
        now, room = (now + int(pieces[c]), 0) if pieces[c] > 1 else (now, room + n)

    def file(batches):
        for b in batches:
            cell = _nearest(_matrix(b.column(b.num_columns - 1), dim), centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(part[cell]), pa.array(pieces[cell])],
                                             names=[*b.schema.names, "cell", "part0", "pieces"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    filed = (rows.mapInArrow(file, kinds + ", cell int, part0 long, pieces long")
             .withColumn("part", F.col("part0") + F.pmod(F.xxhash64("iid"), F.col("pieces"))).drop("part0", "pieces"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("iid")
        lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type)) for c in t.schema.names if c in ("iid", "acl")]
        vectors = _matrix(t.column("v"), dim).tobytes()
        return pa.table([*lists, pa.array([t.column("cell").to_numpy().tobytes()]), pa.array([pa.compress(vectors, "lz4", asbytes=True)], pa.binary())],
                        names=[*[c for c in t.schema.names if c in ("iid", "acl")], "cell", "v"])

    listed = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.schema if f.name in ("iid", "acl"))
    # rows of whole parts: few at once, and no more of them in a partition than a task may hold
    packed = checkpoint(filed.groupBy("part").applyInArrow(pack, listed + ", cell binary, v binary"))
    size = packed.agg(F.sum(F.length("v") + F.length("cell") + 16 * F.size("iid"))).first()[0]
    return Index(packed.coalesce(1 + size // PARTITION_BYTES), dim, centres, radius, held, acl is not None)


def _visited(q: np.ndarray, index: Index, probes: int, k: int) -> np.ndarray:
    """(queries, cells): the cells of the nearest centres, ``probes`` of them or as many as hold k items."""
    middle = q @ index.centres.T
    middle[:, index.rows == 0] = -np.inf
    order = np.argsort(-middle, axis=1, kind="stable")
    before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
    first = (before < k) | (np.arange(len(index.rows)) < probes)
    out = np.zeros(first.shape, bool)
    np.put_along_axis(out, order, first, axis=1)
    return out


def _allowed(acls: list, whos: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of equal access lists and of equal principals, and which may see which: an empty or null list is public."""
    sets = lambda xs: [tuple(sorted(set(x))) if x is not None else () for x in xs]
    a, w = sets(acls), sets(whos)
    a_code, w_code = {x: i for i, x in enumerate(dict.fromkeys(a))}, {x: i for i, x in enumerate(dict.fromkeys(w))}
    may = np.array([[not x or not set(x).isdisjoint(y) for y in w_code] for x in a_code])
    return np.array([a_code[x] for x in a], np.int64), np.array([w_code[x] for x in w], np.int64), may


def _products(cell: np.ndarray, visited: np.ndarray, visitor: np.ndarray):
    """(items, queries) to multiply, each of ``PRODUCT`` scores at most: a cell with its visitors, or, where visitors visit a third of
    everything, all items of the part with all of them. Items are in the order of their ids."""
    turn, by_cell = np.argsort(visited, kind="stable"), np.argsort(cell, kind="stable")
    visited, visitor, cells = visited[turn], visitor[turn], cell[by_cell]
    each = np.unique(visited)
    lows, highs = np.searchsorted(cells, each), np.searchsorted(cells, each, "right")
    begins, ends = np.searchsorted(visited, each), np.searchsorted(visited, each, "right")
    everyone = np.unique(visitor)
    if 3 * ((highs - lows) * (ends - begins)).sum() >= len(cell) * len(everyone):
        work = [(np.arange(a, min(a + 1024, len(cell))), everyone) for a in range(0, len(cell), 1024)]
    else:
        work = [(by_cell[a:b], visitor[c:d]) for a, b, c, d in zip(lows, highs, begins, ends)]
    for rows, who in work:
        step = max(1, PRODUCT // max(1, len(rows)))
        for at in range(0, len(who) if len(rows) else 0, step):
            yield rows, who[at:at + step]


def _blocks(queries: DataFrame, index: Index) -> DataFrame:
    """(block, qid, who, v): rows of about ``BLOCK_QUERIES`` queries, as a copy."""
    blocks = 1 + queries.count() // BLOCK_QUERIES
    qkind = queries.schema["qid"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type)) for c in ("qid", "who")]
        return pa.table([t.column("block").slice(0, 1), *lists, pa.array([_matrix(t.column("v"), index.dim).tobytes()], pa.binary())], ["block", "qid", "who", "v"])

    dealt = queries.select("qid", "who", "v", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("block").applyInArrow(pack, f"block long, qid array<{qkind}>, who array<array<string>>, v binary")
    # tasks are pairs of a partition of blocks and one of parts
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(packed.repartition(min(blocks, -(-2 * tasks // index.parts.rdd.getNumPartitions())), "block"))


def _best(cell: np.ndarray, x: np.ndarray, q: np.ndarray, least: np.ndarray, visits: np.ndarray, barred: np.ndarray, may, k: int, digits: int):
    """(query, row, score) of the best k rows that each query visits and may see, of at least its score in ``least``. Rows of other cells
    may be among them, where all were multiplied, but none of barred cells."""
    visitor, visited = np.nonzero(visits)
    out = []
    for rows, w in _products(cell, visited, visitor):
        s = q[w] @ x[rows].T
        able = (s >= least[w][:, None] - 1e-8) & ~barred[w][:, cell[rows]]
        if may is not None:
            a_code, w_code, allowed = may
            able &= allowed[a_code[rows][None, :], w_code[w][:, None]]
        at, column = np.nonzero(able)
        if len(at) <= 8 * k * len(w):
            out.append((w[at], rows[column], np.round(s[at, column], digits)))
            continue
        s = np.where(able, np.round(s, digits), -np.inf)
        for _ in range(min(k, len(rows))):  # the first of the best is that of the lowest id
            best = np.argmax(s, axis=1)
            value = s[np.arange(len(w)), best]
            held = np.flatnonzero(value > -np.inf)
            if not len(held):
                break
            out.append((w[held], rows[best[held]], value[held]))
            s[held, best[held]] = -np.inf
    who, row, value = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64 if i < 2 else np.float64) for i in range(3))
    order = np.lexsort((row, -value, who))
    who, row, value = who[order], row[order], value[order]
    held = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[held], row[held], value[held]


def _scored(blocks: DataFrame, index: Index, probes: int | None, k: int, digits: int) -> DataFrame:
    """(qid, iid, similarity, rank): the best k items of each query, of all cells or of ``probes`` cells."""
    spark = blocks.sparkSession
    qkind, ikind = (d.schema[c].dataType.elementType.simpleString() for d, c in ((blocks, "qid"), (index.parts, "iid")))

    def run(batches):
        now, qid = None, None

        def results():
            taken = np.asarray(best.column("who"))
            return pa.RecordBatch.from_arrays([qid.take(pa.array(taken)), best.column("iid").combine_chunks(), best.column("similarity").combine_chunks()],
                                              ["qid", "iid", "similarity"])

        def kept(best, found, iid, least):
            """The best k of those so far and those found; ``least`` becomes the score of the k-th."""
            who, at, value = found
            if not len(who):
                return best
            more = pa.table({"who": pa.array(who), "similarity": pa.array(value), "iid": iid.take(pa.array(at))})
            both = pa.concat_tables([best, more]).sort_by([("who", "ascending"), ("similarity", "descending"), ("iid", "ascending")])
            who = both.column("who").to_numpy()
            place = np.arange(len(who)) - np.searchsorted(who, who)
            kth = np.flatnonzero(place == k - 1)
            least[who[kth]] = both.column("similarity").to_numpy()[kth]
            return both.filter(pa.array(place < k))

        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(i)[r] for i, name in enumerate(b.schema.names)}
                iid = row["iid"].values
                if row["block"].as_py() != now:
                    if now is not None:
                        yield results()
                    now, qid, whos = row["block"].as_py(), row["qid"].values, row["who"].as_py()
                    q = np.frombuffer(row["query"].as_buffer(), np.float64).reshape(-1, index.dim).copy()
                    chosen = None if probes is None else _visited(q, index, probes, k)
                    bound = q @ index.centres.T + index.radius
                    least = np.full(len(q), -np.inf)
                    best = pa.table({"who": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "iid": pa.array([], iid.type)})
                cell = np.frombuffer(row["cell"].as_buffer(), np.int32)
                x = np.frombuffer(pa.decompress(row["v"].as_buffer(), 8 * len(cell) * index.dim, "lz4"), np.float64).reshape(-1, index.dim)
                may = _allowed(row["acl"].as_py(), whos) if index.acl else None
                held = np.bincount(cell, minlength=len(index.rows))
                if chosen is not None:
                    best = kept(best, _best(cell, x, q, least, chosen & (held > 0), np.zeros(bound.shape, bool), may, k, digits), iid, least)
                    continue
                visits = np.broadcast_to(held > 0, bound.shape)
                seeds = np.zeros(bound.shape, bool)
                new = np.flatnonzero(least == -np.inf)
                if len(new):
                    order = np.argsort(-np.where(visits[new], bound[new], -np.inf), axis=1, kind="stable")
                    before = np.cumsum(held[order], axis=1) - held[order]
                    first = np.zeros(order.shape, bool)
                    np.put_along_axis(first, order, before < SEED_ROWS, axis=1)
                    seeds[new] = first & visits[new]
                    best = kept(best, _best(cell, x, q, least, seeds, ~seeds, may, k, digits), iid, least)
                rest = visits & ~seeds & (bound >= least[:, None] - 1e-8)
                best = kept(best, _best(cell, x, q, least, rest, seeds, may, k, digits), iid, least)
        if now is not None:
            yield results()

    pairs = blocks.withColumnRenamed("v", "query").hint("shuffle_replicate_nl").crossJoin(index.parts)
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(AT_ONCE))
    try:  # whole blocks and parts are large rows
        found = checkpoint(pairs.mapInArrow(run, f"qid {qkind}, iid {ikind}, similarity double"))
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.asc("iid"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _prepared(queries: DataFrame, index: Index, qid: str, embedding: str, principals: str | None) -> DataFrame:
    """qid, v (of length one), who; only queries with a vector of the items' length."""
    who = F.col(principals).cast("array<string>") if principals else F.lit(None).cast("array<string>")
    packed = _as_bytes(queries.withColumn("_who", who), embedding, [F.col(qid).alias("qid"), F.col("_who").alias("who")])

    def run(batches):
        for b in batches:
            q = _matrix(b.column(2), index.dim)
            length = np.sqrt((q * q).sum(1))
            q = q / np.where(length == 0, 1.0, length)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary()), b.column(1)],
                                             ["qid", "v", "who"])

    kind = packed.schema["qid"].dataType.simpleString()
    return checkpoint(packed.filter(F.col("size") == index.dim).select("qid", "who", "v").mapInArrow(
        run, f"qid {kind}, v binary, who array<string>"))


def exact(index: Index, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(qid, iid, similarity, rank) of prepared queries with distinct ids, of all cells that bounds don't leave out."""
    return _scored(_blocks(queries, index), index, None, k, digits)


def calibrated(index: Index, queries: DataFrame, k: int, digits: int = 9) -> int:
    """The least number of probes, among a growing series, that finds ``RECALL`` of the exact results of a bounded sample of queries."""
    some = _blocks(checkpoint(queries.orderBy(F.xxhash64("qid")).limit(CALIBRATION)), index)
    truth = checkpoint(_scored(some, index, None, k, digits).select("qid", "iid"))
    wanted, cells = truth.count(), int((index.rows > 0).sum())
    probes = 1
    while probes < cells:
        got = _scored(some, index, probes, k, digits).join(truth, ["qid", "iid"], "left_semi").count()
        if got >= RECALL * wanted:
            break
        probes *= 2
    return min(probes, cells)


def probed(index: Index, queries: DataFrame, k: int, probes: int | None = None, digits: int = 9) -> DataFrame:
    """(qid, iid, similarity, rank) from the probed cells; a query with fewer than k items is searched exactly."""
    probes = probes or calibrated(index, queries, k, digits)
    found = checkpoint(_scored(_blocks(queries, index), index, probes, k, digits))
    full = found.filter(F.col("rank") == k).select("qid")
    short = checkpoint(queries.join(full, "qid", "left_anti"))
    return found.join(full, "qid", "left_semi").unionByName(exact(index, short, k, digits))


def search(items: DataFrame, queries: DataFrame, k: int, qid: str, item_id: str, embedding: str = "embedding", principals: str | None = None,
           acl: str | None = None, digits: int = 9, approximate: bool = False, probes: int | None = None) -> DataFrame:
    """qid, item_id, similarity, rank: items build the index, then all queries are searched. Ids must be distinct on both sides."""
    index = build(items, item_id, embedding, acl if principals else None)
    if index is None:
        return (queries.join(items, F.lit(False)).select(queries[qid], items[item_id], F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")))
    asked = _prepared(queries, index, qid, embedding, principals)
    found = probed(index, asked, k, probes, digits) if approximate else exact(index, asked, k, digits)
    return found.select(F.col("qid").alias(qid), F.col("iid").alias(item_id), "similarity", "rank")
