"""Blocked scoring of users against a catalog (M05-M10, M15): no model on the driver, no broadcast catalog.

Users are dealt to blocks and catalog items, numbered by id, to tiles. A task meets one block of users with one tile of items,
scores them with numpy and keeps for each user only the best few of the tile; these are merged by user. What a score needs from the
whole catalog comes as counts instead of rows:

- The rank of an item that a user's neighbours do not reach follows from how many reached items have a smaller number.
- Content scores and context lifts depend only on an item's group (category, price tier), so the rank of an item among all follows
  from the sizes of the groups of lower score, and of those of equal score up to the tile.
- A blended similarity row is a value per group plus corrections for the item's neighbours and itself.

Scores and components are rounded to ``DIGITS`` digits before they are ranked; ties go to the lower item id.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround
from tessera.operators.common import checkpoint, global_order_index

TILE = 4096
BLOCK = 256
DIGITS = 9
COMPONENTS = ("cf", "content", "popularity", "context")
#: Default weights of the components, and of a user without history.
WEIGHTS = (0.5, 0.2, 0.1, 0.2)
COLD = (0.0, 0.0, 0.6, 0.4)

ITEM_SIDE = ["item_id", "place", "pop", "gid", "category", "tier", "before", "total", "ctx", "lift", "js", "cs", "ds"]


@dataclass
class Catalog:
    """Items numbered by id (place, tile), their groups and popularity ranks, and what every tile must know."""
    placed: DataFrame
    groups: DataFrame
    side: DataFrame
    n: int
    tiles: int


def _typed(df: DataFrame) -> DataFrame:
    """All columns of the item side, null where a kind of row lacks one."""
    kinds = dict(zip(ITEM_SIDE, ["long", "long", "double", "int", "string", "double", "long", "long", "string", "double",
                                 "array<long>", "array<double>", "array<double>"]))
    have = set(df.columns)
    return df.select("tile", "kind", *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def catalog(items: DataFrame, pop: DataFrame, affinity: DataFrame) -> Catalog:
    """``items``: item_id, category, price_tier; ``pop``: item_id, pop; ``affinity``: device, hour_bucket, is_weekend, category, lift."""
    base = items.select("item_id", "category", F.col("price_tier").cast("double").alias("tier"))
    known = base.join(pop.select("item_id", F.round("pop", DIGITS).alias("p")), "item_id", "left").fillna(0.0, ["p"])
    ranked = global_order_index(known, [F.asc("p"), F.asc("item_id")], out="rank")
    placed = global_order_index(ranked, [F.asc("item_id")], out="place")
    groups = placed.groupBy("category", "tier").agg(F.count(F.lit(1)).alias("total"))
    groups = checkpoint(global_order_index(groups, [F.asc("category"), F.asc("tier")], out="gid").withColumn("gid", F.col("gid").cast("int")))
    n = placed.count()
    tiles = max(1, -(-n // TILE))
    placed = checkpoint(placed.join(groups.drop("total"), ["category", "tier"]).select(
        "item_id", "place", F.floor(F.col("place") / TILE).cast("int").alias("tile"), "gid", "category", "tier",
        (F.col("rank") / max(n - 1, 1)).alias("pop")))
    held = placed.groupBy("tile", "gid").agg(F.count(F.lit(1)).alias("c"))
    grid = groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(held, ["tile", "gid"], "left")
    lower = Window.partitionBy("gid").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # one row per tile
    grid = grid.withColumn("before", F.coalesce(F.sum("c").over(lower), F.lit(0))).withColumn("kind", F.lit(1))
    lifts = (affinity.select(context_key(), "category", "lift").withColumn("kind", F.lit(2))
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))))
    side = _typed(grid).unionByName(_typed(lifts))
    return Catalog(placed, groups, checkpoint(side), n, tiles)


def context_key():
    return F.concat_ws("|", "device", "hour_bucket", F.col("is_weekend").cast("string")).alias("ctx")


@dataclass
class Recommender:
    """Tables fitted on the train events: seen pairs, interaction weights, item similarities, user profiles and the catalog."""
    catalog: Catalog
    seen: DataFrame
    weights: DataFrame
    similarity: DataFrame
    profiles: DataFrame

    # -- sides ------------------------------------------------------------------------------------------
    def _item_side(self, alpha: float | None = None, top_n: int = 50) -> DataFrame:
        placed = self.catalog.placed.withColumn("kind", F.lit(0))
        if alpha is not None:
            placed = placed.join(blended(self.catalog, self.similarity, alpha, top_n), "place")
        return _typed(placed).unionByName(self.catalog.side)

    def _user_side(self, users: DataFrame, contexts: DataFrame | None, cf: bool, history: bool) -> tuple[DataFrame, int]:
        """A row per user and tile: ctx, profile, seen places, reached places with score and rank, counts of reached items, history."""
        place = self.catalog.placed.select("item_id", "place", "tile", "gid")
        base = users.select("user_id").distinct()
        if contexts is not None:
            base = base.join(contexts.select("user_id", context_key()), "user_id", "left")
        else:
            base = base.withColumn("ctx", F.lit(None).cast("string"))
        base = base.join(self.profiles.groupBy("user_id").agg(F.collect_list(F.struct("feature", "p")).alias("profile")), "user_id", "left")
        known = self.seen.select("user_id").distinct().withColumn("warm", F.lit(True))
        base = base.join(known, "user_id", "left").withColumn("warm", F.coalesce("warm", F.lit(False)))
        seen = self.seen.join(place, "item_id").groupBy("user_id", "tile").agg(F.collect_list("place").alias("seen"))
        if cf:
            score = F.round("score", DIGITS)
            reached = (cf_long(self.similarity, self.weights).withColumn("score", score).filter("score > 0").join(place, "item_id"))
            order = Window.partitionBy("user_id").orderBy("score", "place")
            reached = checkpoint(reached.withColumn("rank", F.row_number().over(order) - 1))
            parts = reached.groupBy("user_id", "tile").agg(F.collect_list(F.struct("place", "score", "rank")).alias("reached"))
            counts = (parts.select("user_id", "tile", F.size("reached").cast("long").alias("c")).groupBy("user_id")
                      .agg(F.collect_list(F.struct("tile", "c")).alias("counts")))
            base = base.join(counts, "user_id", "left")
        if history:
            own = self.weights.join(place, "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", "gid", "w"))).alias("history"))
            base = base.join(own, "user_id", "left")
        base = checkpoint(base)
        blocks = max(1, -(-base.count() // BLOCK))
        rows = base.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(self.catalog.tiles - 1)))).join(seen, ["user_id", "tile"], "left")
        none = F.lit(None)
        if cf:
            lower = F.aggregate(F.filter("counts", lambda x: x["tile"] < F.col("tile")), F.lit(0).cast("long"), lambda a, x: a + x["c"])
            every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["c"])
            rows = (rows.join(parts, ["user_id", "tile"], "left").withColumn("reached_before", F.coalesce(lower, F.lit(0).cast("long")))
                    .withColumn("reached_all", F.coalesce(every, F.lit(0).cast("long"))).drop("counts"))
        else:
            rows = (rows.withColumn("reached", none.cast("array<struct<place: bigint, score: double, rank: int>>"))
                    .withColumn("reached_before", F.lit(0).cast("long")).withColumn("reached_all", F.lit(0).cast("long")))
        if not history:
            rows = rows.withColumn("history", none.cast("array<struct<place: bigint, gid: int, w: double>>"))
        return rows.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")), blocks

    def _met(self, items: DataFrame, users: DataFrame, blocks: int, kernel, schema: str) -> DataFrame:
        dealt = items.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.groupBy("tile", "block").cogroup(users.groupBy("tile", "block")).applyInArrow(kernel, schema)

    # -- results ----------------------------------------------------------------------------------------
    def recommend(self, users: DataFrame, contexts: DataFrame | None = None, method: str = "hybrid", k: int = 10,
                  weights=WEIGHTS, alpha: float = 0.7, top_n_sim: int = 50) -> DataFrame:
        """user_id, item_id, score, rank: the top k unseen items of every user (ties: lower item id).

        method: ``item_cf``, ``content``, ``hybrid`` (weighted rank-normalised components; a user without history gets 0.6 popularity
        and 0.4 context) or ``sim_blend`` (rows of alpha * cf / max + (1 - alpha) * content / max, pruned to top_n_sim)."""
        if method not in ("item_cf", "content", "hybrid", "sim_blend"):
            raise ValueError(f"unknown method {method}")
        rows, blocks = self._user_side(users, contexts, method in ("item_cf", "hybrid"), method == "sim_blend")
        items = self._item_side(alpha if method == "sim_blend" else None, top_n_sim)
        n = self.catalog.n

        def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
            tile, out = Tile(left, n), []
            for u in right.to_pylist():
                if method == "hybrid":
                    mix = np.asarray(weights if u["warm"] else COLD)
                    score = mix @ tile.components(u)
                else:
                    score = {"item_cf": tile.cf, "content": tile.content, "sim_blend": tile.blend}[method](u)
                score = np.round(score, DIGITS)
                at = tile.best(score, tile.unseen(u), k)
                out += [(u["user_id"], int(tile.item[i]), float(score[i])) for i in at]
            return _rows(out, ("user_id", "item_id", "score"), (pa.int64(), pa.int64(), pa.float64()))

        found = self._met(items, rows, blocks, kernel, "user_id long, item_id long, score double")
        order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def explain(self, pairs: DataFrame, contexts: DataFrame | None = None, weights=WEIGHTS) -> DataFrame:
        """user_id, item_id and each component's weighted rank-normalised contribution, to 4 digits."""
        rows, blocks = self._user_side(pairs, contexts, True, False)
        wanted = (pairs.select("user_id", "item_id").distinct().join(self.catalog.placed.select("item_id", "place", "tile"), "item_id")
                  .groupBy("user_id", "tile").agg(F.collect_list("place").alias("wanted")))
        n = self.catalog.n

        def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
            tile, out = Tile(left, n), []
            for u in right.to_pylist():
                part = tile.components(u)
                for p in u["wanted"]:
                    i = p - tile.start
                    out.append((u["user_id"], int(tile.item[i]), *(np.asarray(weights) * part[:, i]).tolist()))
            return _rows(out, ("user_id", "item_id", *COMPONENTS), (pa.int64(), pa.int64(), *[pa.float64()] * 4))

        schema = "user_id long, item_id long, " + ", ".join(f"{c} double" for c in COMPONENTS)
        out = self._met(self._item_side(), rows.join(wanted, ["user_id", "tile"]), blocks, kernel, schema)
        return out.select("user_id", "item_id", *[fround(F.round(c, DIGITS), 4).alias(c) for c in COMPONENTS])

    def tune_weights(self, truth: DataFrame, contexts: DataFrame | None = None, k: int = 10, step: float = 0.1) -> DataFrame:
        """Mean NDCG@k of the users in ``truth`` for every weight vector of the simplex grid; ``best``: the highest, the first on ties.

        One pass over users and tiles keeps, per user, the items that are among the tile's best k for any grid point, found with
        the threshold algorithm over the sorted components; a second one ranks these for all grid points."""
        spark = truth.sparkSession
        grid = simplex_grid(step)
        points = np.asarray(grid)
        rows, blocks = self._user_side(truth, contexts, True, False)
        n = self.catalog.n

        def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
            tile, out = Tile(left, n), []
            for u in right.to_pylist():
                part, free = tile.components(u), np.flatnonzero(tile.unseen(u))
                at = free[threshold_best(part[:, free], points if u["warm"] else np.asarray([COLD]), k)]
                out += [(u["user_id"], u["warm"], int(tile.item[i]), *part[:, i].tolist()) for i in at]
            return _rows(out, ("user_id", "warm", "item_id", *COMPONENTS), (pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 4))

        schema = "user_id long, warm boolean, item_id long, " + ", ".join(f"{c} double" for c in COMPONENTS)
        found = self._met(self._item_side(), rows, blocks, kernel, schema)
        marked = found.join(truth.select("user_id", "item_id").distinct().withColumn("good", F.lit(True)), ["user_id", "item_id"], "left")
        goods = truth.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("goods"))
        marked = marked.withColumn("good", F.coalesce("good", F.lit(False))).join(goods, "user_id").withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int"))

        def judge(t: pa.Table) -> pa.Table:
            gain, users = np.zeros(len(points)), 0
            frame = t.to_pandas().sort_values(["user_id", "item_id"], kind="stable")
            for _, u in frame.groupby("user_id", sort=False):
                part = u[list(COMPONENTS)].to_numpy().T
                good = u["good"].to_numpy(bool)
                score = np.round((points if u["warm"].iloc[0] else np.tile(COLD, (len(points), 1))) @ part, DIGITS)
                first = np.argsort(-score, axis=1, kind="stable")[:, :k]  # rows are in the order of item ids
                gain += (good[first] / np.log2(np.arange(first.shape[1]) + 2)).sum(1) / ideal(int(u["goods"].iloc[0]), k)
                users += 1
            return pa.table({"grid_index": pa.array(np.arange(len(points), dtype=np.int32)), "gain": pa.array(gain),
                             "users": pa.array(np.full(len(points), users))})

        sums = marked.groupBy("block").applyInArrow(judge, "grid_index int, gain double, users long")
        count = goods.agg(F.count(F.lit(1)).alias("n"))
        table = spark.createDataFrame([(i, *w) for i, w in enumerate(grid)], "grid_index int, w_cf double, w_content double, w_pop double, w_ctx double")
        out = sums.groupBy("grid_index").agg(F.sum("gain").alias("gain")).crossJoin(count).withColumn("ndcg", F.round(F.col("gain") / F.col("n"), DIGITS))
        order = Window.orderBy(F.desc("ndcg"), F.asc("grid_index"))  # a row per grid point
        return (out.join(table, "grid_index").withColumn("best", F.row_number().over(order) == 1)
                .select("grid_index", "w_cf", "w_content", "w_pop", "w_ctx", fround("ndcg", 6).alias("ndcg"), "best"))

    def tune_alpha(self, truth: DataFrame, grid=(0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), k: int = 10, top_n_sim: int = 50) -> DataFrame:
        """Mean NDCG@k of the similarity blend for every alpha; ``best``: the highest, the first on ties."""
        users = truth.select("user_id").distinct()
        goods = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("goods"))
        every = [self.recommend(users, method="sim_blend", k=k, alpha=a, top_n_sim=top_n_sim).withColumn("alpha", F.lit(float(a))) for a in grid]
        hits = reduce(DataFrame.unionByName, every).join(truth, ["user_id", "item_id"]).join(goods, "user_id")
        best = F.aggregate(F.sequence(F.lit(1), F.least("goods", F.lit(k))), F.lit(0.0), lambda a, x: a + 1.0 / F.log2(x + 1))
        gain = hits.groupBy("alpha").agg(F.sum((1.0 / F.log2(F.col("rank") + 1)) / best).alias("gain"))
        table = truth.sparkSession.createDataFrame([(float(a), i) for i, a in enumerate(grid)], "alpha double, turn int")
        out = (table.join(gain, "alpha", "left").crossJoin(users.agg(F.count(F.lit(1)).alias("n")))
               .withColumn("ndcg", F.round(F.coalesce("gain", F.lit(0.0)) / F.col("n"), DIGITS)))
        order = Window.orderBy(F.desc("ndcg"), F.asc("turn"))  # a row per alpha
        return out.withColumn("best", F.row_number().over(order) == 1).select("alpha", fround("ndcg", 6).alias("ndcg"), "best")


def _rows(rows: list[tuple], names, kinds) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})


def cf_long(similarity: DataFrame, weights: DataFrame) -> DataFrame:
    """sum_j sim(i, j) * w(u, j) for the items that the user's items reach."""
    s = similarity.select("i", F.col("j").alias("item_id"), "sim")
    return (s.join(weights.select("user_id", "item_id", "w"), "item_id")
            .groupBy("user_id", F.col("i").alias("item_id")).agg(F.sum(F.col("sim") * F.col("w")).alias("score")))


def features(category: list, tier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of an item's category and of its price in its normalised feature vector."""
    price = np.asarray(tier, np.float64) / 3.0
    length = np.sqrt(1.0 + price * price) + 1e-12
    return 1.0 / length, price / length


class Tile:
    """Items of one tile and what the catalog's counts say about them."""

    def __init__(self, left: pa.Table, n: int):
        self.n = n
        kind = left.column("kind").to_numpy()
        item = left.filter(pa.array(kind == 0)).sort_by("place")
        group = left.filter(pa.array(kind == 1)).sort_by("gid")
        lift = left.filter(pa.array(kind == 2))
        self.item, self.place, self.gid = (item.column(c).to_numpy() for c in ("item_id", "place", "gid"))
        self.start = int(self.place[0])
        self.pop = item.column("pop").to_numpy()
        self.category = group.column("category").to_pylist()
        self.share, self.price = features(self.category, group.column("tier").to_numpy())
        self.before, self.total = group.column("before").to_numpy(), group.column("total").to_numpy()
        self.lifts: dict[str, dict] = {}
        for ctx, category, value in zip(*(lift.column(c).to_pylist() for c in ("ctx", "category", "lift"))):
            self.lifts.setdefault(ctx, {})[category] = value
        self.context_ranks: dict[str | None, np.ndarray] = {}
        if item.num_rows and item.column("ds")[0].is_valid:
            self.default = np.asarray(item.column("ds").to_pylist()).T
            js, cs = item.column("js").to_pylist(), item.column("cs").to_pylist()
            at = np.repeat(np.arange(len(js)), [len(j) for j in js])
            j, c = np.concatenate([np.asarray(x, np.int64) for x in js]), np.concatenate([np.asarray(x) for x in cs])
            order = np.argsort(j, kind="stable")
            self.by_item = j[order], at[order], c[order]

    def unseen(self, u: dict) -> np.ndarray:
        out = np.ones(len(self.item), bool)
        out[np.asarray(u["seen"] or [], np.int64) - self.start] = False
        return out

    def best(self, score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        at = np.flatnonzero(allowed)
        if len(at) > k:
            least = np.partition(score[at], len(at) - k)[len(at) - k]
            at = at[score[at] >= least]
        return at[np.argsort(-score[at], kind="stable")][:k]

    def cf(self, u: dict) -> np.ndarray:
        out = np.zeros(len(self.item))
        for r in u["reached"] or []:
            out[r["place"] - self.start] = r["score"]
        return out

    def cf_rank(self, u: dict) -> np.ndarray:
        """Reached items stand above all others; an unreached one has as many below it as there are unreached items before it."""
        reached = np.zeros(len(self.item), bool)
        out = np.zeros(len(self.item))
        rows = u["reached"] or []
        at = np.asarray([r["place"] for r in rows], np.int64) - self.start
        reached[at] = True
        out[:] = self.place - u["reached_before"] - (np.cumsum(reached) - reached)
        out[at] = self.n - u["reached_all"] + np.asarray([r["rank"] for r in rows])
        return out / max(self.n - 1, 1)

    def group_scores(self, u: dict) -> np.ndarray:
        profile = {x["feature"]: x["p"] for x in u["profile"] or []}
        own = np.array([profile.get(f"cat:{c}", 0.0) for c in self.category])
        return own * self.share + profile.get("price", 0.0) * self.price

    def content(self, u: dict) -> np.ndarray:
        return self.group_scores(u)[self.gid]

    def rank_by_group(self, value: np.ndarray) -> np.ndarray:
        """Rank-normalised place of the tile's items in the whole catalog, by a value per group and then by number."""
        _, cls = np.unique(np.round(value, DIGITS), return_inverse=True)
        size = np.bincount(cls, self.total)
        lower = np.cumsum(size) - size + np.bincount(cls, self.before, len(size))
        mine = cls[self.gid]
        order = np.argsort(mine, kind="stable")
        first = np.searchsorted(mine[order], mine[order])
        within = np.empty(len(mine))
        within[order] = np.arange(len(mine)) - first
        return (lower[mine] + within) / max(self.n - 1, 1)

    def context_rank(self, ctx: str | None) -> np.ndarray:
        if ctx not in self.context_ranks:
            lift = self.lifts.get(ctx, {})
            self.context_ranks[ctx] = self.rank_by_group(np.array([lift.get(c, 0.0) for c in self.category]))
        return self.context_ranks[ctx]

    def components(self, u: dict) -> np.ndarray:
        return np.stack([self.cf_rank(u), self.rank_by_group(self.group_scores(u)), self.pop, self.context_rank(u["ctx"])])

    def blend(self, u: dict) -> np.ndarray:
        rows = u["history"] or []
        w = np.asarray([r["w"] for r in rows])
        by_group = np.bincount(np.asarray([r["gid"] for r in rows], np.int64), w, len(self.category)) if len(rows) else np.zeros(len(self.category))
        out = by_group @ self.default
        j, at, c = self.by_item
        own = np.asarray([r["place"] for r in rows], np.int64)
        low, high = np.searchsorted(j, own), np.searchsorted(j, own, "right")
        for a, b, x in zip(low, high, w):
            np.add.at(out, at[a:b], c[a:b] * x)
        return out


def blended(cat: Catalog, similarity: DataFrame, alpha: float, top_n: int) -> DataFrame:
    """M09 per item (place): default value of each group (ds), and corrections (js, cs) for its neighbours and itself.

    Row i of the blend holds alpha * cf(i, j) / max + (1 - alpha) * content(i, j) / max, and entries below the row's top_n-th
    largest one become zero. Without a neighbour, an entry depends only on the two groups, so that entry is found by counting."""
    place = cat.placed.select("item_id", "place", "gid")
    near = (similarity.join(place.toDF("i", "pi", "gi"), "i").join(place.toDF("j", "pj", "gj"), "j")
            .groupBy(F.col("pi").alias("place")).agg(F.collect_list(F.struct("pj", "gj", "sim")).alias("near")))
    peak = similarity.agg(F.coalesce(F.max("sim"), F.lit(0.0)).alias("cf_max"))
    rows = cat.placed.select("place", "tile", "gid").join(near, "place", "left").crossJoin(peak).withColumn("kind", F.lit(0))
    sides = cat.side.filter("kind = 1").select("tile", "gid", "category", "tier", "total", F.lit(1).alias("kind"))
    n = cat.n

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = right.sort_by("gid")
        category, total = np.asarray(group.column("category").to_pylist()), group.column("total").to_numpy()
        share, price = features(list(category), group.column("tier").to_numpy())
        content = np.where(category[:, None] == category[None, :], share[:, None] * share[None, :], 0.0) + price[:, None] * price[None, :]
        able = (total[:, None] > 0) & (total[None, :] > 0)
        np.fill_diagonal(able, total > 1)  # an item has no similarity with itself
        most = max(0.0, content[able].max()) if able.any() else 0.0
        plain = (1 - alpha) * (content / (most + 1e-12))
        out = []
        for row in left.to_pylist():
            g, near = row["gid"], row["near"] or []
            count = total.copy()
            count[g] -= 1
            pj, gj = (np.asarray([x[c] for x in near], np.int64) for c in ("pj", "gj"))
            value = alpha * (np.asarray([x["sim"] for x in near]) / (row["cf_max"] + 1e-12)) + plain[g][gj]
            np.subtract.at(count, gj, 1)
            every = np.concatenate([value, plain[g], [0.0]])
            times = np.concatenate([np.ones(len(value), np.int64), count, [1]])
            order = np.argsort(-every, kind="stable")
            least = every[order][np.searchsorted(np.cumsum(times[order]), top_n)] if top_n < n else -np.inf
            default = np.where(plain[g] < least, 0.0, plain[g])
            kept = np.where(value < least, 0.0, value)
            out.append((row["place"], [*pj.tolist(), row["place"]], [*(kept - default[gj]).tolist(), -float(default[g])], default.tolist()))
        return _rows(out, ("place", "js", "cs", "ds"), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())))

    return rows.groupBy("tile").cogroup(sides.groupBy("tile")).applyInArrow(run, "place long, js array<long>, cs array<double>, ds array<double>")


def simplex_grid(step: float = 0.1) -> list[tuple[float, float, float, float]]:
    """All weight vectors (cf, content, popularity, context) whose parts are multiples of ``step`` and sum to one."""
    parts = round(1 / step)
    return [(a * step, b * step, c * step, (parts - a - b - c) * step)
            for a, b, c in itertools.product(range(parts + 1), repeat=3) if a + b + c <= parts]


def ideal(goods: int, k: int) -> float:
    return sum(1 / math.log2(r + 2) for r in range(min(goods, k)))


def threshold_best(parts: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Columns of ``parts`` (components x items, items by id) that are among the best k for any weight vector of ``points``.

    Threshold algorithm: the components' sorted lists are read to growing depth; a weight vector is done once its k-th best score
    exceeds what its weights give for the values at that depth, which no item further down can beat."""
    items = parts.shape[1]
    order = np.argsort(-parts, axis=1, kind="stable")
    found, open_, depth = np.zeros(items, bool), np.arange(len(points)), 4 * k
    while len(open_):
        depth = min(depth, items)
        known = np.unique(order[:, :depth])
        score = np.round(points[open_] @ parts[:, known], DIGITS)
        first = np.argsort(-score, axis=1, kind="stable")[:, :k]
        if depth == items:
            done = np.ones(len(open_), bool)
        else:
            reach = points[open_] @ parts[np.arange(len(parts)), order[:, depth - 1]]
            done = score[np.arange(len(score)), first[:, -1]] > reach + 10.0 ** -DIGITS
        found[known[first[done]].ravel()] = True
        open_, depth = open_[~done], depth * 4
    return np.flatnonzero(found)


def fit(train: DataFrame, items: DataFrame, similarity: DataFrame, weights: DataFrame, pop: DataFrame, profiles: DataFrame,
        affinity: DataFrame) -> Recommender:
    """Checkpointed tables of the train events; all of them stay distributed."""
    return Recommender(catalog(items, pop, affinity), checkpoint(train.select("user_id", "item_id").distinct()), checkpoint(weights),
                       checkpoint(similarity), checkpoint(profiles))
