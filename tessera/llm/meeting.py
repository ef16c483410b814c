"""Links among nodes that meet in places, confirmed on their sets, without all pairs of a place.

Each node is compared with its place's hub, the node that meets most others over all places, and what links is merged into
components. In places that still hold several components, blocks of the largest one are then compared with blocks of all other
nodes, and these with one another, inside tasks; only links leave a task. While that would send entries too often, such places take
another hub instead. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.components import components
from tessera.llm.spark_tools import bitmap, checkpoint

HUB_ROUNDS = 3
#: Nodes of a block of a meeting place.
BLOCK = 256
#: Blockwise comparison begins when it sends each entry so many times at most on average, or after the last round.
SPREAD = 8
#: Shared shingles of a group that are multiplied at a time.
COLUMNS = 1 << 13


def met(entries: Callable[[Broadcast | None], DataFrame]) -> DataFrame:
    """(g, node, weight): the meeting places of two nodes or more; weight counts whom the node meets over all places.

    ``entries`` gives (g, node), and with a bitmap only those whose place may be in it, so that places with one node, nearly all
    of them, are shuffled once only, to be counted."""
    many = checkpoint(entries(None).groupBy("g").agg(F.count("*").alias("many")).filter("many > 1"))
    held = checkpoint(entries(bitmap(many, "g")).join(many, "g"))
    weight = held.groupBy("node").agg(F.sum("many").alias("weight"))
    return checkpoint(held.drop("many").join(weight, "node").select("g", "node", "weight"))


def hub_links(now: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links (u, v) between the nodes of each place and its hub; in later turns the hub is the heaviest node of a random component."""
    best = F.struct(F.lit(0) if turn == 0 else F.xxhash64("comp", F.lit(turn)), F.col("weight"), F.col("node"), F.col("comp"))
    hubs = now.groupBy("g").agg(F.max(best).alias("hub")).select(F.col("g").alias("_g"), F.col("hub.node").alias("hub"), F.col("hub.comp").alias("_comp"))
    pairs = (now.join(hubs, F.col("g") == F.col("_g")).filter("comp != _comp").select("hub", "node").distinct())
    both = (pairs.join(sets.toDF("hub", "nh", "sh"), "hub").join(sets.toDF("node", "nn", "sn"), "node")
            .filter(F.lit(100) * F.least("nh", "nn") >= F.lit(percent) * F.greatest("nh", "nn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for n, x, y in zip(*(t.column(i).to_pylist() for i in (2, 3, 4))):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * (n - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("hub", "node", F.col("nh") + F.col("nn"), "sh", "sn").mapInArrow(run, "u long, v long")


def linked_within(comp: np.ndarray, block: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links among the rows of a group, as pairs of row numbers: rows of different components, and of different blocks if there are two.

    n: sizes of the full sets, of which ``sets`` may leave out what no other row holds."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first, size = K.runs(tokens)
    held = np.repeat(size > 1, size)  # only shingles of two rows or more
    column, owner = np.repeat(np.arange(len(first)), size)[held], owner[held]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) + 1 - at)), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        common += grid @ grid.T
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    link &= comp[:, None] != comp[None, :]
    if block.min() != block.max():
        link &= block[:, None] != block[None, :]
    return np.argwhere(np.triu(link, 1))


def mixed_places(now: DataFrame) -> DataFrame:
    """Entries (g, node, weight, comp) of the places that hold several components, with ``many`` (whether of the place's largest one) and the
    blocks into which those of the largest (``big``) and all others (``small``) are cut; places with the same nodes count once."""
    sizes = now.groupBy("g", "comp").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("a"), F.sum(F.xxhash64("node", F.lit(1)) % (1 << 31)).alias("b"))
    place = sizes.groupBy("g").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.bit_xor("a").alias("a"), F.sum("b").alias("b"))
    place = place.filter("top.m < m").groupBy("m", "a", "b").agg(F.min("g").alias("_g"), F.first("top").alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    place = place.select("_g", F.col("top.comp").alias("top"), blocks(F.col("top.m")).alias("big"), blocks(F.col("m") - F.col("top.m")).alias("small"))
    return (now.join(place, F.col("g") == F.col("_g")).withColumn("many", F.col("comp") == F.col("top"))
            .select("g", "node", "weight", "comp", "many", "big", "small"))


def block_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between nodes of different components within each place: blocks of its largest component meet the blocks of all
    other nodes, and these meet one another."""
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("many"), F.col("big")).otherwise(F.col("small"))).cast("int")
    others = F.sequence(F.lit(0), F.col("small") - 1)
    pair = lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))
    across = F.struct(F.when(F.col("many"), -1 - F.col("own")).otherwise(-1 - F.col("other")).alias("i"), F.when(F.col("many"), F.col("other")).otherwise(F.col("own")).alias("j"))
    dealt = mixed.withColumn("own", own)
    rows = (dealt.withColumn("other", F.explode(F.when(F.col("many"), others).otherwise(F.sequence(F.lit(0), F.col("big") - 1)))).withColumn("at", across)
            .select("g", "at", "node", "comp", F.when(F.col("many"), 0).otherwise(1).alias("block"))
            .unionByName(dealt.filter("not many").withColumn("other", F.explode(others)).withColumn("at", pair(F.col("other")))
                         .select("g", "at", "node", "comp", F.col("own").alias("block"))))
    rows = rows.join(sets.select("node", "n", "tokens"), "node")

    def compare(t: pa.Table) -> pa.Table:
        node, comp, block, n = (t.column(c).to_numpy() for c in ("node", "comp", "block", "n"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        at = linked_within(comp, block, n, sets, percent) if len(sets) > 1 else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(node[at[:, 0]]), "v": pa.array(node[at[:, 1]])})

    return rows.select("g", "at.i", "at.j", "node", "comp", "block", "n", "tokens").groupBy("g", "i", "j").applyInArrow(compare, "u long, v long")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after the links (u, v): components of the graph whose nodes are the components so far."""
    name = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}"))
    edges = links.join(name("u"), "u").join(name("v"), "v").filter("_u != _v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    joint = components(edges).select(F.col("node").alias("_comp"), "component")
    return comp.join(joint, F.col("comp") == F.col("_comp"), "left").select("node", F.coalesce("component", "comp").alias("comp"))


def node_components(meet: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of all nodes that meet others; see step 4."""
    comp, count, entries = nodes.select("node", F.col("node").alias("comp")), nodes.count(), meet.count()
    now = meet.withColumn("comp", F.col("node"))
    for turn in range(HUB_ROUNDS + 1):
        rest = turn == HUB_ROUNDS
        if turn:
            now = checkpoint(mixed_places(meet.join(comp, "node")), entries)
            work = F.when(F.col("many"), F.col("small")).otherwise(F.col("big") + F.col("small"))
            left = now.agg(F.count("*").alias("rows"), F.sum(work).alias("work")).first()
            if not left["rows"]:
                break
            rest = rest or left["work"] <= SPREAD * left["rows"]
            meet = now.select("g", "node", "weight")
        links = checkpoint(block_links(now, sets, percent) if rest else hub_links(now, sets, percent, turn))
        if not links.isEmpty():
            comp = checkpoint(merged(comp, links), count)
        if rest:
            break
    return comp
