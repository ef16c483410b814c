"""Cooldown chains without a sequential fold: which events fire when each firing silences its key for a while.

Per key the first event fires, then the first one at or after the end of that event's cooldown, and so on. The events that
fire are the path from a key's first event along ``next`` (the first event at or after the own cooldown end), so they are
found by list ranking instead of a fold per key:

1. All distinct (key, time) pairs and all cooldown ends are sorted together over range partitions; prefix counts number the
   events and give each the number of its ``next``. A closing mark per key keeps paths inside their key.
2. Events are cut into blocks of ``BLOCK`` consecutive numbers, whatever their keys. Inside a block, paths are followed in one
   task; only the events by which paths enter a block matter between blocks.
3. Those few entries, linked by where their path leaves the block, are followed from the first events by pointer jumping:
   round k adds what lies up to 2^k entries further.
4. Each block marks what its reached entries fire; events before a block's first firing take the last firing of the blocks
   before (one row per block).

One key with all events is spread over as many tasks as there are blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import checkpoint, prefix_sums

#: Events of a block.
BLOCK = 1 << 16
END = (1 << 63) - 1


def _numbered(events: DataFrame, key: str) -> DataFrame:
    """(key, t, idx, next, block) of the events and of a closing mark per key (t = END, next = -1), numbered by key and time."""
    marks = events.groupBy(key).agg(F.lit(END).alias("t")).select(key, "t", F.lit(END).alias("at"), F.lit(1).alias("event"))
    own = events.select(key, "t", F.col("t").alias("at"), F.lit(1).alias("event"))
    ends = events.select(key, "t", (F.col("t") + F.col("cooldown")).alias("at"), F.lit(0).alias("event"))
    counted = prefix_sums(own.unionByName(marks).unionByName(ends), [key, "at", "event", "t"], ["event"])
    number = F.max(F.when(F.col("event") == 1, F.col("event_cum") - 1))
    following = F.max(F.when(F.col("event") == 0, F.col("event_cum")))
    paired = counted.groupBy(key, "t").agg(number.alias("idx"), F.coalesce(following, F.lit(-1)).alias("next"))
    return checkpoint(paired.withColumn("block", F.floor(F.col("idx") / BLOCK)))


def _local(table: pa.Table, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's rows by number, and their next as a place in the block (its length or more: outside)."""
    order = np.argsort(table.column("idx").to_numpy())
    follow = table.column("next").to_numpy()[order]
    return order, np.where(follow < 0, END, follow - start)


def _exits(follow: np.ndarray) -> np.ndarray:
    """Where the path from each place leaves the block; pointers go forward, so doubling ends."""
    n, at = len(follow), follow.copy()
    while True:
        inside = np.flatnonzero(at < n)
        if not len(inside):
            return at
        at[inside] = at[at[inside]]


def _targets(chain: DataFrame) -> DataFrame:
    """Numbers at which paths enter a block from an earlier one."""
    def run(table: pa.Table) -> pa.Table:
        start = table.column("block")[0].as_py() * BLOCK
        out = np.unique(_exits(_local(table, start)[1]))
        return pa.table({"idx": pa.array(out[out < END] + start)})

    return chain.select("block", "idx", "next").groupBy("block").applyInArrow(run, "idx long").distinct()


def _links(chain: DataFrame, entries: DataFrame) -> DataFrame:
    """(idx, to) of each entry whose path goes on in a later block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        start = left.column("block")[0].as_py() * BLOCK
        entry = right.column("idx").to_numpy()
        out = _exits(_local(left, start)[1])[entry - start] if len(entry) else entry
        on = out < END
        return pa.table({"idx": pa.array(entry[on]), "to": pa.array(out[on] + start)})

    return chain.select("block", "idx", "next").groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(run, "idx long, to long")


def _reached(links: DataFrame, first: DataFrame) -> DataFrame:
    """Entries on the paths from ``first``, by pointer jumping."""
    reached, known = checkpoint(first), first.count()
    while True:
        further = reached.join(links, "idx").select(F.col("to").alias("idx"))
        reached = checkpoint(reached.unionByName(further).distinct())
        now = reached.count()
        if now == known:
            return reached
        known = now
        hop = links.select(F.col("idx").alias("to"), F.col("to").alias("far"))
        links = checkpoint(links.join(hop, "to").select("idx", F.col("far").alias("to")))


def fired(events: DataFrame, key: str) -> DataFrame:
    """Mark the events that fire. ``events``: distinct (key, t) with ``cooldown``, all longs but the key, cooldown positive.

    Returns key, t, fires (boolean) and last (t of the latest event of the key that fired at or before t).
    """
    chain = _numbered(events.select(key, F.col("t").cast("long").alias("t"), F.col("cooldown").cast("long").alias("cooldown")), key)
    first = chain.filter(F.col("t") == END).select((F.col("idx") + 1).alias("idx")).unionByName(
        chain.sparkSession.range(1).select(F.col("id").alias("idx"))).join(chain.select("idx"), "idx")
    place = F.floor(F.col("idx") / BLOCK).alias("block")
    first = checkpoint(first)
    entries = checkpoint(_targets(chain).unionByName(first).distinct().select("idx", place))
    links = checkpoint(_links(chain, entries))
    start = _reached(links, first).select("idx", place)
    kind = chain.schema[key].dataType.simpleString()

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        begin = left.column("block")[0].as_py() * BLOCK
        order, follow = _local(left, begin)
        hit = np.zeros(len(follow), bool)
        now = right.column("idx").to_numpy() - begin
        while len(now):
            hit[now] = True
            now = follow[now]
            now = now[now < len(follow)]
            now = now[~hit[now]]
        t = left.column("t").to_numpy()[order]
        hit &= t < END
        latest = np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1))
        last = pa.array(t[np.maximum(latest, 0)], mask=latest < 0)
        return pa.table({key: left.column(key).combine_chunks().take(pa.array(order)), "t": pa.array(t), "fires": pa.array(hit), "last": last,
                         "idx": pa.array(begin + np.arange(len(t))), "block": pa.array(np.full(len(t), begin // BLOCK))})

    marked = checkpoint(chain.groupBy("block").cogroup(start.groupBy("block")).applyInArrow(
        mark, f"`{key}` {kind}, t long, fires boolean, last long, idx long, block long"))
    ends = marked.groupBy("block").agg(F.max(F.when(F.col("fires"), F.struct("idx", "t"))).alias("end"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    ends = ends.select("block", F.last("end.t", ignorenulls=True).over(earlier).alias("before"))
    return (marked.join(ends, "block").filter(F.col("t") < END)
            .select(key, "t", "fires", F.coalesce("last", "before").alias("last")))
