"""Operator 3: training-order materialisation into fixed-stride binary shards.

``order`` gives every piece of tokens a global slot by a keyed permutation; ``records`` lays the pieces of each shard in slot order;
``write_shards`` writes them as files that are read sequentially and resumed at any slot; ``read_back`` reads records at their offsets;
``stored`` does all of it in a new folder.

Method. Pieces are numbered densely: their place in their partition, plus the pieces of the partitions before. A Feistel network
over the smallest even number of bits that holds all numbers, with rounds keyed by ``key``, permutes the numbers; a result
beyond the last number is permuted again (cycle-walking) until it is one, so slots are 0..n-1, each once. Shard k holds
the slots from k * shard_size on; shards are dealt to range partitions and sorted by slot, and record i of a shard starts at byte
i * stride: the piece's ids as little-endian unsigned integers of ``width`` bytes, filled up with zeros. Slot, shard and place follow from each
other, so a reader needs no index. The number of a piece depends on the partitions of the input, which a copy fixes. The copy is
compressed and ``stored`` writes the shards in ``PASSES`` passes, so that the disk holds the shards, the copy and the shuffle files of a
pass at once.

Defined cases: a null or empty text is the end id alone. Repeated rows are pieces of their own. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.packing import token_pieces
from tessera.llm.spark_tools import checkpoint, new_folder, packed_copy

ROUNDS = 6
#: Passes in which all shards are written.
PASSES = 4


def feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """Permutation of the numbers of ``bits`` (even) bits."""
    half = np.uint64(bits // 2)
    low = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & low
    for r in range(ROUNDS):
        left, right = right, left ^ (K.mix(right ^ K.mix(np.array([key * ROUNDS + r], np.int64).view(np.uint64))) & low)
    return (left << half) | right


def slot_of(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each number below n."""
    bits = max(2, (max(n - 1, 1)).bit_length())
    bits += bits % 2
    x = feistel(number.astype(np.uint64), bits, key)
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):
        x[out] = feistel(x[out], bits, key)
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def numbered(rows: DataFrame, out: str = "number") -> tuple[DataFrame, int]:
    """A compressed copy with dense numbers from 0 in the order of the partitions; the number of rows."""
    copy = packed_copy(rows.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    at = copy.withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.sum("_n").over(Window.orderBy("_part")).alias("_end"), "_n")  # a row per partition
    starts = checkpoint(before.select("_part", (F.col("_end") - F.col("_n")).alias("_start"), "_n"))
    total = starts.agg(F.sum("_n")).first()[0] or 0
    number = F.col("_start") + F.col("_at") - F.shiftleft("_part", 33)
    return at.join(F.broadcast(starts.drop("_n")), "_part").withColumn(out, number).drop("_at", "_part", "_start"), total


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)


def order(pieces: DataFrame, key: int, shard_size: int) -> tuple[DataFrame, int]:
    """Add slot, shard and place (record of the shard); the number of shards."""
    rows, n = numbered(pieces)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(slot_of(number.to_numpy(), n, key))

    # marked so that Spark keeps it in one place: a filter on the shard would compute it a second time
    place = rows.withColumn("slot", slot.asNondeterministic()("number")).drop("number")
    return (place.withColumn("shard", F.floor(F.col("slot") / shard_size).cast("long")).withColumn("place", F.col("slot") % shard_size),
            -(-n // shard_size))


def laid(ordered: DataFrame) -> DataFrame:
    """Whole shards in range partitions, in slot order."""
    return ordered.repartitionByRange(F.col("shard")).sortWithinPartitions("slot")


def record(ids: bytes, capacity: int, width: int) -> bytes:
    """Fixed-stride form of a piece."""
    kind = {2: "<u2", 4: "<u4"}[width]
    return np.frombuffer(ids, "<u4").astype(kind).tobytes().ljust(capacity * width, b"\0")


def records(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, width: int = 2, key: int = 20_001,
            shard_size: int = 8192, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, slot, shard, byte_offset, record (binary, ``capacity * width`` bytes)."""
    return recorded(placed(df, tokenizer, capacity, end_id, width, key, shard_size, text, id)[0], capacity * width)


def placed(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, width: int = 2, key: int = 20_001,
           shard_size: int = 8192, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, int]:
    """Pieces with their slots, and ids of ``width`` bytes; the number of shards."""
    pieces = token_pieces(df, tokenizer, capacity, end_id, text, id, with_ids=True, width=width)
    return order(pieces, key, shard_size)


def recorded(pieces: DataFrame, stride: int) -> DataFrame:
    """Placed pieces as records, whole shards in range partitions."""
    return laid(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "slot", "shard", (F.col("place") * stride).alias("byte_offset"),
                       padded(F.col("ids"), stride).alias("record"))


def padded(ids: Column, stride: int) -> Column:
    return F.rpad(ids, stride, F.lit(b"\0"))


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Write each shard to ``folder``/shard-<number>.bin; (shard, records, crc32) of the files.

    A shard is written by one task, in slot order, under a temporary name that is then renamed, so a repeated task leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        now, file, part, n, crc = None, None, "", 0, 0

        def close() -> pa.RecordBatch:
            file.close()
            fs.move(part, f"{path}/shard-{now:08d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([crc], pa.int64())], ["shard", "records", "crc32"])

        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != now:
                    if file:
                        yield close()
                    now, n, crc = shard, 0, 0
                    part = f"{path}/shard-{now:08d}.{uuid.uuid4().hex}"
                    file = fs.open_output_stream(part)
                file.write(data)
                n, crc = n + 1, zlib.crc32(data, crc)
        if file:
            yield close()

    return rows.select("shard", "record").mapInArrow(run, "shard long, records long, crc32 long")


def read_back(rows: DataFrame, folder: str, stride: int) -> DataFrame:
    """Add record_crc32 to rows with shard and byte_offset: of the ``stride`` bytes that the shard's file holds there."""
    names = rows.columns
    shard_at, offset_at = names.index("shard"), names.index("byte_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        now, file = None, None
        for b in batches:
            found = []
            for shard, offset in zip(b.column(shard_at).to_pylist(), b.column(offset_at).to_pylist()):
                if shard != now:
                    if file:
                        file.close()
                    now, file = shard, fs.open_input_file(f"{path}/shard-{shard:08d}.bin")
                file.seek(offset)
                data = file.read(stride)
                if len(data) != stride:
                    raise ValueError(f"shard {shard} ends at byte {offset + len(data)}, within a record")
                found.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*names, "record_crc32"])
        if file:
            file.close()

    return rows.mapInArrow(run, f"{schema_of(rows)}, record_crc32 long")


def stored(df: DataFrame, tokenizer: str, capacity: int = 1024, width: int = 2, **options) -> DataFrame:
    """The columns of ``records``, of the files: all shards are written to a new folder under the shared one, then each record
    is read at its offset; record_crc32 stands for the record. The files stay."""
    folder, stride = new_folder(df, "shards"), capacity * width
    pieces, shards = placed(df, tokenizer, capacity, width=width, **options)
    step = -(-shards // PASSES)
    for first in range(0, shards, step or 1):
        checkpoint(write_shards(recorded(pieces.filter(F.col("shard").between(first, first + step - 1)), stride), folder))
    return read_back(recorded(pieces, stride).drop("record"), folder, stride)
