"""Sum-of-squares packing of documents into token sequences.

A document is its token ids and an end mark.  Documents beyond the capacity are
cut into full pieces, the rest in front.  The packing sees lengths only, in
blocks of ``BLOCK`` pieces, so no task holds more than a block and a block ends
with less than one sequence of waste on average.

In a block the pieces come longest first.  Each goes to the sequence for
which the sum, over residual gaps, of the squared counts of open sequences
becomes smallest (the tightest of equals); opening a sequence is one more choice, as
long as fewer are open than the block's tokens need at least.  Serving the contract of as few
sequences as possible, a block is also packed with opening only when none has room, and the
packing with fewer sequences holds (of equals the first).

Defined results: null and empty texts are the end mark alone; null and repeated
ids are packed as any other row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import cut, staged, table

CAPACITY = 2048
END = 0
#: Pieces that are packed together.
BLOCK = 8192
#: Longer texts go through the linear-time encoder.
LONG_TEXT = 1 << 20


@lru_cache(maxsize=2)
def _ranks(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    # The string of the added token is that token, as in the tokenizers library.
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str, ranks: str, vocabulary: str) -> np.ndarray:
    if len(text) > LONG_TEXT:
        return bpe.load(vocabulary).encode(text)
    return np.array(_ranks(ranks).encode(text, allowed_special="all", disallowed_special=()), dtype="<u4")


def cut_points(length: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of a document: only the first may be short."""
    return [0, *range(length % capacity or capacity, length, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` and, on demand, ``ids`` (little-endian unsigned 32-bit)."""
    ranks, vocabulary = bpe.vocabulary("byte_bpe_50k.tiktoken"), bpe.vocabulary()

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", ranks, vocabulary), END).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    data = ids[a:b].tobytes()
                    rows.append((key, n, a, b - a, zlib.crc32(data), data if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, packed in the given order.  While fewer than ``budget`` bins are
    open (default: as many as the lengths fill at least), opening one is a choice like any other; beyond, it is the last."""
    if budget is None:
        budget = -(-int(lengths.sum()) // capacity)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins per residual gap
    stacks: dict[int, list[int]] = defaultdict(list)
    level: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[size:capacity]) + size
        gap = capacity
        if len(gaps):
            # Moving a bin from gap g to g - size changes the sum by this; a full bin leaves it.
            after = np.where(gaps > size, count[gaps - size], 0)
            change = np.where(gaps > size, 2 * (after - count[gaps]) + 2, 1 - 2 * count[gaps])
            best = int(np.argmin(change))
            opened = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
            if len(level) >= budget or change[best] <= opened:
                gap = int(gaps[best])
        if gap < capacity:
            count[gap] -= 1
            at = stacks[gap].pop()
        else:
            at = len(level)
            level.append(0)
        bins[i], offsets[i] = at, level[at]
        level[at] += size
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(at)
    return bins, offsets


def fewest(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The better packing of the rule with and without early opening."""
    early = sum_of_squares(lengths, capacity)
    if not len(lengths) or early[0].max() < -(-int(lengths.sum()) // capacity):
        return early
    late = sum_of_squares(lengths, capacity, 0)
    return late if late[0].max() < early[0].max() else early


def place(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``parts`` (with ``id, piece, length, row``) and their ``sequence_id`` and ``offset``."""
    blocks = max(1, -(-parts.count() // block))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = fewest(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (np.int64(key[0]) << 32) + bins, offsets
        return rows.drop(columns=["block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return parts.withColumn("block", F.pmod("row", F.lit(blocks))).groupBy("block").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **columns) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: a row per piece."""
    parts = cut(pieces(docs, capacity=capacity, **columns).withColumn("row", F.monotonically_increasing_id()))
    return place(parts, capacity).drop("row")


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, **columns) -> DataFrame:
    """``sequence_id, ids, segments``: the sequences themselves; a segment is
    ``offset, length, id, piece``.  A sequence is bounded by the capacity."""
    parts = staged(
        pieces(docs, capacity=capacity, with_ids=True, **columns).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    placed = place(parts.drop("ids"), capacity).join(parts.select("row", "ids"), "row")
    segment = F.struct("offset", "length", "id", "piece", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))

    def join(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in s), "<u4").astype(np.int32) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], names=["sequence_id", "ids", "segments"])

    shown = F.transform("s", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["id"].alias("id"), x["piece"].alias("piece")))
    kind = "array<struct<offset: long, length: long, id: long, piece: int>>"
    return grouped.select("sequence_id", "s", shown.alias("segments")).mapInArrow(join, f"sequence_id long, ids array<int>, segments {kind}")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
