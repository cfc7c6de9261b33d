"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Tokens never move: the encoding pass returns lengths and checksums, and only these are dealt out by a hash
to parts of a bounded number of pieces, each packed by one task. A part wastes a few sequences at most,
whatever its size, so the waste falls as 1 / PART_PIECES.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts
from .encode import encoder

CAPACITY, END_ID = 2048, 0
#: About so many documents are packed together by a task.
PART_PIECES = 32_768


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the order given.

    open[g] is the number of bins with g places left. A piece goes where the sum of open[g] ** 2 over
    0 < g < capacity becomes smallest, to a new bin if that is smaller still; of equal choices to the
    fullest bin. Lengths are 1 to `capacity`.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    none = np.iinfo(np.int64).max
    for k, s in enumerate(lengths):
        gap, best = capacity, none
        if s < capacity:
            have = count[s:capacity]
            cost = np.where(have > 0, 2 * (count[: capacity - s] - have) + 2, none)
            if have[0]:
                cost[0] = 1 - 2 * have[0]
            g = int(cost.argmin())
            best, gap = int(cost[g]), g + s
        if best > (2 * int(count[capacity - s]) + 1 if s < capacity else 0):
            b, gap = n, capacity
            n += 1
        else:
            b = bins[gap].pop()
            count[gap] -= 1
        left = gap - s
        where[k], offset[k] = b, capacity - gap
        if left:
            bins[left].append(b)
            count[left] += 1
    return where, offset


def _pieces(batches: Iterator[pa.RecordBatch], path: str, kind: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens = encoder(path, kind)
    for batch in in_parts(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.ids(batch.column("text")), strict=True):
            raw = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
            n = len(ids) + 1
            for piece, to in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                start = max(0, to - capacity)
                for column, x in zip(out, (doc, piece, start, to - start, zlib.crc32(raw[4 * start : 4 * to])), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def _packed(part: pa.Table, capacity: int) -> pa.Table:
    """Longest first; what else is in a row makes the order, and so the result of a second try, the same."""
    part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    where, offset = sum_of_squares(part.column("length").to_pylist(), capacity)
    at = part.column("part").to_numpy() << 40
    return part.drop_columns(["part"]).append_column("sequence_id", pa.array(at + where)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, path: str, kind: str = "bytes", capacity: int = CAPACITY, end_id: int = END_ID, part_pieces: int = PART_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of `docs`.

    Null and empty texts are their end id alone. Rows that share a doc_id, or have none, are packed row by
    row, each with its own pieces. No rows: no sequences. Further columns don't count.
    """
    parts = max(1, -(-docs.count() // part_pieces))
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda b: _pieces(b, path, kind, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(lambda t: _packed(t, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
