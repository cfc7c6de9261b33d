"""Token files: Parquet with a list column of ids, in ascending doc_id order.

Ids are dictionary-encoded (two bytes an id at most for common vocabularies), doc_id and the places are
delta-encoded; row groups and pages are small and carry indexes, so a reader that asks for a few documents or
for counts alone skips the rest. Spark's own writer and committer make the files, so a lost executor's part
is written anew and none twice.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .encode import encoder

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: Sizes are looked at after a few rows, as one row can be a long document.
CHECKS = {"parquet.block.size.row.check.min": "8", "parquet.block.size.row.check.max": "1000", "parquet.page.size.row.check.min": "8"}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens, start = encoder(path, kind), 0
    end = np.array([end_id], np.uint32)
    for batch in batches:
        ids: list[np.ndarray] = []
        done = size = 0

        def rows(ids: list[np.ndarray], done: int, start: int) -> pa.RecordBatch:
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(ids)), batch.column("part").slice(done, len(ids)), pa.array(start + ends[:-1]), pa.array(n), flat], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

        for x in tokens.ids(batch.column("text")):
            ids.append(np.concatenate((x, end)))
            size += len(x) + 1
            if size > 1 << 20:
                yield rows(ids, done, start)
                ids, done, start, size = [], done + len(ids), start + size, 0
        if ids:
            yield rows(ids, done, start)
            start += size


def write_tokens(docs: DataFrame, folder: str, path: str, kind: str, end_id: int, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encodes `docs` (doc_id, text) and writes the files. Rows of one id follow a hash of the text; rows without id come first."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = F.col("doc_id").asc(), F.xxhash64("text")  # the hash cuts rows of one id, or of none
    ranged = d.repartitionByRange(*order).sortWithinPartitions(*order)
    out = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(lambda b: _encoded(b, path, kind, end_id), SCHEMA)
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start_in_part", "n_tokens")}
    out.write.options(**{"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.enable.dictionary": "true", **CHECKS}, **plain).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows with `start`: the ids of all documents before it. Columns not asked for are not read."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    # a row for each file: bounded by the number of partitions written
    total = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = total.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False).tobytes())
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, path: str, kind: str = "words", end_id: int = 2) -> DataFrame:
    """Writes `docs` as token files to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32) of each row.

    Null and empty texts are the end id alone. Rows that share an id, or have none, are written row by row.
    No rows: no rows. Further columns don't count.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, kind, end_id)
    return read_tokens(spark, folder).select("doc_id", "start", "ids").mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
