"""Helpers the training-data operators share: white space, local names, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, `[\x20\x09-\x0D]`, as characters and as a pattern class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t\n\x0b\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once a row even where `body` names it in a lambda."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. lower() is far quicker and the same where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs of other characters than white space; an empty array for null or blank text."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+")))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows. At a task's end what its worker has freed goes back to the system: idle workers stay, and each would keep its peak."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset: one of our own in local mode, an error on a cluster."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


#: Folders of written tables, and the sessions that made them.
_TABLES: list[tuple[SparkSession, str]] = []


#: The setting by which Spark deletes a query's shuffle files once the query has ended, not when the driver's collector comes by.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: cuts the lineage and outlives lost executors. The query's shuffle files go with its end."""
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    _TABLES.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        if t is not None:
            _delete(t.sparkSession, t._folder)


def only(before: int, keep: DataFrame) -> None:
    """Deletes what written() has made since it had made `before` tables, but for `keep`."""
    for spark, folder in _TABLES[before:]:
        if folder != keep._folder:
            _delete(spark, folder)
    _TABLES[before:] = [x for x in _TABLES[before:] if x[1] == keep._folder]


def made() -> int:
    """How many tables written() has made."""
    return len(_TABLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
