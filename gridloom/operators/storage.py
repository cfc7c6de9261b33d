"""Tables between the turns of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir and read back: cuts the lineage of loops, and outlives lost executors.

    Joins with it sort: a file of few MB can hold a million rows, which Spark would gather on the driver to broadcast them.
    Where that is unset: a folder of our own in local mode, an error on a cluster, whose machines don't share one.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._folder = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of saved() that nothing will read again."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t._folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
