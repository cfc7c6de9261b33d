"""The resumable metadata scan as a stream: each batch is merged into a table, the last write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")


class Upsert:
    """Merges batches into numbered versions of a table under `folder`; a batch that is run again writes the same version."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: str):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def merge(self, batch: DataFrame, number: int) -> None:
        before = [v for v in self._versions() if v < number]
        old = self.spark.read.parquet(f"{self.folder}/v{before[-1]}") if before else None
        rows = batch if old is None else old.unionByName(batch)
        latest(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.folder}/v{number}")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self._versions()[-1]}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
