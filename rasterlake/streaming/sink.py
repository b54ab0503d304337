"""A stream's sink in which a repeated micro-batch leaves no second record.

The batch is the unit of commit.  Its rows are written to a folder of their own,
which a repetition overwrites, and then a marker file is made; readers see only
batches with a marker, and a batch that has one is not written again.  So a stream
may be killed at any point and started again from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class BatchSink:
    """To be given to ``foreachBatch``.

    ``stream`` names the stream whose batches are numbered, so streams with
    checkpoints of their own can share ``path``.  ``partition_by`` are class
    columns that become folders within the batch.
    """

    def __init__(self, path: str, stream: str, kind: str = "json", partition_by: tuple[str, ...] = ()) -> None:
        self.path, self.stream, self.kind, self.partition_by = path.rstrip("/"), stream, kind, partition_by

    def folder(self, batch: int) -> str:
        return f"{self.path}/data/{self.stream}/{batch}"

    def marker(self, batch: int) -> str:
        return f"{self.path}/commits/{self.stream}/{batch}"

    def __call__(self, df: DataFrame, batch: int) -> None:
        fs, marker = _fs(df.sparkSession, self.marker(batch))
        if fs.exists(marker):
            df.write.format("noop").mode("overwrite").save()  # the stream's state still has to take the batch in
            return
        df.write.mode("overwrite").partitionBy(*self.partition_by).format(self.kind).save(self.folder(batch))
        fs.create(marker, True).close()

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed batches."""
        fs, folder = _fs(spark, f"{self.path}/commits/{self.stream}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def read(self, spark: SparkSession, schema: StructType | str) -> DataFrame:
        """All rows of committed batches."""
        folders = [self.folder(b) for b in self.batches(spark)]
        if not folders:
            return spark.createDataFrame([], schema)
        rows = [spark.read.schema(schema).format(self.kind).load(f) for f in folders] if self.partition_by else [spark.read.schema(schema).format(self.kind).load(folders)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


def run_available(stream: DataFrame, sink: BatchSink, checkpoint: str) -> None:
    """Runs a stream over all that has landed, and stops."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
