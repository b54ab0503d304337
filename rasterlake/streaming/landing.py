"""Frame files that land in a folder, and the stream over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def frame_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", files: int | None = None) -> DataFrame:
    """Frames as they land in a folder of ``kind`` files, at most ``files`` of them in a micro-batch."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(path)


def land_late(frames: DataFrame, path: str, slices: int = 4, files: int = 4) -> float:
    """Lands ``frames`` in ``slices`` steps of time, a third of the frames one step late; returns the delay in seconds that covers it.

    Each step writes ``files`` files.  At the end come frames without camera and
    ``seq``, so far ahead that the watermark passes all others, as a heartbeat of
    quiet sources does.
    """
    lo, hi = frames.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        lo = hi = 0
    step = (hi - lo) // slices + 1
    on_time = F.least(((F.unix_micros("ts") - lo) / step).cast("int"), F.lit(slices - 1))
    late = F.least(on_time + F.when(F.pmod(F.xxhash64("seq"), F.lit(3)) == 0, 1).otherwise(0), F.lit(slices - 1))
    for k in range(slices):
        frames.filter(F.coalesce(late, F.lit(0)) == k).repartition(files).write.mode("append").parquet(path)
    delay = 2 * step
    beat = frames.sparkSession.range(files).select(*(F.timestamp_micros(F.lit(hi + 2 * delay)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in frames.schema))
    for _ in range(2):  # the second lets frames out that the first let pass
        beat.repartition(files).write.mode("append").parquet(path)
    return delay / 1e6
