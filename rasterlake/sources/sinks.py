"""Nested records written as JSON, class-partitioned samples, and undoing a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def capture_records(readings: DataFrame, texts: DataFrame, polarity: str = "auto", sensitivity: float = 12.0) -> DataFrame:
    """One record per image with its glyphs in reading order and the settings; confidences to 3 places."""
    g = F.struct("pos", F.array("x", "y", "w", "h").alias("box_in_roi"), "line", "char", F.round("conf", 3).alias("conf"), F.col("alt").alias("second"), F.round("alt_conf", 3).alias("second_conf"))
    per = readings.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(g)), lambda s: s.dropFields("pos")).alias("glyphs"))
    return texts.join(per, "image_id", "left").withColumns({"polarity": F.lit(polarity), "sensitivity": F.lit(sensitivity)})


def decision_records(judged: DataFrame, cols: list[str]) -> DataFrame:
    """Decision with probability and features to 4 places, null where the gate failed.

    ``shown`` is "1" where the smoothed result ``stable`` is true (this frame's, if there is none).
    """
    stable = "stable" if "stable" in judged.columns else "this_frame"
    f = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(F.round(c, 4) for c in cols)))
    return judged.select("image_id", F.when(F.col(stable), "1").otherwise("").alias("shown"), F.col("this_frame").alias("this_frame_handwritten"), "reason", F.round("prob", 4).alias("prob"), F.when(F.col("prob").isNotNull(), f).alias("features"))


def listing(readings: DataFrame) -> DataFrame:
    return readings.orderBy("image_id", "line", "pos").select("image_id", (F.col("line") + 1).alias("line"), "char", F.format_number("conf", 2).alias("conf"), "alt", F.format_number("alt_conf", 2).alias("alt_conf"))


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").json(path)


def append_samples(df: DataFrame, path: str) -> None:
    """Adds samples below their class folder."""
    df.write.mode("append").partitionBy("cls").parquet(path)


def without_undone(samples: DataFrame, undone: DataFrame) -> DataFrame:
    return samples.join(undone.select("sample_id"), "sample_id", "left_anti")


def last_of_session(samples: DataFrame) -> DataFrame:
    """The sample that an undo removes: the last of each session."""
    return samples.groupBy("session").agg(F.max_by("sample_id", F.struct("ts", "sample_id")).alias("sample_id"))


def sample_name(ordinal, at):
    """Name of a stored sample: time to the microsecond and a zero-padded ordinal."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"), F.lpad(ordinal.cast("string"), 4, "0"))
