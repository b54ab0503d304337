"""Raster, frame, sample and score tables derived from the input tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterlake.operators.ink import labelled_runs, union_runs
from rasterlake.session import ship_code


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixels(image_id, y, x, v)``: each embedding as an 8-wide gray raster; null entries give no pixel."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e")).filter("e is not null")
    v = F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int")
    return e.select("image_id", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), v.alias("v"))


#: Characters in a line of a text's raster.
TEXT_WIDTH = 64
RUN_ROWS, PART_BYTES = 100_000, 1 << 20


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs(image_id, y, x0, x1)``: 64-wide raster of each whole text; every character that is no blank is ink.

    A task looks at the bytes of its texts at once, so only runs leave it.  Runs of
    rows that share an id are joined.
    """
    out, single = _runs_by_row(spark, sf_dir)
    return out if single else union_runs(out)


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_runs`` with ``label``; a text of its own id is labelled in the task that read it."""
    out, single = _runs_by_row(spark, sf_dir)
    return labelled_runs(out, whole=True) if single else labelled_runs(union_runs(out))


def _runs_by_row(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """The runs of each row's text, and whether no two rows share an id."""
    ship_code(spark)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text")
    out = d.mapInArrow(_ink_runs, f"image_id {dict(d.dtypes)['image_id']}, y int, x0 int, x1 int")
    return out, d.filter("image_id is not null").groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _ink_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``image_id, y, x0, x1`` of ``image_id, text``."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        parts = np.flatnonzero(np.diff((ends[1:] - ends[0]) // PART_BYTES)) + 1  # rows of about that many bytes at once
        for lo, hi in zip([0, *parts], [*parts, len(texts)]):
            data, offsets = every[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
            lead = (data & 0xC0) != 0x80  # a character's first byte
            before = np.append(0, np.cumsum(lead))[offsets]
            ink = data[lead] > 0x20
            row = np.repeat(np.arange(hi - lo), np.diff(before))
            at = np.arange(len(ink)) - before[row]
            head = at % TEXT_WIDTH == 0  # no run goes on from a line or a text to the next
            first, last = ink.copy(), ink.copy()
            first[1:] &= ~ink[:-1] | head[1:]
            last[:-1] &= ~ink[1:] | head[1:]
            first, last = np.flatnonzero(first), np.flatnonzero(last)
            cols = [batch.column(0).take(pa.array(lo + row[first])), *(pa.array(c.astype(np.int32)) for c in (at[first] // TEXT_WIDTH, at[first] % TEXT_WIDTH, at[last] % TEXT_WIDTH))]
            out = pa.RecordBatch.from_arrays(cols, names=["image_id", "y", "x0", "x1"])
            for i in range(0, len(first), RUN_ROWS):
                yield out.slice(i, RUN_ROWS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames(camera_id, seq, ts, text, value)``: null text is a missed frame, empty text read nothing."""
    kind = F.col("event_type")
    text = F.when(kind == "error", None).when(kind == "signup", "").otherwise(kind)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"), "value")


SAMPLE_FEATURES = ["f1", "f2", "f3", "f4"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples(sample_id, source, label, f1..f4)``: statistics of labelled texts, null where not computable."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    n = F.length("text").cast("double")
    # replace works on bytes, translate on each character by a dictionary
    without = lambda c, text="text": F.replace(text, F.lit(c), F.lit(""))
    words = (F.length("text") - F.length(without(" ")) + 1).cast("double")
    lines = (F.length("text") - F.length(without("\n")) + 1).cast("double")
    # four numbers a document, not its text, meet the labels
    d = d.select(
        "doc_id", "source",
        F.log(n + 1).alias("f1"),
        F.when(words >= 2, n / words).alias("f2"),
        F.when(lines >= 2, F.log(n / lines)).alias("f3"),
        (F.length(without(",", without("."))).cast("double") / (n + 1)).alias("f4"),
    )
    j = d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").filter("label is not null")
    return j.select(F.col("doc_id").alias("sample_id"), "source", "label", *SAMPLE_FEATURES)


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores(item_id, label, class, logit)``: dot product of each embedding with each label's mean vector.

    The mean vectors, one array a class, are broadcast; null entries count nothing.
    """
    e = read(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null and exists(embedding, v -> v is not null)")
    e = e.select(F.col("vec_id").alias("item_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    cell = e.select("label", F.posexplode("e").alias("p", "v")).filter("v is not null").groupBy(F.col("label").alias("class"), "p").agg(F.avg("v").alias("m"))
    means = cell.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("p", "m"))).alias("at"), F.max("p").alias("top"))  # one row a class
    means = means.select("class", F.expr("transform(sequence(0, top), i -> coalesce(at[i], 0D))").alias("m"))
    dot = F.aggregate(F.zip_with("e", "m", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return e.crossJoin(F.broadcast(means)).select("item_id", "label", "class", (dot * 10).alias("logit"))


def preferred_model(candidates: list[DataFrame | None]) -> DataFrame:
    """The first one-row model record that there is: given, retrained, original."""
    there = [m.withColumn("__rank", F.lit(i)) for i, m in enumerate(candidates) if m is not None]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there)
    return every.orderBy("__rank").limit(1).drop("__rank")


def model_parameters(df: DataFrame, count: int | None = None) -> tuple[list[dict], float, float]:
    """Features by index, bias and threshold (0.5 if absent) of a one-row model record.

    ``count`` is the number of features that the record must have.
    """
    threshold = F.coalesce("decision_threshold", F.lit(0.5)) if "decision_threshold" in df.columns else F.lit(0.5)
    row = df.select(F.expr("array_sort(features, (a, b) -> cast(a.index - b.index as int))").alias("f"), "bias", threshold.alias("t")).first()
    if count is not None and len(row["f"]) != count:
        raise ValueError(f"the record has {len(row['f'])} features, {count} are needed")
    return [r.asDict() for r in row["f"]], float(row["bias"]), float(row["t"])


def best_epoch(log: DataFrame) -> DataFrame:
    """``epoch, best``: the first epoch of the highest validation accuracy of ``log(epoch, accuracy)``."""
    return log.agg(F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).alias("epoch"), F.max("accuracy").alias("best"))


def source_health(fr: DataFrame, reads: int = 15, dark: float = 10.0, last: tuple[str, ...] = ("text", "value")) -> DataFrame:
    """What each camera's last frame of its first ``reads`` shows, and whether it is dark.

    ``last`` are columns of the last frame that was read, such as its resolution; the
    last of them is its brightness.  Missed frames have a null text; cameras without
    a frame are left out.
    """
    r = F.row_number().over(Window.partitionBy("camera_id").orderBy("seq"))
    first = fr.withColumn("r", r).filter((F.col("r") <= reads) & F.col("text").isNotNull())
    ends = first.groupBy("camera_id").agg(F.count("*").alias("n"), F.max_by(F.struct(*last), "r").alias("z"))
    out = ends.select("camera_id", "n", *(F.col(f"z.{c}").alias(f"last_{c}") for c in last))
    return out.withColumn("note", F.when(F.col(f"last_{last[-1]}") < dark, "dark"))
