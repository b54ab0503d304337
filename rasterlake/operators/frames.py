"""Smoothing over recent frames of each camera, in batch.

A camera's frames are cut into ranges of their order (``operators/ranges.py``), so
one camera may hold all rows.  What looks back over the last frames gets these
from the range before; what goes on without an end is summed up for each range,
and only the summaries of ranges meet.

Frames with equal time go by ``seq``; repeated frames count as often as they
come; a null camera is a camera; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.operators.ranges import PART, cut, same, split_keys, with_halo

CAMERA = ["camera_id"]


def _order(fr: DataFrame) -> list[str]:
    """Time and number, and what else frames that agree in both may differ in."""
    return ["ts", "seq", *(c for c in ("text", "hit") if c in fr.columns)]


def _last(fr: DataFrame, n: int, parts: int | None):
    """``fr`` in ranges with the frames before them, and the window of the last ``n`` frames."""
    order = _order(fr)
    rows = with_halo(cut(fr, CAMERA, order, parts), CAMERA, order, n - 1)
    return rows, Window.partitionBy(PART, "camera_id").orderBy(*order).rowsBetween(-(n - 1), 0)


def majority(fr: DataFrame, n: int = 8, parts: int | None = None) -> DataFrame:
    """``stable``: more than half of the last ``n`` flags are set; a window that is not full counts too."""
    rows, w = _last(fr, n, parts)
    hit = F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("int")).over(w)
    return rows.withColumn("stable", hit > F.count("*").over(w) / 2).filter("not __halo").drop(PART, "__halo")


def stable_text(fr: DataFrame, n: int = 10, least: int = 5, parts: int | None = None) -> DataFrame:
    """``shown`` on frames that were read: the most frequent text of the last ``n``, if seen ``least`` times.

    Empty texts fill the window but are never shown; of equals the text that
    comes first in the window counts.
    """
    rows, w = _last(fr.filter("text is not null"), n, parts)
    rows = rows.withColumn("h", F.collect_list("text").over(w)).filter("not __halo").drop(PART, "__halo")
    best = "array_max(transform(array_distinct(filter(h, t -> t <> '')), t -> struct(size(filter(h, u -> u = t)) as n, -array_position(h, t) as p, t as t)))"
    return rows.withColumn("b", F.expr(best)).withColumn("shown", F.when(F.col("b.n") >= least, F.col("b.t"))).drop("h", "b")


def missed_runs(fr: DataFrame, limit: int = 30, parts: int | None = None) -> DataFrame:
    """``misses`` in a row up to each frame, and ``failed`` at the frame that reaches ``limit``.

    A range is summed up by its length, whether it holds a good frame, and the
    misses at its end; a run that a range begins with goes on from the ranges
    before, back to the last good frame.
    """
    order = _order(fr)
    f = cut(fr, CAMERA, order, parts)
    good = F.col("text").isNotNull().cast("int")
    own = Window.partitionBy(PART, "camera_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("__good", F.sum(good).over(own))
    run = F.sum(1 - good).over(Window.partitionBy(PART, "camera_id", "__good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("misses", run)

    last = F.max_by("misses", F.struct(*order, "misses")).alias("tail")
    ends = split_keys(f, CAMERA, F.max("__good").alias("good"), last)
    in_order = Window.partitionBy("camera_id").orderBy(PART)
    ends = ends.withColumn("__g", F.sum((F.col("good") > 0).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    carry = F.sum("tail").over(Window.partitionBy("camera_id", "__g").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("__run", carry).withColumn("carry", F.coalesce(F.lag("__run").over(in_order), F.lit(0)))
    ends = ends.select("camera_id", PART, "carry").alias("s")  # two cameras a range
    joined = f.alias("t").join(F.broadcast(ends), same(CAMERA, "t", "s") & (F.col(f"t.{PART}") == F.col(f"s.{PART}")), "left").select("t.*", "s.carry")
    misses = F.col("misses") + F.when(F.col("__good") == 0, F.coalesce("carry", F.lit(0))).otherwise(0)
    return joined.withColumn("misses", misses).withColumn("failed", F.col("misses") == limit).drop("__good", "carry", PART)


def frame_rate(fr: DataFrame, keep: float = 0.9, parts: int | None = None) -> DataFrame:
    """``fps`` of each camera after its last frame: 0.9 of the old plus 0.1 of the new rate, from 0.

    A range adds up its own rates, aged to its end, and its length is the factor
    that ages what came before.
    """
    f = cut(fr.filter("camera_id is not null").select("camera_id", "ts", "seq"), CAMERA, ["ts", "seq"], parts)
    own = Window.partitionBy(PART, "camera_id").orderBy("ts", "seq")
    f = f.withColumns({"__us": F.unix_micros("ts"), "__from": F.lag(F.unix_micros("ts")).over(own)})
    f = f.withColumn("__left", F.row_number().over(Window.partitionBy(PART, "camera_id").orderBy(F.desc("ts"), F.desc("seq"))) - 1)
    rate = lambda d: F.when(d.isNotNull(), (1 - keep) / F.greatest(d / 1e6, F.lit(1e-6)))
    aged = rate(F.col("__us") - F.col("__from")) * F.pow(F.lit(keep), F.col("__left"))
    p = f.groupBy("camera_id", PART).agg(F.count("*").alias("n"), F.min("__us").alias("first"), F.max("__us").alias("last"), F.coalesce(F.sum(aged), F.lit(0.0)).alias("sum"))
    order = Window.partitionBy("camera_id").orderBy(PART)
    later = Window.partitionBy("camera_id").orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumns({"gap": F.col("first") - F.lag("last").over(order), "after": F.coalesce(F.sum("n").over(later), F.lit(0))})
    joint = F.coalesce(rate(F.col("gap")) * F.pow(F.lit(keep), F.col("n") - 1), F.lit(0.0))
    out = p.groupBy("camera_id").agg(F.sum("n").alias("n"), F.sum((F.col("sum") + joint) * F.pow(F.lit(keep), F.col("after"))).alias("fps"))
    return out.filter("n > 1").select("camera_id", "fps")


def most_common(fr: DataFrame) -> DataFrame:
    """The most frequent non-empty text of each camera, the smallest of equals."""
    c = fr.filter("text <> ''").groupBy("camera_id", "text").agg(F.count("*").alias("n"))
    return c.groupBy("camera_id").agg(F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("text"), F.max("n").alias("n"))
