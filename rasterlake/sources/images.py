"""Image files, class folders, corpora, model records and synthetic plates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake.operators import rasters as R
from rasterlake.session import materialize, ship_code

PIXEL_ROWS = 200_000


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``images(origin, cls, h, w, ch, data, error)``; ``cls`` is the parent folder.

    A file that cannot be decoded keeps its row, with ``error`` set and null data.
    """
    df = spark.read.format("image").option("recursiveFileLookup", recursive).load(path)
    i, bad = F.col("image"), F.col("image.height") < 0
    whole = lambda c: F.when(~bad, c)
    return df.select(
        i.origin.alias("origin"), F.regexp_extract(i.origin, r"([^/]+)/[^/]+$", 1).alias("cls"), whole(i.height).alias("h"), whole(i.width).alias("w"), whole(i.nChannels).alias("ch"),
        whole(i.data).alias("data"), F.when(bad, F.concat(F.lit("cannot read "), i.origin)).alias("error"),
    )


def labelled(images: DataFrame, positive: str = "handwritten") -> DataFrame:
    """Adds ``label``: 1 for the positive class folder, else 0, in order of file name."""
    return images.withColumn("label", (F.col("cls") == positive).cast("int")).orderBy("origin")


def class_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("cls").count()


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pixels from raster bytes of 1, 3 or 4 channels."""
    for batch in batches:
        for i in range(batch.num_rows):
            w, ch = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            data = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(-1, ch).astype(np.int32)
            b, g, r = (data[:, min(c, ch - 1)] for c in range(3))
            for lo in range(0, len(data), PIXEL_ROWS):
                at = np.arange(lo, min(lo + PIXEL_ROWS, len(data)))
                key = pa.repeat(batch.column(0)[i], len(at))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(v, pa.int32()) for v in (at // w, at % w, b[at], g[at], r[at]))], names=["key", "y", "x", "b", "g", "r"])


def pixels(images: DataFrame, key: str = "origin") -> DataFrame:
    """``(key, y, x, b, g, r)``; bytes are row-major B, G, R, gray rasters have equal channels, a fourth (alpha) is left out.

    Images without data have no pixels; a channel count that is none of 1, 3, 4 is an error.
    """
    ship_code(images.sparkSession)
    kind = dict(images.dtypes)[key]
    ok = F.when(F.col("ch").isin(1, 3, 4), F.col("ch")).otherwise(F.raise_error(F.concat(F.lit("unknown channel count: "), F.col("ch").cast("string"))))
    rows = images.filter("data is not null and w > 0").select(F.col(key).alias("key"), F.col("w").cast("int").alias("w"), ok.cast("int").alias("ch"), "data")
    return rows.mapInArrow(_bytes, f"key {kind}, y int, x int, b int, g int, r int").withColumnRenamed("key", key)


def gray(px: DataFrame) -> DataFrame:
    """Public luma weights, rounded half to even."""
    return px.withColumn("v", F.rint(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")).cast("int")).drop("b", "g", "r")


#: Class folder, label, percentile of the padding, and whether to invert, of the second corpus.
SECOND_CORPUS = [("handwritten", 1, 0.7, False), ("formal", 0, 0.3, True)]


def padded_corpus(px: DataFrame, classes=SECOND_CORPUS) -> DataFrame:
    """Gray ``px(image_id, cls, y, x, v)`` of tightly cropped images, padded and inverted by class.

    Classes that are not listed are left out, as the folders beside them are.
    """
    parts = []
    for cls, label, q, invert in classes:
        p = R.pad_half(px.filter(F.col("cls") == cls).select("image_id", "y", "x", "v"), q)
        parts.append(p.select("image_id", F.lit(label).alias("label"), "y", "x", (255 - F.col("v") if invert else F.col("v")).alias("v")))
    return reduce(DataFrame.unionByName, parts)


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """All corpora's rows with ``source``, the corpus they come from."""
    return reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(name)) for name, df in corpora.items()))


def labelled_features(px: DataFrame, labels: DataFrame, features_fn) -> DataFrame:
    """``sample_id, source, label`` and features of every image; ``labels(image_id, source, label)``.

    Images without features are counted by an anti join of ``labels`` with the result.
    """
    return labels.join(features_fn(materialize(px, "corpus")), "image_id").withColumnRenamed("image_id", "sample_id")


def plates(spark: SparkSession, n: int, h: int = 200, w: int = 300, noise: bool = True) -> DataFrame:
    """Synthetic plates: background 120, a filled rectangle of 255, and 2 % of 0 and of 255 by a hash of the place."""
    p = spark.range(n).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("p"))
    p = p.select("image_id", F.expr(f"cast(p div {w} as int)").alias("y"), F.expr(f"cast(p % {w} as int)").alias("x"))
    inside = F.col("x").between(50, 150) & F.col("y").between(50, 100)
    u = F.pmod(F.xxhash64("image_id", "y", "x"), F.lit(100))
    v = F.when(inside, 255).otherwise(120)
    return p.withColumn("v", (F.when(u < 2, 0).when(u >= 98, 255).otherwise(v) if noise else v).cast("int"))
