"""Sparse ink: runs, the algebra of masks on runs, connected components and their cleaning.

``ink(image_id, y, x)`` holds ink pixels only; repeated pixels count once, and
an empty table gives empty tables.  A component's label is the smallest raster
index ``y * W + x`` of its pixels with ``W`` = 2**16, so images may be of any
height and up to 2**16 wide.  A label names a component within its image, so
image ids may be any whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.operators.graph import connected_components, roots
from rasterlake.session import materialize, ship_code

SIDE = 1 << 16
#: Lines of an image that one task labels, and rows that it looks at at once.
BAND, BLOCK_ROWS = 256, 200_000
KEY = ("image_id",)


def runs(ink: DataFrame) -> DataFrame:
    """``runs(image_id, y, x0, x1)``: maximal rows of neighbouring ink pixels."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    island = ink.select("image_id", "y", "x").distinct().withColumn("g", F.col("x") - F.row_number().over(w))
    return island.groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def sweep(*masks: DataFrame, keys: tuple[str, ...] = KEY, tag: str | None = None) -> DataFrame:
    """``keys, y, x0, x1, c0, c1...``: pieces of lines, and how many runs of each mask cover them.

    ``masks`` are runs, which may overlap.  A run is two events at its ends, so
    rows are in proportion to runs and not to pixels.  ``tag`` is a column of the first mask, whose
    runs must not overlap then, and comes with the pieces that it covers.
    """
    counts = [f"c{i}" for i in range(len(masks))]
    parts = []
    for i, m in enumerate(masks):
        tagged = F.col(tag) if tag and i == 0 else F.lit(None).cast(dict(masks[0].dtypes)[tag]) if tag else F.lit(None).cast("int")
        ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("c"), tagged.alias("tag")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("c"), F.lit(None).cast(m.select(tagged.alias("t")).dtypes[0][1]).alias("tag"))))
        e = m.select(*keys, "y", ends.alias("e"))
        parts.append(e.select(*keys, "y", "e.x", "e.tag", *((F.col("e.c") if j == i else F.lit(0)).alias(c) for j, c in enumerate(counts))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    events = every.groupBy(*keys, "y", "x").agg(*(F.sum(c).alias(c) for c in counts), F.max("tag").alias("tag"))
    line = Window.partitionBy(*keys, "y").orderBy("x")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    out = events.select(*keys, "y", F.col("x").alias("x0"), (F.lead("x").over(line) - 1).alias("x1"), *(F.sum(c).over(upto).alias(c) for c in counts), F.last("tag", True).over(upto).alias("tag"))
    out = out.filter("x1 is not null")
    return out.drop("tag") if tag is None else out.withColumnRenamed("tag", tag)


def joined_pieces(pieces: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Runs of pieces that follow each other without a gap."""
    line = Window.partitionBy(*keys, "y").orderBy("x0")
    new = F.coalesce(F.col("x0") > F.lag("x1").over(line) + 1, F.lit(True)).cast("int")
    g = pieces.select(*keys, "y", "x0", "x1", new.alias("new"))
    g = g.withColumn("g", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "y", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")


def union_runs(*masks: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return joined_pieces(sweep(*masks, keys=keys).filter(" or ".join(f"c{i} > 0" for i in range(len(masks)))), keys)


def without_runs(mask: DataFrame, gone: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The runs of ``mask`` less those of ``gone``."""
    return joined_pieces(sweep(mask, gone, keys=keys).filter("c0 > 0 and c1 = 0"), keys)


def dilate_runs(mask: DataFrame, radius: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Dilation by a square, a row for each run and line of the square; it may reach outside the raster."""
    lines = F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius))
    grown = mask.select(*keys, lines.alias("y"), (F.col("x0") - radius).alias("x0"), (F.col("x1") + radius).alias("x1"))
    return union_runs(grown, keys=keys)


def raster_lines(sizes: DataFrame, margin: int = 0) -> DataFrame:
    """One run for each line of rasters ``sizes(image_id, h, w)``, with a frame of ``margin``."""
    lines = F.explode(F.sequence(F.lit(-margin), F.col("h") - 1 + margin))
    return sizes.filter("h > 0 and w > 0").select("image_id", lines.alias("y"), F.lit(-margin).alias("x0"), (F.col("w") - 1 + margin).alias("x1"))


def run_pixels(mask: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return mask.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def changes(col: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike."""
    if pa.types.is_struct(col.type):
        return np.logical_or.reduce([changes(c) for c in col.flatten()])
    a, b = col.slice(0, len(col) - 1), col.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.RecordBatch], np.ndarray], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Blocks of at least ``rows`` rows that end where a group ends; ``starts`` tells of each row but the first whether it begins one."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        block = joined()
        at = np.flatnonzero(starts(block))
        if len(at):
            yield block.slice(0, at[-1] + 1)
            block = block.slice(at[-1] + 1)
        held, n = [block], block.num_rows
        rows = max(rows, 2 * n)  # a long group is not joined anew for each batch
    if held:
        yield joined()


def _labelled(batches: Iterator[pa.RecordBatch], eight: bool, band: int | None, pixels: bool) -> Iterator[pa.RecordBatch]:
    """``image_id, y, x0, x1, label`` of ``image_id, y, x0, x1`` (``pixels``: ``image_id, y, x``) in that order.

    Lines of one image and ``band`` (None: of one image) are joined.
    """

    def starts(block: pa.RecordBatch) -> np.ndarray:
        new = changes(block.column(0))
        if band is not None:
            new = new | (np.diff(block.column(1).to_numpy() // band) != 0)
        return new

    for block in whole_groups(batches, starts):
        y, x0, x1 = (block.column(i).to_numpy().astype(np.int64) for i in (1, 2, 2 if pixels else 3))
        ids, new, known = block.column(0), starts(block), block.column(0).is_valid().to_numpy(zero_copy_only=False)
        if pixels:
            cut = new | (np.diff(y) != 0) | (np.diff(x0) > 1)
            first, last = np.flatnonzero(np.append(True, cut)), np.flatnonzero(np.append(cut, True))
            new = np.logical_or.reduceat(np.append(True, new), first)[1:]
            ids, y, x0, x1, known = ids.take(pa.array(first)), y[first], x0[first], x1[last], known[first]
        # neighbouring lines of a group have numbers that follow each other
        line = np.append(0, np.cumsum(np.where(new, 2, np.minimum(np.diff(y), 2)))) * (4 * SIDE)
        reach = 1 if eight else 0
        low = np.searchsorted(line + x1, line - 4 * SIDE + x0 - reach, "left")
        high = np.searchsorted(line + x0, line - 4 * SIDE + x1 + reach, "right")
        n = np.where(known, np.maximum(high - low, 0), 0)
        b = np.repeat(np.arange(len(y)), n)
        a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[b]
        root = roots(len(y), a, b)
        label = y[root] * SIDE + x0[root]
        types = [block.schema.field(i).type for i in (1, 2, 2 if pixels else 3)]
        cols = [ids, *(pa.array(c, pa.int64()).cast(t) for c, t in zip((y, x0, x1), types)), pa.array(label, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["image_id", "y", "x0", "x1", "label"])


def label_runs(ink: DataFrame, eight: bool = True) -> DataFrame:
    """``runs`` of ``ink`` with ``label``."""
    return _labels(ink.select("image_id", "y", "x"), eight, True)


def labelled_runs(mask: DataFrame, eight: bool = True, whole: bool = False) -> DataFrame:
    """Runs ``(image_id, y, x0, x1)`` with ``label``.

    With ``whole`` all runs of an image follow each other in one task, by ``y`` and ``x0``, and are labelled there.
    """
    mask = mask.select("image_id", "y", "x0", "x1")
    if not whole:
        return _labels(mask, eight, False)
    ship_code(mask.sparkSession)
    kinds = ", ".join(f"{n} {t}" for n, t in mask.dtypes)
    return mask.mapInArrow(partial(_labelled, eight=eight, band=None, pixels=False), f"{kinds}, label bigint")


def _labels(mask: DataFrame, eight: bool, pixels: bool) -> DataFrame:
    """Labels the bands of each image, one band in one task, and then joins what goes on from band to band."""
    ship_code(mask.sparkSession)
    kinds = dict(mask.dtypes)
    band = F.floor(F.col("y") / BAND)
    dealt = mask.repartition("image_id", band).sortWithinPartitions("image_id", "y", "x" if pixels else "x0")
    x = [kinds["x"]] * 2 if pixels else [kinds["x0"], kinds["x1"]]
    out = f"image_id {kinds['image_id']}, y {kinds['y']}, x0 {x[0]}, x1 {x[1]}, label bigint"
    lab = materialize(dealt.mapInArrow(partial(_labelled, eight=eight, band=BAND, pixels=pixels), out), "runs")
    reach = 1 if eight else 0
    a, b = lab.filter(F.pmod("y", F.lit(BAND)) == BAND - 1).alias("a"), lab.filter(F.pmod("y", F.lit(BAND)) == 0).alias("b")
    touch = (F.col("b.x0") <= F.col("a.x1") + reach) & (F.col("b.x1") >= F.col("a.x0") - reach)
    if lab.filter(F.pmod("y", F.lit(BAND)) == BAND - 1).isEmpty():
        return lab
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("b.y") == F.col("a.y") + 1) & touch)
    pairs = materialize(pairs.select("a.image_id", F.col("a.label").alias("p"), F.col("b.label").alias("q")).distinct(), "bands")
    ends = pairs.select("image_id", F.col("p").alias("label")).union(pairs.select("image_id", "q")).distinct()
    ends = materialize(ends.withColumn("id", F.monotonically_increasing_id()), "bands")
    of = lambda c: ends.select("image_id", F.col("label").alias(c), F.col("id").alias(f"{c}_id"))
    links = pairs.join(of("p"), ["image_id", "p"]).join(of("q"), ["image_id", "q"])
    joined = connected_components(links, "p_id", "q_id")
    held = ends.join(joined, F.col("id") == F.col("node")).select("image_id", "label", "component")
    first = held.groupBy("component").agg(F.min("label").alias("first"))
    new = held.join(first, "component").select("image_id", "label", "first")
    return lab.join(new, ["image_id", "label"], "left").select("image_id", "y", "x0", "x1", F.coalesce("first", "label").alias("label"))


def components(labelled: DataFrame) -> DataFrame:
    """``components(image_id, label, x, y, w, h, area)``."""
    return labelled.groupBy("image_id", "label").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )


def to_ink(labelled: DataFrame) -> DataFrame:
    """Labelled runs as pixels ``(image_id, y, x, label)``."""
    return labelled.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def clean_components(comp: DataFrame, sizes: DataFrame) -> DataFrame:
    """Drops specks, components at the border, and long lines; ``sizes(image_id, h, w)`` are the rasters'."""
    s = comp.join(sizes.withColumnsRenamed({"h": "ih", "w": "iw"}), "image_id")
    speck = F.col("area") < F.greatest(F.lit(6.0), 0.0002 * F.col("ih") * F.col("iw"))
    border = F.expr("x <= 1 or y <= 1 or x + w >= iw - 1 or y + h >= ih - 1")
    line = F.expr("(w > 0.5 * iw and w > 6 * h) or (h > 0.8 * ih and h > 6 * w)")
    return s.filter(~(speck | border | line)).drop("ih", "iw")


def largest_share(comp: DataFrame, share: float = 0.02, least: int = 4) -> DataFrame:
    """Components of at least ``share`` of the image's largest, and ``least`` pixels."""
    top = F.max("area").over(Window.partitionBy("image_id"))
    return comp.withColumn("top", top).filter(F.col("area") >= F.greatest(F.lit(float(least)), share * F.col("top"))).drop("top")


def classify_size(comp: DataFrame, sizes: DataFrame, tiny: int = 15) -> DataFrame:
    """``kind``: tiny first, then border, else candidate."""
    s = comp.join(sizes.withColumnsRenamed({"h": "ih", "w": "iw"}), "image_id")
    border = F.expr("x <= 1 or y <= 1 or x + w >= iw - 1 or y + h >= ih - 1")
    return s.withColumn("kind", F.when(F.col("area") < tiny, "tiny").when(border, "border").otherwise("candidate"))


def outside(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of the background that 4-connectivity joins to the raster's frame, the frame itself included.

    ``mask`` are runs.  The background is the gaps between them, so there are about as many rows as runs and lines.
    """
    frame = raster_lines(sizes, 1)
    back = without_runs(frame, mask.join(sizes.select("image_id"), "image_id", "left_semi"))
    shifted = back.select("image_id", *((F.col(c) + 1).alias(c) for c in ("y", "x0", "x1")))
    lab = labelled_runs(shifted, eight=False).filter("label = 0")
    return lab.select("image_id", *((F.col(c) - 1).alias(c) for c in ("y", "x0", "x1")))


def fill_holes(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of the ink and everything that it encloses."""
    return without_runs(raster_lines(sizes), outside(mask, sizes))


def outer_labels(labelled: DataFrame, out: DataFrame) -> DataFrame:
    """``image_id, label`` of the components of labelled runs that the outside's runs touch."""
    lines = F.expr("explode(array(struct(-1 as dy, 0 as r), struct(0 as dy, 1 as r), struct(1 as dy, 0 as r)))")
    near = out.select("image_id", "y", "x0", "x1", lines.alias("d")).select("image_id", F.expr("y + d.dy").alias("y"), F.expr("x0 - d.r").alias("x0"), F.expr("x1 + d.r").alias("x1"))
    return sweep(labelled, near, tag="label").filter("c0 > 0 and c1 > 0").select("image_id", "label").distinct()
