"""Shape operators on sparse ink: areas, hulls, distances, thinning, contours, features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.operators import ink as I, rasters as R
from rasterlake.session import materialize, ship_code

#: Neighbours in the order of Zhang and Suen: up, then clockwise.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def contour_area(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image_id, label, area``: polygon area of outer contours by Pick's theorem.

    ``labelled`` are runs; of the filled component, pixels minus half of its
    boundary pixels (those with an outside 4-neighbour) minus 1.  A pixel
    is inside the boundary when its run and both neighbouring lines go on around it.
    """
    filled = materialize(I.labelled_runs(I.fill_holes(labelled.select("image_id", "y", "x0", "x1"), sizes)), "area")
    n = filled.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    core = filled.filter("x1 - x0 >= 2").select("image_id", "y", F.expr("x0 + 1").alias("x0"), F.expr("x1 - 1").alias("x1"), "label")
    above, below = (filled.select("image_id", F.expr(f"y + {d}").alias("y"), "x0", "x1") for d in (1, -1))
    inner = I.sweep(core, above, below, tag="label").filter("c0 > 0 and c1 > 0 and c2 > 0")
    inner = inner.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("i"))
    got = n.join(inner, ["image_id", "label"], "left").withColumn("b", F.col("n") - F.coalesce("i", F.lit(0)))
    return got.select("image_id", "label", F.greatest(F.lit(0.0), F.col("n") - F.col("b") / 2 - 1).alias("area"))


def hull_area(px: DataFrame) -> DataFrame:
    """``image_id, label, hull``: area of the convex hull of pixel centres.

    Only the ends of each row can be hull points; they go through a monotone
    chain, a fold over an array of at most two points a row.
    """
    return _hulls(px.groupBy("image_id", "label", "y").agg(F.min("x").alias("l"), F.max("x").alias("r")))


def _hulls(ends: DataFrame) -> DataFrame:
    """``hull_area`` of the outermost pixels ``image_id, label, y, l, r`` of each line."""
    pts = ends.groupBy("image_id", "label").agg(F.sort_array(F.collect_list(F.struct("y", "l", "r"))).alias("e"))
    cross = "(element_at(s, -1).x - element_at(s, -2).x) * (p.y - element_at(s, -2).y) - (element_at(s, -1).y - element_at(s, -2).y) * (p.x - element_at(s, -2).x)"

    def chain(side: str, sign: str) -> str:
        start = "cast(array() as array<struct<x:bigint,y:bigint>>)"
        point = f"transform(e, q -> struct(cast(q.{side} as bigint) as x, cast(q.y as bigint) as y))"
        pop = f"aggregate(sequence(1, greatest(1, size(acc))), acc, (s, i) -> if(size(s) >= 2 and {sign} ({cross}) <= 0, slice(s, 1, size(s) - 1), s))"
        return f"aggregate({point}, {start}, (acc, p) -> concat({pop}, array(p)))"

    ring = pts.withColumn("left", F.expr(chain("l", "-"))).withColumn("right", F.expr(chain("r", ""))).withColumn("ring", F.expr("concat(right, reverse(left))"))
    shoelace = "abs(aggregate(sequence(1, size(ring)), 0D, (s, i) -> s + element_at(ring, i).x * element_at(ring, i % size(ring) + 1).y - element_at(ring, i % size(ring) + 1).x * element_at(ring, i).y)) / 2"
    return ring.select("image_id", "label", F.expr(shoelace).alias("hull"))


def envelope(column: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """Squared distances along one run of ink by the lower envelope of parabolas; -1 where there is no background.

    ``column`` holds each pixel's distance to the background within its column
    (-1 for none); ``left`` and ``right`` tell whether the run ends at background.
    Nothing behind these ends is nearer, so a run needs no other pixels of its line.
    Each parabola enters and leaves the envelope once.
    """
    n = len(column)
    sites = [(i, c * c) for i, c in enumerate(column.tolist()) if c >= 0]
    sites = [(-1, 0)] * left + sites + [(n, 0)] * right
    if not sites:
        return np.full(n, -1, np.int64)
    at, base, begin = [], [], []
    for q, f in sites:
        s = float("-inf")
        while at:
            s = ((f + q * q) - (base[-1] + at[-1] * at[-1])) / (2 * (q - at[-1]))
            if s > begin[-1]:
                break
            at.pop(), base.pop(), begin.pop()
            s = float("-inf")
        at.append(q), base.append(f), begin.append(s)
    x = np.arange(n)
    k = np.searchsorted(np.array(begin), x, "left") - 1
    return (x - np.array(at)[k]) ** 2 + np.array(base)[k]


def _envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        offsets = batch.column(0).offsets.to_numpy()
        values = batch.column(0).values.to_numpy()
        d2 = [envelope(values[a:z], i, j) for a, z, i, j in zip(offsets[:-1], offsets[1:], left, right)]
        flat = np.concatenate(d2) if d2 else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], lists], names=[*batch.schema.names[3:], "d2"])


def distance_transform(ink: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image_id, y, x, d``: exact Euclidean distance of ink to the nearest other pixel of the raster; null if there is none.

    Runs of ink along each column give the distance within the column, then each
    run along a line is one array, in time linear in its length.  Only ink has rows.
    """
    ship_code(ink.sparkSession)
    px = ink.select("image_id", "y", "x").distinct().join(sizes.select("image_id", "h", "w"), "image_id")
    px = px.withColumn("__g", F.col("y") - F.row_number().over(R.columns_of()))
    own = Window.partitionBy("image_id", "x", "__g")
    up = F.when(F.min("y").over(own) > 0, F.col("y") - F.min("y").over(own) + 1)
    down = F.when(F.max("y").over(own) < F.col("h") - 1, F.max("y").over(own) - F.col("y") + 1)
    px = px.withColumn("c", F.coalesce(F.least(up, down), F.lit(-1)).cast("bigint"))
    line = Window.partitionBy("image_id", "y").orderBy("x")
    px = px.withColumn("__g", F.col("x") - F.row_number().over(line))
    part = px.groupBy("image_id", "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("w").alias("w"), F.sort_array(F.collect_list(F.struct("x", "c"))).alias("a"))  # one run of a line
    part = part.select(F.col("a.c").alias("c"), (F.col("x0") > 0).alias("l"), (F.col("x1") < F.col("w") - 1).alias("r"), "image_id", "y", "x0")
    kind = dict(part.dtypes)
    got = part.mapInArrow(_envelopes, f"image_id {kind['image_id']}, y {kind['y']}, x0 {kind['x0']}, d2 array<bigint>")
    got = got.select("image_id", "y", "x0", F.posexplode("d2").alias("i", "d2"))
    return got.select("image_id", "y", (F.col("x0") + F.col("i")).alias("x"), F.when(F.col("d2") >= 0, F.sqrt("d2")).alias("d"))


def _neighbours(ink: DataFrame) -> DataFrame:
    """``image_id, y, x, n``: ink with a byte of its ink neighbours, bits in the order of ``AROUND``."""
    bits = F.expr("array(" + ", ".join(f"struct({-dy} as dy, {-dx} as dx, {1 << i} as bit)" for i, (dy, dx) in enumerate(AROUND)) + ", struct(0 as dy, 0 as dx, 256 as bit))")
    e = ink.select("image_id", "y", "x", F.explode(bits).alias("o")).select("image_id", F.expr("y + o.dy").alias("y"), F.expr("x + o.dx").alias("x"), "o.bit")
    return e.groupBy("image_id", "y", "x").agg(F.bit_or("bit").alias("n")).filter("n >= 256").withColumn("n", F.expr("n - 256"))


def _leaves(second: bool) -> str:
    """Whether a Zhang-Suen sub-iteration removes a pixel of neighbours ``n``."""
    a = "bit_count((255 - n) & (shiftright(n, 1) | shiftleft(n & 1, 7)))"
    first, last = ((1 | 4 | 64, 1 | 16 | 64) if second else (1 | 4 | 16, 4 | 16 | 64))
    return f"(bit_count(n) between 2 and 6 and {a} = 1 and (n & {first}) <> {first} and (n & {last}) <> {last})"


def thinning_step(ink: DataFrame, second: bool) -> DataFrame:
    """One Zhang-Suen sub-iteration: the ink that stays."""
    return _neighbours(ink).filter(f"not {_leaves(second)}").select("image_id", "y", "x")


def _front_step(front: DataFrame, second: bool) -> DataFrame:
    """One sub-iteration on the front: what it removes (``gone``), and the front after it.

    A removed pixel's byte names its ink neighbours, which lose a bit; one that was not
    of the front had all eight.  A pixel is looked at when a neighbour has gone since the
    last sub-iteration of the kind (``due``).
    """
    bit = 2 if second else 1
    seen = front.withColumn("gone", F.expr(f"(due & {bit}) <> 0 and {_leaves(second)}"))
    # of a removed pixel's neighbour i, the pixel itself is neighbour i + 4
    tell = F.expr("filter(array(" + ", ".join(f"struct({dy} as dy, {dx} as dx, {1 << i} as have, {1 << (i + 4) % 8} as lost)" for i, (dy, dx) in enumerate(AROUND)) + "), o -> (n & o.have) <> 0)")
    told = seen.filter("gone").select("image_id", "y", "x", F.explode(tell).alias("o"))
    told = told.select("image_id", F.expr("y + o.dy").alias("y"), F.expr("x + o.dx").alias("x"), F.lit(None).cast("int").alias("n"), F.lit(3).alias("due"), F.lit(False).alias("gone"), F.col("o.lost").alias("lost"))
    own = seen.select("image_id", "y", "x", "n", F.expr(f"due & {3 - bit}").alias("due"), "gone", F.lit(0).alias("lost"))
    merged = own.unionByName(told).groupBy("image_id", "y", "x").agg(F.max("n").alias("n"), F.bit_or("due").alias("due"), F.max("gone").alias("gone"), F.bit_or("lost").alias("lost"))
    return merged.select("image_id", "y", "x", F.expr("coalesce(n, 255) & ~lost").cast("int").alias("n"), "due", "gone")


def skeleton(ink: DataFrame) -> DataFrame:
    """Zhang-Suen thinning to the fixpoint, on a front.

    The front holds the ink that has a neighbour which is no ink; all other ink
    cannot go and is read once.  Each step reads the front alone, and images in which
    nothing is due leave it.
    """
    every = materialize(ink.select("image_id", "y", "x").distinct(), "thin")
    front = _neighbours(every).filter("n <> 255").select("image_id", "y", "x", F.col("n").cast("int").alias("n"), F.lit(3).alias("due"), F.lit(False).alias("gone"))
    front, gone = materialize(front, "thin"), []
    while True:
        for second in (False, True):
            step = materialize(_front_step(front, second), "thin")
            gone.append(step.filter("gone").select("image_id", "y", "x"))
            front = step.filter("not gone")
        due = front.filter("due <> 0").select("image_id").distinct()
        front = materialize(front.join(due, "image_id", "left_semi"), "thin")
        if front.isEmpty():
            return every.join(reduce(DataFrame.unionByName, gone), ["image_id", "y", "x"], "left_anti")


def contours(px: DataFrame) -> DataFrame:
    """``image_id, label, k, y, x``: outer contour pixels of each component, counter-clockwise from the first in raster order.

    Sides of pixels against the background are directed edges with the ink to
    their right; the next edge is found by a join, and its place from the start
    (the smallest raster index) by pointer doubling.
    """
    key = ["image_id", "y", "x"]
    ink = px.select(*key, "label")
    sides = F.expr("array(struct(0 as d, -1 as dy, 0 as dx), struct(1 as d, 0 as dy, 1 as dx), struct(2 as d, 1 as dy, 0 as dx), struct(3 as d, 0 as dy, -1 as dx))")
    s = ink.withColumn("s", F.explode(sides)).withColumn("ny", F.expr("y + s.dy")).withColumn("nx", F.expr("x + s.dx"))
    free = s.join(ink.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx")), ["image_id", "ny", "nx"], "left_anti")
    e = free.select("image_id", "label", "y", "x", "s.d", F.expr("y + case s.d when 0 then 0 when 1 then 0 when 2 then 1 else 1 end").alias("fy"), F.expr("x + case s.d when 0 then 0 when 1 then 1 when 2 then 1 else 0 end").alias("fx"))
    e = e.withColumn("ty", F.expr("fy + case d when 1 then 1 when 3 then -1 else 0 end")).withColumn("tx", F.expr("fx + case d when 0 then 1 when 2 then -1 else 0 end"))
    e = materialize(e.withColumn("id", F.monotonically_increasing_id()), "contour")
    a, b = e.alias("a"), e.alias("b")
    meet = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ty") == F.col("b.fy")) & (F.col("a.tx") == F.col("b.fx"))
    turn = F.expr("pmod(b.d - a.d + 1, 4)")  # a left turn first: diagonal pixels belong together
    nxt = a.join(b, meet).groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("b.id"), turn).alias("next"))
    start = e.groupBy("image_id", "label").agg(F.min_by("id", F.struct("y", "x", "d")).alias("head")).select("head")
    hop = materialize(nxt.join(start, F.col("next") == F.col("head"), "left").select("id", F.when(F.col("head").isNull(), F.col("next")).alias("next"), F.lit(1).alias("n")), "contour")
    while True:
        far = hop.alias("p").join(hop.alias("q"), F.col("p.next") == F.col("q.id"), "left")
        moved = far.select(F.col("p.id").alias("id"), F.col("q.next").alias("next"), F.expr("p.n + coalesce(q.n, 0)").alias("n"))
        before, hop = hop, materialize(moved, "contour")
        if hop.filter("next is not null").count() == before.filter("next is not null").count():
            break  # what is left runs round holes and never meets a start
    left = hop.filter("next is null").select("id", "n")
    total = Window.partitionBy("image_id", "label")
    order = e.join(left, "id").withColumn("k", F.max("n").over(total) - F.col("n")).select("image_id", "label", "k", "y", "x")
    last = Window.partitionBy("image_id", "label").orderBy("k")
    step = order.withColumn("same", (F.lag("y").over(last) == F.col("y")) & (F.lag("x").over(last) == F.col("x"))).filter("same is null or not same")
    full = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = step.withColumn("k", F.row_number().over(last) - 1).withColumn("end", F.max("k").over(total))
    back = (F.col("k") == F.col("end")) & (F.col("k") > 0) & (F.col("y") == F.first("y").over(full)) & (F.col("x") == F.first("x").over(full))
    once = step.withColumn("back", back).filter("not back")  # the way ends where it began
    turned = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.max("k").over(total) + 1 - F.col("k"))
    return once.withColumn("k", turned).select("image_id", "label", "k", "y", "x")


# ---- images of bounded size, one at a time in a task --------------------------

#: Pixels of a raster that one task holds as an array; larger ones are spread over tasks.
IMAGE_PIXELS = 1 << 21


def by_size(sizes: DataFrame, *areas: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sizes`` whose ``areas`` fit an array of one task, and the others."""
    fits = F.expr(" and ".join(f"{a} <= {IMAGE_PIXELS}" for a in areas))
    return sizes.filter(fits), sizes.filter(~fits)


def each_image(runs: DataFrame, sizes: DataFrame, kernel, out: str) -> DataFrame:
    """``kernel`` over the runs, and what comes with them, of each image of ``sizes``, whose columns come last."""
    ship_code(runs.sparkSession)
    dealt = runs.join(sizes, "image_id").repartition("image_id").sortWithinPartitions("image_id")
    return dealt.mapInArrow(partial(_over_images, kernel=kernel), f"image_id {dict(runs.dtypes)['image_id']}, {out}")


def _over_images(batches: Iterator[pa.RecordBatch], kernel) -> Iterator[pa.RecordBatch]:
    for block in I.whole_groups(batches, lambda b: I.changes(b.column(0))):
        cols = [c.to_numpy(zero_copy_only=False) for c in block.columns[1:]]
        ends = np.append(np.flatnonzero(np.append(True, I.changes(block.column(0)))), block.num_rows)
        for a, z in zip(ends[:-1], ends[1:]):
            got = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in kernel(*(c[a:z] for c in cols)).items()}
            n = len(next(iter(got.values())))
            yield pa.RecordBatch.from_arrays([block.column(0).slice(a, 1).take(pa.array(np.zeros(n, np.int64))), *got.values()], names=["image_id", *got])


def _raster(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, h: int, w: int, v=1) -> np.ndarray:
    """Runs, which have gaps between them, as an array of ``v``."""
    m = np.zeros((h, w + 1), np.int32)
    m[y, x0], m[y, x1 + 1] = v, -v
    return np.cumsum(m, axis=1)[:, :w]


def _leaving(second: bool) -> np.ndarray:
    """``_leaves`` of every byte of neighbours."""
    n = np.arange(256)
    on = (n[:, None] >> np.arange(8)) & 1
    first, last = ((1 | 4 | 64, 1 | 16 | 64) if second else (1 | 4 | 16, 4 | 16 | 64))
    a = ((on == 0) & (np.roll(on, -1, axis=1) == 1)).sum(1)
    return (on.sum(1) >= 2) & (on.sum(1) <= 6) & (a == 1) & ((n & first) != first) & ((n & last) != last)


LEAVING = _leaving(False), _leaving(True)


def _thinned(m: np.ndarray) -> np.ndarray:
    """``skeleton`` of one raster."""
    p, (h, w) = np.pad(m, 1).astype(np.uint8), m.shape
    own, gone = p[1:-1, 1:-1], True
    while gone:
        gone = False
        for table in LEAVING:
            n = np.zeros((h, w), np.uint8)
            for i, (dy, dx) in enumerate(AROUND):
                n |= p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << i
            drop = (own == 1) & table[n]
            own[drop] = 0
            gone = gone or bool(drop.any())
    return own == 1


#: Further than any two pixels of an array are apart.
FAR = 1 << 22


def _squared_distances(m: np.ndarray) -> np.ndarray:
    """Squares of ``distance_transform`` of one raster; ``FAR`` squared or more where there is no background."""
    y = np.arange(m.shape[0])[:, None]
    above = y - np.maximum.accumulate(np.where(m, -FAR, y), axis=0)
    below = np.minimum.accumulate(np.where(m, FAR + m.shape[0], y)[::-1], axis=0)[::-1] - y
    column = np.minimum(np.minimum(above, below), FAR).astype(np.int64) ** 2
    d2, k = column.copy(), 1
    while k < m.shape[1] and k * k < d2.max():
        np.minimum(d2[:, k:], column[:, :-k] + k * k, out=d2[:, k:])
        np.minimum(d2[:, :-k], column[:, k:] + k * k, out=d2[:, :-k])
        k += 1
    return d2


def _strokes(y, x0, x1, h, w) -> dict:
    m = _raster(y, x0, x1, h[0], w[0]) > 0
    y, x = np.nonzero(_thinned(m))
    d2 = _squared_distances(m)[y, x]
    return {"y": y.astype(np.int32), "x": x.astype(np.int32), "d": pa.array(np.sqrt(d2.astype(float)), mask=d2 >= FAR * FAR)}


def stroke_pixels(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image_id, y, x, d``: the skeleton of runs and its distances to the background, over rasters ``sizes(image_id, h, w)``.

    ``sizes`` should be written, as it is read more than once.  A raster that one task
    holds needs no rounds; larger ones go by ``skeleton`` and ``distance_transform``.
    """
    small, large = by_size(sizes.select("image_id", "h", "w"), "cast(h as bigint) * w")
    mask = mask.select("image_id", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    out = each_image(mask, small, _strokes, "y int, x int, d double")
    if large.isEmpty():
        return out
    ink = materialize(I.run_pixels(mask.join(large.select("image_id"), "image_id", "left_semi")), "thin")
    return out.unionByName(skeleton(ink).join(distance_transform(ink, large), ["image_id", "y", "x"]))


def _outline(y, x0, x1, label, h, w) -> dict:
    """``contours`` of one raster, with the number ``n`` of each contour's points."""
    names, of = np.unique(label, return_inverse=True)
    m = np.pad(_raster(y, x0, x1, h[0], w[0], of.astype(np.int32) + 1), 1)
    own = m[1:-1, 1:-1]
    free = np.stack([(own > 0) & (m[1 + dy : 1 + dy + own.shape[0], 1 + dx : 1 + dx + own.shape[1]] == 0) for dy, dx in ((-1, 0), (0, 1), (1, 0), (0, -1))], axis=2)
    py, px, d = np.nonzero(free)  # sides in the order of pixels
    fy, fx = py + (d >= 2), px + ((d == 1) | (d == 2))
    ty, tx = fy + (d == 1) - (d == 3), fx + (d == 0) - (d == 2)
    at = np.full((4, h[0] + 1, w[0] + 1), -1, np.int32)
    at[d, fy, fx] = np.arange(len(d))
    follow = np.full(len(d), -1)
    for turn in (2, 1, 0, -1):  # a left turn counts most
        side = at[(d + turn) % 4, ty, tx]
        follow = np.where(side >= 0, side, follow)
    group = own[py, px] - 1
    head = np.unique(group, return_index=True)[1]
    follow, n = np.where(np.isin(follow, head), -1, follow), np.ones(len(d), np.int64)
    while True:
        go = follow >= 0
        n, before = n + np.where(go, n[follow], 0), go.sum()
        follow = np.where(go, follow[follow], -1)
        if (follow >= 0).sum() == before:
            break
    on = np.flatnonzero(follow < 0)
    on = on[np.lexsort((-n[on], group[on]))]
    group, py, px = group[on], py[on], px[on]
    keep = np.append(True, (np.diff(group) != 0) | (np.diff(py) != 0) | (np.diff(px) != 0))
    group, py, px = group[keep], py[keep], px[keep]
    first = np.searchsorted(group, group, "left")
    last = np.append(np.diff(group) != 0, True)
    keep = ~(last & (np.arange(len(group)) > first) & (py == py[first]) & (px == px[first]))
    group, py, px = group[keep], py[keep], px[keep]
    first, n = np.searchsorted(group, group, "left"), np.bincount(group)[group]
    k = (n - (np.arange(len(group)) - first)) % n
    return {"label": names[group], "k": k.astype(np.int32), "y": py.astype(np.int32), "x": px.astype(np.int32), "n": n.astype(np.int64)}


def outlines(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """``contours`` of labelled runs, with the number ``n`` of points; ``sizes(image_id, h, w)`` should be written."""
    small, large = by_size(sizes.select("image_id", "h", "w"), "cast(h as bigint) * w")
    runs = labelled.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")), "label")
    out = each_image(runs, small, _outline, "label bigint, k int, y int, x int, n bigint")
    if large.isEmpty():
        return out
    far = contours(materialize(I.to_ink(runs.join(large.select("image_id"), "image_id", "left_semi")), "contour"))
    far = far.withColumn("n", F.count("*").over(Window.partitionBy("image_id", "label")))
    return out.unionByName(far.select("image_id", "label", F.col("k").cast("int").alias("k"), "y", "x", "n"))


def _scaled(y, x0, x1, h, w, nh, nw) -> dict:
    """Runs of one box scaled as ``R.resize`` does it linearly, where more than half is ink; 4 pixels are left around."""
    v = _raster(y, x0, x1, h[0], w[0]) * 255.0
    for n, m in ((h[0], nh[0]), (w[0], nw[0])):
        s = (np.arange(m) + 0.5) * n / m - 0.5
        k = (s - np.floor(s))[:, None]
        low = np.floor(s).astype(int)
        v = ((1 - k) * v[np.clip(low, 0, n - 1)] + k * v[np.clip(low + 1, 0, n - 1)]).T
    step = np.diff(np.pad((np.rint(v) > 127).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), x1 = np.nonzero(step == 1), np.nonzero(step == -1)[1]
    return {"y": (y + 4).astype(np.int32), "x0": (x0 + 4).astype(np.int32), "x1": (x1 + 3).astype(np.int32)}


# ---- features: one row per image, null where not computable ---------------


def variation(v):
    """Population standard deviation over mean; null when empty or the mean is not positive."""
    return F.when(F.avg(v) > 0, F.stddev_pop(v) / F.avg(v))


def stroke_width_var(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """``mask`` are runs."""
    return stroke_pixels(mask, sizes).groupBy("image_id").agg(variation("d").alias("stroke_width_var"))


def spacing_dev(boxes: DataFrame) -> DataFrame:
    """Variation of the gaps between neighbouring boxes ``(image_id, x, y, w, h)``; n boxes have n - 1 gaps."""
    after = F.lead("x").over(Window.partitionBy("image_id").orderBy("x", "y", "w", "h"))
    gap = F.when(after.isNotNull(), F.greatest(after - (F.col("x") + F.col("w")), F.lit(0)))
    return boxes.withColumn("gap", gap).groupBy("image_id").agg(F.when(F.count("*") >= 2, variation("gap")).alias("spacing_dev"))


def baseline_wobble(boxes: DataFrame) -> DataFrame:
    b = F.col("y") + F.col("h")
    return boxes.groupBy("image_id").agg(F.when(F.count("*") >= 2, (F.max(b) - F.min(b)) / F.percentile("h", F.lit(0.5))).alias("baseline_wobble"))


def slant_var(mask: DataFrame) -> DataFrame:
    """Spread of edge angles within 30 degrees of the vertical gradient; ``mask`` is a dense 0/1 raster."""
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0)) - 90
    e = R.sobel(mask).filter(F.hypot("gx", "gy") > 0.5).withColumn("t", angle).filter(F.abs("t") < 30)
    return e.groupBy("image_id").agg(F.when(F.count("*") > 10, F.stddev_pop("t")).alias("slant_var"))


def slant_var_of_runs(mask: DataFrame) -> DataFrame:
    """``slant_var`` of runs ``(image_id, y, x0, x1)`` that leave the raster's outermost pixels free.

    Along a line both parts of the gradient are sums of steps at the ends of the runs in
    three lines, so rows are in proportion to runs, and only pieces with a slope become pixels.
    """
    lines = F.explode(F.expr("array(struct(-1 as dy, 1 as w, 1 as s), struct(0 as dy, 2 as w, 0 as s), struct(1 as dy, 1 as w, -1 as s))"))
    steps = F.explode(F.expr("array(struct(x0 - 1 as x, l.w as gx, l.s as gy), struct(x0 as x, 0 as gx, 2 * l.s as gy), struct(x0 + 1 as x, -l.w as gx, l.s as gy), struct(x1 as x, -l.w as gx, -l.s as gy), struct(x1 + 1 as x, 0 as gx, -2 * l.s as gy), struct(x1 + 2 as x, l.w as gx, -l.s as gy))"))
    e = mask.select("image_id", "y", "x0", "x1", lines.alias("l")).select("image_id", F.expr("y + l.dy").alias("y"), steps.alias("e"))
    e = e.groupBy("image_id", "y", "e.x").agg(F.sum("e.gx").alias("gx"), F.sum("e.gy").alias("gy")).filter("gx <> 0 or gy <> 0")
    line = Window.partitionBy("image_id", "y").orderBy("x")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    part = e.select("image_id", (F.lead("x").over(line) - F.col("x")).alias("n"), *(F.sum(c).over(upto).cast("double").alias(c) for c in ("gx", "gy")))
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0)) - 90
    part = part.filter(F.hypot("gx", "gy") > 0.5).withColumn("t", angle).filter(F.abs("t") < 30)
    each = part.select("image_id", "t", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.groupBy("image_id").agg(F.when(F.count("*") > 10, F.stddev_pop("t")).alias("slant_var"))


def curvature_var(px: DataFrame, outer: DataFrame, step: int = 5) -> DataFrame:
    """Spread of the turns along every fifth point of contours of 15 points or more; needs six turns.

    ``outer(image_id, label)`` are the components that count, not those inside another's hole.
    """
    c = contours(px.join(outer, ["image_id", "label"], "left_semi"))
    return _turns(c.withColumn("n", F.count("*").over(Window.partitionBy("image_id", "label"))), step)


def _turns(c: DataFrame, step: int = 5) -> DataFrame:
    """``curvature_var`` of contours that have ``n`` points."""
    long = c.filter("n >= 15").filter(F.col("k") % step == 0)
    w = Window.partitionBy("image_id", "label").orderBy("k")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = lambda v: F.coalesce(F.lead(v).over(w), F.first(v).over(full))
    way = long.withColumn("t", F.atan2(ring("y") - F.col("y"), ring("x") - F.col("x")))
    turn = way.withColumn("dt", ring("t") - F.col("t")).withColumn("dt", F.atan2(F.sin("dt"), F.cos("dt")))
    return turn.groupBy("image_id").agg(F.when(F.count("*") > 5, F.stddev_pop("dt")).alias("curvature_var"))


def component_features(comp: DataFrame) -> DataFrame:
    """``cc_size_var`` (0 with fewer than two components) and ``stroke_connectivity``."""
    n = F.count("*")
    return comp.groupBy("image_id").agg(F.when(n >= 2, variation("area")).otherwise(F.lit(0.0)).alias("cc_size_var"), (1 / n).alias("stroke_connectivity"))


def contour_irregularity(labelled: DataFrame, outer: DataFrame) -> DataFrame:
    """Hull areas of the components ``outer(image_id, label)`` over ink pixels; ``labelled`` are runs."""
    hulls = _hulls(labelled.groupBy("image_id", "label", "y").agg(F.min("x0").alias("l"), F.max("x1").alias("r")))
    outer = hulls.join(outer, ["image_id", "label"])
    n = labelled.groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    return outer.groupBy("image_id").agg(F.sum("hull").alias("s")).join(n, "image_id").select("image_id", (F.col("s") / F.col("n")).alias("contour_irregularity"))


def ink_mask(px: DataFrame, height: int | None = None) -> DataFrame:
    """The pixels of ``ink_mask_runs``."""
    return I.run_pixels(ink_mask_runs(px, height))


def ink_mask_runs(px: DataFrame, height: int | None = None) -> DataFrame:
    """Runs of ink by polarity, blur, Otsu and the 2 % area rule, moved to its bounding box plus 4.

    With ``height`` the bounding box is scaled to it (bilinear, above half stays).
    """
    bright = R.to_bright_ink(px, qs=R.SHAPE_POLARITY)
    blurred = R.gaussian_blur(bright, 3).withColumn("v", F.rint("v").cast("int"))
    lit = blurred.join(R.otsu(blurred), "image_id").filter("v > thr").select("image_id", "y", "x")
    lab = materialize(I.label_runs(lit), "mask")
    kept = lab.join(I.largest_share(I.components(lab)).select("image_id", "label"), ["image_id", "label"], "left_semi")
    box = kept.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x0").alias("left"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x1") - F.min("x0") + 1).alias("w"))
    moved = kept.join(box, "image_id").select("image_id", F.expr("y - y0").alias("y"), F.expr("x0 - left").alias("x0"), F.expr("x1 - left").alias("x1"))
    if height is None:
        return moved.select("image_id", *((F.col(c) + 4).alias(c) for c in ("y", "x0", "x1")))
    s = box.select("image_id", "h", "w").withColumns({"nh": F.lit(height), "nw": F.greatest(F.lit(1), F.bround(F.col("w") * height / F.col("h")).cast("int"))})
    small, large = by_size(materialize(s, "mask"), "cast(h as bigint) * w", "cast(nh as bigint) * nw")
    out = each_image(moved, small, _scaled, "y int, x0 int, x1 int")
    if large.isEmpty():
        return out
    # pixels without ink add nothing to the sums, so the sparse table is enough
    scaled = R.resize(I.run_pixels(moved).withColumn("v", F.lit(255)), large, "linear").filter(F.rint("v") > 127)
    far = I.runs(scaled.select("image_id", F.expr("y + 4").alias("y"), F.expr("x + 4").alias("x")))
    return out.unionByName(far)


#: The eight features in the order of a model record.
FEATURES = ["stroke_width_var", "spacing_dev", "slant_var", "baseline_wobble", "curvature_var", "cc_size_var", "contour_irregularity", "stroke_connectivity"]


def features(px: DataFrame, height: int | None = 100, least_ink: int = 30) -> DataFrame:
    """The eight shape features of each raster with ``least_ink`` ink pixels or more."""
    from rasterlake.operators.layout import merge_boxes

    mask = materialize(ink_mask_runs(px, height), "features")
    enough = mask.groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), (F.max("y") + 5).alias("h"), (F.max("x1") + 5).alias("w")).filter(F.col("n") >= least_ink)
    enough = materialize(enough, "features")
    sizes = enough.select("image_id", "h", "w")
    lab = materialize(I.labelled_runs(mask.join(enough.select("image_id"), "image_id", "left_semi")), "features")
    comp = materialize(I.components(lab), "features")
    boxes = materialize(merge_boxes(comp), "features")
    outer = materialize(I.outer_labels(lab, I.outside(lab.select("image_id", "y", "x0", "x1"), sizes)), "features")
    turns = _turns(outlines(lab.join(outer, ["image_id", "label"], "left_semi"), sizes))
    out = sizes.select("image_id")
    for f in (stroke_width_var(lab, sizes), spacing_dev(boxes), slant_var_of_runs(lab), baseline_wobble(boxes), turns, component_features(comp), contour_irregularity(lab, outer)):
        out = out.join(f, "image_id", "left")
    return out
