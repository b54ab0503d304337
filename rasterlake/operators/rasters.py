"""Neighbourhood and per-image operators on ``pixels(image_id, y, x, v)``.

Rows and columns are window partitions, so an image of any size is spread over
many; the exchange of one pass is by ``(image_id, y)`` or ``(image_id, x)``.
Borders are named per operator: ``reflect`` mirrors without the edge pixel,
``replicate`` repeats it, ``ignore`` leaves outside pixels out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from rasterlake.session import ship_code


def rows_of():
    """Window along each row of pixels."""
    return Window.partitionBy("image_id", "y").orderBy("x")


def columns_of():
    """Window along each column of pixels."""
    return Window.partitionBy("image_id", "x").orderBy("y")


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` of doubles with one rounding, by the error terms of the product and of the sum."""
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    s = p + c
    off = (p - (s - (s - p))) + (c - (s - p))
    return s + (off + ((ah * bh - p) + ah * bl + al * bh + al * bl))


def percentiles(px: DataFrame, qs: list[float], name: str = "q") -> DataFrame:
    """Exact percentiles per image with linear interpolation: ``q0, q1, ...``.

    Between two values it is ``lo * (1 - part) + hi * part``, rounded as the SQL's engine does:
    another order of these operations breaks the ties of compared percentiles otherwise.
    """
    hist = px.groupBy("image_id", F.col("v").cast("double").alias("v")).agg(F.count("v").alias("n"))
    every = Window.partitionBy("image_id")  # a row for each value
    h = hist.select("image_id", "v", "n", F.sum("n").over(every.orderBy("v")).alias("upto"), F.sum("n").over(every).alias("total"))
    cols = []
    for i, q in enumerate(qs):
        at = (F.col("total") - 1) * F.lit(float(q))
        ends = (F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("v"))) for k in (F.floor(at), F.ceil(at)))
        cols.append(F.struct(*(e.alias(n) for e, n in zip(ends, ("lo", "hi"))), F.max(at - F.floor(at)).alias("part")).alias(f"{name}{i}"))
    got = h.groupBy("image_id").agg(*cols)
    value = lambda q: fused(q["lo"], 1 - q["part"], q["hi"] * q["part"])
    return got.select("image_id", *(value(F.col(f"{name}{i}")).alias(f"{name}{i}") for i in range(len(qs))))


def shape(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _shifted(v: str, w, k: int, reflect: bool, along: str) -> Column:
    """Value ``k`` places on (negative: back) under a border rule; ``k`` of 0, 1 or 2 when reflecting."""
    if k == 0:
        return F.col(v)
    there = F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w)
    if not reflect:
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(there, F.last(v).over(full) if k > 0 else F.first(v).over(full))
    back = F.lag(v, k).over(w) if k > 0 else F.lead(v, -k).over(w)
    if abs(k) == 1:
        return F.coalesce(there, back, v)
    one = F.lead(v, 1).over(w) if k > 0 else F.lag(v, 1).over(w)
    return F.coalesce(there, F.when(one.isNotNull(), F.col(v)).otherwise(back), v)


def separable(px: DataFrame, kernel: list[float], reflect: bool = True, kernel_y: list[float] | None = None) -> DataFrame:
    """Weighted sum along rows, then along columns (``kernel_y``, else the same)."""
    r, ky = len(kernel) // 2, kernel_y or kernel
    across = sum((F.lit(k) * _shifted("v", rows_of(), i - r, reflect, "x") for i, k in enumerate(kernel) if k), F.lit(0.0))
    down = sum((F.lit(k) * _shifted("s", columns_of(), i - r, reflect, "y") for i, k in enumerate(ky) if k), F.lit(0.0))
    return px.withColumn("s", across).withColumn("v", down).drop("s")


def gaussian_blur(px: DataFrame, size: int = 3) -> DataFrame:
    """3x3 or 5x5 binomial blur, reflecting borders, in double precision."""
    return separable(px, {3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}[size])


def median_blur(px: DataFrame) -> DataFrame:
    """5x5 median, replicating borders."""
    row = px.withColumn("a", F.array(*(_shifted("v", rows_of(), k, False, "x") for k in range(-2, 3))))
    return row.withColumn("v", F.sort_array(F.flatten(F.array(*(_shifted("a", columns_of(), k, False, "y") for k in range(-2, 3)))))[12]).drop("a")


def gaussian_kernel(block: int) -> list[float]:
    """Normalised Gaussian weights of an odd window; the deviation follows from its size."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - block // 2) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    return [x / sum(w) for x in w]


def _weighted_lines(px: DataFrame, kernels: DataFrame, along: str, across: str) -> DataFrame:
    """``v`` as the weighted sum along one axis, replicating borders, by each image's array of ``kernels(image_id, k)``.

    A line of one image is one array, so a window of any width costs no rows; weights meet lines, not pixels.
    """
    ship_code(px.sparkSession)
    rest = [c for c in px.columns if c not in ("image_id", along, across, "v")]
    line = px.groupBy("image_id", across).agg(F.sort_array(F.collect_list(F.struct(along, "v", *rest))).alias("a")).join(kernels, "image_id")
    line = line.select(F.col("a.v").cast("array<double>").alias("v"), F.col("k").cast("array<double>").alias("k"), "image_id", across, "a")
    out = line.mapInArrow(_weighted_sums, StructType([*line.schema.fields[2:]]).add("s", ArrayType(DoubleType())))
    out = out.select("image_id", across, F.explode(F.arrays_zip("a", "s")).alias("z"))
    return out.select("image_id", F.col(f"z.a.{along}").alias(along), across, F.col("z.s").alias("v"), *(F.col(f"z.a.{c}").alias(c) for c in rest))


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts for the first two columns, a line and weights, the line's sums weighted around each place; they come last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (v, at), (k, from_) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().astype(np.int64)) for c in batch.columns[:2])
        n, width = np.diff(at), np.diff(from_)
        sums = np.empty(at[-1] - at[0])
        for long, wide in np.unique(np.stack([n, width]), axis=1).T:  # lines of one length at once
            rows = np.flatnonzero((n == long) & (width == wide))
            if not long:
                continue
            place = np.clip(np.arange(-(wide // 2), long + wide - wide // 2 - 1), 0, long - 1)
            lines, weights = v[at[rows][:, None] + place], k[from_[rows][:, None] + np.arange(wide)]
            total = np.zeros((len(rows), long))
            for j in range(wide):
                total += weights[:, j, None] * lines[:, j : j + long]
            sums[at[rows][:, None] - at[0] + np.arange(long)] = total
        lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(sums))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], names=[*batch.schema.names[2:], "s"])


def adaptive_threshold(px: DataFrame, block: int | None = 15, sensitivity: float = 5.0) -> DataFrame:
    """``ink``: pixels above the local Gaussian mean by more than ``sensitivity`` (replicating borders).

    Without ``block`` every image has its own, ``block_size`` of its sides.
    """
    if block is not None:
        mean = separable(px.withColumn("v0", F.col("v")), gaussian_kernel(block), reflect=False)
        return mean.filter(F.col("v0") > F.col("v") + sensitivity).select("image_id", "y", "x")
    d = "(i - b div 2)"
    sigma = "(0.3D * ((b - 1) * 0.5D - 1) + 0.8D)"
    raw = F.expr(f"transform(sequence(0, b - 1), i -> exp(-{d} * {d} / (2 * {sigma} * {sigma})))")
    kernel = shape(px).select("image_id", block_size(F.col("h"), F.col("w")).alias("b")).withColumn("r", raw)
    kernel = kernel.select("image_id", F.expr("transform(r, x -> x / aggregate(r, 0D, (s, y) -> s + y))").alias("k"))
    keyed = px.select("image_id", "y", "x", F.col("v").cast("double").alias("v"), F.col("v").alias("v0"))
    mean = _weighted_lines(_weighted_lines(keyed, kernel, "x", "y"), kernel, "y", "x")
    return mean.filter(F.col("v0") > F.col("v") + sensitivity).select("image_id", "y", "x")


def block_size(h: Column, w: Column) -> Column:
    """A sixth of the short side, made odd, 15 at least."""
    return F.greatest(F.lit(15), F.floor(F.least(h, w) / 6).cast("int").bitwiseOR(F.lit(1)))


def open_2x2(px: DataFrame) -> DataFrame:
    """Opening: minimum over offsets -1, 0, then maximum over 0, +1; outside pixels are ignored."""
    for f, lo, hi in ((F.min, -1, 0), (F.max, 0, 1)):
        px = px.withColumn("v", f("v").over(rows_of().rowsBetween(lo, hi))).withColumn("v", f("v").over(columns_of().rowsBetween(lo, hi)))
    return px


def half_widths(size: int) -> dict[int, int]:
    """Half of an ellipse's width in each of its lines."""
    r = size // 2
    return {dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) for dy in range(-r, r + 1)}


def _ellipse(px: DataFrame, size: int, f) -> DataFrame:
    r, half = size // 2, half_widths(size)
    for k in sorted(set(half.values())):
        px = px.withColumn(f"m{k}", f("v").over(rows_of().rowsBetween(-k, k)))
    pick = F.greatest if f is F.max else F.least
    lines = [F.col(f"m{half[0]}")] + [(F.lead if dy > 0 else F.lag)(f"m{half[dy]}", abs(dy)).over(columns_of()) for dy in range(-r, r + 1) if dy]
    return px.withColumn("v", pick(*lines)).drop(*(f"m{k}" for k in set(half.values())))


def ellipse_close(px: DataFrame, size: int = 15) -> DataFrame:
    """Maximum, then minimum, over an elliptic neighbourhood; outside pixels are ignored."""
    return _ellipse(_ellipse(px, size, F.max), size, F.min)


def ellipse_open(px: DataFrame, size: int = 15) -> DataFrame:
    return _ellipse(_ellipse(px, size, F.min), size, F.max)


def ink_strength(px: DataFrame, dark: bool = True, size: int = 15) -> DataFrame:
    """How far a pixel is from its paper: closing minus pixel, or pixel minus opening; 0..255."""
    kept = px.withColumn("v0", F.col("v"))
    out = ellipse_close(kept, size) if dark else ellipse_open(kept, size)
    d = F.col("v") - F.col("v0") if dark else F.col("v0") - F.col("v")
    return out.withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), d))).drop("v0")


def ink_strength_channels(px: DataFrame, dark: bool = True, size: int = 15) -> DataFrame:
    """The largest ink strength over the channels of ``(image_id, ch, y, x, v)``."""
    keyed = px.withColumn("key", F.struct("image_id", "ch")).withColumnRenamed("image_id", "i").withColumnRenamed("key", "image_id")
    return ink_strength(keyed.drop("ch"), dark, size).groupBy(F.col("i").alias("image_id"), "y", "x").agg(F.max("v").alias("v"))


def dilate(ink: DataFrame, radius: int) -> DataFrame:
    """Sparse dilation by a square; the result may reach outside the raster."""
    from rasterlake.operators import ink as I

    return I.run_pixels(I.dilate_runs(I.runs(ink), radius))


def sobel(px: DataFrame) -> DataFrame:
    """``gx, gy`` of the 3x3 Sobel kernels, reflecting borders."""
    a, b = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
    gx = separable(px, b, kernel_y=a).withColumnRenamed("v", "gx")
    return gx.join(separable(px, a, kernel_y=b).withColumnRenamed("v", "gy"), ["image_id", "y", "x"])


#: Percentiles that tell ink from paper: when finding glyphs, and when measuring shapes.
GLYPH_POLARITY, SHAPE_POLARITY = (0.005, 0.5, 0.995), (0.01, 0.5, 0.99)


def polarity(px: DataFrame, qs: tuple[float, float, float] = GLYPH_POLARITY) -> DataFrame:
    """``image_id, dark``: whether ink is darker than paper, from percentiles of the blurred raster."""
    p = percentiles(gaussian_blur(px), list(qs))
    return p.select("image_id", ((F.col("q1") - F.col("q0")) > (F.col("q2") - F.col("q1"))).alias("dark"))


def to_bright_ink(px: DataFrame, kind: str = "auto", qs: tuple[float, float, float] = GLYPH_POLARITY) -> DataFrame:
    """Dark ink inverted; ``kind`` is dark, light or auto (by ``polarity``)."""
    if kind != "auto":
        return px.withColumn("v", 255 - F.col("v")) if kind == "dark" else px
    return px.join(polarity(px, qs), "image_id").withColumn("v", F.when(F.col("dark"), 255 - F.col("v")).otherwise(F.col("v"))).drop("dark")


def otsu(px: DataFrame) -> DataFrame:
    """``image_id, thr``: threshold of largest between-class variance, the lowest of equals."""
    hist = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")  # at most 256 rows each
    h = hist.select("image_id", "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_).alias("s"))
    w0, w1 = F.col("w0"), F.col("w") - F.col("w0")
    d = F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.round(w0.cast("double") * w1 * d * d, 3)).otherwise(F.lit(-1.0))
    return h.groupBy("image_id").agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("thr"))


def noise_threshold(px: DataFrame) -> DataFrame:
    """``image_id, noise, thr``: 1.4826 times the median absolute deviation, and five times it within 12..30."""
    # medians of whole numbers are exact in any order of operations, so both come from one count of values
    hist = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    med = hist.groupBy("image_id").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("med"))
    off = F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5), F.col("n"))
    mad = hist.join(med, "image_id").groupBy("image_id").agg((1.4826 * off).alias("noise"))
    return mad.select("image_id", "noise", F.greatest(F.lit(12.0), F.least(F.lit(30.0), 5 * F.col("noise"))).alias("thr"))


def has_ink(px: DataFrame) -> DataFrame:
    """Contrast of 40 or more, and 0.3 % to 35 % of pixels beyond half of it."""
    b = gaussian_blur(px, 5)
    p = percentiles(b, [0.01, 0.5, 0.99])
    dark = (F.col("q1") - F.col("q0")) > (F.col("q2") - F.col("q1"))
    contrast = F.greatest(F.col("q1") - F.col("q0"), F.col("q2") - F.col("q1"))
    lit = F.when(dark, F.col("q1") - F.col("v") > contrast / 2).otherwise(F.col("v") - F.col("q1") > contrast / 2)
    share = b.join(p, "image_id").groupBy("image_id").agg(F.avg(lit.cast("int")).alias("share"), F.first(contrast).alias("contrast"))
    return share.select("image_id", "contrast", "share", ((F.col("contrast") >= 40) & F.col("share").between(0.003, 0.35)).alias("has_ink"))


def roi_box(h: Column, w: Column, rw: float = 0.7, rh: float = 0.5) -> Column:
    """Centred box as ``struct(x, y, w, h)``."""
    bw, bh = (w * rw).cast("int"), (h * rh).cast("int")
    return F.struct(F.floor((w - bw) / 2).cast("int").alias("x"), F.floor((h - bh) / 2).cast("int").alias("y"), bw.alias("w"), bh.alias("h"))


def crop(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside ``boxes(image_id, box)``, from the box's corner on."""
    j = px.join(boxes, "image_id").filter("x >= box.x and x < box.x + box.w and y >= box.y and y < box.y + box.h")
    return j.withColumn("x", F.expr("x - box.x")).withColumn("y", F.expr("y - box.y")).drop("box")


def rotate(px: DataFrame, angle: int, sizes: DataFrame | None = None) -> DataFrame:
    """Clockwise rotation by 90, 180 or 270 degrees; other angles change nothing."""
    if angle not in (90, 180, 270):
        return px
    s = (shape(px) if sizes is None else sizes).select("image_id", F.col("h").alias("__h"), F.col("w").alias("__w"))
    x, y = {90: ("__h - 1 - y", "x"), 180: ("__w - 1 - x", "__h - 1 - y"), 270: ("y", "__w - 1 - x")}[angle]
    turned = px.join(s, "image_id").withColumns({"x": F.expr(x), "y": F.expr(y)})
    return turned.drop("__h", "__w")


def pad(px: DataFrame, margin: int, value: Column | int) -> DataFrame:
    """A constant border on every side."""
    s = shape(px).withColumn("y", F.explode(F.expr(f"sequence(0, h + {2 * margin} - 1)"))).withColumn("x", F.explode(F.expr(f"sequence(0, w + {2 * margin} - 1)")))
    border = s.filter(f"y < {margin} or y >= h + {margin} or x < {margin} or x >= w + {margin}").select("image_id", "y", "x")
    inner = px.select("image_id", (F.col("y") + margin).alias("y"), (F.col("x") + margin).alias("x"), "v")
    return inner.unionByName(border.withColumn("v", F.lit(value) if isinstance(value, int) else value))


def pad_half(px: DataFrame, q: float) -> DataFrame:
    """Half the height added on every side, filled with the image's percentile ``q``, truncated."""
    s = px.groupBy("image_id").agg(F.percentile("v", F.lit(q)).cast("int").alias("fill"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).withColumn("m", F.expr("cast(h div 2 as int)"))
    grid = s.withColumn("y", F.explode(F.expr("sequence(0, h + 2 * m - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w + 2 * m - 1)")))
    border = grid.filter("y < m or y >= h + m or x < m or x >= w + m").select("image_id", "y", "x", F.col("fill").alias("v"))
    inner = px.join(s.select("image_id", "m"), "image_id").select("image_id", F.expr("y + m").alias("y"), F.expr("x + m").alias("x"), "v")
    return inner.unionByName(border)


#: Source places and weights of an output place ``o`` when ``n`` places become ``m``.
TAPS = {
    "linear": "transform(sequence(0, 1), j -> struct(cast(greatest(0, least(n - 1, floor(s) + j)) as int) as i, case j when 1 then s - floor(s) else 1 - (s - floor(s)) end as k))",
    "cubic": "transform(transform(sequence(-1, 2), j -> struct(j, abs(j - (s - floor(s))) as t)), q -> struct(cast(greatest(0, least(n - 1, floor(s) + q.j)) as int) as i, "
    "case when q.t <= 1 then (1.25D * q.t - 2.25D) * q.t * q.t + 1 else ((-0.75D * q.t + 3.75D) * q.t - 6D) * q.t + 3D end as k))",
    "area": "transform(sequence(cast(floor(lo) as int), cast(least(n, ceil(hi - 1e-9D)) as int) - 1), j -> struct(j as i, (least(hi, j + 1D) - greatest(lo, cast(j as double))) * m / n as k))",
}


def _axis(sizes: DataFrame, old: str, new: str, at: str) -> DataFrame:
    """``image_id, at, o, k``: weights of the source places of each output place along one axis."""
    o = sizes.select("image_id", "method", F.col(old).cast("int").alias("n"), F.col(new).cast("int").alias("m")).withColumn("o", F.explode(F.expr("sequence(0, m - 1)")))
    o = o.withColumns({"s": F.expr("(o + 0.5D) * n / m - 0.5D"), "lo": F.expr("o * cast(n as double) / m"), "hi": F.expr("(o + 1) * cast(n as double) / m")})
    pick = F.expr(f"case method when 'linear' then {TAPS['linear']} when 'cubic' then {TAPS['cubic']} else {TAPS['area']} end")
    return o.select("image_id", "o", F.explode(pick).alias("t")).select("image_id", "o", F.col("t.i").alias(at), F.col("t.k").alias("k"))


def resize(px: DataFrame, sizes: DataFrame, method: str | None = None) -> DataFrame:
    """Each image from ``h`` x ``w`` to ``nh`` x ``nw`` of ``sizes(image_id, h, w, nh, nw)``.

    ``method`` is linear or cubic (centre-aligned, replicating borders) or area
    (overlap-weighted mean); without it each row of ``sizes`` names its own.
    The pass over the rows comes first, then that over the columns.
    """
    s = sizes if method is None else sizes.withColumn("method", F.lit(method))
    down = px.join(_axis(s, "h", "nh", "y"), ["image_id", "y"]).groupBy("image_id", F.col("o").alias("y"), "x").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    return down.join(_axis(s, "w", "nw", "x"), ["image_id", "x"]).groupBy("image_id", "y", F.col("o").alias("x")).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def resize_linear(px: DataFrame, factor: float) -> DataFrame:
    """Bilinear resize by one factor, centre-aligned, replicating borders."""
    new = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * factor).cast("int"))
    return resize(px, shape(px).withColumns({"nh": new("h"), "nw": new("w")}), "linear")


def shrink_to(px: DataFrame, height: int = 360) -> DataFrame:
    """Images above ``height`` scaled down to it by area means, rounded; the others as they are."""
    f = F.least(F.lit(1.0), height / F.col("h"))
    new = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * f).cast("int"))
    s = shape(px).withColumns({"nh": new("h"), "nw": new("w")})
    tall = resize(px, s.filter(F.col("h") > height), "area").withColumn("v", F.rint("v").cast("int"))
    return px.select("image_id", "y", "x", F.col("v").cast("int").alias("v")).join(s.filter(F.col("h") <= height).select("image_id"), "image_id", "left_semi").unionByName(tall)


def resize_area(px: DataFrame, factor: int) -> DataFrame:
    """Mean of ``factor`` x ``factor`` cells."""
    cell = lambda c: F.expr(f"cast({c} div {factor} as int)")
    return px.groupBy("image_id", cell("y").alias("y"), cell("x").alias("x")).agg(F.avg("v").alias("v"))


def mean_absolute_error(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.join(b.withColumnRenamed("v", "u"), ["image_id", "y", "x"])
    return j.groupBy("image_id").agg(F.avg(F.abs(F.col("v") - F.col("u"))).alias("mae"))


def contrast_map(px: DataFrame) -> DataFrame:
    """``255 - clip(v * 200 / max(p90, 1))``, truncated."""
    p = percentiles(px, [0.9])
    v = 255 - F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v") * 200 / F.greatest(F.col("q0"), F.lit(1.0))))
    return px.join(p, "image_id").withColumn("v", F.floor(v).cast("int")).drop("q0")
