"""Deciding which rasters hold marks or writing."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterlake.operators import ink as I, learn as M, rasters as R, shapes as S
from rasterlake.session import materialize

#: Words shown for the reasons of the gate.
NO_WRITING, NOT_WRITING = "no writing", "not writing"


def detect_markings(px: DataFrame, threshold: int = 200, min_area: float = 500, denoise: bool = True) -> DataFrame:
    """``image_id, label, x, y, w, h, contour_area`` of bright marks after a 5x5 median."""
    sizes = R.shape(px)
    lit = (R.median_blur(px) if denoise else px).filter(F.col("v") > threshold).select("image_id", "y", "x")
    lab = materialize(I.label_runs(lit), "marks")
    area = S.contour_area(lab, sizes).filter(F.col("area") >= min_area).withColumnRenamed("area", "contour_area")
    return I.components(lab).drop("area").join(area, ["image_id", "label"])


def strengths(px: DataFrame, dark: bool = True, size: int = 15) -> DataFrame:
    """``R.ink_strength`` of whole numbers; a raster that fits a task is one array there, so its windows are not sorted."""
    small, large = S.by_size(materialize(R.shape(px), "soft"), "cast(h as bigint) * w")
    whole = px.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("y", "x", "v")))
    out = S.each_image(whole, small, partial(_strengths, dark=dark, size=size), "y int, x int, v int")
    if large.isEmpty():
        return out
    return out.unionByName(R.ink_strength(whole.join(large.select("image_id"), "image_id", "left_semi"), dark, size))


def _strengths(y, x, v, h, w, dark: bool, size: int) -> dict:
    """Ink strength of one raster; closing is an opening of the negative."""
    sign, none = (1 if dark else -1), -(1 << 20)
    m = np.full((h[0], w[0]), none)
    m[y, x] = sign * v
    there = m != none
    for f in (1, -1):
        m = np.where(there, f * _widest(np.where(there, f * m, none), size, none), none)
    return {"y": y, "x": x, "v": np.clip(m[y, x] - sign * v, 0, 255).astype(np.int32)}


def _widest(m: np.ndarray, size: int, none: int) -> np.ndarray:
    """The maximum over an ellipse around each place; places outside hold ``none``."""
    half, (h, w), r = R.half_widths(size), m.shape, size // 2
    p, line, lines = np.pad(m, ((0, 0), (r, r)), constant_values=none), m, {0: m}
    for k in range(1, r + 1):
        lines[k] = line = np.maximum(line, np.maximum(p[:, r - k : r - k + w], p[:, r + k : r + k + w]))
    out = lines[half[0]]
    for dy, k in half.items():
        q = np.pad(lines[k], ((r, r), (0, 0)), constant_values=none)
        out = np.maximum(out, q[r + dy : r + dy + h])
    return out


def gate_rasters(px: DataFrame, dark: bool = True, height: int = 360, size: int = 15) -> tuple[DataFrame, DataFrame]:
    """Ink strength and gray paper of ``px(image_id, y, x, v)``, or of channels ``(image_id, ch, y, x, v)``.

    Images above ``height`` are scaled down first, then a 3x3 blur (rounded).
    Channels 0, 1, 2 are blue, green, red; the strongest channel counts.
    """
    colour = "ch" in px.columns
    keyed = px.select(F.struct("image_id", "ch").alias("image_id"), "y", "x", "v") if colour else px
    soft = materialize(R.gaussian_blur(R.shrink_to(keyed, height)).withColumn("v", F.rint("v").cast("int")), "soft")
    strength = materialize(strengths(soft, dark, size), "strength")  # the gate and its crops read it many times
    if not colour:
        return strength, soft
    luma = F.sum(F.expr("v * case image_id.ch when 0 then 0.114D when 1 then 0.587D else 0.299D end"))
    paper = soft.groupBy("image_id.image_id", "y", "x").agg(F.rint(luma).cast("int").alias("v"))
    return strength.groupBy("image_id.image_id", "y", "x").agg(F.max("v").alias("v")), paper


def ring_spread(px: DataFrame, labelled: DataFrame, every: DataFrame | None = None, least: int = 20) -> DataFrame:
    """``image_id, label, spread``: brightness spread in an 11x11 ring around a component, away from all ink.

    ``labelled`` are runs, ``every`` those of all ink (else the same); they are widened as runs.
    """
    ring = I.run_pixels(I.dilate_runs(labelled, 5, ("image_id", "label")), ("image_id", "label"))
    grown = I.run_pixels(I.dilate_runs(labelled if every is None else every, 1))
    free = ring.join(grown, ["image_id", "y", "x"], "left_anti")
    return free.join(px, ["image_id", "y", "x"]).groupBy("image_id", "label").agg(F.when(F.count("*") >= least, F.stddev_pop("v")).alias("spread"))


def _gated(px: DataFrame, paper: DataFrame | None, max_spread: float) -> tuple[DataFrame, DataFrame]:
    """The gate's table, and the ink of the rasters that pass its cheap tests."""
    sizes = R.shape(px)
    thr = R.noise_threshold(px).select("image_id", "thr")
    lit = R.open_2x2(px.join(thr, "image_id").withColumn("v", (F.col("v") > F.col("thr")).cast("int")).drop("thr")).filter("v = 1").select("image_id", "y", "x")
    lab = materialize(I.label_runs(lit), "gate")
    comp = I.classify_size(I.components(lab), sizes)
    if paper is not None:
        some = lab.join(comp.filter("kind = 'candidate'").select("image_id", "label"), ["image_id", "label"], "left_semi")
        comp = comp.join(ring_spread(paper, some, lab), ["image_id", "label"], "left")
        comp = comp.withColumn("kind", F.when((F.col("kind") == "candidate") & (F.col("spread") > max_spread), "textured").otherwise(F.col("kind")))
    comp = materialize(comp, "gate")
    cand, edge = F.col("kind") == "candidate", F.col("kind") == "border"
    m = comp.groupBy("image_id").agg(F.sum(F.when(cand, F.col("area")).otherwise(0)).alias("area"), F.sum(F.when(edge, F.col("area")).otherwise(0)).alias("border"), F.count_if(cand).alias("pieces"), F.min(F.when(cand, F.col("y"))).alias("top"), F.max(F.when(cand, F.col("y") + F.col("h"))).alias("bottom"))
    m = sizes.join(m, "image_id", "left").fillna(0, ["area", "border", "pieces"])
    cheap = F.when(F.expr("area < 0.001 * h * w"), "none").when(F.expr("area > 0.15 * h * w"), "too much dark").when(F.expr("border > 2 * area"), "runs off box").when(F.col("pieces") > 40, "too many pieces")
    m = materialize(m.withColumn("cheap", cheap), "gate")
    passed = m.filter("cheap is null").select("image_id")
    runs = lab.join(comp.filter(cand).select("image_id", "label"), ["image_id", "label"], "left_semi").join(passed, "image_id", "left_semi")
    runs = materialize(runs.select("image_id", "y", "x0", "x1"), "gate")
    thin = S.stroke_pixels(runs, m.filter("cheap is null").select("image_id", "h", "w"))
    thin = thin.groupBy("image_id").agg(F.count("*").alias("skel"), (2 * F.percentile("d", F.lit(0.5))).alias("width"))
    out = m.join(thin, "image_id", "left").withColumns({"skel": F.coalesce("skel", F.lit(0)), "width": F.when(F.col("cheap").isNull(), F.coalesce("width", F.lit(0.0)))})
    out = out.withColumn("likeness", F.when(F.col("cheap").isNull(), F.expr("skel * greatest(width, 1) / nullif(area, 0)")))
    late = F.when(F.expr("width > 0.10 * h"), "too thick").when(~F.col("likeness").between(0.5, 2), "not stroke-shaped")
    return out.withColumn("reason", F.coalesce("cheap", late)).drop("cheap"), I.run_pixels(runs)


def find_writing(px: DataFrame, paper: DataFrame | None = None, max_spread: float = 15.0) -> DataFrame:
    """``image_id, reason`` and the measures of the gate, ``reason`` null where writing was found.

    ``px`` is the ink strength, ``paper`` the raster behind it.  Thinning and
    distances run only on rasters that pass the cheap tests; ink whose skeleton
    is empty has width 0 and is not stroke-shaped.
    """
    return _gated(px, paper, max_spread)[0]


def writing_crops(px: DataFrame, paper: DataFrame | None = None, max_spread: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """The gate's table, and of each raster with writing its crop, white with dark ink.

    Strengths are scaled by the 90th percentile of the ink's; the crop is the
    ink's box with a tenth of its height and 4 pixels around.
    """
    table, ink = _gated(px, paper, max_spread)
    table = materialize(table, "gate")
    ink = ink.join(table.filter("reason is null").select("image_id"), "image_id", "left_semi")
    top = ink.join(px, ["image_id", "y", "x"]).groupBy("image_id").agg(
        F.percentile("v", F.lit(0.9)).alias("hi"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
    )
    top = top.withColumn("pad", F.expr("cast(0.1 * (y1 - y0) as int) + 4")).withColumns({"y0": F.expr("greatest(0, y0 - pad)"), "x0": F.expr("greatest(0, x0 - pad)"), "y1": F.expr("y1 + pad"), "x1": F.expr("x1 + pad")})
    v = 255 - F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v") * 200 / F.greatest(F.col("hi"), F.lit(1.0))))
    part = px.join(top, "image_id").filter("y >= y0 and y < y1 and x >= x0 and x < x1")
    return table, part.select("image_id", F.expr("y - y0").alias("y"), F.expr("x - x0").alias("x"), F.floor(v).cast("int").alias("v"))


def judge(gated: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gate results with the decision of those that passed; others have a null probability."""
    return gated.select("image_id", "reason").join(decisions, "image_id", "left").withColumn("this_frame", F.coalesce(F.col("reason").isNull() & F.col("is_handwritten"), F.lit(False)))


def judge_rasters(px: DataFrame, model: list[dict], bias: float, threshold: float = 0.5, live: bool = True, features_fn=S.features, cols: list[str] = S.FEATURES) -> DataFrame:
    """Every raster's gate, features and decision.

    Live rasters pass ``find_writing`` and their crop is measured; others, whole
    photographs, need only ``has_ink`` and are measured whole.  ``features_fn``
    maps rasters to a table of ``image_id`` and ``cols``.
    """
    if live:
        gated, crops = writing_crops(*gate_rasters(px))
    else:
        seen = materialize(R.has_ink(px), "gate")
        gated = seen.select("image_id", F.when(~F.col("has_ink"), "none").alias("reason"))
        crops = px.join(gated.filter("reason is null"), "image_id", "left_semi")
    return judge(gated, M.decide(features_fn(materialize(crops, "gate")), cols, model, bias, threshold))


def shown_reason(reason):
    """A gate's reason in the words shown."""
    return F.when(reason.isNull(), None).when(reason == "none", NO_WRITING).otherwise(NOT_WRITING)
