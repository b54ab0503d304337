"""Registered queries of the image-table operators, over the given tables.

Floats are rounded to 6 places on both sides; every sort has a full tie-break.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake.operators import frames as FR, gate as G, ink as I, layout as L, learn as M, rasters as R, shapes as S
from rasterlake.plans.sql import SQL
from rasterlake.sources import images as IM, views as V
from rasterlake.session import broadcast_by_measure, materialize, scratch_path
from rasterlake.sources import sinks
from rasterlake.streaming import frames as ST
from rasterlake.streaming.landing import frame_stream, land_late
from rasterlake.streaming.sink import BatchSink, run_available

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: Fixed model for scoring queries: medians, means, deviations, weights of f1..f4.
MODEL = [{"median_for_missing": m, "mean": u, "std": s, "weight": w} for m, u, s, w in ((7.0, 7.0, 1.0, 0.4), (6.0, 6.0, 1.5, -0.3), (5.0, 5.0, 1.2, 0.2), (0.9, 0.9, 0.1, 0.5))]
#: Fixed model of the streamed frames' two features.
FRAME_MODEL = [{"median_for_missing": m, "mean": u, "std": s, "weight": w} for m, u, s, w in ((0.5, 0.5, 0.3, 0.8), (5.0, 5.0, 2.0, 0.5))]
INK = 135


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        broadcast_by_measure(spark)
        return f(spark, d)

    REGISTRY[f.__name__] = run
    return run


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def gray(spark: SparkSession, d: str) -> DataFrame:
    return V.embedding_pixels(spark, d)


def lit(spark: SparkSession, d: str) -> DataFrame:
    """Bright pixels of the embedding rasters as sparse ink."""
    return gray(spark, d).filter(F.col("v") > INK).select("image_id", "y", "x")


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Dark marks on paper: bright pixels as ink, three times as large, with a margin."""
    p = gray(spark, d).withColumn("v", F.when(F.col("v") > INK + 5, 40).otherwise(230))
    big = R.resize(p, R.shape(p).withColumns({"nh": F.col("h") * 3, "nw": F.col("w") * 3}), "linear")
    return materialize(R.pad_half(big.withColumn("v", F.rint("v").cast("int")), 0.5), "scenes")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return materialize(I.label_runs(lit(spark, d)), "labels")


# ---- rasters ---------------------------------------------------------------


@query
def raster_percentiles(spark, d):
    return r6(R.percentiles(gray(spark, d), [0.01, 0.5, 0.99, 0.005, 0.995, 0.1, 0.9]), *(f"q{i}" for i in range(7)))


@query
def raster_brightness(spark, d):
    p = gray(spark, d)
    return r6(p.groupBy("image_id").agg(F.avg("v").alias("mean"), S.variation("v").alias("cv"), F.avg((F.col("v") > INK).cast("int")).alias("ink")), "mean", "cv", "ink")


@query
def raster_blur3(spark, d):
    return r6(R.gaussian_blur(gray(spark, d), 3), "v")


@query
def raster_blur5(spark, d):
    return r6(R.gaussian_blur(gray(spark, d), 5), "v")


@query
def raster_polarity(spark, d):
    return R.polarity(gray(spark, d))


@query
def raster_bright_ink(spark, d):
    return R.to_bright_ink(gray(spark, d))


@query
def raster_median_blur(spark, d):
    return R.median_blur(gray(spark, d))


@query
def raster_denoise_error(spark, d):
    return r6(R.mean_absolute_error(gray(spark, d), R.median_blur(gray(spark, d))), "mae")


@query
def raster_open(spark, d):
    return R.open_2x2(gray(spark, d))


@query
def raster_ellipse_close(spark, d):
    return R.ellipse_close(gray(spark, d), 5)


@query
def raster_ellipse_close15(spark, d):
    return R.ellipse_close(gray(spark, d))


@query
def raster_ellipse_open15(spark, d):
    return R.ellipse_open(gray(spark, d))


@query
def raster_ink_strength(spark, d):
    return R.ink_strength(gray(spark, d), True, 5)


@query
def raster_dilate(spark, d):
    return R.dilate(lit(spark, d), 1)


@query
def raster_ring(spark, d):
    """Pixels that a dilation adds: set difference of masks."""
    return R.dilate(lit(spark, d), 1).join(lit(spark, d), ["image_id", "y", "x"], "left_anti")


@query
def raster_sobel(spark, d):
    return r6(R.sobel(gray(spark, d)), "gx", "gy")


@query
def raster_adaptive(spark, d):
    return R.adaptive_threshold(gray(spark, d), 5, 2.0)


@query
def raster_otsu(spark, d):
    return R.otsu(gray(spark, d))


@query
def raster_noise_threshold(spark, d):
    return r6(R.noise_threshold(gray(spark, d)), "noise", "thr")


@query
def raster_has_ink(spark, d):
    return r6(R.has_ink(gray(spark, d)), "contrast", "share")


@query
def raster_crop(spark, d):
    p = gray(spark, d)
    return R.crop(p, R.shape(p).select("image_id", R.roi_box(F.col("h"), F.col("w"), 0.7, 0.5).alias("box")))


@query
def raster_rotate(spark, d):
    return R.rotate(gray(spark, d), 90)


@query
def raster_rotate_180(spark, d):
    return R.rotate(gray(spark, d), 180)


@query
def raster_rotate_270(spark, d):
    return R.rotate(gray(spark, d), 270)


@query
def raster_resize_area(spark, d):
    return r6(R.resize_area(gray(spark, d), 2), "v")


@query
def raster_resize_linear(spark, d):
    return r6(R.resize_linear(gray(spark, d), 0.75), "v")


@query
def raster_reader_input(spark, d):
    return r6(L.reader_input(gray(spark, d)), "v")


@query
def raster_contrast_map(spark, d):
    return R.contrast_map(gray(spark, d))


# ---- ink and shapes --------------------------------------------------------


@query
def ink_runs(spark, d):
    return V.text_runs(spark, d)


@query
def ink_components(spark, d):
    return I.components(labelled(spark, d))


@query
def ink_text_components(spark, d):
    return I.components(V.labelled_texts(spark, d))


@query
def ink_clean(spark, d):
    return I.clean_components(I.components(labelled(spark, d)), R.shape(gray(spark, d)))


@query
def ink_size_kinds(spark, d):
    c = I.classify_size(I.components(labelled(spark, d)), R.shape(gray(spark, d)), 3)
    return c.groupBy("image_id").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("area"))), F.lit(0)).alias(k) for k in ("tiny", "border", "candidate")))


@query
def ink_largest_share(spark, d):
    return I.largest_share(I.components(labelled(spark, d)), 0.3, 2).select("image_id", "label", "area")


@query
def component_features(spark, d):
    return r6(S.component_features(I.components(labelled(spark, d))), "cc_size_var", "stroke_connectivity")


@query
def distance(spark, d):
    return r6(S.distance_transform(lit(spark, d), R.shape(gray(spark, d))), "d")


@query
def thinning_once(spark, d):
    return S.thinning_step(lit(spark, d), False)


@query
def skeleton(spark, d):
    return S.skeleton(lit(spark, d))


@query
def hull_areas(spark, d):
    return S.hull_area(I.to_ink(labelled(spark, d)))


@query
def contour_points(spark, d):
    return S.contours(I.to_ink(labelled(spark, d)))


@query
def shape_features(spark, d):
    f = S.features(gray(spark, d), None, 4)
    return r6(f, *(c for c in f.columns if c != "image_id"))


@query
def detect_markings(spark, d):
    return G.detect_markings(gray(spark, d), INK, 2.0)


@query
def find_writing(spark, d):
    return r6(G.find_writing(*G.gate_rasters(gray(spark, d), size=5)), "width", "likeness")


#: Fixed model of the eight shape features for the judging query.
SHAPE_MODEL = [{"median_for_missing": m, "mean": u, "std": s, "weight": w} for m, u, s, w in ((0.2, 0.2, 0.1, 0.5), (0.5, 0.6, 0.3, 0.3), (9.0, 10.0, 4.0, 0.2), (0.2, 0.3, 0.2, 0.4), (0.8, 0.8, 0.2, 0.1), (0.4, 0.5, 0.3, 0.2), (1.2, 1.3, 0.3, 0.3), (0.5, 0.4, 0.2, -0.3))]


@query
def judge_rasters(spark, d):
    """Whole photographs: ink test, eight features at full height, decision."""
    out = G.judge_rasters(scenes(spark, d), SHAPE_MODEL, 0.1, live=False)
    return r6(out.select("image_id", "reason", "prob", "this_frame"), "prob")


@query
def judge_live(spark, d):
    """Live frames: the gate, then the features of its crop."""
    out = G.judge_rasters(scenes(spark, d), SHAPE_MODEL, 0.1)
    return r6(out.select("image_id", G.shown_reason(F.col("reason")).alias("reason"), "prob", "this_frame"), "prob")


@query
def corpus_padded(spark, d):
    """Both classes of the second corpus, padded and inverted by their rule."""
    cls = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.expr("if(label % 2 = 0, 'handwritten', 'formal')").alias("cls"))
    px = IM.padded_corpus(gray(spark, d).join(cls, "image_id"))
    return r6(px.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


# ---- layout ----------------------------------------------------------------


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Component boxes of the sparse text rasters."""
    return materialize(I.components(V.labelled_texts(spark, d)), "boxes")


def listed(groups: DataFrame) -> DataFrame:
    """Groups with their labels as one text."""
    return groups.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query
def glyph_groups(spark, d):
    return listed(L.group_glyphs(I.components(labelled(spark, d))))


@query
def glyph_boxes(spark, d):
    return listed(L.merge_boxes(I.components(labelled(spark, d))))


@query
def glyph_lines(spark, d):
    return L.assign_lines(I.components(labelled(spark, d)).select("image_id", "x", "y", "w", "h", "label")).select("image_id", "label", "line")


@query
def glyph_top(spark, d):
    return L.top_groups(L.keep_tall(I.components(labelled(spark, d)).select("image_id", "x", "y", "w", "h"), 0.35, 2), 3)


@query
def glyph_gaps(spark, d):
    c = I.components(labelled(spark, d))
    return r6(S.spacing_dev(c).join(S.baseline_wobble(c), "image_id"), "spacing_dev", "baseline_wobble")


def mean_reader(pictures: DataFrame) -> DataFrame:
    """Readings from the mean brightness of each glyph's image."""
    m = pictures.groupBy("image_id", "pos").agg(F.avg("v").alias("m"))
    conf = F.pmod(F.col("m"), F.lit(1.0))
    return m.select("image_id", "pos", F.char(65 + F.floor("m") % 26).alias("char"), conf.alias("conf"), F.char(65 + F.floor(F.col("m") + 1) % 26).alias("alt"), (1 - conf).alias("alt_conf"))


@query
def find_glyphs(spark, d):
    glyphs, pictures = L.find_glyphs(scenes(spark, d), least=4)
    seen = pictures.groupBy("image_id", "pos").agg(F.count("*").alias("pixels"), F.avg("v").alias("mean"))
    return r6(glyphs.drop("labels").join(seen, ["image_id", "pos"]), "mean")


@query
def read_frames(spark, d):
    return L.read_frame(scenes(spark, d), mean_reader, min_conf=0.3, least=4)[1]


@query
def line_texts(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("image_id"), F.dayofmonth("ts").alias("line"), F.col("event_id").alias("pos"), F.substring("event_type", 1, 1).alias("char"), (F.abs("value") / 100).alias("conf"))
    return L.line_text(e, 0.3)


@query
def top_readings(spark, d):
    return r6(L.top_two(V.class_scores(spark, d)).drop("label"), "conf", "alt_conf").withColumn("band", L.confidence_band(F.col("conf")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of marks in the text rasters: boxes per line and the line's extent."""
    g = L.assign_lines(boxes(spark, sf_dir).select("image_id", "x", "y", "w", "h"))
    return g.groupBy("image_id", "line").agg(F.count("*").alias("boxes"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"))


@query
def document_lines(spark, d):
    return flagship(spark, d)


# ---- frames ----------------------------------------------------------------


@query
def frames_majority(spark, d):
    return FR.majority(V.frames(spark, d).withColumn("hit", F.col("value") > 50)).select("camera_id", "seq", "stable")


@query
def frames_stable_text(spark, d):
    return FR.stable_text(V.frames(spark, d)).select("camera_id", "seq", "shown")


@query
def frames_missed(spark, d):
    return FR.missed_runs(V.frames(spark, d), 3).select("camera_id", "seq", "misses", "failed")


@query
def frames_rate(spark, d):
    return r6(FR.frame_rate(V.frames(spark, d)), "fps")


@query
def frames_most_common(spark, d):
    return FR.most_common(V.frames(spark, d))


@query
def frames_health(spark, d):
    return r6(V.source_health(V.frames(spark, d)), "last_value")


def landed(spark: SparkSession, fr: DataFrame) -> tuple[DataFrame, str]:
    """The stream of frames that land late by up to one step, and the delay that covers it."""
    path = scratch_path(spark, "landing")
    delay = land_late(fr, path)
    return frame_stream(spark, path, fr.schema, "parquet", 4), f"{delay} seconds"


@query
def frames_streamed(spark, d):
    """Majority, stable text and missed frames from a stream whose files land out of order."""
    stream, delay = landed(spark, V.frames(spark, d).filter("ts is not null and camera_id is not null").withColumn("hit", F.col("value") > 50).drop("value"))
    sink = BatchSink(scratch_path(spark, "smoothed"), "frames", "parquet")
    with ST.state_store(spark):
        run_available(ST.smooth_in_order(stream, delay, limit=3), sink, scratch_path(spark, "checkpoint"))
    return sink.read(spark, ST.OUT).select("camera_id", "seq", "stable", "shown", F.col("misses").cast("bigint").alias("misses"), "failed")


@query
def decisions_streamed(spark, d):
    """Every frame of a stream scored, and its decision record appended to its class folder."""
    f1 = F.when(F.col("text").isNotNull(), F.col("value") / 100)
    fr = V.frames(spark, d).filter("ts is not null and camera_id is not null").withColumns({"f1": f1, "f2": F.length(F.nullif("text", F.lit(""))).cast("double")})
    stream, _ = landed(spark, fr.select("camera_id", "seq", "ts", "text", "f1", "f2"))
    judged = M.decide(stream.filter("camera_id is not null"), ["f1", "f2"], FRAME_MODEL, -0.2)
    gate = F.coalesce("f1", "f2").isNotNull()
    judged = judged.select(F.col("seq").alias("image_id"), F.when(~gate, "no frame").alias("reason"), F.when(gate, F.col("prob")).alias("prob"), (gate & F.col("is_handwritten")).alias("this_frame"), "f1", "f2")
    records = sinks.decision_records(judged, ["f1", "f2"]).withColumn("cls", F.when(F.col("this_frame_handwritten"), "handwritten").otherwise("printed"))
    sink = BatchSink(scratch_path(spark, "decisions"), "frames", "json", ("cls",))
    run_available(records, sink, scratch_path(spark, "checkpoint"))
    back = sink.read(spark, "image_id bigint, shown string, this_frame_handwritten boolean, reason string, prob double, features map<string, double>, cls string")
    return back.select("image_id", "cls", "shown", "reason", "prob", F.col("features")["f1"].alias("f1"), F.col("features")["f2"].alias("f2"))


# ---- learning --------------------------------------------------------------


@query
def samples_by_source(spark, d):
    return V.samples(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("label").alias("positive"))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """The samples' few numbers, written once, as fits read them many times."""
    return materialize(V.samples(spark, d), "samples")


@query
def samples_standardized(spark, d):
    z = M.class_weights(M.standardize(M.impute(sampled(spark, d), V.SAMPLE_FEATURES), V.SAMPLE_FEATURES))
    return r6(z.select("sample_id", "label", "cw", *V.SAMPLE_FEATURES), "cw", *V.SAMPLE_FEATURES)


@query
def samples_scored(spark, d):
    s = M.decide(V.samples(spark, d), V.SAMPLE_FEATURES, MODEL, 0.3, 0.5)
    return r6(s.select("sample_id", "prob", "is_handwritten", F.concat_ws(",", "imputed").alias("imputed")), "prob")


@query
def samples_scored_by_record(spark, d):
    """The model is a table, its features in any order."""
    feats = [(i + 1, f"f{i + 1}", *(m[c] for c in ("median_for_missing", "mean", "std", "weight"))) for i, m in enumerate(MODEL)]
    record = spark.createDataFrame([(feats[::-1], 0.3)], "features array<struct<index:int,key:string,median_for_missing:double,mean:double,std:double,weight:double>>, bias double")
    s = M.decide_by(V.samples(spark, d), V.SAMPLE_FEATURES, record)
    return r6(s.select("sample_id", "prob", "is_handwritten", F.concat_ws(",", "imputed").alias("imputed")), "prob")


@query
def samples_metrics(spark, d):
    s = M.decide(V.samples(spark, d), V.SAMPLE_FEATURES, MODEL, 0.3, 0.5).withColumn("prob", F.round("prob", 6))
    m = M.metrics(s)
    return r6(m, *(c for c in m.columns if c != "n"))


@query
def samples_metrics_by_source(spark, d):
    s = M.decide(V.samples(spark, d), V.SAMPLE_FEATURES, MODEL, 0.3, 0.5)
    return r6(M.metrics(s, ["source"]).select("source", "n", "tpr", "tnr", "balanced_accuracy", "rmse"), "tpr", "tnr", "balanced_accuracy", "rmse")


@query
def samples_folds(spark, d):
    return M.folds(sampled(spark, d)).select("sample_id", "repeat", "fold")


@query
def samples_cross_validation(spark, d):
    cv = M.cross_validate(sampled(spark, d), V.SAMPLE_FEATURES)
    return r6(cv, *(c for c in cv.columns if c not in ("repeat", "out", "n")))


@query
def samples_model(spark, d):
    m = M.train_model(sampled(spark, d), V.SAMPLE_FEATURES)
    return m.select("selected_lambda", F.round("bias", 6).alias("bias"), F.explode("features").alias("f")).select("selected_lambda", "bias", "f.*")


@query
def samples_drift(spark, d):
    model = spark.createDataFrame([(c, float(m["mean"]), float(m["std"])) for c, m in zip(V.SAMPLE_FEATURES, MODEL)], "key string, mean double, std double")
    return r6(M.feature_drift(V.samples(spark, d), V.SAMPLE_FEATURES, model), "measured_mean", "measured_std")


@query
def class_confusions(spark, d):
    t = L.top_two(V.class_scores(spark, d))
    return M.confusion_pairs(t.select("label", F.col("char").alias("predicted")))


@query
def class_accuracy(spark, d):
    t = L.top_two(V.class_scores(spark, d))
    return r6(t.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("char")).cast("int")).alias("accuracy")), "accuracy")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in REGISTRY}
