import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import frames as FR, learn as M, ranks
from rasterlake.sources import sinks, views as V
from rasterlake.streaming.frames import smooth, smooth_scored

SCHEMA = "camera_id bigint, seq bigint, ts timestamp, text string, hit boolean"


def rows(n=60):
    t0 = datetime(2024, 1, 1)
    texts = ["a", "b", "", None, "a", "a", None, None, "b", "b"]
    return [(c, i, t0 + timedelta(seconds=i + c / 10), texts[(i * 7 + c) % 10], (i * i + c) % 3 > 0) for c in (1, 2) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    for k in range(3):
        df.filter((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.json(str(tmp_path / "in" / f"k={k}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "k=*"))
    q = smooth(src, limit=2).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.camera_id, r.seq): (r.stable, r.shown, r.misses, r.failed) for r in spark.table("smoothed").collect()}
    a = FR.majority(df).select("camera_id", "seq", "stable")
    b = FR.stable_text(df).select("camera_id", "seq", "shown")
    c = FR.missed_runs(df, 2).select("camera_id", "seq", "misses", "failed")
    want = {(r.camera_id, r.seq): (r.stable, r.shown, r.misses, r.failed) for r in a.join(b, ["camera_id", "seq"], "left").join(c, ["camera_id", "seq"]).collect()}
    assert got == want
    fps = {r.camera_id: r.fps for r in FR.frame_rate(df).collect()}
    last = {r.camera_id: r.fps for r in spark.table("smoothed").filter("seq = 59").collect()}
    assert all(abs(fps[k] - last[k]) < 1e-9 for k in fps)


def test_frames_of_a_stream_are_scored_and_smoothed(spark, tmp_path):
    model = [{"median_for_missing": 0.0, "mean": 0.0, "std": 1.0, "weight": w} for w in (2.0, -1.0)]
    data = [(1, i, datetime(2024, 1, 1) + timedelta(seconds=i), "t", None if i % 5 == 0 else float(i % 4), None if i % 5 < 2 else float(i % 3)) for i in range(40)]
    shape = "camera_id bigint, seq bigint, ts timestamp, text string, f1 double, f2 double"
    df = spark.createDataFrame(data, shape)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    src = spark.readStream.schema(shape).json(str(tmp_path / "in"))
    q = smooth_scored(src, ["f1", "f2"], model, -1.0).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    hits = [not (a is None and b is None) and 2 * (a or 0) - (b or 0) - 1 >= 0 for *_, a, b in data]
    want = {i: 2 * sum(hits[max(0, i - 7) : i + 1]) > min(i + 1, 8) for i in range(40)}
    assert {r.seq: r.stable for r in spark.table("scored").collect()} == want


def samples(spark, n=80):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2))
    y = (x @ [1.5, -1] + rng.normal(size=n) > 0.4).astype(int)
    data = [(i, "p", int(y[i]), None if i % 17 == 0 else float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(data, "sample_id bigint, source string, label int, f1 double, f2 double")


def test_fit_reaches_the_optimum(spark):
    z = M.class_weights(M.standardize(M.impute(samples(spark), ["f1", "f2"]), ["f1", "f2"]))
    w = np.array(M.fit_grouped(z.withColumn("k", F.lit(0)), ["f1", "f2"], ["k"], [0.03]).first()["w"])
    r = z.toPandas()
    x, y, cw = np.c_[r[["f1", "f2"]].to_numpy(), np.ones(len(r))], r.label.to_numpy(), r.cw.to_numpy()
    g = x.T @ (cw * (1 / (1 + np.exp(-x @ w)) - y)) / cw.sum() + 2 * 0.03 * np.append(w[:2], 0)
    assert np.abs(g).max() < 1e-6


def test_folds_are_stratified(spark):
    f = M.folds(samples(spark), 2, 5).groupBy("repeat", "label", "fold").count()
    got = f.groupBy("repeat", "label").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k")).collect()
    assert all(r.d <= 1 and r.k == 5 for r in got)


def test_model_record_round_trip_scores_alike(spark, tmp_path):
    s = samples(spark)
    model = M.train_model(s, ["f1", "f2"], [0.03, 0.3], 1, 4)
    sinks.write_json(model, str(tmp_path / "m"), one_file=True)
    feats, bias, thr = V.model_parameters(spark.read.json(str(tmp_path / "m")))
    got = M.decide(s, ["f1", "f2"], feats, bias, thr).orderBy("sample_id").first()
    z = bias + sum(f["weight"] * ((f["median_for_missing"] if v is None else v) - f["mean"]) / f["std"] for f, v in zip(feats, (got.f1, got.f2)))
    assert abs(got.prob - 1 / (1 + np.exp(-z))) < 1e-9 and got.imputed == ["f1"]
    assert json.loads(model.toJSON().first())["dataset"]["total"] == 80


def test_a_fit_that_does_not_settle_is_an_error(spark):
    z = M.class_weights(M.standardize(M.impute(samples(spark), ["f1", "f2"]), ["f1", "f2"])).withColumn("k", F.lit(0))
    with pytest.raises(ValueError, match="not settled"):
        M.fit_grouped(z, ["f1", "f2"], ["k"], [0.03], rounds=2)


def test_steps_are_halved_on_far_data(spark):
    rows = [(i, 1 if i > 6 else 0, 0.5, 40.0 * (i - 6) + (90 if i == 3 else 0)) for i in range(14)]
    z = spark.createDataFrame(rows, "k int, label int, cw double, f double").withColumn("k", F.lit(0))
    w = np.array(M.fit_grouped(z, ["f"], ["k"], [1e-4]).first()["w"])
    x, y = np.array([[r[3], 1.0] for r in rows]), np.array([r[1] for r in rows])
    g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(rows) + 2e-4 * np.append(w[:1], 0)
    assert np.abs(g).max() < 1e-6


def test_features_that_are_not_finite_are_imputed(spark):
    rows = [(0, float("nan")), (1, 1.0), (2, 5.0), (3, float("inf")), (4, 3.0), (5, None)]
    got = {r.sample_id: r.f for r in M.impute(spark.createDataFrame(rows, "sample_id bigint, f double"), ["f"]).collect()}
    assert got == {0: 3.0, 1: 1.0, 2: 5.0, 3: 3.0, 4: 3.0, 5: 3.0}


def test_running_counts_and_medians_equal_plain_ones(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), float(v), int(i)) for i, (k, v) in enumerate(zip(r.choice([0, 0, 0, 1, 2], 300), r.integers(0, 40, 300)))] + [(None, 2.0, 900), (3, None, 901)]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(7)
    upto = {x.i: x.upto for x in ranks.running(df, ["v", "i"], keys=["k"]).collect()}
    for k, v, i in rows:
        mine = sorted((b is not None, b or 0, j) for a, b, j in rows if a == k)
        assert upto[i] == mine.index((v is not None, v or 0, i)) + 1
    got = {x.k: x.med_v for x in ranks.medians(df.filter("k is not null"), ["v"], ["k"]).collect()}
    assert got == {k: (float(np.median([b for a, b, _ in rows if a == k])) if k < 3 else None) for k in range(4)}
    assert ranks.medians(df, ["v"]).first().med_v == np.median([v for _, v, _ in rows if v is not None])
    assert ranks.medians(df.filter("i < 0"), ["v"]).first().med_v is None


def test_frame_rate_over_many_days_equals_a_plain_loop(spark):
    r = np.random.default_rng(2)
    at = [datetime(2024, 1, 1) + timedelta(hours=float(h)) for h in np.cumsum(r.exponential(9, 80))]
    df = spark.createDataFrame([(1, i, t, "", True) for i, t in enumerate(at)] + [(2, 0, at[0], "", True)], SCHEMA)
    want = 0.0
    for a, b in zip(at, at[1:]):
        want = 0.9 * want + 0.1 / (b - a).total_seconds()
    got = {x.camera_id: x.fps for x in FR.frame_rate(df).collect()}
    assert set(got) == {1} and abs(got[1] - want) < 1e-12


def test_models_are_preferred_in_order_and_checked(spark):
    def record(bias, n):
        feats = [(i, f"f{i}", 1.0) for i in range(n, 0, -1)]
        return spark.createDataFrame([(bias, feats)], "bias double, features array<struct<index:int,name:string,weight:double>>")

    feats, bias, threshold = V.model_parameters(V.preferred_model([None, record(2.0, 8), record(3.0, 8)]), 8)
    assert (bias, threshold) == (2.0, 0.5) and [f["index"] for f in feats] == list(range(1, 9))
    with pytest.raises(ValueError):
        V.model_parameters(record(1.0, 7), 8)


def test_best_epoch_is_the_first_of_the_best(spark):
    log = spark.createDataFrame([(1, 0.8), (2, 0.9), (3, 0.85), (4, 0.9)], "epoch int, accuracy double")
    assert tuple(V.best_epoch(log).first()) == (2, 0.9)


def test_too_few_samples_stop(spark):
    with pytest.raises(ValueError):
        M.enough_samples(samples(spark, 8), "p")


def test_folds_fitted_in_one_scan_equal_grouped_fits(spark):
    df, cols, lams = samples(spark, 90), ["f1", "f2"], [0.01, 0.3]
    table = M.fold_table(df, cols, 2, 3)
    stats = M.fold_statistics(table, cols, 2, 3)
    got = M.fit_folds(table, cols, stats, lams)
    rows = M.folds(df, 2, 3).toPandas()
    assert table.count() == 90 and len(got) == 12
    for r in range(2):
        for out in range(3):
            part = rows[(rows.repeat == r) & (rows.fold != out)]
            med, st = part[cols].median(), stats[r, out]
            x = part[cols].fillna(med)
            z = ((x - x.mean()) / (x.std(ddof=0) + 1e-9)).to_numpy()
            assert np.allclose(st["med"], med) and np.allclose(st["mu"], x.mean()) and np.allclose(st["sd"], x.std(ddof=0) + 1e-9)
            y = part.label.to_numpy()
            cw = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
            one = np.c_[z, np.ones(len(y))]
            for lam in lams:  # the gradient of the loss is zero where it is least
                w = got[lam, r, out]
                g = one.T @ (cw * (1 / (1 + np.exp(-one @ w)) - y)) / cw.sum() + 2 * lam * np.append(w[:2], 0)
                assert np.abs(g).max() < 1e-7
            keyed = spark.createDataFrame([(0, int(a), float(b), *map(float, v)) for a, b, v in zip(y, cw, z)], "k int, label int, cw double, f1 double, f2 double")
            want = {m.lam: m.w for m in M.fit_grouped(keyed, cols, ["k"], lams).collect()}
            assert all(np.allclose(want[lam], got[lam, r, out], atol=1e-7) for lam in lams)
    assert M.cross_validate(df.limit(0), cols, lams, 2, 3).count() == 0


def test_repeated_samples_keep_their_rows_and_folds(spark):
    df = samples(spark, 30)
    twice = df.unionByName(df.filter("sample_id < 5"))
    table = M.fold_table(twice, ["f1", "f2"], 2, 3)
    assert table.count() == 35 and all(len(r.folds) == 2 for r in table.collect())


def test_choosing_a_model_ranks_no_held_out_sample(spark, monkeypatch):
    ranked, plain = [], M._mid_ranks
    monkeypatch.setattr(M, "_mid_ranks", lambda df, keys=None: ranked.append(keys) or plain(df, keys))
    s = samples(spark)
    model = M.train_model(s, ["f1", "f2"], [0.03, 0.3], 2, 4).first()
    assert ranked == [None]  # the final training metrics alone
    lam, means = M.select_lambda(M.cross_validate(s, ["f1", "f2"], [0.03, 0.3], 2, 4))
    assert lam == model.selected_lambda and ranked == [None, ["lam", "repeat", "out"]]
    want = means.filter(F.col("lam") == lam).first().asDict()
    assert model.cross_validation_at_selected_lambda == pytest.approx(want)
    assert "auc" in model.final_training_metrics


def test_sample_features_equal_a_plain_loop(spark, tmp_path):
    texts = ["", " ", "a", "a b", "é 😀. x,\n\ny", "..,,", "\n", "one two\nthree. four,", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.sample_id: (r.f1, r.f2, r.f3, r.f4) for r in V.samples(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[:-1]):
        n, words, lines = len(t), t.count(" ") + 1, t.count("\n") + 1
        want = (np.log(n + 1), n / words if words >= 2 else None, np.log(n / lines) if lines >= 2 else None, len(t.replace(".", "").replace(",", "")) / (n + 1))
        assert got[i] == pytest.approx(want), t
    assert len(got) == len(texts) - 1
