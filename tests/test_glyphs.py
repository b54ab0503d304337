"""Finding, isolating and reading glyphs, and the gate in front of shape measuring."""

import math
import struct
import zlib

import numpy as np
from art import pixels
from pyspark.sql import functions as F

from rasterlake.operators import gate, ink as I, layout, rasters as R, shapes as S
from rasterlake.sources import images, sinks


def stroke(g, y0, x0, y1, x1, v=40, pen=1):
    n = max(abs(y1 - y0), abs(x1 - x0)) + 1
    for y, x in zip(np.linspace(y0, y1, n).round().astype(int), np.linspace(x0, x1, n).round().astype(int)):
        g[y - pen : y + pen + 1, x - pen : x + pen + 1] = v


def letter(g, y, x, h=26, w=16, v=40):
    """An H."""
    stroke(g, y, x, y + h, x, v)
    stroke(g, y, x + w, y + h, x + w, v)
    stroke(g, y + h // 2, x, y + h // 2, x + w, v)


def paper(*places, shape=(110, 240), v=40):
    g = np.full(shape, 230)
    for y, x in places:
        letter(g, y, x, v=v)
    return g


PAGE = paper((10, 20), (12, 70), (9, 120), (62, 25), (60, 80))


def test_glyphs_are_found_line_by_line_and_read(spark):
    noise = paper()
    noise[50:53, 100:103] = 40  # a speck that is no glyph
    noise[:, :12] = 40  # a shadow at the border
    tight = paper((20, 20), (20, 46))

    def recognise(pictures):
        return pictures.select("image_id", "pos").distinct().select("image_id", "pos", F.lit("H").alias("char"), F.when(F.col("pos") == 1, 0.2).otherwise(0.9).alias("conf"), F.lit("N").alias("alt"), F.lit(0.05).alias("alt_conf"))

    read, texts = layout.read_frame(pixels(spark, PAGE, noise, tight), recognise)
    got = read.orderBy("image_id", "pos").collect()
    assert [r.line for r in got if r.image_id == 0] == [0, 0, 0, 1, 1]
    assert [r.x for r in got if r.image_id == 0][:3] == sorted(r.x for r in got if r.image_id == 0 and r.line == 0)
    assert sum(r.image_id == 2 for r in got) == 2
    assert {r.image_id: r.text for r in texts.collect()} == {0: "H?H / HH", 1: "", 2: "H?"}
    record = sinks.capture_records(read, texts).filter("image_id = 0").first()
    assert record.text == "H?H / HH" and [g.char for g in record.glyphs] == ["H"] * 5
    assert sinks.listing(read).count() == 7


def test_a_region_of_interest_is_read_alone(spark):
    none = lambda p: p.select("image_id", "pos").distinct().select("*", F.lit("x").alias("char"), F.lit(1.0).alias("conf"), F.lit("y").alias("alt"), F.lit(0.0).alias("alt_conf"))
    read, _ = layout.read_frame(pixels(spark, paper((40, 20), (40, 110))), none, roi=(0.5, 0.9))
    assert read.count() == 1


def test_a_neighbours_ink_is_covered(spark):
    glyphs, pictures = layout.find_glyphs(pixels(spark, paper((20, 20), (20, 43))))
    assert glyphs.count() == 2
    rows = pictures.collect()
    assert {(r.y, r.x) for r in rows} == {(y, x) for y in range(64) for x in range(64)}
    for pos in (0, 1):
        m = np.zeros((64, 64))
        for r in rows:
            if r.pos == pos:
                m[r.y, r.x] = r.v
        assert m[:, :4].mean() < 130 and m[:, -4:].mean() < 130 and m.max() > 200


def test_a_glyph_is_normalised_by_the_rule(spark):
    rng = np.random.default_rng(5)
    crop = rng.integers(20, 40, (30, 24)).astype(float)
    own = np.zeros(crop.shape, bool)
    own[8:20, 9:13] = True
    crop[own] = rng.integers(150, 220, own.sum())
    rows = [(7, 0, y, x, int(crop[y, x]), bool(own[y, x])) for y in range(30) for x in range(24)]
    got = {(r.y, r.x): r.v for r in layout.normalise_glyph(spark.createDataFrame(rows, "image_id bigint, pos int, y int, x int, v int, own boolean")).collect()}
    c, o = crop[6:22, 7:15], own[6:22, 7:15]  # 8 % of 12, at least 2
    bg, hi = np.median(c[~o]), np.percentile(c[o], 90)
    toned = 110 + (c - bg) * 115 / max(hi - bg, 8)
    assert len(got) == 128 * 128 and got[0, 0] == 110 and max(got.values()) <= 255
    ys, xs = {y for (y, x), v in got.items() if v > 150}, {x for (y, x), v in got.items() if v > 150}
    assert 14 <= min(ys) and max(ys) < 114 and abs((min(xs) + max(xs)) / 2 - 63.5) < 2
    inner = [(y, x) for y in range(2, 14) for x in range(3, 5)]  # centres of source pixels, far from the ink's edge
    near = [abs(got[14 + int((y + 0.5) * 100 / 16), 39 + int((x + 0.5) * 50 / 8)] - min(255, toned[y, x])) for y, x in inner]
    assert np.median(near) < 30
    few = [(7, 0, y, x, 50 + x, x == 9 and y < 3) for y in range(10) for x in range(10)]
    assert layout.normalise_glyph(spark.createDataFrame(few, "image_id bigint, pos int, y int, x int, v int, own boolean")).count() == 128 * 128


def test_each_image_has_its_own_threshold_window(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 255, (20, 30)), rng.integers(0, 255, (130, 110))
    got = R.adaptive_threshold(pixels(spark, a, b), None, 5.0).collect()
    for i, g in enumerate((a, b)):
        n = max(15, (min(g.shape) // 6) | 1)
        k = np.array(R.gaussian_kernel(n))
        p = np.pad(g.astype(float), n // 2, mode="edge")
        rows = np.array([[(p[y, x : x + n] * k).sum() for x in range(g.shape[1])] for y in range(p.shape[0])])
        mean = np.array([[(rows[y : y + n, x] * k).sum() for x in range(g.shape[1])] for y in range(g.shape[0])])
        assert {(r.y, r.x) for r in got if r.image_id == i} == {(y, x) for y, x in zip(*np.nonzero(g > mean + 5))}
    assert {n for n in (15, 19)} == {max(15, (min(g.shape) // 6) | 1) for g in (a, b)}


def written(shape=(90, 160), v=40):
    g = np.full(shape, 215)
    for i in range(4):
        stroke(g, 30, 30 + 25 * i, 55, 38 + 25 * i, v, 1)
        stroke(g, 55, 38 + 25 * i, 30, 46 + 25 * i, v, 1)
    return g


def test_the_gate_takes_paper_and_leaves_a_textured_scene(spark):
    rng = np.random.default_rng(0)
    scene = rng.integers(30, 230, (90, 160)).astype(float)
    scene = sum(np.roll(np.roll(scene, dy, 0), dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    for i in range(4):
        stroke(scene, 25, 10 + 40 * i, 65, 14 + 40 * i, 20, 0)
    table, crops = gate.writing_crops(*gate.gate_rasters(pixels(spark, written(), scene, np.full((90, 160), 200))))
    reason = {r.image_id: r.reason for r in table.collect()}
    assert reason[0] is None and reason[1] is not None and reason[2] == "none"
    got = {(r.y, r.x): r.v for r in crops.collect()}
    assert {r.image_id for r in crops.select("image_id").distinct().collect()} == {0}
    h = max(y for y, _ in got) + 1
    assert min(got.values()) < 120 and max(got.values()) == 255 and 30 < h < 60
    words = table.select(gate.shown_reason(F.col("reason")).alias("w")).collect()
    assert sorted(str(r.w) for r in words) == ["None", "no writing", "not writing"]


def test_a_yellow_pen_is_found_in_the_blue_channel(spark):
    rows = [(0, c, int(y), int(x), int(v)) for c, pen in enumerate((40, 215, 215)) for (y, x), v in np.ndenumerate(written(v=pen))]
    px = spark.createDataFrame(rows, "image_id bigint, ch int, y int, x int, v int")
    assert gate.find_writing(*gate.gate_rasters(px)).first().reason is None


def test_tall_scenes_are_scaled_to_the_gates_height(spark):
    s = R.shape(R.shrink_to(pixels(spark, written(), np.full((400, 30), 9)), 360)).collect()
    assert sorted((r.h, r.w) for r in s) == [(90, 160), (360, 27)]


def test_judging_live_and_whole_photographs(spark):
    model = [{"median_for_missing": 0.1, "mean": 0.0, "std": 1.0, "weight": w} for w in (0.5, 0.2, 0.01, 0.3, 0.1, 0.4, 0.2, -0.3)]
    px = pixels(spark, written(), np.full((90, 160), 200))
    for live in (True, False):
        got = {r.image_id: r for r in gate.judge_rasters(px, model, 0.1, live=live).collect()}
        x = [model[0]["median_for_missing"] if got[0][c] is None else got[0][c] for c in S.FEATURES]
        assert math.isclose(got[0].prob, 1 / (1 + math.exp(-0.1 - sum(m["weight"] * v for m, v in zip(model, x)))))
        assert got[0].this_frame and got[1].prob is None and not got[1].this_frame and got[1].reason == "none"
    record = {r.image_id: r for r in sinks.decision_records(gate.judge_rasters(px, model, 0.1, live=False), S.FEATURES).collect()}
    assert record[1].features is None and set(record[0].features) == set(S.FEATURES)
    one = lambda p: p.groupBy("image_id").agg(F.avg("v").alias("mean"))
    own = gate.judge_rasters(px, model[:1], 0.0, live=False, features_fn=one, cols=["mean"]).collect()
    assert sum(r.prob is not None for r in own) == 1


def png(a):
    """A PNG file of an 8-bit raster with 1, 3 or 4 channels."""
    kind, rows = {2: 0, 3: {3: 2, 4: 6}.get(a.shape[-1])}[a.ndim], b"".join(b"\0" + line.tobytes() for line in a)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_of_all_channel_counts_and_a_broken_file(spark, tmp_path):
    g = np.arange(48, dtype=np.uint8).reshape(6, 8)
    for kind, a in (("L", g), ("RGB", np.stack([g, g, g], 2)), ("RGBA", np.stack([g, g, g, g], 2))):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "a.png").write_bytes(png(a))
    (tmp_path / "L" / "broken.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path)).cache()
    assert read.filter("error is not null").count() == 1 and read.count() == 4
    px = images.gray(images.pixels(read)).collect()
    for kind in ("L", "RGB", "RGBA"):
        assert {(r.y, r.x): r.v for r in px if f"/{kind}/" in r.origin} == {(y, x): int(g[y, x]) for y in range(6) for x in range(8)}
    counts = {r.cls: r["count"] for r in images.class_counts(read).collect()}
    assert counts == {"L": 2, "RGB": 1, "RGBA": 1}
    assert images.labelled(read, "L").filter("label = 1").count() == 2


def test_two_corpora_are_padded_and_joined(spark):
    rng = np.random.default_rng(6)
    grids = [rng.integers(0, 255, (9, 5)), rng.integers(0, 255, (6, 7)), rng.integers(0, 255, (4, 4))]
    cls = spark.createDataFrame([(0, "handwritten"), (1, "formal"), (2, "other")], "image_id bigint, cls string")
    got = images.padded_corpus(pixels(spark, *grids).join(cls, "image_id")).collect()
    for i, (q, invert) in enumerate(((70, False), (30, True))):
        g = np.pad(grids[i], grids[i].shape[0] // 2, constant_values=int(np.percentile(grids[i], q)))
        assert {(r.y, r.x): r.v for r in got if r.image_id == i} == {(y, x): int(255 - v if invert else v) for (y, x), v in np.ndenumerate(g)}
        assert {r.label for r in got if r.image_id == i} == {1 - i}
    assert {r.image_id for r in got} == {0, 1}
    a = spark.createDataFrame([(1,)], "k int")
    assert sorted((r.k, r.source) for r in images.union_corpora({"x": a, "y": a}).collect()) == [(1, "x"), (1, "y")]
    labels = spark.createDataFrame([(0, "x", 1), (1, "y", 0)], "image_id bigint, source string, label int")
    fn = lambda p: p.groupBy("image_id").agg(F.avg("v").alias("f1"))
    assert images.labelled_features(pixels(spark, grids[0]), labels, fn).count() == 1


def test_padding_by_a_constant(spark):
    got = {(r.y, r.x): r.v for r in R.pad(pixels(spark, [[1, 2], [3, 4]]), 1, 9).collect()}
    assert got == {(y, x): int(v) for (y, x), v in np.ndenumerate(np.pad([[1, 2], [3, 4]], 1, constant_values=9))}


def test_long_images_keep_their_components_apart(spark):
    rows = [(i, y, x) for i in (1, 2) for y, x in ((5, 7), (6, 7), (70_000, 7), (70_001, 8), (4_300_000, 0))] + [(2**40, 0, 0), (1, 5, 7)]
    comp = I.components(I.label_runs(spark.createDataFrame(rows, "image_id bigint, y int, x int"))).collect()
    assert sorted((r.image_id, r.y, r.area) for r in comp) == [(i, y, a) for i in (1, 2) for y, a in ((5, 2), (70_000, 2), (4_300_000, 1))] + [(2**40, 0, 1)]


def test_samples_are_appended_listed_and_undone(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", 1, "p"), (2, "a", 2, "p"), (3, "b", 1, "q")], "sample_id int, session string, ts int, cls string")
    sinks.append_samples(s, str(tmp_path / "s"))
    sinks.append_samples(s.limit(0), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.sample_id for r in sinks.without_undone(back, sinks.last_of_session(back)).collect()} == {1}
    names = {r.name for r in s.select(sinks.sample_name(F.col("sample_id"), F.lit("2024-01-02 03:04:05.678901").cast("timestamp")).alias("name")).collect()}
    assert "20240102_030405_678901_0001" in names


def test_pictures_of_small_glyphs_are_not_exchanged(spark, monkeypatch):
    """Crops become pictures in one task each; those too large for that get the same pictures by joins of pixels."""
    g = paper((10, 20), (12, 46), (62, 25))
    g[40, 100:160] += np.arange(60) % 7
    px = pixels(spark, g)
    found = []
    for most in (1 << 20, 1200, 0):
        with monkeypatch.context() as m:
            m.setattr(layout, "CROP_PIXELS", most)
            if most == 1 << 20:
                m.setattr(layout, "normalise_glyph", lambda px: pytest.fail("scaled pixels are exchanged"))
            found.append(sorted(map(tuple, layout.find_glyphs(px)[1].collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3 * 64 * 64
