import math

import numpy as np
import pytest
from art import ink, pixels, sizes

from rasterlake.operators import gate, ink as I, layout, rasters as R, shapes as S
from rasterlake.sources import images

U = ["#..#", "#..#", "####"]
DIAG = ["#..", ".#.", "..#"]
RING = [".......", ".#####.", ".#...#.", ".#.#.#.", ".#...#.", ".#####.", "......."]


def test_plate_has_one_marking_where_it_was_drawn(spark):
    got = gate.detect_markings(images.plates(spark, 1)).collect()
    assert len(got) == 1
    for r in got:
        assert abs(r.x - 50) <= 3 and abs(r.y - 50) <= 3 and abs(r.w - 101) <= 5 and abs(r.h - 51) <= 5


def test_median_blur_lowers_the_error(spark):
    clean, noisy = images.plates(spark, 1, 60, 80, noise=False), images.plates(spark, 1, 60, 80)
    before = R.mean_absolute_error(clean, noisy).first().mae
    assert R.mean_absolute_error(clean, R.median_blur(noisy)).first().mae < before


def test_components_are_eight_connected(spark):
    lab = I.label_runs(ink(spark, U, DIAG))
    got = {(r.image_id, r.area) for r in I.components(lab).collect()}
    assert got == {(0, 8), (1, 3)}
    assert I.components(I.label_runs(ink(spark, DIAG), eight=False)).count() == 3


def test_contour_area_of_a_rectangle_and_a_ring(spark):
    rect = ["." * 105] * 2 + ["." * 2 + "#" * 101 + ".."] * 51 + ["." * 105] * 2
    lab = I.label_runs(ink(spark, rect, RING))
    got = {(r.image_id, r.area) for r in S.contour_area(lab, sizes(spark, rect, RING)).collect()}
    assert got == {(0, 5000.0), (1, 16.0)}  # the dot in the ring's hole is no outer contour


def test_hull_of_an_l_shape(spark):
    cells = I.to_ink(I.label_runs(ink(spark, ["#...", "#...", "#...", "####"])))
    assert S.hull_area(cells).first().hull == 4.5


def test_distance_is_exact(spark):
    pic = ["......", ".####.", ".####.", ".####.", "......"]
    got = {(r.y, r.x): r.d for r in S.distance_transform(ink(spark, pic), sizes(spark, pic)).collect()}
    free = [(y, x) for y, line in enumerate(pic) for x, c in enumerate(line) if c == "."]
    for (y, x), d in got.items():
        assert math.isclose(d, min(math.hypot(y - a, x - b) for a, b in free))


def thin(mask):
    mask = mask.copy()
    while True:
        gone = 0
        for second in (False, True):
            drop = []
            for y, x in zip(*np.nonzero(mask)):
                n = [mask[y + dy, x + dx] for dy, dx in S.AROUND]
                b, a = sum(n), sum(n[i] == 0 and n[(i + 1) % 8] == 1 for i in range(8))
                c = (n[0] * n[2] * n[6], n[0] * n[4] * n[6]) if second else (n[0] * n[2] * n[4], n[2] * n[4] * n[6])
                if 2 <= b <= 6 and a == 1 and c == (0, 0):
                    drop.append((y, x))
            for p in drop:
                mask[p] = 0
            gone += len(drop)
        if not gone:
            return {(y, x) for y, x in zip(*np.nonzero(mask))}


def test_skeleton_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    m = np.zeros((14, 30), int)
    m[3:12, 2:28] = 1
    m[5:9, rng.integers(4, 26, 5)] = 0
    pic = ["".join("#" if v else "." for v in line) for line in m]
    assert {(r.y, r.x) for r in S.skeleton(ink(spark, pic)).collect()} == thin(m)


def test_contour_runs_once_round(spark):
    cells = I.to_ink(I.label_runs(ink(spark, ["####", "####", "####"])))
    got = [(r.y, r.x) for r in S.contours(cells).orderBy("k").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (2, 3), (1, 3), (0, 3), (0, 2), (0, 1)]


def test_lines_and_order(spark):
    rows = [(0, i, x, y, 8, 20, 160) for i, (x, y) in enumerate([(50, 2), (5, 0), (90, 1), (30, 60), (2, 62)])]
    g = layout.assign_lines(spark.createDataFrame(rows, "image_id bigint, label bigint, x int, y int, w int, h int, area int"))
    assert [(r.line, r.x) for r in g.orderBy("pos").collect()] == [(0, 5), (0, 50), (0, 90), (1, 2), (1, 30)]


def test_a_bridge_joins_the_first_group_only(spark):
    # 1 and 2 stand apart; 3, later in x order, is narrow enough to overlap both by half of its width
    rows = [(0, 1, 0, 0, 20, 10, 0), (0, 2, 2, 40, 18, 10, 0), (0, 3, 4, 12, 10, 26, 0)]
    g = layout.group_glyphs(spark.createDataFrame(rows, "image_id bigint, label bigint, x int, y int, w int, h int, area int"))
    assert sorted(sorted(r.labels) for r in g.collect()) == [[1, 3], [2]]


def test_equal_gaps_have_no_spread(spark):
    rows = [(0, x, 0, 4, 9) for x in (0, 10, 20)] + [(1, x, 0, 4, 9) for x in (0, 10)] + [(2, 0, 0, 4, 9)] + [(3, x, 0, 4, 9) for x in (0, 6, 30)]
    got = {r.image_id: r.spacing_dev for r in S.spacing_dev(spark.createDataFrame(rows, "image_id bigint, x int, y int, w int, h int")).collect()}
    assert got[0] == got[1] == 0 and got[2] is None and math.isclose(got[3], 9 / 11)


def test_a_part_inside_a_hole_turns_nothing(spark):
    ring = ["." * 24] + ["." + "#" * 22 + "."] * 3 + ["." + "###" + "." * 16 + "###" + "."] * 14 + ["." + "#" * 22 + "."] * 3 + ["." * 24]
    filled = [line[:9] + "######" + line[15:] if 8 <= y <= 14 else line for y, line in enumerate(ring)]
    lab = I.label_runs(ink(spark, ring, filled))
    outer = I.outer_labels(lab, I.outside(lab.select("image_id", "y", "x0", "x1"), sizes(spark, ring, filled)))
    got = {r.image_id: r.curvature_var for r in S.curvature_var(I.to_ink(lab), outer).collect()}
    assert got[0] is not None and got[0] == got[1]


def test_shape_polarity_and_glyph_polarity_differ(spark):
    g = np.full(1000, 120)
    g[:8], g[8:18] = 20, 180  # dark beyond the 0.5 % mark only
    p = pixels(spark, g.reshape(10, 100).repeat(1, 0))
    flat = R.percentiles(p, [0.005, 0.01, 0.5, 0.99, 0.995]).first()
    dark = {q: flat.q2 - lo > hi - flat.q2 for q, lo, hi in (("glyph", flat.q0, flat.q4), ("shape", flat.q1, flat.q3))}
    assert dark == {"glyph": True, "shape": False}
    assert R.SHAPE_POLARITY == (0.01, 0.5, 0.99)


def plain_resize(m, nh, nw):
    h, w = m.shape
    out = np.zeros((nh, nw))
    for y in range(nh):
        for x in range(nw):
            sy, sx = (y + 0.5) * h / nh - 0.5, (x + 0.5) * w / nw - 0.5
            fy, fx = math.floor(sy), math.floor(sx)
            for dy in (0, 1):
                for dx in (0, 1):
                    k = (sy - fy if dy else 1 - sy + fy) * (sx - fx if dx else 1 - sx + fx)
                    out[y, x] += k * m[min(max(fy + dy, 0), h - 1), min(max(fx + dx, 0), w - 1)]
    return out


def test_mask_is_scaled_to_height_100(spark):
    g = np.full((60, 90), 230)
    g[10:40, 20:26], g[10:16, 20:50], g[30:50, 60:66] = 30, 30, 30
    got = {(r.y, r.x) for r in S.ink_mask(pixels(spark, g), 100).collect()}
    b = 255 - g.astype(float)
    p = np.pad(b, 1, mode="reflect")
    soft = np.rint(sum(ky * kx * p[1 + dy : 61 + dy, 1 + dx : 91 + dx] for dy, ky in ((-1, 0.25), (0, 0.5), (1, 0.25)) for dx, kx in ((-1, 0.25), (0, 0.5), (1, 0.25))))
    values = np.unique(soft)[:-1]
    m = soft > max(values, key=lambda t: ((soft <= t).sum() * float((soft > t).sum()) * (soft[soft <= t].mean() - soft[soft > t].mean()) ** 2, -t))
    ys, xs = np.nonzero(m)
    m = m[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    big = plain_resize(m * 255.0, 100, max(1, round(m.shape[1] * 100 / m.shape[0])))
    assert got == {(y + 4, x + 4) for y, x in zip(*np.nonzero(np.rint(big) > 127))}


def test_resizing_by_area_and_cubic(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 256, (7, 10))
    s = spark.createDataFrame([(0, 7, 10, 3, 4)], "image_id bigint, h int, w int, nh int, nw int")

    def weights(n, m):
        return np.array([[max(0.0, min((o + 1) * n / m, i + 1) - max(o * n / m, i)) * m / n for i in range(n)] for o in range(m)])

    want = weights(7, 3) @ g @ weights(10, 4).T
    for r in R.resize(pixels(spark, g), s, "area").collect():
        assert math.isclose(r.v, want[r.y, r.x], abs_tol=1e-9)
    up = s.select("image_id", "h", "w", (s.h * 3).alias("nh"), (s.w * 3).alias("nw"))
    flat = R.resize(pixels(spark, np.full((7, 10), 9)), up, "cubic").collect()
    assert len(flat) == 21 * 30 and all(math.isclose(r.v, 9) for r in flat)
    assert {(r.y, r.x): round(r.v) for r in R.resize(pixels(spark, g), up, "cubic").filter("y % 3 = 1 and x % 3 = 1").collect()} == {(3 * y + 1, 3 * x + 1): g[y, x] for y in range(7) for x in range(10)}


def test_cleaning_drops_border_line_and_speck(spark):
    rows = [(0, 1, 0, 5, 10, 10, 90), (0, 2, 20, 20, 70, 3, 200), (0, 3, 50, 50, 2, 2, 4), (0, 4, 30, 30, 20, 20, 300)]
    c = spark.createDataFrame(rows, "image_id bigint, label bigint, x int, y int, w int, h int, area int")
    s = spark.createDataFrame([(0, 100, 100)], "image_id bigint, h int, w int")
    assert [r.label for r in I.clean_components(c, s).collect()] == [4]


def test_polarity_flip_leaves_ink_bright(spark):
    g = np.full((20, 40), 220)
    g[5:15, 8:12] = g[5:15, 20:30] = 40
    for grid in (g, 255 - g):
        assert R.to_bright_ink(pixels(spark, grid)).agg({"v": "avg"}).first()[0] < 128


def test_blank_page_has_no_ink_and_text_has(spark):
    blank = 200 + np.random.default_rng(0).integers(0, 6, (30, 40))
    text = np.full((30, 40), 220)
    text[8:20, 6:10] = 40
    got = {r.image_id: r.has_ink for r in R.has_ink(pixels(spark, blank, text)).collect()}
    assert got == {0: False, 1: True}


def test_flat_image_has_null_variation_of_nothing(spark):
    got = R.noise_threshold(pixels(spark, np.full((6, 6), 9))).first()
    assert got.noise == 0 and got.thr == 12


def test_rotation_four_times_is_the_identity(spark):
    p = pixels(spark, np.arange(12).reshape(3, 4))
    q = R.rotate(R.rotate(p, 90), 270)
    assert {tuple(r[c] for c in "yxv") for r in q.collect()} == {tuple(r[c] for c in "yxv") for r in p.collect()}


def test_slant_of_runs_equals_that_of_the_dense_raster(spark):
    r = np.random.default_rng(11)
    rows = []
    for i, (h, w, share) in enumerate([(20, 25, 0.5), (18, 30, 0.15), (6, 6, 0.9), (12, 12, 1.0), (9, 40, 0.3)]):
        a = np.zeros((h + 8, w + 8), int)
        a[4:-4, 4:-4] = r.random((h, w)) < share
        rows += [(i, y, x, int(v)) for (y, x), v in np.ndenumerate(a)]
    dense = spark.createDataFrame(rows, "image_id bigint, y int, x int, v int")
    want = {x.image_id: x.slant_var for x in S.slant_var(dense).collect()}
    got = {x.image_id: x.slant_var for x in S.slant_var_of_runs(I.runs(dense.filter("v = 1").select("image_id", "y", "x"))).collect()}
    assert got.keys() == want.keys() and len(want) >= 4
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
