"""Masks as runs, thinning on a front, linear distances and clusters, against plain loops over pixels."""

import math
from collections import deque

import numpy as np
import pytest
from art import ink, pixels, sizes
from pyspark.sql import functions as F

from rasterlake.operators import ink as I, layout, rasters as R, shapes as S
from rasterlake.sources import views as V
from test_shapes import thin


def noise(seed, h=13, w=17, share=0.6):
    m = np.random.default_rng(seed).random((h, w)) < share
    return m, ["".join("#" if v else "." for v in line) for line in m]


def cells(df):
    return {(r.y, r.x) for r in I.run_pixels(df).collect()}


def plain_outside(m):
    h, w = m.shape
    seen, todo = {(-1, -1)}, deque([(-1, -1)])
    while todo:
        y, x = todo.popleft()
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            a, b = y + dy, x + dx
            if -1 <= a <= h and -1 <= b <= w and (a, b) not in seen and not (0 <= a < h and 0 <= b < w and m[a, b]):
                seen.add((a, b))
                todo.append((a, b))
    return seen


@pytest.mark.parametrize("seed", [0, 1])
def test_run_algebra_equals_pixel_loops(spark, seed):
    m, pic = noise(seed)
    other, pic2 = noise(seed + 10, share=0.3)
    a, b, size = I.runs(ink(spark, pic)), I.runs(ink(spark, pic2)), sizes(spark, pic)
    assert cells(I.union_runs(a, b)) == {tuple(p) for p in np.argwhere(m | other)}
    assert cells(I.without_runs(a, b)) == {tuple(p) for p in np.argwhere(m & ~other)}
    r = 2
    assert cells(I.dilate_runs(a, r)) == {(y + dy, x + dx) for y, x in np.argwhere(m) for dy in range(-r, r + 1) for dx in range(-r, r + 1)}
    out = plain_outside(m)
    assert cells(I.outside(a, size)) == out
    h, w = m.shape
    assert cells(I.fill_holes(a, size)) == {(y, x) for y in range(h) for x in range(w)} - out
    lab = I.label_runs(ink(spark, pic))
    touched = {r.label for r in I.to_ink(lab).collect() if any((r.y + dy, r.x + dx) in out for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    assert {r.label for r in I.outer_labels(lab, I.outside(a, size)).collect()} == touched
    # runs are maximal: no two of a line touch
    for df in (I.union_runs(a, b), I.outside(a, size), I.dilate_runs(a, r)):
        ends = sorted((x.y, x.x0, x.x1) for x in df.collect())
        assert all(p[0] != q[0] or p[2] + 1 < q[1] for p, q in zip(ends, ends[1:]))


def test_rows_go_with_runs_and_not_with_pixels(spark):
    h = w = 300
    block = spark.createDataFrame([(7, y, 10, 289) for y in range(10, 290)], "image_id bigint, y int, x0 int, x1 int")
    size = spark.createDataFrame([(7, h, w)], "image_id bigint, h int, w int")
    assert I.dilate_runs(block, 5).count() == 290
    assert I.outside(block, size).count() == 2 * 280 + 22
    assert I.fill_holes(block, size).count() == 280
    assert I.sweep(block, I.raster_lines(size)).count() <= 4 * (280 + 300)


def test_masks_without_rows(spark):
    none = spark.createDataFrame([], "image_id bigint, y int, x0 int, x1 int")
    size = spark.createDataFrame([(1, 2, 3), (2, 0, 0)], "image_id bigint, h int, w int")
    assert I.dilate_runs(none, 3).count() == I.union_runs(none, none).count() == 0
    assert sorted((r.image_id, r.y, r.x0, r.x1) for r in I.outside(none, size).collect()) == [(1, y, -1, 3) for y in range(-1, 3)]
    assert I.fill_holes(none, size).count() == 0 and S.skeleton(R.dilate(ink(spark, []), 1)).count() == 0
    assert S.distance_transform(ink(spark, []), size).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_front_thinning_equals_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pics, masks = [], []
    for k in range(4):
        m = np.zeros((18, 26), int)
        m[1:-1, 1:-1] = rng.random((16, 24)) < 0.75 + 0.08 * k
        masks.append(m)
        pics.append(["".join("#" if v else "." for v in line) for line in m])
    got = {}
    for r in S.skeleton(ink(spark, *pics)).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
    assert got == {i: thin(m) for i, m in enumerate(masks)}


def test_front_steps_read_fewer_rows_from_round_to_round(spark, monkeypatch):
    read, step = [], S._front_step

    def counted(front, second):
        read.append(front.count())
        return step(front, second)

    monkeypatch.setattr(S, "_front_step", counted)
    pic = ["." * 60] + ["." + "#" * 58 + "."] * 40 + ["." * 60]
    area = 58 * 40
    m = np.array([[c == "#" for c in line] for line in pic], int)
    assert {(r.y, r.x) for r in S.skeleton(ink(spark, pic)).collect()} == thin(m)
    assert len(read) > 20 and max(read) < area / 8 and read[-3] < read[0] / 2


@pytest.mark.parametrize("seed", [4, 5])
def test_distances_equal_a_plain_loop(spark, seed):
    m, pic = noise(seed, 12, 30, 0.85)
    free = np.argwhere(~m)
    got = {(r.y, r.x): r.d for r in S.distance_transform(ink(spark, pic), sizes(spark, pic)).collect()}
    assert got.keys() == {tuple(p) for p in np.argwhere(m)}
    for (y, x), d in got.items():
        assert math.isclose(d, np.sqrt(((free - (y, x)) ** 2).sum(1).min()))
    full = ["###", "###"]
    assert {r.d for r in S.distance_transform(ink(spark, full), sizes(spark, full)).collect()} == {None}


def test_the_envelope_is_linear_and_exact():
    r = np.random.default_rng(6)
    for n in (1, 2, 7, 60):
        for left, right in ((True, True), (True, False), (False, True), (False, False)):
            c = r.integers(-1, 9, n)
            sites = [(i, int(v) ** 2) for i, v in enumerate(c) if v >= 0] + [(-1, 0)] * left + [(n, 0)] * right
            want = [min(((x - i) ** 2 + f for i, f in sites), default=-1) for x in range(n)]
            assert S.envelope(c, left, right).tolist() == want

    class Counted(int):
        looks = 0

        def __pow__(self, k):
            return int(self) ** k

    wide = np.full(200_000, 5000)  # a block of 10,000 lines: slices would take 2e9 steps
    d2 = S.envelope(wide, True, True)
    assert d2[0] == 1 and d2[4999] == 5000**2 and d2.max() == 5000**2


def first_fit(boxes):
    groups = []
    for label, x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0])):
        for g in groups:
            if min(g[0] + g[2], x + w) - max(g[0], x) >= 0.5 * min(g[2], w) and max(g[1], y) - min(g[1] + g[3], y + h) < 0.5 * max(g[3], h):
                x0, y0 = min(g[0], x), min(g[1], y)
                g[2], g[3] = max(g[0] + g[2], x + w) - x0, max(g[1] + g[3], y + h) - y0
                g[0], g[1] = x0, y0
                g[4].append(label)
                break
        else:
            groups.append([x, y, w, h, [label]])
    return sorted((g[0], g[1], g[2], g[3], tuple(g[4])) for g in groups)


COMP = "image_id bigint, label bigint, x int, y int, w int, h int, area int"


def test_clusters_are_folded_as_the_whole_image_is(spark):
    r = np.random.default_rng(8)
    images = {i: [(k, int(r.integers(0, 400)), int(r.integers(0, 60)), int(r.integers(1, 14)), int(r.integers(1, 20))) for k in range(60)] for i in range(3)}
    images[3] = [(k, 3 * k, 0, 5, 5) for k in range(50)]  # one chain
    df = spark.createDataFrame([(i, *b, 0) for i, bs in images.items() for b in bs], COMP)
    got = {}
    for g in layout.group_glyphs(df).collect():
        got.setdefault(g.image_id, []).append((g.x, g.y, g.w, g.h, tuple(g.labels)))
    assert {i: sorted(v) for i, v in got.items()} == {i: first_fit(b) for i, b in images.items()}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_clusters_over_ranges(spark, parts):
    r = np.random.default_rng(9)
    boxes = [(k, int(r.integers(0, 900)), 0, int(r.choice([2, 4, 90], p=[0.6, 0.35, 0.05])), 5) for k in range(150)]
    df = spark.createDataFrame([(1, *b, 0) for b in boxes] + [(2, 0, 5, 0, 3, 3, 0), (None, 0, 5, 0, 3, 3, 0)], COMP)
    want, end, head = {}, None, None
    for label, x, _, w, _ in sorted(boxes, key=lambda b: (b[1], b[0])):
        if end is None or x >= end:
            head = (x, label)
        end = max(end or 0, x + w)
        want[label] = head
    got = {c.label: tuple(c.cluster) for c in layout.clusters(df, parts).filter("image_id = 1").collect()}
    assert got == want and len(set(got.values())) > 3
    assert layout.clusters(df.limit(0), parts).count() == 0


def test_a_long_image_is_spread_over_tasks(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("image_id"), F.col("id").alias("label"), (F.col("id") * 7).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(5).alias("w"), F.lit(9).alias("h"), F.lit(45).alias("area"))
    c = layout._sorted_components(df)
    assert c.count() == n and c.agg(F.max(F.size("cs"))).first()[0] == 1
    assert layout.merge_boxes(df).count() == n


def test_contours_of_any_image_id(spark):
    pic = ["####", "#..#", "####"]
    one = I.to_ink(I.label_runs(ink(spark, pic)))
    far = one.withColumn("image_id", F.lit(2**62 + 1).cast("bigint"))
    got = {(r.image_id, r.k, r.y, r.x) for r in S.contours(one.unionByName(far)).collect()}
    assert {g[1:] for g in got if g[0] == 0} == {g[1:] for g in got if g[0] == 2**62 + 1} and len(got) == 20


@pytest.mark.parametrize("eight", [True, False])
def test_labels_join_over_bands_in_no_rounds_of_their_own(spark, monkeypatch, eight):
    """A long image is labelled band by band, and only what goes over a band's end is joined in rounds."""
    monkeypatch.setattr(I, "BAND", 4)
    m = np.random.default_rng(9).random((3, 21, 17)) < 0.55
    rows = [(i - 1, int(y), int(x)) for i in range(3) for y, x in zip(*np.nonzero(m[i]))]
    px = spark.createDataFrame(rows + rows[:5], "image_id bigint, y int, x int")  # repeated pixels count once
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (eight or not dy or not dx) and (dy or dx)]
    want, ink_of = {}, set(rows)
    for p in sorted(rows):
        if p in want:
            continue
        todo, want[p] = deque([p]), p[1] * I.SIDE + p[2]
        while todo:
            i, y, x = todo.popleft()
            for q in ((i, y + dy, x + dx) for dy, dx in near):
                if q in ink_of and q not in want:
                    want[q] = want[p]
                    todo.append(q)
    got = {(r.image_id, r.y, r.x): r.label for r in I.to_ink(I.label_runs(px, eight)).collect()}
    assert got == want and I.to_ink(I.label_runs(px, eight)).count() == len(rows)


def test_texts_are_labelled_where_they_are_read(spark, tmp_path, monkeypatch):
    """No run of a text is exchanged or written before its components are known."""
    texts = ["ab c\n" * 40, "", None, "x" * 200 + " " * 70 + "y", "é ü" * 50]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {tuple(r) for r in I.components(I.labelled_runs(V.text_runs(spark, str(tmp_path)))).collect()}
    monkeypatch.setattr(I, "materialize", lambda *a, **b: pytest.fail("runs were written"))
    lab = V.labelled_texts(spark, str(tmp_path))
    assert "Exchange" not in lab._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in I.components(lab).collect()} == want and len(want) > 3


def test_small_rasters_need_no_rounds_and_large_ones_get_the_same(spark, monkeypatch):
    """Thinning, distances and contours of a raster in one task equal those by joins and rounds."""
    rng = np.random.default_rng(12)
    pics = []
    for k in range(3):
        m = rng.random((17, 23)) < 0.55 + 0.1 * k
        m[3:12, 4:15] |= k > 0
        m[[0, -1]], m[:, [0, -1]] = k == 2, False
        pics.append(["".join("#" if v else "." for v in line) for line in m])
    lab, size = I.label_runs(ink(spark, *pics)).cache(), sizes(spark, *pics).cache()
    found = []
    for most in (1 << 21, 0):
        with monkeypatch.context() as m:
            m.setattr(S, "IMAGE_PIXELS", most)
            if most:
                m.setattr(S, "skeleton", lambda ink: pytest.fail("rounds of thinning"))
                m.setattr(S, "contours", lambda px: pytest.fail("rounds of contours"))
            strokes = sorted(map(tuple, S.stroke_pixels(lab, size).collect()))
            found.append((strokes, sorted(map(tuple, S.outlines(lab, size).collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 50 and len(found[0][1]) > 100


@pytest.mark.parametrize("height", [None, 37])
def test_masks_are_scaled_alike_in_a_task_and_by_joins(spark, monkeypatch, height):
    g = np.full((2, 30, 34), 220)
    g[0, 6:22, 5:27], g[1, 4:25, 9:12], g[0, 10:13, 8:20] = 40, 30, 215
    px = pixels(spark, *g)
    found = []
    for most in (1 << 21, 0):
        monkeypatch.setattr(S, "IMAGE_PIXELS", most)
        found.append(sorted(map(tuple, S.ink_mask(px, height).collect())))
    assert found[0] == found[1] and len(found[0]) > 300
