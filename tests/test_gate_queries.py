"""The gate's registered queries on small rasters with a known answer."""

import random

import numpy as np
import pytest
from art import pixels

from rasterlake.operators import gate, rasters as R, shapes as S
from rasterlake.plans import catalog


def stored(spark, folder, rasters):
    """Writes 8-wide rasters of 0..255 as an embeddings table."""
    rows = [(i, [(v + 0.5) / 127.5 - 1 for row in r for v in row]) for i, r in enumerate(rasters)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_marks_are_denoised_first(spark, tmp_path):
    def block(a, z):
        return [[255 if a <= y < z and a <= x < z else 0 for x in range(8)] for y in range(8)]

    d = stored(spark, tmp_path, [block(2, 5), block(1, 7)])
    assert [r.image_id for r in catalog.queries()["detect_markings"](spark, d).collect()] == [1]


def test_marks_on_uneven_paper_are_no_writing(spark, tmp_path):
    def stroke(below):
        return [[20 if 3 <= x <= 4 and 12 <= y < 24 else (250 if y < 18 else below) for x in range(8)] for y in range(40)]

    d = stored(spark, tmp_path, [stroke(250), stroke(150)])
    pieces = {r.image_id: r.pieces for r in catalog.queries()["find_writing"](spark, d).collect()}
    assert pieces == {0: 1, 1: 0}


def test_lines_of_whole_texts_equal_a_plain_loop(spark, tmp_path):
    r = random.Random(3)
    texts = ["".join(r.choice("ab  \n\t\u00e9") for _ in range(n)) for n in (0, 1, 63, 64, 65, 700, 1500)] + [None, " " * 200, "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        ink = {(k // 64, k % 64) for k, c in enumerate(t or "") if ord(c) > 32}
        boxes = []
        while ink:
            todo, part = [ink.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & ink
                ink -= near
                todo += near
            ys, xs = [y for y, _ in part], [x for _, x in part]
            boxes.append((min(xs), min(ys), max(xs) + 1 - min(xs), max(ys) + 1 - min(ys)))
        if not boxes:
            continue
        heights, line, last = sorted(b[3] for b in boxes), 0, None
        med = (heights[(len(boxes) - 1) // 2] + heights[len(boxes) // 2]) / 2
        rows = {}
        for x, y, w, h in sorted(boxes, key=lambda b: (b[1] + b[3] / 2, b[0], b[1], b[2])):
            cy = y + h / 2
            line += last is not None and cy - last > 0.6 * med
            last = cy
            rows.setdefault(line, []).append((x, y, w, h))
        for k, bs in rows.items():
            want.add((i, k, len(bs), min(b[0] for b in bs), max(b[0] + b[2] for b in bs), min(b[1] for b in bs), max(b[1] + b[3] for b in bs)))
    got = {(g.image_id, g.line, g.boxes, g.x0, g.x1, g.y0, g.y1) for g in catalog.queries()["document_lines"](spark, str(tmp_path)).collect()}
    assert got == want


def test_pixel_tables_are_not_broadcast_by_their_files_size(spark, tmp_path):
    d = stored(spark, tmp_path, [[[(7 * x + y) % 256 for x in range(8)] for y in range(8)]])
    for name in ("find_writing", "judge_live", "read_frames"):
        plan = catalog.queries()[name](spark, d)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_runs_of_texts_come_from_their_bytes(spark, tmp_path, monkeypatch):
    """No null, empty, wide or long text shifts the runs of another, however the batches are cut."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab \t\né一\U0001f600") for _ in range(n)) for n in (0, 1, 64, 65, 130, 3000, 2)] + [None, "", "\x00a\x1f", " " * 70]
    rows = list(zip([*range(len(texts) - 1), None], texts))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        for y in range(0, len(t or ""), 64):
            line = [ord(c) > 32 for c in t[y : y + 64]] + [False]
            heads = [x for x in range(64) if x < len(line) and line[x] and (x == 0 or not line[x - 1])]
            want += [(i, y // 64, x, x + line[x:].index(False) - 1) for x in heads]
    from rasterlake.sources import views

    out = catalog.queries()["ink_runs"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(views, "PART_BYTES", 50)
    again = [b for batch in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").toArrow().to_batches() for b in views._ink_runs(iter([batch]))]
    assert sorted(str((x["image_id"], x["y"], x["x0"], x["x1"])) for b in again for x in b.to_pylist()) == sorted(map(str, want))


@pytest.mark.parametrize("dark", [True, False])
def test_strengths_of_small_rasters_need_no_windows(spark, monkeypatch, dark):
    """A raster in one task has the ink strength that windows give, which larger ones still use."""
    g = np.random.default_rng(3).integers(0, 256, (2, 19, 23))
    px, found = pixels(spark, *g), []
    for most in (1 << 21, 0):
        with monkeypatch.context() as m:
            m.setattr(S, "IMAGE_PIXELS", most)
            if most:
                m.setattr(R, "ink_strength", lambda *a: pytest.fail("windows of pixels"))
            found.append(sorted(map(tuple, gate.strengths(px, dark, 7).select("image_id", "y", "x", "v").collect())))
    assert found[0] == found[1] and len(found[0]) == 2 * 19 * 23
