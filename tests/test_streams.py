"""Event-time streams, their sink, and ranges of one long camera, against plain loops."""

import os
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import frames as FR, ranges
from rasterlake.streaming import frames as ST
from rasterlake.streaming.landing import frame_stream, land_late
from rasterlake.streaming.sink import BatchSink, run_available

SCHEMA = "camera_id bigint, seq bigint, ts timestamp, text string, hit boolean"
T0 = datetime(2024, 1, 1)


def plain(rows, n=8, history=10, least=5, limit=30, keep=0.9):
    """The results of each frame by one loop over each camera."""
    out = {}
    for camera in {r[0] for r in rows}:
        hits, seen, misses, last, fps = [], [], 0, None, 0.0
        for _, seq, ts, text, hit in sorted((r for r in rows if r[0] == camera), key=lambda r: (r[2], r[1])):
            hits.append(bool(hit))
            misses = misses + 1 if text is None else 0
            shown = None
            if text is not None:
                seen.append(text)
                window = seen[-history:]
                count = Counter(t for t in window if t)
                best = max(count, key=lambda t: (count[t], -window.index(t)), default=None)
                shown = best if best and count[best] >= least else None
            if last is not None:
                fps = keep * fps + (1 - keep) / max((ts - last).total_seconds(), 1e-6)
            last = ts
            out[camera, seq] = (sum(hits[-n:]) * 2 > len(hits[-n:]), shown, misses, misses == limit, fps)
    return out


def frames(n, cameras=(1, 2), seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for c in cameras:
        at = np.cumsum(r.exponential(2.0, n))
        text = r.choice(["a", "b", "", "MISS"], n, p=[0.4, 0.2, 0.1, 0.3])
        rows += [(c, i, T0 + timedelta(microseconds=int(t * 1e6)), None if x == "MISS" else str(x), bool(h)) for i, (t, x, h) in enumerate(zip(at, text, r.random(n) < 0.55))]
    return rows


def results(df):
    return {(r.camera_id, r.seq): (r.stable, r.shown, r.misses, r.failed, r.fps) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4] and abs(got[k][4] - w[4]) < 1e-9, k


def test_stream_of_late_files_equals_a_plain_loop(spark, tmp_path):
    rows = frames(150)
    df = spark.createDataFrame(rows, SCHEMA)
    delay = land_late(df, str(tmp_path / "in"), slices=4, files=1)
    # files hold frames that are older than those of the file before
    parts = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=os.path.getmtime)
    spans = [spark.read.parquet(str(p)).filter("seq is not null").agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert any(a[1] > b[0] for a, b in zip(spans, spans[1:]) if a[1] and b[0])
    stream = frame_stream(spark, str(tmp_path / "in"), SCHEMA, "parquet", 1)
    sink = BatchSink(str(tmp_path / "out"), "s", "parquet")
    with ST.state_store(spark):
        run_available(ST.smooth_in_order(stream, f"{delay} seconds", limit=2), sink, str(tmp_path / "cp"))
    assert len(sink.batches(spark)) > 3
    same(results(sink.read(spark, ST.OUT)), plain(rows, limit=2))


class Killed(RuntimeError):
    pass


class Killing(BatchSink):
    """Dies once in a batch, after its rows are written and before or after its marker."""

    def __init__(self, *args, batch, marked):
        super().__init__(*args)
        self.at, self.marked = batch, marked

    def __call__(self, df, batch):
        if batch != self.at:
            return super().__call__(df, batch)
        if self.marked:
            super().__call__(df, batch)
        else:
            df.write.mode("overwrite").format(self.kind).save(self.folder(batch))
        raise Killed


@pytest.mark.parametrize("marked", [False, True])
def test_a_killed_stream_goes_on_from_its_checkpoint_without_second_records(spark, tmp_path, marked):
    rows = frames(120, seed=3)
    delay = land_late(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "in"), slices=4, files=1)
    where, checkpoint = (str(tmp_path / "out"), "s", "parquet"), str(tmp_path / "cp")

    def run(sink):
        with ST.state_store(spark):
            run_available(ST.smooth_in_order(frame_stream(spark, str(tmp_path / "in"), SCHEMA, "parquet", 1), f"{delay} seconds", limit=2), sink, checkpoint)

    with pytest.raises(Exception, match="Killed"):
        run(Killing(*where, batch=2, marked=marked))
    sink = BatchSink(*where)
    done = sink.batches(spark)
    assert done == ([0, 1, 2] if marked else [0, 1])
    run(sink)
    assert sink.batches(spark)[: len(done)] == done and len(sink.batches(spark)) > 4
    got = sink.read(spark, ST.OUT)
    assert got.count() == len(rows)
    same(results(got), plain(rows, limit=2))


def test_a_repeated_batch_leaves_no_second_record(spark, tmp_path):
    sink = BatchSink(str(tmp_path), "a", "json", ("cls",))
    one = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, v string, cls string")
    for _ in range(2):
        sink(one, 0)
    sink(one.limit(0), 1)
    two = BatchSink(str(tmp_path), "b", "json", ("cls",))
    two(one.filter("id = 1"), 0)
    # rows without a marker are not there
    one.write.json(sink.folder(7))
    schema = "id int, v string, cls string"
    assert sorted(map(tuple, sink.read(spark, schema).collect())) == [(1, "x", "p"), (2, "y", "q")]
    assert [tuple(r) for r in two.read(spark, schema).collect()] == [(1, "x", "p")]
    assert BatchSink(str(tmp_path), "none").read(spark, schema).count() == 0


def batch_results(df, parts, limit=30):
    a = FR.majority(df, parts=parts).select("camera_id", "seq", "stable")
    b = FR.stable_text(df, parts=parts).select("camera_id", "seq", "shown")
    c = FR.missed_runs(df, limit, parts=parts).select("camera_id", "seq", "misses", "failed")
    out = a.join(b, ["camera_id", "seq"], "left").join(c, ["camera_id", "seq"])
    return {(r.camera_id, r.seq): (r.stable, r.shown, r.misses, r.failed) for r in out.collect()}


@pytest.mark.parametrize("parts", [1, 7, 90])
def test_ranges_of_long_cameras_equal_a_plain_loop(spark, parts):
    rows = frames(200, (1,), 5) + frames(6, range(2, 9), 6)
    # a run of misses that goes over many ranges
    rows = [(c, s, t, None if c == 1 and 60 <= s < 150 else x, h) for c, s, t, x, h in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, limit=30)
    assert batch_results(df, parts) == {k: v[:4] for k, v in want.items()}
    last = {c: max((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))[1] for c in {r[0] for r in rows}}
    got = {r.camera_id: r.fps for r in FR.frame_rate(df, parts=parts).collect()}
    assert got.keys() == last.keys() and all(abs(got[c] - want[c, s][4]) < 1e-9 for c, s in last.items())


def test_one_camera_takes_several_tasks(spark):
    df = spark.createDataFrame(frames(400, (1,)), SCHEMA)
    cut = ranges.cut(df, ["camera_id"], ["ts", "seq"], 8)
    sizes = [r["count"] for r in cut.groupBy(ranges.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150
    halo = ranges.with_halo(cut, ["camera_id"], ["ts", "seq"], 7).filter("__halo").groupBy(ranges.PART).count().collect()
    assert len(halo) == 7 and all(r["count"] == 7 for r in halo)
    assert ranges.split_keys(cut, ["camera_id"]).count() == 8


def test_frames_edge_rows(spark):
    rows = [(None, 1, T0, "a", True), (None, 2, T0, None, None), (1, 1, None, "b", True), (1, 2, T0, None, False), (1, 2, T0, None, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.camera_id is not None, r.seq, r.misses) for r in FR.missed_runs(df, 2, parts=3).collect())
    assert got == [(False, 1, 0), (False, 2, 1), (True, 1, 0), (True, 2, 1), (True, 2, 2)]
    assert FR.majority(df, parts=3).count() == 5
    for run in (FR.majority, FR.stable_text, FR.missed_runs, FR.frame_rate):
        assert run(df.limit(0)).count() == 0


def test_a_million_frames_of_one_camera_in_a_day(spark):
    n = 1_000_000
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("camera_id"), F.col("id").alias("seq"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 80000 + F.pmod(F.xxhash64("id"), F.lit(70000))).alias("ts"),
        F.when(F.pmod(F.col("id"), F.lit(1000)) >= 7, F.lit("t")).alias("text"),
    )
    us = np.array([r[0] for r in df.select(F.unix_micros("ts")).orderBy("seq").collect()])
    fps = 0.0
    for dt in (np.diff(us) / 1e6)[-2000:]:  # what is older has less than 1e-90 of the weight
        fps = 0.9 * fps + 0.1 / dt
    assert abs(FR.frame_rate(df, parts=16).first().fps - fps) < 1e-9
    got = FR.missed_runs(df, 5, parts=16).agg(F.max("misses"), F.sum(F.col("failed").cast("int"))).first()
    assert tuple(got) == (7, 1000)


class Counted:
    """A state, or the handle of states, in memory; counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.timers = calls, [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] += 1
            if name in ("getListState", "getValueState"):
                return Counted(self.calls)
            if name in ("listTimers", "registerTimer", "deleteTimer"):
                self.timers += args if name == "registerTimer" else []
                return list(self.timers)
            if name == "get":
                return self.value
            self.value = {"appendValue": lambda: [*self.value, *args], "put": lambda: list(*args), "update": lambda: args[0], "clear": list, "exists": lambda: self.value}[name]()
            return bool(self.value)

        return call


@pytest.mark.parametrize("cameras", [3, 200])
def test_a_groups_calls_to_its_state_do_not_grow_with_its_cameras(cameras):
    rows = [(c, s, T0 + timedelta(seconds=s), None if s % 4 == 3 else "ab"[s % 2], s % 3 > 0) for c in range(cameras) for s in range(12)]
    calls, out = Counter(), []
    group = ST.InOrder({"flags": 8, "texts": 10, "least": 5, "limit": 1, "keep": 0.9})
    group.init(Counted(calls))
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for lo, upto in ((0, 3), (6, 20)):
        part = ST.pd.DataFrame([(c, us(t), s, x, h) for c, s, t, x, h in reversed(rows) if lo <= s < lo + 6], columns=["camera_id", "us", "seq", "text", "hit"])
        list(group.handleInputRows((5,), iter([part]), None))
        now = type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda upto=upto: us(T0 + timedelta(seconds=upto)) // 1000)})
        out += [r for df in group.handleExpiredTimer((5,), now, None) for r in df.itertuples(index=False)]
    same({(r.camera_id, r.seq): tuple(r[3:]) for r in out}, plain(rows, limit=1))
    assert sum(calls.values()) < 30


def test_cameras_that_share_a_state_equal_a_plain_loop(spark, tmp_path):
    big = 1 << 60
    rows = [(c + big, s + big + 1, *rest) for c, s, *rest in frames(30, range(7), 8)]
    df = spark.createDataFrame(rows + [(None, 1, T0, "a", True), (1, None, T0, "a", True)], SCHEMA)
    delay = land_late(df, str(tmp_path / "in"), slices=2, files=1)
    sink = BatchSink(str(tmp_path / "out"), "s", "parquet")
    with ST.state_store(spark):
        run_available(ST.smooth_in_order(frame_stream(spark, str(tmp_path / "in"), SCHEMA, "parquet", 1), f"{delay} seconds", limit=2, groups=2), sink, str(tmp_path / "cp"))
    same(results(sink.read(spark, ST.OUT)), plain(rows, limit=2))
