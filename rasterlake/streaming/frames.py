"""The frame operators as stateful streams, one state per camera or group of cameras.

``smooth_in_order`` holds frames back until the watermark has passed them, so
its results do not depend on the micro-batch in which a frame lands, as long as
it is no later than the allowed delay.  ``smooth`` answers at once and puts only
the frames of one micro-batch in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterlake.operators.learn import decide
from rasterlake.session import ship_code

OUT = "camera_id bigint, seq bigint, ts timestamp, stable boolean, shown string, misses int, failed boolean, fps double"
STATE = "flags array<boolean>, texts array<string>, misses int, last double, fps double"
COLUMNS = ["camera_id", "seq", "ts", "stable", "shown", "misses", "failed", "fps"]
#: The group of rows that are no frames.
NO_FRAME = -1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Recent:
    """What a camera's last frames leave behind: a few short lists and numbers."""

    def __init__(self, held: tuple | None, flags: int, texts: int, least: int, limit: int, keep: float) -> None:
        hits, seen, self.misses, self.last, self.fps = held or ([], [], 0, None, 0.0)
        self.hits, self.seen = list(hits), list(seen)
        self.flags, self.texts, self.least, self.limit, self.keep = flags, texts, least, limit, keep

    def held(self) -> tuple:
        return self.hits, self.seen, self.misses, self.last, self.fps

    def add(self, text: str | None, hit: bool, us: float) -> tuple:
        """``stable, shown, misses, failed, fps`` with one more frame, at ``us`` microseconds."""
        self.hits = [*self.hits, hit][-self.flags :]
        missed, shown = text is None, None
        self.misses = self.misses + 1 if missed else 0
        if not missed:
            self.seen = [*self.seen, text][-self.texts :]
            count = Counter(t for t in self.seen if t)
            best = max(count, key=lambda t: (count[t], -self.seen.index(t)), default=None)
            shown = best if best and count[best] >= self.least else None
        if self.last is not None:
            self.fps = self.keep * self.fps + (1 - self.keep) / max((us - self.last) / 1e6, 1e-6)
        self.last = us
        return 2 * sum(self.hits) > len(self.hits), shown, self.misses, self.misses == self.limit, self.fps


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _hit(value) -> bool:
    return value is not None and value == value and bool(value)


def smooth(stream: DataFrame, flags: int = 8, texts: int = 10, least: int = 5, limit: int = 30, keep: float = 0.9) -> DataFrame:
    """Majority, stable text, missed frames and frame rate of ``frames(camera_id, seq, ts, text, hit)``.

    The state of a camera is a few short lists, whatever its history.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, out = Recent(state.get if state.exists else None, flags, texts, least, limit, keep), []
        for r in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples():
            out.append((key[0], r.seq, r.ts, *recent.add(_text(r.text), _hit(r.hit), float(r.ts.value // 1000))))
        state.update(recent.held())
        yield pd.DataFrame(out, columns=COLUMNS)

    return stream.groupBy("camera_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


WAITING = pa.schema([("camera_id", pa.int64()), ("us", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("hit", pa.bool_())])
HELD = pa.schema([("camera_id", pa.int64()), ("hits", pa.list_(pa.bool_())), ("seen", pa.list_(pa.string())), ("misses", pa.int64()), ("last", pa.float64()), ("fps", pa.float64())])


def _packed(table: pa.Table) -> bytes:
    """A table as one value of a state."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(values: list, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(v).read_all() for v in values)])


class InOrder(StatefulProcessor):
    """Holds the frames of a group of cameras in a list state and passes them on when a timer says that none before them can come.

    A call to the state costs far more than a frame, so states hold tables: the frames
    of a micro-batch are one value of the list, and what the group's cameras leave behind is one value.
    """

    def __init__(self, how: dict) -> None:
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frames binary")
        self.held = handle.getValueState("held", "cameras binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for part in rows if key[0] != NO_FRAME else ():
            cols = part["camera_id"], part["us"], part["seq"], [_text(t) for t in part["text"]], [_hit(h) for h in part["hit"]]
            new.append(pa.table([pa.array(c, f.type) for c, f in zip(cols, WAITING)], schema=WAITING))
        if new:
            table = pa.concat_tables(new)
            self.waiting.appendValue((_packed(table),))
            self._wake(pc.min(table["us"]).as_py())
        yield pd.DataFrame(columns=COLUMNS)

    def _wake(self, us: int) -> None:
        """One timer a group, at its earliest waiting frame."""
        at, there = -(-us // 1000), list(self.handle.listTimers())
        if not there or at < min(there):
            for t in there:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked([r[0] for r in self.waiting.get()], WAITING)
        ready = waiting.filter(pc.less_equal(waiting["us"], upto))
        later = waiting.filter(pc.greater(waiting["us"], upto))
        if later.num_rows:
            self.waiting.put([(_packed(later),)])
            self.handle.registerTimer(-(-pc.min(later["us"]).as_py() // 1000))
        else:
            self.waiting.clear()
        if not ready.num_rows:
            yield pd.DataFrame(columns=COLUMNS)
            return
        held = _unpacked([self.held.get()[0]] if self.held.exists() else [], HELD)
        left = dict(zip(held["camera_id"].to_pylist(), zip(*(held[c].to_pylist() for c in HELD.names[1:]))))
        # a missed frame before an empty text, and no hit before a hit
        ready = ready.append_column("read", pc.is_valid(ready["text"])).sort_by([(c, "ascending") for c in ("camera_id", "us", "seq", "read", "text", "hit")])
        camera, recent, out = None, None, []
        for c, us, seq, text, hit in zip(*(ready[c].to_pylist() for c in WAITING.names)):
            if c != camera:
                if recent is not None:
                    left[camera] = recent.held()
                camera, recent = c, Recent(left.get(c), **self.how)
            out.append((c, seq, us, *recent.add(text, hit, float(us))))
        left[camera] = recent.held()
        self.held.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*((c, *v) for c, v in left.items())), HELD)], schema=HELD)),))
        done = pd.DataFrame(out, columns=COLUMNS)
        done["ts"] = pd.to_datetime(done["ts"], unit="us")
        yield done

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB, which timers and list states need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def smooth_in_order(stream: DataFrame, delay: str, flags: int = 8, texts: int = 10, least: int = 5, limit: int = 30, keep: float = 0.9, groups: int = 512) -> DataFrame:
    """``smooth`` in the order of ``(ts, seq)`` across micro-batches.

    A frame waits until the watermark, ``delay`` behind the latest time seen, has
    passed it; frames that come later than that are dropped, as Spark counts
    them.  Cameras share ``groups`` states by a hash of their id; a state is the
    waiting frames of its cameras, as many as come within the delay, and a few short lists of each camera.
    A group's frames that get ready in a micro-batch meet in one task, so ``groups``
    should follow the rate of the stream.  Rows without a ``seq`` only move the watermark;
    frames without a time or a camera have no place in the order and are left out.
    Start the stream within ``state_store``.
    """
    ship_code(stream.sparkSession)
    how = {"flags": flags, "texts": texts, "least": least, "limit": limit, "keep": keep}
    rows = stream.select("camera_id", "ts", "seq", "text", "hit").withWatermark("ts", delay).filter("ts is not null").withColumn("us", F.unix_micros("ts"))
    group = F.when(F.expr("camera_id is null or seq is null"), NO_FRAME).otherwise(F.pmod(F.xxhash64("camera_id"), F.lit(groups)).cast("int"))
    return rows.withColumn("group", group).groupBy("group").transformWithStateInPandas(statefulProcessor=InOrder(how), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def smooth_scored(stream: DataFrame, cols: list[str], model: list[dict], bias: float, threshold: float = 0.5, **how) -> DataFrame:
    """``smooth`` with the flag of each frame from its features ``cols``.

    Scoring is stateless; a frame without any feature, which the gate has
    rejected, is no hit.
    """
    return smooth(scored_frames(stream, cols, model, bias, threshold), **how)


def scored_frames(stream: DataFrame, cols: list[str], model: list[dict], bias: float, threshold: float = 0.5) -> DataFrame:
    """``camera_id, seq, ts, text, hit`` of frames with features ``cols``."""
    scored = decide(stream, cols, model, bias, threshold)
    hit = F.coalesce(*cols).isNotNull() & F.col("is_handwritten")
    return scored.select("camera_id", "seq", "ts", "text", hit.alias("hit"))
