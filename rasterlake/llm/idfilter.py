"""A hashed bit set of ids, of fixed size, to skip rows before their text is read.

It may let further rows through but never holds one back, so the exact join
that follows stays right.  Its size does not depend on the data: beyond a few
million ids it merely skips less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.kernels import U64, mix

BITS = 1 << 26
PIECE = 1 << 18


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(U64) + U64(0x51ED27)) % U64(BITS)).astype(np.int64)


def slot(i: int) -> int:
    """``_slots`` of one id from 0 up, without arrays."""
    x = i + 0x51ED27
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return (x ^ (x >> 31)) % BITS


def _marks(batches):
    for batch in batches:
        ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.unique(_slots(ids))
        yield pa.RecordBatch.from_arrays([pa.array(slot // PIECE), pa.array(slot % PIECE)], names=["piece", "bit"])


def build(ids: DataFrame) -> Broadcast:
    """The bit set of the single id column of ``ids``."""
    rows = (
        ids.mapInArrow(_marks, "piece bigint, bit bigint")
        .withColumn("word", F.expr("bit div 63"))
        .groupBy("piece", "word")
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 63 as int))) AS v"))
        .groupBy("piece")
        .agg(F.collect_list(F.struct("word", "v")).alias("words"))  # at most PIECE / 63 + 1
        .coalesce(16)  # the whole is bounded, so a few parts one after another
        .toLocalIterator()
    )
    bits = np.zeros(BITS, bool)
    for row in rows:
        at = np.array([w["word"] for w in row["words"]], np.int64)
        v = np.array([w["v"] for w in row["words"]], np.int64)
        for b in range(63):
            on = at[(v >> b) & 1 == 1] * 63 + b
            bits[row["piece"] * PIECE + on] = True
    return ids.sparkSession.sparkContext.broadcast(np.packbits(bits))


def mask(packed: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which entries of ``ids`` may be in the set; nulls are not."""
    there = np.asarray(ids.is_valid())
    slot = _slots(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return there & ((packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
