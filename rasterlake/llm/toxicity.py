"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, word pairs and skip-grams (one word left out)
of a text, lower-cased and hashed into 2**31 slots, each with value 1.  The
learner is FTRL-proximal with a rate of its own for every coordinate and L1
regularisation, so only a small sorted array of slots and weights is broadcast.

Training uses a bounded sample of labelled rows: those with the smallest hash of
``doc_id``, ``max_rows`` at most and with ``max_slots`` features at most (one row
at least).  Spark extracts the features; one task then runs the sequential
learner over that bounded block.  A feature of a single row is
left out beforehand, as L1 would leave it at zero.  Scoring covers every row
without a shuffle.

Edge cases: null or empty texts have only the bias; labels that are null or
unmatched are not used; with no usable labels every score is 0.5; repeated rows
give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.llm.kernels import ALNUM, LOWER, U64, chunks, mix, signed, tidy, window_hashes, word_hashes, words
from rasterlake.session import materialize

SLOT_BITS = 31
BIAS = -1


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the slots of its words, pairs and skip-grams (with repeats)."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, ALNUM)
    h = word_hashes(data, starts, ends)
    pair = window_hashes(h, 2)
    skip = mix(h[:-2] * U64(3) + h[2:] * U64(5) + U64(7)) if len(h) > 2 else h[:0]
    low = U64(64 - SLOT_BITS)
    one, two, gap = mix(h + U64(1)) >> low, mix(pair + U64(2)) >> low, mix(skip + U64(3)) >> low
    for lo, hi in zip(at[:-1], at[1:]):
        yield np.concatenate([one[lo:hi], two[lo : max(lo, hi - 1)], gap[lo : max(lo, hi - 2)]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, label, n, slots) of the training sample."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(2)):
            slots = [np.unique(x).astype(np.int32).tobytes() for x in features(data, offsets)]
            cols = [*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array([len(s) // 4 for s in slots], pa.int64()), pa.array(slots, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["o", "label", "n", "slots"])


def _ftrl(flat: np.ndarray, size: np.ndarray, label: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of ``size`` slots each, row after row; slots and weights that are not zero."""
    ordered = np.sort(flat)
    first = np.append(True, ordered[1:] != ordered[:-1])
    # one row moves z by at most epochs * positive, which may not pass l1
    if epochs * positive <= 2 * l1:
        first[:-1] &= ordered[1:] == ordered[:-1]
        first[-1:] = False
    names = ordered[first]
    del ordered, first
    bias = len(names)

    def local(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, x), max(0, bias - 1))
        return np.append(at[names[at] == x] if bias else at[:0], bias).astype(np.int32)

    ends = np.cumsum(size)
    parts = [local(flat[z - n : z]) for z, n in zip(ends.tolist(), size.tolist())]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        """Closed form of the proximal step; the bias, always last, has no L1."""
        pull = np.full(len(zi), l1)
        pull[-1] = 0
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(ni)) / alpha + l2))

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(parts)):
            at = parts[r]
            w = weights(z[at], n[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label[r]
            g *= positive if label[r] else 1
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    keep = (w != 0) | (np.arange(bias + 1) == bias)
    return np.append(names.astype(np.int64), BIAS)[keep], w[keep]


def _fit(*args: float):
    """The learner in one task, over all rows that come, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, size, label, mark = [], [], [], []
        for batch in batches:
            for y, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(s.as_buffer(), np.int32)
                flat.append(x.copy())
                size.append(len(x))
                label.append(y)
                mark.append(int(mix(x.astype(U64)).sum()))
        if not size:
            return
        order = np.lexsort((np.array(label), np.array(mark, U64), np.array(size)))
        joined = np.concatenate([flat[i] for i in order])
        flat.clear()
        slot, w = _ftrl(joined, np.array(size)[order], np.array(label, float)[order], *args)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(w, pa.float64())], names=["slot", "w"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 16_384,
    max_slots: int = 1 << 25,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.1,
    positive: float = 1.5,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    ``max_rows`` and ``max_slots`` bound the sample of labelled rows that is
    fitted, in one task, in rows and in features (four bytes each);
    ``positive`` is the weight of a toxic row.  A document with two labels
    counts as toxic if either says so.
    """
    picked = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).cast("int").alias("label"))
        .withColumn("o", F.xxhash64("doc_id"))
        .orderBy("o", "doc_id")
        .limit(max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("o", "label", "text")
    rows = materialize(sample.mapInArrow(tidy(_rows), "o bigint, label int, n bigint, slots binary"), "toxic")
    # a row of two numbers for each of the sample's at most max_rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"), F.lit(0))
    fits = rows.select("o", "n").withColumn("before", before).filter((F.col("before") + F.col("n") <= max_slots) | (F.col("before") == 0)).select("o").distinct()
    block = rows.join(F.broadcast(fits), "o", "left_semi").select("label", "slots").coalesce(1)
    fit = block.mapInArrow(tidy(_fit(epochs, alpha, beta, l1, l2, positive)), "slot bigint, w double")
    got = {r["slot"]: r["w"] for r in fit.collect()}
    slot = np.array(sorted(s for s in got if s != BIAS), np.int64)
    return slot, np.array([got[s] for s in slot.tolist()], float), got.get(BIAS, 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """``doc_id, score`` for every row, or the columns ``keep`` and ``toxic_score``.

    A repeated feature counts once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, weight, bias = sent.value
        bits = np.zeros(1 << 16, bool)
        bits[slot & 0xFFFF] = True
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                for i, x in enumerate(features(data, offsets)):
                    s = signed(x)
                    s = s[bits[s & 0xFFFF]]
                    total = bias
                    if len(s) and len(slot):
                        at = np.minimum(np.searchsorted(slot, s), len(slot) - 1)
                        total += weight[np.unique(at[slot[at] == s])].sum()
                    out[lo + i] = total
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*cols, "score" if keep is None else "toxic_score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + (", score double" if keep is None else ", toxic_score double")
    return docs.select(*cols, F.col("text").alias("__text")).mapInArrow(tidy(run), schema)
