"""Removal of long passages that an earlier document holds already.

Every document is indexed by its non-overlapping blocks of half a window (25
of 50 words); a repeated window contains such a block whole, wherever it
stands.  Every rolling block of every document probes the index.  A block that
another document holds too is an anchor; around its anchors each document's
full windows are compared exactly, and neighbouring windows that repeat join to
maximal repeats.

Probes are numerous, so they travel packed: a task hashes its documents, sorts
the hashes and sends each partition one array of (47-bit hash, block flag,
document) words.  Blocks that many documents of one task share are answered in
that task and sent once, so frequent passages fill no partition.  Window hashes
(128 bits, of two salts) are sent once per task with the smallest document, which
decides who is first; within a document 64 bits name a window.  ``spark.sql.shuffle.partitions`` sets the number of hash ranges, each
of which one task sorts in memory (about 30 bytes for each probe).

Edge cases: null and empty texts have no words; documents shorter than a window
lose nothing; rows that repeat a ``doc_id`` are each judged against smaller ids
only; rows with a null ``doc_id`` lose nothing and take nothing; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm import idfilter
from rasterlake.llm.kernels import U64, chunks, mix, window_hashes, word_hashes, words
from rasterlake.session import materialize

FLUSH = 2_000_000
COMMON = 64
MAX_LOCAL = 1 << 16
BLOCK_BITS = U64(17)
FLAG = U64(1 << 16)
LOW = U64(0xFFFF)
#: Salt of a window's second hash.
SECOND = 0x2545F4914F6CDD1D


def _ranges(sorted_hash: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of a ``bits``-bit hash begins."""
    edges = np.array([(i << bits) // parts for i in range(parts)], U64)
    return np.append(np.searchsorted(sorted_hash, edges), len(sorted_hash))


def _packed(doc: np.ndarray, value: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed pairs) of answers, dealt out by document."""
    part = (mix(doc.view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    pair = np.stack([doc.view(U64)[order], value[order]], 1)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, z in zip(cut, np.append(cut[1:], len(part))):
        yield int(part[a]), pair[a:z].tobytes()


def _told(doc: np.ndarray, value: np.ndarray, parts: int) -> pa.RecordBatch:
    """Answers found before the exchange; they already go to their document's part."""
    rows = list(_packed(doc, value, parts))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], names=["part", "data", "docs"])


def _sent(slices: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([s[0] for s in slices], pa.int32()), pa.array([s[1] for s in slices], pa.binary()), pa.array([s[2] for s in slices], pa.binary())],
        names=["part", "data", "docs"],
    )


PARCEL = "part int, data binary, docs binary"
ANSWER = "part int, data binary"


def _probe(window: int, parts: int):
    """Rolling blocks and reference blocks of each document, packed by hash range."""
    block = window // 2

    def flush(held: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        packed = np.unique(np.concatenate(held))
        doc_of = np.array(ids, np.int64)
        h = packed >> BLOCK_BITS
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        if (size > COMMON).any():
            common = np.repeat(size > COMMON, size)
            yield _told(doc_of[(packed[common] & LOW).astype(np.int64)], h[common], parts)
            # the first two rows of a common block speak for all: one with the flag, if any has it
            keep = ~common
            big = begin[size > COMMON]
            keep[big] = keep[big + 1] = True
            flagged = np.bitwise_or.reduceat(packed, begin)[size > COMMON] & FLAG
            packed[big] |= flagged
            packed, h = packed[keep], h[keep]
        cuts, out = _ranges(h, parts, 47), []
        for p in range(parts):
            x = packed[cuts[p] : cuts[p + 1]]
            if len(x):
                local, at = np.unique(x & LOW, return_inverse=True)
                out.append((p, ((x & ~LOW) | at.astype(U64)).tobytes(), doc_of[local.astype(np.int64)].tobytes()))
        for lo in range(0, len(out), 16):
            yield _sent(out[lo : lo + 16])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, n = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, _, data, offsets in chunks(batch.column(1)):
                starts, ends, at = words(data, offsets)
                g = (window_hashes(word_hashes(data, starts, ends), block) >> BLOCK_BITS) << BLOCK_BITS
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if b - a < window or doc_ids[lo + i] is None:
                        continue
                    x = g[a : b - block + 1] | U64(len(ids))
                    x[::block] |= FLAG
                    held.append(x)
                    ids.append(doc_ids[lo + i])
                    n += len(x)
                    if n >= FLUSH or len(ids) == MAX_LOCAL:
                        yield from flush(held, ids)
                        held, ids, n = [], [], 0
        if n:
            yield from flush(held, ids)

    return run


def _parcels(batches: Iterator[pa.RecordBatch], mine: list) -> Iterator[pa.RecordBatch]:
    """Passes answers on and keeps the rest in ``mine``."""
    for batch in batches:
        rest = np.asarray(batch.column(2).is_valid())
        kept = batch.filter(pa.array(rest))
        mine += zip(kept.column(1).to_pylist(), kept.column(2).to_pylist())
        if not rest.all():
            yield batch.filter(pa.array(~rest)).select(["part", "data"])


def _answers(doc: np.ndarray, value: np.ndarray, parts: int) -> pa.RecordBatch:
    return _told(doc, value, parts).select(["part", "data"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the answers: a row for each document with all it was told."""
    raw = [d for batch in batches for d in batch.column(1).to_pylist()]
    if not raw:
        return
    pair = np.frombuffer(b"".join(raw), U64).reshape(-1, 2)
    raw.clear()
    doc = pair[:, 0].copy().view(np.int64)
    order = np.lexsort((pair[:, 1], doc))
    doc, value = doc[order], pair[order, 1]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    end = np.append(cut[1:], len(doc))
    for lo in range(0, len(cut), 2000):
        rows = [np.unique(value[a:z]).tobytes() for a, z in zip(cut[lo : lo + 2000], end[lo : lo + 2000])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cut[lo : lo + 2000]]), pa.array(rows, pa.binary())], names=["doc_id", "told"])


def _anchors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """One hash range: the blocks that some document indexes and another holds."""
    mine: list = []
    yield from _parcels(batches, mine)
    if not mine:
        return
    raw = [np.frombuffer(d, U64) for d, _ in mine]
    docs = np.concatenate([np.frombuffer(t, np.int64)[(x & LOW).astype(np.int64)] for x, (_, t) in zip(raw, mine)])
    x = np.concatenate(raw)
    mine.clear()
    h = x >> BLOCK_BITS
    index = np.unique(h[(x & FLAG) != 0])
    if not len(index):
        return
    at = np.minimum(np.searchsorted(index, h), len(index) - 1)
    hit = index[at] == h
    at, docs = at[hit], docs[hit]
    low, high = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
    np.minimum.at(low, at, docs)
    np.maximum.at(high, at, docs)
    shared = (low < high)[at]
    if shared.any():
        pair = np.unique(np.rec.fromarrays([docs[shared], at[shared]], names="d,a"))
        yield _answers(np.ascontiguousarray(pair["d"]), index[pair["a"]], parts)


def _sorted_windows(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows by both hashes and document, and which of them begin a window."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    return h, g, doc, np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))


def _windows(window: int, parts: int):
    """Exact windows around the anchors, packed by hash range with the task's smallest document."""
    block = window // 2

    def flush(held: list[tuple[np.ndarray, np.ndarray]], ids: list[int]) -> Iterator[pa.RecordBatch]:
        h, g = (np.concatenate(x) for x in zip(*held))
        doc = np.repeat(np.array(ids, np.int64), [len(x) for x, _ in held])
        h, g, doc, first = _sorted_windows(h, g, doc)
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        later = doc != least
        if later.any():
            pair = np.unique(np.rec.fromarrays([doc[later], h[later]], names="d,h"))
            yield _told(np.ascontiguousarray(pair["d"]), pair["h"], parts)
        pair, doc = np.stack([h[first], g[first]], 1), doc[first]
        cuts = _ranges(pair[:, 0], parts, 64)
        out = [(p, pair[cuts[p] : cuts[p + 1]].tobytes(), doc[cuts[p] : cuts[p + 1]].tobytes()) for p in range(parts) if cuts[p + 1] > cuts[p]]
        for lo in range(0, len(out), 16):
            yield _sent(out[lo : lo + 16])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, n = [], [], 0
        for batch in batches:
            doc_ids, told = batch.column(0).to_pylist(), batch.column(2)
            for lo, _, data, offsets in chunks(batch.column(1)):
                starts, ends, at = words(data, offsets)
                h = word_hashes(data, starts, ends)
                g, full, second = window_hashes(h, block) >> BLOCK_BITS, window_hashes(h, window), window_hashes(h, window, SECOND)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if b - a < window:
                        continue
                    anchors = np.frombuffer(told[lo + i].as_py(), U64)
                    p = np.flatnonzero(np.isin(g[a : b - block + 1], anchors))
                    last = b - a - window  # the last start of a full window
                    change = np.zeros(last + 2, np.int64)
                    np.add.at(change, np.clip(p - (window - block), 0, last + 1), 1)
                    np.add.at(change, np.clip(p + 1, 0, last + 1), -1)
                    s = np.flatnonzero(np.cumsum(change)[: last + 1] > 0)
                    if len(s):
                        held.append((full[a + s], second[a + s]))
                        ids.append(doc_ids[lo + i])
                        n += len(s)
                    if n >= FLUSH:
                        yield from flush(held, ids)
                        held, ids, n = [], [], 0
        if n:
            yield from flush(held, ids)

    return run


def _firsts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """One hash range: every document but the smallest is told that a window repeats."""
    mine: list = []
    yield from _parcels(batches, mine)
    if not mine:
        return
    pair = np.concatenate([np.frombuffer(d, U64) for d, _ in mine]).reshape(-1, 2)
    doc = np.concatenate([np.frombuffer(t, np.int64) for _, t in mine])
    mine.clear()
    h, _, doc, first = _sorted_windows(pair[:, 0], pair[:, 1], doc)
    later = doc != doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    if later.any():
        yield _answers(doc[later], h[later], parts)


def _cut(window: int):
    """Removes the words of repeated windows (maximal repeats) from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, removed, whole, kept = batch.column(2), [], [], []
            texts = batch.column(1).to_pylist()
            for lo, _, data, offsets in chunks(batch.column(1)):
                starts, ends, at = words(data, offsets)
                full = window_hashes(word_hashes(data, starts, ends), window)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    ws = (texts[lo + i] or "").encode().split()
                    gone = np.zeros(b - a, bool)
                    if b - a >= window:
                        s = np.isin(full[a : b - window + 1], np.frombuffer(told[lo + i].as_py(), U64))
                        change = np.zeros(b - a + 1, np.int64)
                        change[: len(s)] += s
                        change[window : window + len(s)] -= s
                        gone = np.cumsum(change)[: b - a] > 0
                    removed.append(int(gone.sum()))
                    whole.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                    kept.append(hashlib.sha256(b" ".join(w for w, g in zip(ws, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole), pa.array(removed, pa.int64()), pa.array(kept)], names=["doc_id", "whole", "n_removed", "kept"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column(1).to_pylist():
            ws = (text or "").encode().split()
            n.append(len(ws))
            sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "whole"])


def _skip(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``ids``, before any shuffle."""
    bits = idfilter.build(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bits.value
        for batch in batches:
            yield batch.filter(pa.array(idfilter.mask(packed, batch.column(0))))

    return docs.mapInArrow(run, docs.schema)


def _with(docs: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """``doc_id, text, told``: each document with what it was told (bounded by its length)."""
    told = materialize(answers.repartitionById(parts, "part").mapInArrow(_gather, "doc_id bigint, told binary"), "substr")
    return _skip(docs, told.select("doc_id")).join(told, "doc_id").select("doc_id", "text", "told")


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``.

    ``window`` must be even.
    """
    if window % 2:
        raise ValueError("window must be even")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    probes = docs.mapInArrow(_probe(window, parts), PARCEL).repartitionById(parts, "part")
    near = _with(docs, probes.mapInArrow(lambda b: _anchors(b, parts), ANSWER), parts)
    exact = near.mapInArrow(_windows(window, parts), PARCEL).repartitionById(parts, "part")
    cut = _with(docs, exact.mapInArrow(lambda b: _firsts(b, parts), ANSWER), parts).mapInArrow(_cut(window), "doc_id bigint, whole string, n_removed bigint, kept string").distinct()
    base = docs.mapInArrow(_count, "doc_id bigint, n_words bigint, whole string")
    out = base.join(cut, ["doc_id", "whole"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))
