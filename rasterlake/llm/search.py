"""Ranked lexical search with hashed max-sketches.

Every document becomes a sketch: each of its terms has an impact (what the
score gives a term for its frequency and the document's length), terms are
hashed to 2**16 coordinates, and a coordinate holds the largest impact of its
terms, rounded up to one of 255 levels.  Empty coordinates are not stored, so
a sketch takes three bytes a distinct term.  An item's score is at most the sum
of its terms' weights times their coordinates.

Items go in blocks of bounded size.  A block's lookups over all sketches give
the bounds of whole batches of documents at once.  First the documents of each
item's highest bounds are scored exactly; their tenth score is a threshold that
the final tenth cannot fall below.  Then all documents whose bound reaches the
threshold are scored exactly.  No other can be among the first ten.

Scores are whole numbers.  Exact scores compare the terms' bytes; the counts of
documents that hold a term, and the sketches, compare 64-bit hashes of terms.

Edge cases: null and empty texts have no terms and are found by nothing; rows
that repeat are documents of their own, also where they share a ``doc_id``; rows
with a null ``doc_id`` count in the statistics and are not ranked; rows that
share an ``item_id`` are one item with all their terms, those with a null one
are left out; an empty table of either gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.llm import idfilter
from rasterlake.llm.kernels import ALNUM, LOWER, U64, chunks, mix, tidy, word_hashes, words
from rasterlake.session import materialize

WIDTH = 1 << 16
TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
FOLD = bytes(LOWER.tolist())
#: Upper ends of the levels; no impact exceeds the last.
LEVELS = np.array([0] + [math.ceil(10 ** (6 * i / 255)) for i in range(1, 256)], np.int64)
BLOCK_CHARS = 400_000
CELLS = 1 << 21
FIRST = 16


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms and the range of each row's terms."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), at


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h + U64(0x5E7C)) % U64(WIDTH)).astype(np.int64)


def length_factor(n: int, docs: int, terms: int) -> int:
    """``m`` of a document of ``n`` terms."""
    return 10 + 90 * n * docs // terms


def weight(docs: int, holding: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Block:
    """Items with their terms; ``weigh`` adds the weights."""

    def __init__(self, items: dict[int, set[bytes]]) -> None:
        self.ids = sorted(items)
        vocabulary = sorted(set().union(*items.values()))
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(t) for t in vocabulary])
        h = word_hashes(flat, np.append(0, ends[:-1]), ends) if vocabulary else np.zeros(0, U64)
        order = np.argsort(h)
        self.hash = h[order]
        self.place = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
        self.terms = [sorted(self.place[t] for t in items[i]) for i in self.ids]
        self.slots, self.column = np.unique(_slots(self.hash), return_inverse=True)
        self.lookup = np.full(WIDTH, -1, np.int32)
        self.lookup[self.slots] = np.arange(len(self.slots))

    def weigh(self, docs: int, holding: np.ndarray) -> None:
        self.docs = docs
        self.weight = [weight(docs, int(n)) for n in holding]
        self.items = []
        for terms in self.terms:
            columns, at = np.unique(self.column[terms], return_inverse=True)
            self.items.append((columns, np.bincount(at, [self.weight[t] for t in terms], len(columns))))

    def bounds(self, rows: int, row: np.ndarray, slot: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, upper bounds of a range of rows by item); whole numbers below 2**53."""
        column = self.lookup[slot]
        row, column, level = row[column >= 0], column[column >= 0], level[column >= 0]
        step = max(1, CELLS // max(1, len(self.slots)))
        for lo in range(0, rows, step):
            n = min(step, rows - lo)
            a, z = np.searchsorted(row, [lo, lo + n])
            held = np.zeros((n, len(self.slots)))
            held[row[a:z] - lo, column[a:z]] = LEVELS[level[a:z]]
            yield lo, np.stack([held[:, columns] @ w for columns, w in self.items], 1)

    def scores(self, text: str, items: list[int], terms: int) -> list[int]:
        """Exact scores of some items in one text."""
        tf = Counter(TERM.findall((text or "").encode().translate(FOLD)))
        n = tf.total()
        if not n:
            return [0] * len(items)
        m = length_factor(n, self.docs, terms)
        impact = {self.place[t]: 1_000_000_000 * k // (1000 * k + 8 * m) for t, k in tf.items() if t in self.place}
        return [sum(self.weight[t] * impact[t] for t in self.terms[i] if t in impact) for i in items]


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_CHARS`` characters, one after the other."""
    rows = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    for b in range(blocks):
        found: dict[int, set[bytes]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            found.setdefault(r["item_id"], set()).update(TERM.findall(r["text"].encode().translate(FOLD)))
        found = {i: t for i, t in found.items() if t}
        if found:
            yield Block(found)


def _statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, and for each of the block's terms the documents that hold it."""
    sent, n = docs.sparkSession.sparkContext.broadcast(block.hash), len(block.hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = sent.value, np.zeros(n + 2, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                h, at = _terms(data, offsets)
                size = np.diff(at)
                count[n:] += (size > 0).sum(), len(h)
                place = np.minimum(np.searchsorted(known, h), n - 1)
                hit = known[place] == h
                row = np.repeat(np.arange(len(size)), size)[hit]
                held = np.unique(row * n + place[hit]) % n
                count[:n] += np.bincount(held, minlength=n)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["term", "n"])

    got = docs.select("text").mapInArrow(tidy(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(n + 2, np.int64)
    for r in got:
        count[r["term"]] = r["n"]
    sent.destroy()
    return int(count[n]), int(count[n + 1]), count[:n]


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column of ``values`` cut at ``starts`` (which ends with their number)."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return data[offsets[0] : offsets[-1]].view(dtype), (offsets - offsets[0]) // size


def sketches(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, slots, levels``: the coordinates of each document that has terms, and their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                h, at = _terms(data, offsets)
                size = np.diff(at)
                row = np.repeat(np.arange(hi - lo), size)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                h, row = h[first], row[first]
                m = np.array([length_factor(k, n_docs, n_terms) for k in size.tolist()], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                key = np.sort(row << 24 | _slots(h) << 8 | np.searchsorted(LEVELS, impact))
                key = key[np.append(key[1:] >> 8 != key[:-1] >> 8, True)] if len(key) else key
                starts = np.searchsorted(key >> 24, np.arange(hi - lo + 1))
                slots, levels = (key >> 8 & 0xFFFF).astype(np.uint16), (key & 0xFF).astype(np.uint8)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _binary(slots, starts), _binary(levels, starts)], names=["doc_id", "slots", "levels"])
                yield out.filter(pa.array(starts[1:] > starts[:-1]))

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, slots binary, levels binary")


def _bounds(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc ids, bounds by item) of ranges of sketches."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        slots, starts = _flat(batch.column(1), np.uint16)
        levels, _ = _flat(batch.column(2), np.uint8)
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        for lo, bound in block.bounds(batch.num_rows, row, slots, levels):
            yield docs[lo : lo + len(bound)], bound


CANDIDATE = "doc_id bigint, item int, bound bigint"


def _candidate(docs: np.ndarray, items: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(items.astype(np.int32)), pa.array(bound.astype(np.int64))], names=["doc_id", "item", "bound"])


def _highest(sent, count: int):
    """The ``count`` highest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        n = len(block.ids)
        best, of = np.zeros((0, n)), np.zeros((0, n), np.int64)
        for docs, bound in _bounds(batches, block):
            best, of = np.concatenate([best, bound]), np.concatenate([of, np.repeat(docs[:, None], n, 1)])
            if len(best) > count:
                top = np.argpartition(-best, count - 1, axis=0)[:count]
                best, of = np.take_along_axis(best, top, 0), np.take_along_axis(of, top, 0)
        r, i = np.nonzero(best)
        yield _candidate(of[r, i], i, best[r, i])

    return run


def _reaching(sent, threshold: np.ndarray):
    """All bounds that are positive and reach their item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, bound in _bounds(batches, sent.value):
            r, i = np.nonzero(bound >= np.maximum(threshold, 1))
            if len(r):
                yield _candidate(docs[r], i, bound[r, i])

    return run


def _first(rows: DataFrame, count: int, by: list) -> DataFrame:
    """The first ``count`` rows of each item, taken within parts of each item before they meet."""
    part = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("r") <= count)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= count).drop("part", "r")


def _scored(docs: DataFrame, candidates: DataFrame, sent, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: exact scores of candidates, from the whole texts."""
    wanted = materialize(candidates.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "search")  # at most a block's items
    ids = idfilter.build(wanted.select("doc_id"))

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(idfilter.mask(ids.value, batch.column(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            out = []
            for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out += [(i, doc, s) for i, s in zip(items, block.scores(text, items, n_terms)) if s > 0]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    texts = docs.select("doc_id", "text").mapInArrow(tidy(skip), "doc_id bigint, text string").join(wanted, "doc_id")
    return texts.select("doc_id", "text", "items").mapInArrow(tidy(run), "item int, doc_id bigint, score bigint")


RANKED = "item_id bigint, rank int, doc_id bigint, score bigint"


def ranked(docs: DataFrame, items: DataFrame, count: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``count`` best documents of each item of ``items(item_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out, index = [], None
    for block in _blocks(items):
        n_docs, n_terms, holding = _statistics(docs, block)
        if not n_docs:
            break
        if index is None:  # the statistics are the same for all blocks
            index = materialize(sketches(docs, n_docs, n_terms), "sketch")
        block.weigh(n_docs, holding)
        sent = spark.sparkContext.broadcast(block)
        by_score = [F.desc("score"), F.asc("doc_id")]
        highest = _first(index.mapInArrow(tidy(_highest(sent, max(FIRST, count))), CANDIDATE), max(FIRST, count), [F.desc("bound"), F.asc("doc_id")])
        early = materialize(_scored(docs, highest, sent, n_terms), "search")
        threshold = np.zeros(len(block.ids), np.int64)
        for r in _first(early, count, by_score).filter(F.col("rank") == count).collect():  # one row an item of the block
            threshold[r["item"]] = r["score"]
        scored = materialize(_scored(docs, index.mapInArrow(tidy(_reaching(sent, threshold)), CANDIDATE), sent, n_terms), "search")
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id bigint")
        best = _first(scored, count, by_score).join(F.broadcast(names), "item")  # names of a block's items
        out.append(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RANKED)
