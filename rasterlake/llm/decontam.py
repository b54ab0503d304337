"""Benchmark passages in documents, up to a small edit distance of words.

Texts are compared by words: letters and digits of any script, case-folded by the
full Unicode rules; each character of a script that is written without spaces is
a word of its own.  Words of benchmark items form a vocabulary of symbols.

An edit breaks at most two word pairs, so a stretch of a document can hold an item
only if enough of its word pairs are pairs of items; the other stretches are left
at once, and no leak is lost by that.  Windows of an item's size that begin at a
known pair of what remains go through CGK random walks: a walk copies symbols and
steps on by random bits that depend on the step and the symbol, over the whole
item, which turns a small edit distance into a small Hamming distance.  Hash
tables sample a few coordinates of several walks.  Items of similar length share
their tables, whose number follows from the stated ``recall``: copies of the items
with as many random edits as are allowed are walked, and walks are added until
that share of the copies meets its item.  An item is entered from each word that
may be the first without an edit.  Each hit names an item-sized window, whose
smallest edit distance to the item is then computed exactly.

The items are a stated query set: they are counted, and cut into blocks of at most
``BLOCK_WORDS`` words.  One block at a time is built, broadcast, searched for (the
rows found are written to the shared folder) and released; documents are not
shuffled.

Edge cases: null and empty texts hold nothing; items that are null or shorter
than ``min_words`` words are not searched for, as they are common phrases;
repeated items with one ``item_id`` give one row with the smallest distance; of
equal distances the earliest end counts; repeated documents give repeated rows;
empty tables give an empty table; further columns are ignored (``clean`` keeps
them).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.kernels import ALNUM, U64, chunks, mix, tidy, window_hashes, word_hashes, words
from rasterlake.session import materialize

BLOCK_WORDS = 100_000
TABLES, SAMPLE, MAX_WALKS, COPIES = 8, 4, 512, 300
#: Standard errors by which the copies met must exceed the recall, as they also decide when to stop.
MARGIN = 1.0
CHUNK, FOLD = 1 << 19, 1024
#: Rows whose texts are held as strings at a time.
ROWS = 256
PRE_BITS = 20
SCHEMA = "doc_id bigint, item_id bigint, distance int, similarity double, start_word int, end_word int"
#: What is no letter, digit or ASCII character.
OTHER = re.compile(r"[^\x00-\x7f\w]+")
#: Scripts written without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
SOLID = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Case-folded text whose words are runs of ASCII letters, digits and non-ASCII characters."""
    if not text or text.isascii():
        return (text or "").lower()
    text = OTHER.sub(" ", unicodedata.normalize("NFC", text).casefold())
    return SOLID.sub(r" \g<0> ", text) if SOLID.search(text) else text


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to a part of ``text``, and that part's end."""
    row, step = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, x in enumerate(item):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != x))
        row = np.minimum.accumulate(best - step) + step
    end = int(np.argmin(row))
    return int(row[end]), end


def errors(n: int, similarity: float) -> int:
    """Edits that an item of ``n`` words may have."""
    return int((1 - similarity) * n + 1e-9)


class Walk:
    """One random walk over strings of at least ``least`` symbols, and tables of sampled coordinates."""

    def __init__(self, number: int, least: int) -> None:
        rng = np.random.default_rng([number, least])
        steps = 2 * least  # half of the steps move on, so a walk covers an item
        self.bits = rng.integers(0, 2, (steps, FOLD), np.intp).astype(np.int8)  # each task holds every walk
        self.samples = [np.sort(rng.choice(steps, min(SAMPLE, steps), replace=False)) for _ in range(TABLES)]
        self.at: dict[int, list[int]] = {}
        for t, sample in enumerate(self.samples):
            for j in sample.tolist():
                self.at.setdefault(j, []).append(t)

    def keys(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each table and start the key of the sampled coordinates, and whether all lie before ``end``."""
        padded, at = np.append(sym, np.zeros(len(self.bits), np.int64)), start.astype(np.intp)
        low = padded % FOLD
        key, inside = np.zeros((TABLES, len(start)), U64), np.ones((TABLES, len(start)), bool)
        for j in range(max(self.at) + 1):
            for t in self.at.get(j, ()):
                key[t] = mix(key[t] + padded[at].astype(U64) + U64(j + 1))
                inside[t] &= at < end
            at += self.bits[j][low[at]]
        return key, inside


class LengthClass:
    """Items of similar length and the tables of enough walks."""

    def __init__(self, members: list[int], symbols: list[np.ndarray], similarity: float, recall: float) -> None:
        size = [len(symbols[k]) for k in members]
        least = min(size)
        first = [errors(n, similarity) + 1 for n in size]  # the first word without an edit is one of these
        flat = np.concatenate([symbols[k] for k in members])
        ends = np.cumsum(size)
        self.owner = np.repeat(np.array(members), first)
        self.offset = np.concatenate([np.arange(n) for n in first])
        start = np.repeat(ends - size, first) + self.offset
        end = np.repeat(ends, first)
        # copies with all the edits that are allowed, of items spread over the class
        rng = np.random.default_rng(least)
        copies, of = [], []
        for k in rng.choice(members, COPIES):
            copy = symbols[k].tolist()
            for _ in range(errors(len(copy), similarity)):
                i = int(rng.integers(len(copy)))
                copy[i : i + 1] = ([0], [], [copy[i], 0])[int(rng.integers(3))]
            copies.append(np.array(copy, np.int64))
            of.append(k)
        text = np.concatenate(copies)
        stop = np.cumsum([len(c) for c in copies])
        row = np.repeat(np.arange(len(copies)), [len(c) for c in copies])
        met = np.zeros(len(copies), bool)
        self.walks: list[tuple[Walk, list[tuple[np.ndarray, np.ndarray]]]] = []
        while met.mean() - MARGIN * (met.mean() * (1 - met.mean()) / len(met)) ** 0.5 < recall:
            if len(self.walks) == MAX_WALKS:
                raise ValueError(f"{MAX_WALKS} walks meet {met.mean():.3f} of the copies of items of {least} words or more; recall {recall} is not reached")
            walk = Walk(len(self.walks), least)
            key, inside = walk.keys(flat, start, end)
            tables = []
            for t in range(TABLES):
                entry = np.flatnonzero(inside[t])
                order = entry[np.argsort(key[t][entry], kind="stable")]
                tables.append((key[t][order], order))
            self.walks.append((walk, tables))
            for begin, entry in self.lookup(len(self.walks) - 1, text, np.arange(len(text)), stop[row]):
                same = self.owner[entry] == np.array(of)[row[begin]]
                met[row[begin][same]] = True
        self.reached = float(met.mean())

    def lookup(self, number: int, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of a start, index of an entry) that meet in a table of one walk."""
        walk, tables = self.walks[number]
        key, inside = walk.keys(sym, start, end)
        for t, (keys, order) in enumerate(tables):
            lo, hi = np.searchsorted(keys, key[t], "left"), np.searchsorted(keys, key[t], "right")
            some = np.flatnonzero((hi > lo) & inside[t])
            n = hi[some] - lo[some]
            at = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(some, n), order[at]


class Matcher:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float, recall: float) -> None:
        self.items, self.similarity = items, similarity
        self.vocab = np.unique(np.concatenate([h for _, h in items]))
        self.pre = np.zeros(1 << PRE_BITS, bool)
        self.pre[(self.vocab & U64((1 << PRE_BITS) - 1)).astype(np.int64)] = True
        self.symbols = [self.symbol(h) for _, h in items]
        self.pairs = np.unique(np.concatenate([window_hashes(h, 2) for _, h in items]))
        self.pre_pairs = np.zeros(1 << PRE_BITS, bool)
        self.pre_pairs[(self.pairs & U64((1 << PRE_BITS) - 1)).astype(np.int64)] = True
        size = sorted({len(h) for _, h in items})
        self.stretches, self.classes, lo = [], [], 0
        for k, n in enumerate(size):  # (words looked at, word pairs that must be known)
            if k + 1 == len(size) or size[k + 1] > 1.25 * size[lo]:
                need = min(m - 1 - 2 * errors(m, similarity) for m in size[lo : k + 1])
                self.stretches.append((n + errors(n, similarity), max(1, need)))
                members = [i for i, (_, h) in enumerate(items) if size[lo] <= len(h) <= n]
                self.classes.append(LengthClass(members, self.symbols, similarity, recall))
                lo = k + 1

    def symbol(self, h: np.ndarray) -> np.ndarray:
        """1 and up for known words, 0 for others."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.pre[(h & U64((1 << PRE_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
        out[maybe] = np.where(self.vocab[at] == h[maybe], at + 1, 0)
        return out

    def starts(self, h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """For each class, words that begin a known pair in a stretch that may hold one of its items."""
        n = len(h)
        g = window_hashes(h, 2)
        known = np.zeros(n, bool)
        maybe = np.flatnonzero(self.pre_pairs[(g & U64((1 << PRE_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.pairs, g[maybe]), len(self.pairs) - 1)
        known[maybe] = self.pairs[at] == g[maybe]
        known[bounds[1:][np.diff(bounds) > 0] - 1] = False  # a pair may not cross into the next row
        total = np.zeros(n + 1, np.int32)
        np.cumsum(known, out=total[1:])
        begin = np.flatnonzero(known)
        end = np.repeat(bounds[1:], np.diff(bounds))[begin]
        out = []
        for size, need in self.stretches:
            stop = np.minimum(begin + size, end)
            ok = np.flatnonzero(total[stop] - total[begin] >= need)
            # stretches that go on: known pairs inside one of them
            last = np.searchsorted(begin, stop[ok])
            change = np.zeros(len(begin) + 1, np.int32)
            np.add.at(change, ok, 1)
            np.add.at(change, last, -1)
            out.append(begin[np.cumsum(change[:-1]) > 0])
        return out

    def hits(self, sym: np.ndarray, starts: list[np.ndarray], bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, end) for walks from each class's ``starts`` in a chunk's symbols."""
        found = [np.zeros((0, 3), np.int64)]
        for c, start in zip(self.classes, starts):
            if not len(start):
                continue
            row = np.searchsorted(bounds, start, "right") - 1
            end = bounds[row + 1]
            for number in range(len(c.walks)):
                for at, entry in c.lookup(number, sym, start, end):
                    found.append(np.unique(np.stack([row[at], c.owner[entry], (start[at] - c.offset[entry]) >> 2], 1), axis=0))
        last = (-1, -1, 0)
        for r, k, quarter in np.unique(np.concatenate(found), axis=0).tolist():
            item, begin = self.symbols[k], quarter * 4
            most = errors(len(item), self.similarity)
            if (r, k) == last[:2] and begin - last[2] <= max(4, most // 2):
                continue  # the window tried before covers this one
            last = (r, k, begin)
            lo, hi = max(bounds[r], begin - most - 4), min(bounds[r + 1], begin + len(item) + 2 * most + 8)
            distance, stop = infix_distance(item, sym[lo:hi])
            if distance <= most:
                _, length = infix_distance(item[::-1], sym[lo : lo + stop][::-1])
                yield r, k, distance, int(lo + stop - length - bounds[r]), int(lo + stop - bounds[r])


def _words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds of each row's words) of chunks of a text column."""
    plain = pa.concat_arrays([pa.array(map(normal, column.slice(i, ROWS).to_pylist()), pa.large_string()) for i in range(0, len(column), ROWS)] or [pa.array([], pa.large_string())])
    for lo, _, data, offsets in chunks(plain, CHUNK):
        starts, ends, at = words(data, offsets, ALNUM)
        yield lo, word_hashes(data, starts, ends), at


def _matchers(items: DataFrame, min_words: int, similarity: float, recall: float) -> Iterator[Matcher]:
    """Matchers of all items, one block of bounded size after the other."""
    size = F.length("text")
    rows = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = rows.agg(F.sum(size)).first()[0] or 0
    blocks = 1 + chars // (4 * BLOCK_WORDS)
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        kept = []
        for lo, h, at in _words_of(pa.array([r["text"] for r in got], pa.string())):
            kept += [(got[lo + i]["item_id"], h[a:z]) for i, (a, z) in enumerate(zip(at[:-1], at[1:])) if z - a >= min_words]
        if kept:
            yield Matcher(kept, similarity, recall)


def _search(matcher: Matcher, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, end) for each row of a text column."""
    for lo, h, at in _words_of(column):
        some = matcher.starts(h, at)
        if any(map(len, some)):
            for r, *hit in matcher.hits(matcher.symbol(h), some, at):
                yield lo + r, *hit


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, min_words: int = 5, recall: float = 0.97) -> DataFrame:
    """A row for each document and item that it holds with word similarity of at least ``similarity``.

    ``distance`` is the edit distance in words, ``similarity`` 1 - distance /
    item length, and the words ``start_word`` to ``end_word`` (exclusive) the place.
    ``recall`` is the share of copies with the most edits allowed that are to be
    met; copies with fewer edits are met more often.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for matcher in _matchers(items, min_words, similarity, recall):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for batch in batches:
                ids, best = batch.column(0), {}
                for row, k, distance, start, end in _search(matcher, batch.column(1)):
                    key = (row, matcher.items[k][0])
                    value = (distance, end, start, len(matcher.items[k][1]))
                    best[key] = min(best.get(key, value), value)
                rows = sorted(best.items())
                cols = [ids.take(pa.array([r for (r, _), _ in rows], pa.int64()))]
                cols += [pa.array([i for (_, i), _ in rows], pa.int64()), pa.array([v[0] for _, v in rows], pa.int32())]
                cols += [pa.array([1 - v[0] / v[3] for _, v in rows], pa.float64()), pa.array([v[2] for _, v in rows], pa.int32()), pa.array([v[1] for _, v in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "similarity", "start_word", "end_word"])

        out = out.unionByName(materialize(docs.mapInArrow(tidy(run), SCHEMA), "leaks"))
        sent.destroy()
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, min_words: int = 5, recall: float = 0.97) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    at, sent = docs.columns.index("text"), None
    for matcher in _matchers(items, min_words, similarity, recall):
        if sent is not None:  # what the block before has left is written, and that block released
            docs = materialize(docs, "leaks")
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in _search(sent.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
