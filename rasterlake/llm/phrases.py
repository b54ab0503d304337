"""Phrase collocations, found by best-first growth of prefixes.

Counts of words, then of pairs whose words are frequent, are taken over all
documents.  A prefix that occurs ``c`` times and begins with a word that occurs
``F`` times bounds the score of every phrase that grows from it by
``floor(2000000 c / (F + c))``, as no such phrase is more frequent than its
prefix.  A language's best known phrases give a first threshold; prefixes whose
bound reaches it are grown to three and four words, and so are the phrases to
the left of those that reach it, as they may absorb them.  When too few phrases
survive, the threshold falls and the frontier grows; it stops when every language
has enough survivors at or above its threshold, or nothing is left to grow.

A longer phrase absorbs one that it holds; as the counts between the two lie
between theirs, only phrases with one word more need to be looked at.

Words are identified within their language by 64-bit hashes and phrases by the
hashes of their words.  The count of words sees most words that share a hash and
then begins again with another salt.  Broadcast bit sets have one fixed size and
only let phrases through that need not be counted.

Edge cases: null and empty texts have no words; a null ``lang`` is ``und``; rows
that repeat count each time; a language without candidates gives no rows, nor does
an empty table; words and texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.llm import idfilter
from rasterlake.llm.kernels import JOIN, LOWER, U64, chunks, mix, signed, tidy, word_hashes, words
from rasterlake.session import materialize

SEPARATORS = np.zeros(256, bool)
SEPARATORS[list(b".,;:!?\n\x0b\x0c\r")] = True
IN_WORD = ~SEPARATORS
IN_WORD[[0x20, 0x09]] = False
LONGEST = 4
FLUSH = 2_000_000
FLUSH_WORDS = 300_000
ROWS = 20_000


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\x00", np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _tokens(batch: pa.RecordBatch, salt: int) -> Iterator[tuple]:
    """Hashes of the words with their language, pieces and rows, and the bytes with the words' ends, of ``lang, text``."""
    langs = batch.column(0).to_pylist()
    own = {lang: _lang_hash(lang) for lang in set(langs)}
    for lo, hi, data, offsets in chunks(batch.column(1)):
        data = LOWER[data]
        starts, ends, at = words(data, offsets, IN_WORD)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        of = np.array([own[lang] for lang in langs[lo:hi]], U64)
        h = mix((word_hashes(data, starts, ends) ^ of[row]) + U64(salt))
        piece = np.cumsum(SEPARATORS[data])[starts] + row if len(starts) else row
        yield h, piece, lo + row, data, starts, ends


def _words(salt: int):
    """``x, lang, word, n`` of the words of a task."""

    def rows(held: list[np.ndarray], seen: dict[int, tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(h), ROWS):
            text = [seen[x] for x in h[lo : lo + ROWS].tolist()]
            cols = [pa.array(signed(h[lo : lo + ROWS])), pa.array([t[0] for t in text]), pa.array([t[1] for t in text], pa.binary()).cast(pa.string()), pa.array(n[lo : lo + ROWS])]
            yield pa.RecordBatch.from_arrays(cols, names=["x", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], {}, 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for h, _, row, data, starts, ends in _tokens(batch, salt):
                held.append(h)
                size += len(h)
                some, first = np.unique(h, return_index=True)
                for x, i in zip(some.tolist(), first.tolist()):
                    if x not in seen:
                        seen[x] = langs[row[i]], data[starts[i] : ends[i]].tobytes()
                if size >= FLUSH or len(seen) >= FLUSH_WORDS:
                    yield from rows(held, seen)
                    held, seen, size = [], {}, 0
        if size:
            yield from rows(held, seen)

    return run


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of a phrase from those of its words."""
    out = columns[0]
    for c in columns[1:]:
        out = mix(out * U64(JOIN) + c)
    return out


def _names(k: int) -> list[str]:
    return [f"x{i + 1}" for i in range(k)]


def _bits(phrases: DataFrame, columns: list[str]) -> Broadcast:
    """The bit set of the keys of some columns of a phrase table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(_key([c.to_numpy().view(U64) for c in batch.columns])))], names=["key"])

    return idfilter.build(phrases.select(*columns).mapInArrow(run, "key bigint"))


def _in(bits: Broadcast, key: np.ndarray) -> np.ndarray:
    return idfilter.mask(bits.value, pa.array(signed(key)))


def _phrases(k: int, salt: int, parts: Broadcast, prefixes: Broadcast | None, suffixes: Broadcast | None, whole: Broadcast | None):
    """``x1..xk, n`` of the phrases of a task whose parts are frequent and that are asked for.

    Parts are words for pairs, and pairs for longer phrases, as all frequent pairs are
    known but only those triples that were asked for.
    """
    part = min(k - 1, 2)

    def rows(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(_key(columns))
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.append(True, reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))))
        n = np.diff(np.append(first, len(order)))
        columns = [signed(c[first]) for c in columns]
        for lo in range(0, len(n), ROWS):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[lo : lo + ROWS]) for c in columns), pa.array(n[lo : lo + ROWS])], names=[*_names(k), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h, piece, *_ in _tokens(batch, salt):
                if len(h) < k:
                    continue
                known, n = _in(parts, _key([h[i : len(h) - part + 1 + i] for i in range(part)])), len(h) - k + 1
                at = np.flatnonzero(reduce(np.logical_and, (known[i : n + i] for i in range(k - part + 1))) & (piece[k - 1 :] == piece[:n]))
                asked = np.zeros(len(at), bool)
                if whole is not None:
                    asked |= _in(whole, _key([h[at + i] for i in range(k)]))
                if prefixes is not None:
                    asked |= _in(prefixes, _key([h[at + i] for i in range(k - 1)]))
                if suffixes is not None:
                    asked |= _in(suffixes, _key([h[at + i] for i in range(1, k)]))
                at = at if whole is prefixes is suffixes is None else at[asked]
                held.append([h[at + i] for i in range(k)])
                size += len(at)
                if size >= FLUSH:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)

    return run


def _counted(docs: DataFrame, k: int, salt: int, least: int, parts: Broadcast, prefixes: Broadcast | None = None, suffixes: Broadcast | None = None, whole: Broadcast | None = None) -> DataFrame:
    """``x1..xk, a``: the frequent phrases of ``k`` words."""
    rows = docs.mapInArrow(tidy(_phrases(k, salt, parts, prefixes, suffixes, whole)), ", ".join(f"{x} bigint" for x in _names(k)) + ", n bigint")
    return materialize(rows.groupBy(*_names(k)).agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "phrases")


def _score(a, of) -> F.Column:
    """``floor(2000000 a / of)`` in whole numbers of any size that counts can take."""
    wide = lambda c: F.col(c) if isinstance(c, str) else c
    product = wide(a).cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    return F.call_function("div", product, wide(of).cast("decimal(20,0)"))


def _with_scores(phrases: DataFrame, k: int, tables: dict[int, DataFrame]) -> DataFrame:
    """Phrases of ``k`` words with ``lang``, ``bound``, and the cut (``l, r, score``) that scores lowest, earlier ones first."""
    x, out = _names(k), phrases
    for j in range(1, k):
        left = tables[j].select(*(F.col(c).alias(x[i]) for i, c in enumerate(_names(j))), F.col("a").alias(f"l{j}"), *(["lang"] if j == 1 else []))
        right = tables[k - j].select(*(F.col(c).alias(x[j + i]) for i, c in enumerate(_names(k - j))), F.col("a").alias(f"r{j}"))
        out = out.join(left, x[:j]).join(right, x[j:])
    cuts = F.array(*(F.struct(_score("a", F.col(f"l{j}") + F.col(f"r{j}")).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)))
    cut = F.array_min(cuts) if k > 2 else cuts[0]
    bound = _score("a", F.col("l1") + F.col("a")).alias("bound")
    return out.select("lang", *x, "a", bound, cut.alias("cut")).select("lang", *x, "a", "bound", "cut.l", "cut.r", "cut.score")


def _threshold(known: DataFrame, want: int) -> DataFrame:
    """``lang, t``: the score of the ``want``-th best phrase of each language, 0 where there are fewer.

    Equal scores are counted before they meet; a language has 1,000,001 scores at most.
    """
    sizes = known.groupBy("lang", "score").agg(F.count("*").alias("c"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    ranked = sizes.withColumn("so_far", F.sum("c").over(down))
    return ranked.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("so_far") >= want, F.col("score"))), F.lit(0).cast("bigint")).alias("t"))


def _reaching(phrases: DataFrame, limits: DataFrame, column: str = "score") -> DataFrame:
    return phrases.join(limits, "lang").filter(F.col(column) >= F.col("t")).drop("t")


def _survivors(scored: dict[int, DataFrame], tables: dict[int, DataFrame], limits: DataFrame, share: int) -> DataFrame:
    """The phrases at or above their language's threshold that no longer one absorbs, as ``lang, x1..x4, a, l, r, score``."""
    out = []
    for k, phrases in scored.items():
        x, kept = _names(k), _reaching(phrases, limits)
        if k < LONGEST:
            y = _names(k + 1)
            longer = [tables[k + 1].select(*(F.col(c).alias(x[i]) for i, c in enumerate(part)), F.col("a").alias("m")) for part in (y[:-1], y[1:])]
            longer = longer[0].unionByName(longer[1]).groupBy(*x).agg(F.max("m").alias("m"))
            kept = kept.join(longer, x, "left").filter(F.col("m").isNull() | (100 * F.col("m").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)"))).drop("m")
        none = [F.lit(None).cast("bigint").alias(c) for c in _names(LONGEST)[k:]]
        out.append(kept.select("lang", *x, *none, "a", "l", "r", "score"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, count: int = 2000, least: int = 30, share: int = 80, ahead: int = 3) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of ``docs(lang, text)``.

    Phrases occur ``least`` times or more; one that a longer candidate holds
    with ``share`` per cent of its count or more is left out.  The first frontier
    is that of each language's ``ahead * count`` best pairs; the result does not depend on it.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    salt = 0
    while True:
        found = docs.mapInArrow(tidy(_words(salt)), "x bigint, lang string, word string, n bigint")
        found = materialize(found.groupBy("x", "lang", "word").agg(F.sum("n").alias("a")), "phrases")
        if found.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
            break
        salt += 1
    totals = found.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = materialize(found.filter(F.col("a") >= least).select(F.col("x").alias("x1"), "lang", "word", "a"), "phrases")
    tables = {1: vocabulary}
    tables[2] = _counted(docs, 2, salt, least, _bits(vocabulary, ["x1"]))
    scored = {2: materialize(_with_scores(tables[2], 2, tables), "phrases")}
    pairs = _bits(tables[2], _names(2))

    want, limits = ahead * count, None
    while True:
        known = reduce(DataFrame.unionByName, (s.select("lang", "score") for s in scored.values()))
        fresh = _threshold(known, want)
        if limits is not None:  # settled languages stay
            fresh = fresh.join(open_langs, "lang", "left_semi").unionByName(limits.join(open_langs, "lang", "left_anti"))
        limits = materialize(fresh, "phrases", 1)
        for k in (3, 4):
            below = scored[k - 1]
            asked = _bits(_reaching(below, limits, "bound"), _names(k - 1)), _bits(_reaching(below, limits), _names(k - 1))
            new = _counted(docs, k, salt, least, pairs, *asked)
            if k == 4:  # what is left of a phrase's first word may not have been counted
                y, x = _names(4), _names(3)
                tails = new.select(*(F.col(c).alias(x[i]) for i, c in enumerate(y[1:]))).distinct().join(tables[3], x, "left_anti")
                tails = materialize(tails, "phrases")
                if not tails.isEmpty():
                    more = _counted(docs, 3, salt, least, pairs, whole=_bits(tails, x))
                    tables[3] = materialize(tables[3].unionByName(more).distinct(), "phrases")
            tables[k] = new if k not in tables else materialize(tables[k].unionByName(new).distinct(), "phrases")
            scored[k] = materialize(_with_scores(tables[k], k, tables), "phrases")
        best = materialize(_survivors(scored, tables, limits, share), "phrases")
        enough = best.groupBy("lang").agg(F.count("*").alias("c")).filter(F.col("c") >= count)
        open_langs = materialize(limits.filter("t > 0").join(enough, "lang", "left_anti").select("lang"), "phrases", 1)
        if open_langs.isEmpty():
            break
        want *= 4

    for i, c in enumerate(_names(LONGEST)):
        best = best.join(vocabulary.select(F.col("x1").alias(c), F.col("word").alias(f"w{i + 1}")), c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"w{i + 1}" for i in range(LONGEST))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= count)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= count)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
