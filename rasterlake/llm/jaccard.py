"""Jaccard self-join of word-shingle sets over size-banded tiles.

A set's size puts it in a band; sets that link lie in the same band or in
neighbouring ones, so a set takes part in the tiles of its own band and of the
next.  Two sets that link within a band of largest size U differ in at most
H = 2U(1-t)/(1+t) elements.  The hash range is cut into H + 1 + c parts; then
c + 1 parts at least hold the same elements in both sets, and a tile is the
band, the part and the signature of the part's elements.  Parts without elements
do not count; a set with more than c of them (c is about twice their expected
number) is cut again with another seed, which keeps the guarantee, as its
partner is cut again too or was found before.  No link is lost, and only sets
that share a whole part meet.

A tile's sets are compared with one pivot, the member that meets most others: by
hashed bitmaps first, whose differing bits bound the overlap from above, then by
exact differences of the sorted arrays.  Members of one tile
whose components still differ can link only if they differ from the pivot in
common elements, more than half of the smaller difference; pairs that may are
found by their rarest such elements, and tested by the bitmaps and then by exact
intersection of the arrays.  So the edited copies of one text meet its original, not each other.

Edge cases: null or empty texts have empty sets, link with nothing and are
their own component; texts shorter than a shingle are one element; repeated
rows with one ``doc_id`` count as one node; rows with a null ``doc_id`` get a
null component; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.llm import idfilter
from rasterlake.llm.kernels import LOWER, U64, chunks, mix, signed, tidy, window_hashes, word_hashes, words
from rasterlake.operators.graph import connected_components
from rasterlake.session import Stages, materialize, stages, tasks_for

BITMAP_WORDS = 16
#: Keys of a task that meet at once, and rows made from them at a time.
FLUSH_KEYS, FLUSH_ROWS = 1_000_000, 1 << 16
SHARES = 4
BITMAP = [f"w{i}" for i in range(BITMAP_WORDS)]


class Rule:
    """Shingle length and the threshold as a fraction of whole numbers."""

    def __init__(self, shingle: int = 4, num: int = 85, den: int = 100) -> None:
        self.shingle, self.num, self.den = shingle, num, den
        limit = 1
        while self.differ(limit + 1) == 0 and limit < 1 << 20:
            limit += 1
        # twice the share of parts that the smallest sets of a tile leave empty
        t, share = num / den, 0.0
        for _ in range(50):
            share = 2 * math.exp(-t * t * (1 + t) / (2 * (1 - t)) / (1 + share)) if t < 1 else 0.0
        self.share = share
        self.limits = [limit]
        while limit < 1 << 40:
            limit = max(limit + 1, limit * den // num)
            self.limits.append(limit)

    def differ(self, size: int) -> int:
        """Most elements in which two linked sets of at most ``size`` differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    #: Columns of a set's signature.
    columns = BITMAP

    def may_link(self, x=lambda c: F.col(f"x.{c}"), y=lambda c: F.col(f"y.{c}")):
        """Whether two sets may link by their sizes and signatures, columns ``n, w*`` that ``x`` and ``y`` give."""
        differing = sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in BITMAP), F.lit(0))
        return self.sizes_fit(x, y, F.least(x("n"), y("n"), (x("n") + y("n")) / 2 - differing / 2))

    def sizes_fit(self, x, y, overlap):
        """Whether an overlap from above is enough for two sets' sizes."""
        return overlap * (self.den + self.num) >= self.num * (x("n") + y("n"))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact test of two sorted arrays of distinct values."""
        need = -(-self.num * (len(a) + len(b)) // (self.den + self.num))
        if min(len(a), len(b)) < need:
            return False
        return len(np.intersect1d(a, b, assume_unique=True)) >= need


def doc_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    h = word_hashes(data, starts, ends)
    g = window_hashes(h, k)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(g[lo : hi - k + 1])
        else:
            yield window_hashes(h[lo:hi], hi - lo) if hi > lo else g[:0]


def fingerprint(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(u + U64(11)).sum().view(np.int64)), int(mix(u ^ U64(0xA5A5)).sum().view(np.int64))


@lru_cache(maxsize=4096)
def _cuts(parts: int, band: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.array([(i << 64) // parts for i in range(1, parts)], U64)
    salt = mix(np.arange(parts, dtype=U64) + U64(band << 40) + U64(level << 34))
    return edges, salt


def tile_keys(u: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of all tiles that a set belongs to."""
    out, band = [], bisect_left(rule.limits, len(u))
    for b in (band, band + 1):
        if rule.differ(rule.limits[b]) == 0:
            continue  # only equal sets link there; these are found by fingerprint
        if b > band and len(u) * rule.den < rule.num * (rule.limits[band] + 1):
            continue  # too small for any set of the next band
        spare = 1 + int(rule.differ(rule.limits[b]) * rule.share)
        parts, level, v = rule.differ(rule.limits[b]) + 1 + spare, 0, u
        while True:
            edges, salt = _cuts(parts, b, level)
            at = np.concatenate([[0], np.searchsorted(v, edges), [len(v)]])
            sums = np.zeros(len(v) + 1, U64)
            np.cumsum(mix(v + U64(23)), out=sums[1:])
            full = at[1:] > at[:-1]
            out.append(mix((sums[at[1:]] - sums[at[:-1]])[full] ^ salt[full]))
            if (~full).sum() <= spare:
                break
            level += 1
            v = np.sort(mix(u ^ U64(level * 0x9E3779B97F4A7C15 % 2**64)))
    return np.concatenate(out) if out else u[:0]


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                for u in doc_sets(data, offsets, rule.shingle):
                    n.append(len(u))
                    f = fingerprint(u)
                    one.append(f[0])
                    two.append(f[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "n_shingles", "f1", "f2"])

    return run


def _keys(rule: Rule):
    """(key, doc, pivot, pop): pivot null for rows to meet by key, else a pair of one tile found here.

    Of a tile's members found here the pivot is the one whose keys meet most
    others (``pop`` of them), as an original's do among its copies.
    """

    def flush(keys: list[np.ndarray], docs: list[int]) -> Iterator[pa.RecordBatch]:
        at = np.repeat(np.arange(len(docs), dtype=np.int32), [len(k) for k in keys])
        key = np.concatenate(keys)
        keys.clear()
        order = np.argsort(key)
        key, at = key[order], at[order]
        del order
        first = np.append(True, key[1:] != key[:-1])
        key, tile, size = key[first], np.cumsum(first, dtype=np.int64) - 1, np.diff(np.append(np.flatnonzero(first), len(at)))
        pop = np.bincount(at[(size > 1)[tile]], minlength=len(docs)).astype(np.int32)
        # one number for a tile and the place of a member in it: most met first, then by document
        doc = np.array(docs, np.int64)
        best = np.lexsort((doc, -pop))
        place = np.empty_like(best)
        place[best] = np.arange(len(best))
        tile *= len(docs)
        tile += place[at]
        tile.sort()
        for lo in range(0, len(tile), FLUSH_ROWS):
            t, who = np.divmod(tile[lo : lo + FLUSH_ROWS], len(docs))
            # a tile's members stand together, so its pivot stands where its first row does
            head = np.searchsorted(tile, t * len(docs))
            pivot, who, top = doc[best[tile[head] % len(docs)]], best[who], head == np.arange(lo, lo + len(t))
            keep = top | (doc[who] != pivot)
            t, who, pivot, top = t[keep], who[keep], pivot[keep], top[keep]
            cols = [pa.array(signed(key[t])), pa.array(doc[who]), pa.array(pivot, mask=top), pa.array(pop[who], mask=~top)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "pivot", "pop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held, seen = [], [], 0, set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, offsets in chunks(batch.column(1)):
                for i, u in enumerate(doc_sets(data, offsets, rule.shingle)):
                    f = fingerprint(u)
                    if ids[lo + i] is None or not len(u) or f in seen:
                        continue
                    seen.add(f)
                    k = tile_keys(u, rule)
                    if len(k):
                        keys.append(k)
                        docs.append(ids[lo + i])
                        held += len(k)
                    if held >= FLUSH_KEYS:
                        yield from flush(keys, docs)
                        keys, docs, held, seen = [], [], 0, set()
        if held:
            yield from flush(keys, docs)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, most met first, become pairs with the first document of their key; pairs of a task stay (``own``)."""
    last_key, last_doc = None, None
    for batch in batches:
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        own = np.asarray(batch.column(2).is_valid())
        pivot = batch.column(2).fill_null(0).to_numpy().copy()
        at = np.flatnonzero(~own)
        if len(at):
            k, d = key[at], doc[at]
            first = np.append(last_key is None or k[0] != last_key, k[1:] != k[:-1])
            head = np.where(first, np.arange(len(at)), -1)
            head = np.maximum.accumulate(head)
            pivot[at] = np.where(head >= 0, d[head], last_doc or 0)
            last_key, last_doc = k[-1], pivot[at[-1]]
        keep = pivot != doc
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(pivot[keep]), pa.array(doc[keep]), pa.array(own[keep])], names=["key", "pivot", "doc", "own"])


def bitmap(u: np.ndarray) -> np.ndarray:
    """Signature of a set: one hashed bit for each element."""
    bits = np.zeros(BITMAP_WORDS * 64, bool)
    bits[(mix(u + U64(41)) % U64(BITMAP_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _arrays(rule: Rule, wanted, columns: list[str]):
    """``id, n, arr`` of the wanted documents, with their bitmaps if ``columns`` names these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(idfilter.mask(packed, batch.column(0))))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = list(doc_sets(data, offsets, rule.shingle))
                maps = np.array([bitmap(u) for u in sets]).reshape(len(sets), BITMAP_WORDS) if columns else None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary()), *(pa.array(maps[:, j]) for j in range(len(columns)))],
                    names=["id", "n", "arr", *columns],
                )

    return run


def set_arrays(docs: DataFrame, pairs: DataFrame, rule: Rule, columns: list[str]) -> DataFrame:
    """The sorted sets of all documents of ``pairs(pivot, id)``, as a stage table."""
    ids = idfilter.build(pairs.select("pivot").union(pairs.select("id")))
    schema = "id bigint, n bigint, arr binary" + "".join(f", {w} bigint" for w in columns)
    return materialize(docs.mapInArrow(tidy(_arrays(rule, ids, columns)), schema), "jaccard")


def _verify(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = np.fromiter((rule.linked(np.frombuffer(a.as_py(), U64), np.frombuffer(b.as_py(), U64)) for a, b in zip(x, y)), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])

    return run


def _listed(ids):
    """Rows whose first column may be in a bit set of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(idfilter.mask(ids.value, batch.column(0))))

    return run


def _side(table: DataFrame, columns: list[str], ids) -> DataFrame:
    table = table.select(*columns)
    return table.mapInArrow(tidy(_listed(ids)), table.schema)


def _linked_pairs(pairs: DataFrame, brief: DataFrame, arrays: DataFrame, rule: Rule) -> DataFrame:
    """``a, b`` of the pairs that link: signatures first, then exact intersection."""
    ids = idfilter.build(pairs.select("a").union(pairs.select("b")))
    side = _side(brief, ["id", "n", *rule.columns], ids)
    both = pairs.join(side.alias("x"), F.col("a") == F.col("x.id")).join(side.alias("y"), F.col("b") == F.col("y.id"))
    both = materialize(both.filter(rule.may_link()).select("a", "b"), "jaccard")
    side = _side(arrays, ["id", "arr"], idfilter.build(both.select("a").union(both.select("b"))))
    sent = both.join(side.alias("x"), F.col("a") == F.col("x.id")).join(side.alias("y"), F.col("b") == F.col("y.id"))
    sent = sent.select("a", "b", F.col("x.arr").alias("p"), F.col("y.arr").alias("q"))
    return sent.mapInArrow(tidy(_verify(rule)), "a bigint, b bigint, ok boolean").filter("ok").select("a", "b").distinct()


def _bounds_of(rule: Rule, n, pn, d, least, whole):
    """Of a set that differs from its pivot in ``d`` elements: how many of these a partner of another component must share.

    The first number holds for a set that does not link with the pivot, the second for one that does;
    neither is below the third, as no partner is farther than the sizes allow.  ``least`` and ``whole``
    are the larger of two numbers and division rounded down, of columns or of integers.
    """
    den, num = rule.den + rule.num, rule.den - rule.num
    far = -whole(num * (n + pn) - den * d, 2 * den)
    near = least(1, whole(den * d + num * (pn - n), 2 * den) + 1)
    return far, near, d - whole(n * num, rule.num)


def _needed(rule: Rule, n: int, pn: int, lost: int, gained: int) -> int:
    """So many of the elements that a set alone holds, in order, are enough to tell whether others share them."""
    d = lost + gained
    far, near, size = _bounds_of(rule, n, pn, d, max, lambda a, b: a // b)
    return min(gained, max(0, d - max(min(far, near), size) + pn * (rule.den - rule.num) // rule.num + 1))


def _differences(rule: Rule):
    """(pivot, id, several, sizes, how many elements only the pivot and only the other set holds, and the first of the latter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first = [], []
            for several, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                gained = np.setdiff1d(q, p, assume_unique=True)
                lost = len(p) - (len(q) - len(gained))
                rows.append((len(p), len(q), lost, len(gained)))
                first.append(signed(gained[: _needed(rule, len(q), len(p), lost, len(gained)) if several else 0]))
            sizes = np.array(rows, np.int64).reshape(len(rows), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(sizes[:, j]) for j in range(4)), pa.array(first, pa.list_(pa.int64()))], names=["pivot", "id", "several", "pn", "n", "lost", "gained", "first"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, id, the elements that one of both sets holds)."""
    for batch in batches:
        both = [signed(np.setxor1d(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.list_(pa.int64()))], names=["pivot", "id", "e"])


def _with_sets(pairs: DataFrame, arrays: DataFrame, columns: list[str]) -> DataFrame:
    """``pivot, id, columns`` with both sorted arrays, ``p`` and ``q``."""
    side = _side(arrays, ["id", "arr"], idfilter.build(pairs.select("id").union(pairs.select("pivot"))))
    x, y = side.withColumnRenamed("id", "x").alias("x"), side.withColumnRenamed("id", "y").alias("y")
    sent = pairs.join(x, F.col("id") == F.col("x.x")).join(y, F.col("pivot") == F.col("y.y"))
    return sent.select("pivot", "id", *columns, F.col("y.arr").alias("p"), F.col("x.arr").alias("q"))


def _pairs(met: DataFrame) -> DataFrame:
    """``pivot, id, several``: every member of a tile with the pivot that all tasks have in common.

    ``several`` tells whether one of their tiles has a further member: without
    one, only the pivot itself may link with the member there.
    """
    tiles = met.groupBy("key").agg(F.max(F.when(~F.col("own"), F.col("pivot"))).alias("top"), F.count("*").alias("n"))
    members = met.select("key", "pivot", "doc").join(tiles, "key").select(F.coalesce("top", "pivot").alias("pivot"), F.col("doc").alias("id"), (F.col("n") > 1).alias("several"))
    return members.filter("pivot <> id").groupBy("pivot", "id").agg(F.max("several").alias("several"))


def _compared(pairs: DataFrame, brief: DataFrame, arrays: DataFrame, rule: Rule, made: Stages) -> list[DataFrame]:
    """``pivot, id, several, pn, n, lost, gained, first`` of the pairs that matter: those that may link by their signatures, and those with several members."""
    x, y = brief.withColumnRenamed("id", "x").alias("x"), brief.withColumnRenamed("id", "y").alias("y")
    both = pairs.join(x, F.col("id") == F.col("x.x")).join(y, F.col("pivot") == F.col("y.y"))
    wanted = materialize(both.filter(F.col("several") | rule.may_link()).select("pivot", "id", "several"), "jaccard")
    made.release(pairs)
    done = []
    for r in range(SHARES):  # a share of the pivots at a time, so that only its arrays are on the way at once
        share = wanted.filter(F.pmod(F.xxhash64("pivot"), F.lit(SHARES)) == r)
        sent = _with_sets(share, arrays, ["several"])
        done.append(materialize(sent.mapInArrow(tidy(_differences(rule)), "pivot bigint, id bigint, several boolean, pn bigint, n bigint, lost bigint, gained bigint, first array<bigint>"), "jaccard"))
    made.release(wanted)
    return done


def _across(stars: DataFrame, labels: DataFrame, arrays: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: all pairs of one star and different components that may link.

    Of two sets that differ from the pivot in d(a) and d(b) elements, and link
    though one of them does not link with the pivot, at least ``k`` of these
    elements are the same (sizes and distances bound k from below for each set
    by itself), and at least ``k`` less the lost ones are gained.  A set with too
    few gained elements that another component's set gained as well leaves first:
    that is what a copy's own edits look like.  For that the first elements in one
    order are enough, so many that a linked pair has ``enough`` of them in common (all
    that it must have in common, if these are fewer).  Of the others, both hold a common element among their first ``shared - k + 1``,
    rarest first, where ``shared`` counts those of another component's sets.
    """
    den, num = rule.den + rule.num, rule.den - rule.num

    def label(of: str) -> DataFrame:
        return labels.select(F.col("node").alias(of), F.col("component").alias(f"c_{of}"))

    star = stars.filter("several").select("pivot", "id", "pn", "n", "lost", (F.col("lost") + F.col("gained")).alias("d"))
    star = star.join(label("id"), "id", "left").join(label("pivot"), "pivot", "left")
    star = star.withColumn("c", F.coalesce("c_id", "id")).withColumn("far", F.col("c") != F.coalesce("c_pivot", "pivot")).drop("c_id", "c_pivot")
    star = materialize(star, "jaccard")
    several = star.groupBy("pivot").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("pivot")
    # a far set's partner may equal the pivot, any other set's partner is a far one
    whole = lambda a, b: F.floor(a / b)
    at_far, at_near, by_size = _bounds_of(rule, F.col("n"), F.col("pn"), F.col("d"), lambda a, b: F.greatest(F.lit(a), b), whole)
    k = F.greatest(F.when(F.col("far"), at_far).otherwise(at_near), by_size)
    part = star.withColumn("k", k).filter("k <= d").join(several, "pivot", "left_semi").withColumn("enough", F.floor(F.col("pn") * num / rule.num) + 1)
    take = F.greatest(F.lit(0), F.col("d") - F.col("k") + F.col("enough")).cast("int")  # of the gained: d - lost, less k - lost, and enough
    part = materialize(part.select("pivot", "id", "c", "n", "d", "lost", "k", "enough", take.alias("take")), "jaccard")

    def rows_of(members: DataFrame, table: DataFrame, e) -> DataFrame:
        return materialize(table.join(members, ["pivot", "id"]).select("pivot", "id", "c", F.explode(e).alias("e")), "jaccard")

    def held_apart(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("pivot", "e").agg(F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("pivot", "e", "df")
        return rows.select("pivot", "e", "id").join(materialize(held, "jaccard"), ["pivot", "e"])

    also = []
    for r in range(SHARES):  # their elements are many, so a share of the pivots at a time
        mine = F.pmod(F.xxhash64("pivot"), F.lit(SHARES)) == r
        with stages() as own:
            rows = rows_of(part.filter(mine), stars.filter(mine).select("pivot", "id", "first"), F.slice("first", F.lit(1), F.col("take")))
            also.append(own.keep(materialize(held_apart(rows).groupBy("pivot", "id").agg(F.count("*").alias("also")), "jaccard")))
    gained = reduce(DataFrame.unionByName, also)
    left = lambda p: materialize(p.filter("k <= d").filter(F.col("also") >= F.least(F.col("k") - F.col("lost"), F.col("enough"))), "jaccard")
    part = left(part.drop("take").join(gained, ["pivot", "id"], "left").fillna(0, ["also"]))
    for _ in range(2):
        # who has left is nobody's partner: the others' distances raise k
        of = part.groupBy("pivot").agg(F.min("d").alias("least"), F.max("n").alias("most"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
        k = F.ceil((den * (F.col("d") + F.col("least")) - num * (F.col("n") + F.col("most"))) / (2 * den))
        part = left(part.join(of.select("pivot", "least", "most"), "pivot").withColumn("k", F.greatest("k", k)).drop("least", "most"))
    part = part.select("pivot", "id", "c", "n", "d", "k")
    sets = _with_sets(part.select("pivot", "id"), arrays, []).mapInArrow(tidy(_elements), "pivot bigint, id bigint, e array<bigint>")
    common = materialize(held_apart(rows_of(part, sets.withColumnRenamed("e", "all"), F.col("all"))), "jaccard")
    own = Window.partitionBy("pivot", "id")
    first = common.join(part, ["pivot", "id"]).withColumn("shared", F.count("*").over(own)).filter("shared >= k")
    first = first.withColumn("r", F.row_number().over(own.orderBy("df", "e"))).filter("r <= shared - k + 1").select("pivot", "e", "id", "c", "n", "d", "shared")
    first = materialize(first, "jaccard")
    x, y = first.alias("x"), first.alias("y")
    fits = F.expr(f"{den} * (x.d + y.d - 2 * least(x.shared, y.shared)) <= {num} * (x.n + y.n)")
    meet = [F.col("x.pivot") == F.col("y.pivot"), F.col("x.e") == F.col("y.e"), F.col("x.id") < F.col("y.id"), F.col("x.c") != F.col("y.c"), fits]
    return x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def linked_components(pairs: DataFrame, brief: DataFrame, arrays: DataFrame, copies: DataFrame, rule: Rule, made: Stages) -> DataFrame:
    """``node, component`` of the documents that link: ``copies(a, b)``, and all that a tile or band of ``pairs`` holds.

    ``pairs``, ``brief`` and ``arrays`` are stage tables of ``made`` and are released.
    """
    parts = _compared(pairs, brief, arrays, rule, made)
    stars = reduce(DataFrame.unionByName, parts)
    near = stars.filter((F.col("lost") + F.col("gained")) * (rule.den + rule.num) <= (F.col("n") + F.col("pn")) * (rule.den - rule.num))
    with stages() as own:
        links = materialize(near.select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(copies), "jaccard")
        labels = own.keep(materialize(connected_components(links, "a", "b"), "jaccard"))
    with stages() as own:  # pairs of one star in different components
        more = own.keep(materialize(_across(stars, labels, arrays, rule), "jaccard"))
    made.release(*parts)
    fresh = materialize(_linked_pairs(more, brief, arrays, rule), "jaccard")
    made.release(more, brief, arrays)
    if not fresh.isEmpty():
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialize(connected_components(known.unionByName(fresh), "a", "b"), "jaccard")
    return labels


def similar_classes(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    rule = rule or Rule()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with stages() as made:
        sets = made.keep(materialize(docs.mapInArrow(tidy(_sets(rule)), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint"), "jaccard"))

        # equal sets: their smallest document stands for them
        equal = materialize(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "jaccard")
        copies = sets.join(equal, ["n_shingles", "f1", "f2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

        # pairs of each member of a tile with its pivot
        keys = docs.mapInArrow(tidy(_keys(rule)), "key bigint, doc bigint, pivot bigint, pop int")
        route = F.when(F.col("pivot").isNull(), F.col("key")).otherwise(F.xxhash64("key", "doc"))
        met = keys.repartition(route).sortWithinPartitions("key", F.desc("pop"), "doc").mapInArrow(tidy(_stars), "key bigint, pivot bigint, doc bigint, own boolean")
        met = materialize(met, "jaccard")
        pairs = materialize(_pairs(met), "jaccard", tasks_for(docs.sparkSession, 2 * met.count()))
        made.release(met)
        arrays = set_arrays(docs, pairs, rule, BITMAP)
        brief = materialize(arrays.select("id", "n", *BITMAP), "jaccard")
        labels = made.keep(linked_components(pairs, brief, arrays, copies, rule, made))
    return sets.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
