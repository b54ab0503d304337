"""Near-duplicates by b-bit MinHash with bands.

A document's set of shingles is hashed by ``bands * rows`` functions.  The minima
of ``rows`` functions make a band; documents that share a band are candidates.
Of each minimum the low ``bits`` bits are kept, as bit planes, so that one
``bit_count`` tells how many minima agree.  Minima that differ agree in their low
bits by chance, and the estimated similarity is corrected for that.

With 32 bands of four, a pair at the threshold of 0.8 shares none with
probability 5e-8, and its estimate falls below the floor with 1e-12; every other
step is exact.  Links are confirmed on the full sorted sets.  A band's members are
compared with one pivot, the member that meets most others, and not with each
other; ``jaccard.linked_components`` then finds the links between members of
different components.  So a band that thousands of copies share stays linear.

Edge cases: null or empty texts have empty sets, link with nothing and are
their own component; texts shorter than a shingle are one element; repeated
rows with one ``doc_id`` count as one node; rows with a null ``doc_id`` get a
null component and are not kept; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm import jaccard
from rasterlake.llm.kernels import JOIN, U64, chunks, mix, signed, tidy
from rasterlake.session import materialize, stages, tasks_for

LOSS = 1e-12


class BandRule(jaccard.Rule):
    """Shingle length and threshold, and the size of a signature: ``bands * rows`` a multiple of 64."""

    def __init__(self, shingle: int = 4, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, bits: int = 4) -> None:
        super().__init__(shingle, num, den)
        self.bands, self.rows, self.bits, self.size = bands, rows, bits, bands * rows
        self.factors = mix(np.arange(self.size, dtype=U64) + U64(0xB17)) | U64(1)
        self.longs = self.size // 64
        self.columns = [f"p{i}_{j}" for j in range(self.longs) for i in range(bits)]
        self.chance = 2.0**-bits
        self.floor = self.estimate(self._least_agreeing())

    def _least_agreeing(self) -> int:
        """Agreeing minima that a pair at the threshold has with probability 1 - ``LOSS``."""
        p = self.num / self.den + (1 - self.num / self.den) * self.chance
        total = 0.0
        for m in range(self.size + 1):
            total += math.comb(self.size, m) * p**m * (1 - p) ** (self.size - m)
            if total > LOSS:
                return m
        return self.size

    def estimate(self, agreeing):
        """Similarity from the number of agreeing minima, corrected for chance."""
        return (agreeing / self.size - self.chance) / (1 - self.chance)

    def may_link(self, x=lambda c: F.col(f"x.{c}"), y=lambda c: F.col(f"y.{c}")):
        differing = F.lit(0)
        for j in range(self.longs):
            apart = F.lit(0).cast("bigint")
            for i in range(self.bits):
                apart = apart.bitwiseOR(x(f"p{i}_{j}").bitwiseXOR(y(f"p{i}_{j}")))
            differing = differing + F.bit_count(apart)
        return self.sizes_fit(x, y, F.least(x("n"), y("n"))) & (self.estimate(self.size - differing) >= self.floor)

    def minima(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of minima for each set of ``flat``, cut at ``starts``; no set is empty."""
        out, held = np.empty((self.size, len(starts)), U64), np.empty_like(flat)
        for j, factor in enumerate(self.factors):
            np.multiply(flat, factor, out=held)
            out[j] = np.minimum.reduceat(held, starts)
        return mix(out.T)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        key = np.broadcast_to(np.arange(self.bands, dtype=U64), (len(minima), self.bands))
        for r in range(self.rows):
            key = mix(key * U64(JOIN) + minima[:, r :: self.rows])
        return key

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the minima, one column of ``columns`` for 64 of them."""
        out = np.empty((len(minima), len(self.columns)), np.int64)
        for j in range(self.longs):
            for i in range(self.bits):
                bits = (minima[:, 64 * j : 64 * (j + 1)] >> U64(i)).astype(np.uint8) & 1
                out[:, j * self.bits + i] = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)[:, 0]
        return out


def _sketches(rule: BandRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = list(jaccard.doc_sets(data, offsets, rule.shingle))
                n = np.array([len(u) for u in sets], np.int64)
                prints = np.array([jaccard.fingerprint(u) for u in sets], np.int64).reshape(len(sets), 2)
                # a set that no larger one links with needs no bands: equal sets are found by fingerprint
                some = np.flatnonzero(n * rule.den >= rule.num * (n + 1))
                planes = np.zeros((len(sets), len(rule.columns)), np.int64)
                count = np.zeros(len(sets), np.int64)
                keys = np.zeros(0, U64)
                if len(some):
                    minima = rule.minima(np.concatenate([sets[i] for i in some]), np.cumsum(n[some]) - n[some])
                    planes[some], count[some] = rule.planes(minima), rule.bands
                    keys = rule.band_keys(minima).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(signed(keys)))
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists, *(pa.array(np.ascontiguousarray(planes[:, j])) for j in range(len(rule.columns)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "f1", "f2", "bands", *rule.columns])

    return run


def _band_pairs(own: DataFrame) -> DataFrame:
    """``pivot, id, several`` of the documents that share a band.

    ``several`` tells whether some band of both has a further member.  The pivot
    is the member whose bands hold most documents, as an original's do.
    """
    keys = materialize(own.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc")).distinct(), "minhash")
    sizes = keys.groupBy("key").agg(F.count("*").alias("s")).filter("s > 1")
    met = materialize(keys.join(sizes, "key"), "minhash")
    weights = met.groupBy("doc").agg(F.sum("s").alias("w"))
    met = materialize(met.join(weights, "doc"), "minhash")
    tops = met.groupBy("key").agg(F.max(F.struct("w", -F.col("doc"))).alias("top")).select("key", (-F.col("top.col2")).alias("pivot"))
    pairs = met.join(tops, "key").filter("doc <> pivot")
    return pairs.groupBy("pivot", F.col("doc").alias("id")).agg(F.max(F.col("s") > 2).alias("several"))


def near_duplicates(docs: DataFrame, rule: BandRule | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    rule = rule or BandRule()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>" + "".join(f", {c} bigint" for c in rule.columns)
    with stages() as made:
        found = materialize(docs.mapInArrow(tidy(_sketches(rule)), schema), "minhash")
        sets = made.keep(materialize(found.select("doc_id", "n_shingles", "f1", "f2"), "minhash"))

        # equal sets: their smallest document stands for them
        alike = ["n_shingles", "f1", "f2"]
        equal = sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c")
        equal = materialize(equal, "minhash")
        copies = materialize(sets.join(equal, alike).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "minhash")
        own = found.filter("doc_id is not null").join(equal, alike, "left").filter("rep is null or rep = doc_id").drop("rep")
        own = materialize(own, "minhash")
        made.release(found)

        with stages() as inner:
            pairs = materialize(_band_pairs(own), "minhash")
            pairs = inner.keep(materialize(pairs, "minhash", tasks_for(docs.sparkSession, pairs.count())))
        arrays = jaccard.set_arrays(docs, pairs, rule, [])
        brief = materialize(own.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *rule.columns), "minhash")
        made.release(own)
        labels = made.keep(jaccard.linked_components(pairs, brief, arrays, copies, rule, made))
    component = F.coalesce("component", "doc_id")
    out = sets.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
