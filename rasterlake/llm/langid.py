"""Language identification: words first, then shorter and shorter n-grams.

Training counts the words of every labelled text (counted in each task before
the shuffle) and, from the word counts, the character n-grams of orders 5 to 1.
A word or n-gram enters the tables when its share of some language's occurrences
is at least ``word_share`` or ``gram_share``, with its own count in every
language (half of one where it has none); the tables therefore have at most
1/share rows for each language and order, whatever the size of the corpus, and may
be broadcast.

Scoring adds, for each word, the log frequency of the word in each language; a
word in no table backs off to the mean log frequency of its longest n-grams
that are in a table.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows with a null language do not train; ties go to the name that sorts first;
with nothing learned everything is ``und``; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.session import materialize

ORDERS = (5, 4, 3, 2, 1)
FLUSH_WORDS = 200_000
CACHE_WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each task's texts."""

    def out(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            words = list(c)
            for lo in range(0, len(words), 20_000):
                part = words[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([c[w] for w in part], pa.int64())],
                    names=["lang", "word", "n"],
                )

    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if len(counts[lang]) > FLUSH_WORDS:
                yield from out({lang: counts.pop(lang)})
    yield from out(counts)


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    marked = f"\x02{word}\x03"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, ord, gram, n) from word counts."""

    def out(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        cols = [pa.array([k[i] for k in keys], t) for i, t in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "ord", "gram", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for order in ORDERS:
                for g in grams(word, order):
                    counts[lang, order, g] += n
            if len(counts) > FLUSH_WORDS:
                yield out(counts)
                counts.clear()
    if counts:
        yield out(counts)


def train(docs: DataFrame, word_share: float = 2e-5, gram_share: float = 1e-4) -> dict:
    """Tables learned from ``docs(text, lang)``, all rows whose language is not null."""
    labelled = docs.filter("lang is not null and text is not null").select("text", "lang")
    counts = materialize(labelled.mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang")
    per_gram = materialize(
        counts.mapInArrow(_gram_counts, "lang string, ord int, gram string, n bigint").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")), "lang"
    )
    all_grams = counts.select("lang", F.lit(0).alias("ord"), F.col("word").alias("gram"), "n").unionByName(per_gram)
    total = all_grams.groupBy("lang", "ord").agg(F.sum("n").alias("total"))
    total = materialize(total, "lang")  # a row for each language and order
    share = F.when(F.col("ord") == 0, word_share).otherwise(gram_share)
    kept = all_grams.join(F.broadcast(total), ["lang", "ord"]).filter(F.col("n") >= share * F.col("total")).select("ord", "gram").distinct()
    # at most languages / share rows, so the broadcast has a bound
    rows = all_grams.join(F.broadcast(materialize(kept, "lang")), ["ord", "gram"], "left_semi").select("lang", "ord", "gram", "n").collect()
    totals = {(r["lang"], r["ord"]): r["total"] for r in total.collect()}
    langs = sorted({lang for lang, _ in totals})
    col = {lang: i for i, lang in enumerate(langs)}
    tables: dict[int, dict[str, list[float]]] = {o: {} for o in (0, *ORDERS)}
    none = {o: [float(np.log(0.5 / totals.get((lang, o), 1))) for lang in langs] for o in tables}
    for r in rows:
        o = r["ord"]
        tables[o].setdefault(r["gram"], list(none[o]))[col[r["lang"]]] = float(np.log(r["n"] / totals[r["lang"], o]))
    return {"langs": langs, "tables": tables}


def word_scores(word: str, model: dict) -> list[float]:
    """Log frequency of one word in each language, backing off to n-grams."""
    tables = model["tables"]
    if word in tables[0]:
        return tables[0][word]
    for order in ORDERS:
        table = tables[order]
        found = [x for x in map(table.get, grams(word, order)) if x is not None]
        if found:
            return [sum(x) / len(found) for x in zip(*found)]
    return [0.0] * len(model["langs"])


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``), ``lang_pred`` and ``score`` for every row of ``docs``.

    ``score`` is the share of the best language when the languages' mean log
    frequencies for a word, times the square root of the number of words, are
    turned into probabilities.
    """
    cols = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        langs = model["langs"]
        index: dict[str, int] = {}
        matrix = np.zeros((4096, len(langs)))
        for batch in batches:
            pred, score = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = LETTERS.findall(text.lower()) if text else []
                if not found or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                ids = list(map(index.get, found))
                if None in ids:
                    if len(index) > CACHE_WORDS:
                        index.clear()
                    fresh = [w for w in set(found) if w not in index]
                    while len(index) + len(fresh) > len(matrix):
                        matrix = np.concatenate([matrix, np.zeros_like(matrix)])
                    for w in fresh:
                        matrix[len(index)] = word_scores(w, model)
                        index[w] = len(index)
                    ids = list(map(index.__getitem__, found))
                mean = matrix[ids].mean(axis=0)
                best = int(np.argmax(mean))
                pred.append(langs[best])
                score.append(float(1 / np.exp((mean - mean[best]) * np.sqrt(len(found))).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*cols, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", lang_pred string, score double"
    return docs.select(*cols, F.col("text").alias("__text")).mapInArrow(run, schema)
