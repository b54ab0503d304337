"""A corpus pipeline of training-data operators, run stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

In every stage a null or empty text is an ordinary text without words: it is
scored by the model's bias, is no copy of another, holds no benchmark item and no
personal data, and has no tokens.  Rows that repeat stay or go together; of rows
that share a ``doc_id`` a decision about the id holds for all.  Columns beside
those of ``documents`` are left out, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake.llm import bpe, decontam, jaccard, pii, toxicity
from rasterlake.llm.queries import table
from rasterlake.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, does not reject."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, COLUMNS)
    return scored.filter(F.col("toxic_score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked shingle sets."""
    table(spark, sf_dir, "documents")
    rule = jaccard.Rule(shingle=5, num=80, den=100)
    extra = jaccard.similar_classes(docs, rule).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(materialize(extra, "drop"), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind."""
    table(spark, sf_dir, "documents")
    return pii.redact(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the hashes of ids and decoded text."""
    table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: SQL cannot express a trained model or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, out, sf_dir)
