"""The corpus pipeline: five stages over the documents, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A driver may run them one by one, writing each result and reading it again, or
all at once by ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import gru, mixing, ngram_join, piece_lattice, suffix_dedup
from skyloom.llm.common import cut, plain_names, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. The model is fitted on the labelled
    documents of the source table, so it is the same whatever came before this stage."""
    model = gru.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain = plain_names(docs, ("doc_id", "text"))
    others = tuple(c for c in plain.columns if c != "doc_id")
    return gru.score(plain, model, keep=others).filter("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return ngram_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return piece_lattice.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("mix_to_target_weights", mix),
    ("sentencepiece", encode),
]

#: No stage but the mix can be written as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
