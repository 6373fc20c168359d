"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every stage but the last returns the columns of ``documents``.  In every
stage a null text counts as an empty one and stays null, rows without a doc_id
are kept and judged by their text, rows that repeat a doc_id are each judged by
their own text, further columns are carried along whatever they are called, and
an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from osmlake.llm import bpe, decontaminate, mil, simhash, substring
from osmlake.llm.runtime import materialise, shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model rejects go."""
    return mil.keep_inoffensive(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays; null and empty texts are one such group."""
    return simhash.keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that started earlier are cut out of the texts; no document goes, and n_chars follows the text."""
    return substring.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a benchmark window go, however long the rest of them is."""
    return decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_rows=True, any_window=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the bytes they decode to; other columns end here."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express a trained model, XXH64 fingerprints or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
