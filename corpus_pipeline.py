"""Corpus preparation in five stages, each on what its predecessor kept.

quality classifier -> line dedup -> SimHash near-dedup -> benchmark
decontamination -> byte-level BPE. Every stage's output is written as Parquet to
the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, decontaminate, line_dedup, quality, simhash_near
from recordloom.llm.common import new_folder, table
from recordloom.session import made_folders, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on this corpus's labels, does not reject."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines in repeated three-line windows; one left without a line goes."""
    return line_dedup.rewrite(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, five-word shingles alike to 0.8, that of the smallest doc_id."""
    return simhash_near.keep_one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of the documents left; ids are packed little-endian unsigned 32-bit integers."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("byte-level bpe", tokenize_stage),
]

#: SQL can't express a fitted classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table of ``sf_dir``.

    When a stage's output is written, what it wrote on the way and what it read goes.
    """
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        others = set(made_folders())
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, last + [p for p in made_folders() if p not in others])
        docs, last = spark.read.parquet(path), [path]
    return docs
