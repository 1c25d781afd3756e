"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontaminate, fingerprints, licenses, line_dedup, oracles, quality, sentence_dedup, simhash, substring_dedup, token_files
from recordloom.llm.common import new_folder, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", licenses.document_path(F.col("doc_id"), F.col("source")).alias("path"))
    return licenses.scan(files).drop("path")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit, items = decontaminate.n_hit(F.col("hits")), decontaminate.items_of(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_with_next(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def _kept(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_units", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(sentence_dedup.dedup_sentences(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_simhash": op6_simhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sentence_dedup": op8_sentence_dedup,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES: dict[str, str] = {"op1_license_scan": oracles.OP1, "op2_substring_dedup": oracles.OP2, "op3_decontaminate": oracles.OP3, "op8_sentence_dedup": oracles.OP8, "op10_line_dedup": oracles.OP10}
