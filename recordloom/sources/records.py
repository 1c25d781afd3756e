"""Record, truth and corpus scans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import schemas

#: Cells that the baseline's scan takes for missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A quoted tab-separated file with header; every cell is a string, empty ones included.

    Only a quoted line feed needs a file in one task. It leaves lines with an odd number
    of quotes; a pass over the lines looks for one, and where there is none files are split.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    whole = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', multiLine=whole, encoding="UTF-8").na.fill("")


def load_source(spark: SparkSession, path: str, usecols: list[str] | None = None) -> DataFrame:
    """Records; a name that reads ``NA`` stays ``NA``."""
    records = read_tsv(spark, path, schemas.RECORD)
    return records.select(*usecols) if usecols else records


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Records as the baseline reads them: the usual missing-value words are empty."""
    records = load_source(spark, path)
    return records.select(*[blank_missing(F.col(c)).alias(c) for c in records.columns])


def blank_missing(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).isin(*MISSING), F.lit("")).otherwise(c)


def iter_source_rows(records: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time on the driver."""
    return records.toLocalIterator()


def corpus_union(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Both noisy sources, rows kept as they are."""
    return s2.unionByName(s3)


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, entity_id), one row for each id listed; ids in a list are taken as they are.

    Where a source-1 row is repeated the last of the file counts: the rows' order
    is their order of reading.
    """
    numbered = truth.withColumn("at", F.monotonically_increasing_id())
    last = numbered.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "at").alias("ids"))
    listed = last.select("source1_entity_id", F.regexp_replace(F.coalesce("ids", F.lit("")), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("ids")).where("ids <> ''")
    return listed.select("source1_entity_id", F.explode(F.split("ids", ",")).alias("entity_id")).distinct()


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_pairs(read_tsv(spark, path, schemas.GROUND_TRUTH))


def truth_of_sample(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """The truth of the sampled source-1 records only."""
    return pairs.join(sample.select(F.col("entity_id").alias("source1_entity_id")).distinct(), "source1_entity_id", "left_semi")


def count_rows(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("rows"))


def sample_s1(s1: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by id: a distributed top-n, as rows of a cluster have no file order."""
    return s1.orderBy("entity_id").limit(n)


def holdout(s1: DataFrame, share: float = 0.1) -> DataFrame:
    """``s1`` with ``is_holdout``: the same records on every run and engine, by the first digits of an MD5."""
    digits = F.conv(F.substring(F.md5("entity_id"), 1, 7), 16, 10).cast("long")
    return s1.withColumn("is_holdout", F.pmod(digits, F.lit(10_000)) < int(share * 10_000))


def dataset_paths(root: str, split: str = "train") -> dict[str, str]:
    found = {f"source{k}": f"{root}/{split}/{split}_source{k}.tsv" for k in (1, 2, 3)}
    return found | ({"ground_truth": f"{root}/{split}/{split}_ground_truth.tsv"} if split == "train" else {})
