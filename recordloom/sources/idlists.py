"""Raw scans of id-list files, for validation: no CSV quoting, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLANK = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, file, value): lines and their order, CR LF and CR read as LF; the first line of each file is its header.

    ``path`` is a file or a folder of part files.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    parts = text.select(
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r$", ""), "\r")).alias("k", "value")
    )
    return parts.select(F.struct("at", "k").alias("at"), "file", "value")


def header(spark: SparkSession, path: str) -> str | None:
    """The first line; None for an empty file."""
    first = lines(spark, path).orderBy("at").limit(1).collect()
    return first[0]["value"] if first else None


def body(spark: SparkSession, path: str) -> DataFrame:
    """(at, value, line): all lines but each file's first, with their number in the file, the header's being 1.

    Numbers come from the number of lines of the file's earlier splits, so lines are not moved.
    """
    every = lines(spark, path).withColumn("split", F.shiftrightunsigned("at.at", 33))
    splits = every.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("before"), F.min("from").over(W.partitionBy("file")).alias("first"))
    numbered = every.join(splits, ["file", "split"]).where(F.col("at") != F.col("first"))
    # a split's lines are numbered by their place, which carriage returns alone can move on
    place = F.col("at.at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("at.k") + 1
    return numbered.select("at", "value", (F.col("before") + place).alias("line"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct first columns, trimmed; blank lines are skipped and the header is dropped."""
    ids = body(spark, path).select(F.regexp_replace(F.split_part("value", F.lit("\t"), F.lit(1)), _BLANK, "").alias("id"), "value")
    return ids.where(F.regexp_replace("value", _BLANK, "") != "").select("id").distinct()


def match_targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The ids of all files together."""
    found = read_ids(spark, paths[0])
    for p in paths[1:]:
        found = found.union(read_ids(spark, p))
    return found.distinct()


def id_lists(rows: DataFrame) -> DataFrame:
    """(at, source1_entity_id, ids, malformed, line) of the lines of ``rows`` (at, value, line); a line without a tab is malformed and its own key.

    A line is cut at its first tab and its list at commas; neither ids nor keys are
    trimmed, and a list of blanks only is empty. Blank lines without a tab are skipped.
    """
    tab = F.instr("value", "\t")
    rest = F.substring(F.col("value"), tab + 1, F.length("value"))
    ids = F.when(F.regexp_replace(rest, _BLANK, "") != "", F.split(rest, ",", -1)).otherwise(F.array().cast("array<string>"))
    used = rows.where((tab > 0) | (F.regexp_replace("value", _BLANK, "") != ""))
    return used.select(
        "at",
        F.when(tab > 0, F.substring(F.col("value"), F.lit(1), tab - 1)).otherwise(F.col("value")).alias("source1_entity_id"),
        F.when(tab > 0, ids).alias("ids"),
        (tab == 0).alias("malformed"),
        "line",
    )
