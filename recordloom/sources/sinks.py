"""Result files and the benchmark log."""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_ids(s1: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One row for each source-1 record: its id and its ids, sorted and comma-joined ('' for none)."""
    lists = pairs.groupBy("source1_entity_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("entity_id"))).alias(column))
    keys = s1.select(F.col("entity_id").alias("source1_entity_id"))
    return keys.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def matching_results(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    return grouped_ids(s1, pairs, "matched_entity_ids")


def candidate_pairs(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    return grouped_ids(s1, pairs, "candidate_entity_ids")


def write_tsv(rows: DataFrame, path: str, single_file: bool = False, order_by: str | None = "source1_entity_id") -> None:
    """Tab-separated with header, empty cells empty, sorted: many files with a header each, or one file at ``path``.

    For one file the parts are written in parallel without headers and then copied
    behind one another as streams; ``path`` appears complete or not at all.
    """
    ordered = rows.orderBy(order_by) if order_by else rows
    if not single_file:
        ordered.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", escape='"')
        return
    spark = rows.sparkSession
    parts = f"{path}-parts-{uuid.uuid4().hex}"
    ordered.write.csv(parts, sep="\t", header=False, emptyValue="", escape='"')
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    files = folder.getFileSystem(conf)
    try:
        whole = jvm.org.apache.hadoop.fs.Path(f"{parts}/_whole")
        out = _create(files, whole)
        out.write(("\t".join(rows.columns) + "\n").encode())
        for name in sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")):
            stream = files.open(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
        out.close()
        _put_in_place(files, whole, jvm.org.apache.hadoop.fs.Path(path))
    finally:
        files.delete(folder, True)


def _create(files, path):
    """A stream to a new file; without a checksum beside it, so that other programs may edit the file."""
    files.setWriteChecksum(False)
    try:
        return files.create(path, True)
    finally:
        files.setWriteChecksum(True)


def _put_in_place(files, new, path) -> None:
    files.mkdirs(path.makeQualified(files.getUri(), files.getWorkingDirectory()).getParent())
    files.delete(path, True)
    if not files.rename(new, path):
        raise OSError(f"{new} could not be renamed to {path}")


def append_bench_log(row: DataFrame, path: str) -> None:
    """One more line of a comma-separated file, which has its header once."""
    spark = row.sparkSession
    jvm = spark._jvm
    log = jvm.org.apache.hadoop.fs.Path(path)
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    text = io.StringIO()
    if files.exists(log):
        stream = files.open(log)
        text.write(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    else:
        csv.writer(text, lineterminator="\n").writerow(row.columns)
    csv.writer(text, lineterminator="\n").writerows(row.collect())
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = _create(files, new)
    out.write(text.getvalue().encode())
    out.close()
    _put_in_place(files, new, log)


def show_metrics(row: DataFrame) -> None:
    """Prints a one-row table of metrics, four decimals."""
    for name, value in (row.first() or {}).asDict().items() if row.columns else ():
        print(f"{name}: {value:.4f}" if isinstance(value, float) else f"{name}: {value}")
