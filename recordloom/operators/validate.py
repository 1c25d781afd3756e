"""Checks of result files, as findings tables: (severity, check, n, examples).

Every check is a plan over id lists (``sources.idlists.id_lists``: at,
source1_entity_id, ids, malformed, line); only its few examples reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.sources import idlists

EXAMPLES = 5
ERROR, WARNING = "error", "warning"
MATCH_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


def rows_of(lists: DataFrame) -> DataFrame:
    return lists.where(~F.col("malformed"))


def row_counts(lists: DataFrame) -> DataFrame:
    """(n_rows, n_empty, n_filled); malformed lines aren't rows."""
    empty = F.count_if(F.size("ids") == 0)
    return rows_of(lists).agg(F.count("*").alias("n_rows"), empty.alias("n_empty"), (F.count("*") - empty).alias("n_filled"))


def duplicate_rows(lists: DataFrame) -> DataFrame:
    return rows_of(lists).groupBy(F.col("source1_entity_id").alias("offender")).agg(F.count("*").alias("times")).where("times > 1").select("offender")


def repeated_in_list(lists: DataFrame) -> DataFrame:
    return rows_of(lists).where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("source1_entity_id").alias("offender")).distinct()


def listed_ids(lists: DataFrame) -> DataFrame:
    """(id, kind): each distinct id listed, as 'self', 'foreign' or 'target'; an id is of one kind."""
    kind = F.when(F.col("id").startswith("S1-"), "self").when(~(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")), "foreign").otherwise("target")
    return rows_of(lists).select(F.explode("ids").alias("id")).distinct().withColumn("kind", kind)


def of_kind(lists: DataFrame, kind: str) -> DataFrame:
    return listed_ids(lists).where(F.col("kind") == kind).select(F.col("id").alias("offender"))


def unknown_ids(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of the right prefix that are in no target file: a spillable anti-join."""
    return of_kind(lists, "target").join(targets.select(F.col("id").alias("offender")), "offender", "left_anti")


def missing_rows(lists: DataFrame, required: DataFrame) -> DataFrame:
    seen = rows_of(lists).select(F.col("source1_entity_id").alias("offender"))
    return required.select(F.col("id").alias("offender")).join(seen, "offender", "left_anti")


def extra_rows(lists: DataFrame, required: DataFrame) -> DataFrame:
    seen = rows_of(lists).select(F.col("source1_entity_id").alias("offender")).distinct()
    return seen.join(required.select(F.col("id").alias("offender")), "offender", "left_anti")


def last_lists(lists: DataFrame) -> DataFrame:
    """(source1_entity_id, id): the ids of each key's last row."""
    last = rows_of(lists).groupBy("source1_entity_id").agg(F.max_by("ids", "at").alias("ids"))
    return last.select("source1_entity_id", F.explode("ids").alias("id")).distinct()


def not_in_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    lost = last_lists(matches).join(last_lists(candidates), ["source1_entity_id", "id"], "left_anti")
    return lost.select(F.col("source1_entity_id").alias("offender")).distinct()


def malformed_lines(lists: DataFrame) -> DataFrame:
    """The lines with their numbers; each is an error of its own, so repeated ones count."""
    return lists.where("malformed").select(F.concat(F.lit("line "), F.lpad("line", 6, " "), F.lit(": "), F.col("source1_entity_id")).alias("offender"))


def summarize(offenders: dict[str, DataFrame], severity: str = ERROR) -> DataFrame:
    """One finding for each check that has offenders: their number and the first few.

    All checks are one tagged plan. The first few come from a ranking that is cut
    before the shuffle, so no list of all offenders is built.
    """
    tagged = reduce(DataFrame.unionByName, (o.select(F.lit(c).alias("check"), "offender") for c, o in offenders.items()))
    ranked = tagged.withColumn("place", F.row_number().over(W.partitionBy("check").orderBy("offender"))).where(F.col("place") <= EXAMPLES)
    top = ranked.groupBy("check").agg(F.array_sort(F.collect_list("offender")).alias("examples"))
    return tagged.groupBy("check").agg(F.count("*").alias("n")).join(top, "check").select(F.lit(severity).alias("severity"), "check", "n", "examples")


def id_list_findings(lists: DataFrame, required: DataFrame, targets: DataFrame | None, label: str) -> DataFrame:
    checks = {
        "line without a tab": malformed_lines(lists),
        "source-1 row repeated": duplicate_rows(lists),
        "id repeated in a list": repeated_in_list(lists),
        "source-1 id in a list": of_kind(lists, "self"),
        "id of neither S2- nor S3-": of_kind(lists, "foreign"),
        "required source-1 row missing": missing_rows(lists, required),
        "source-1 row not required": extra_rows(lists, required),
    }
    if targets is not None:
        checks["id in no target file"] = unknown_ids(lists, targets)
    return summarize({f"{label}: {c}": o for c, o in checks.items()})


@dataclass
class Report:
    """Findings and row counts by file; a file that can't be parsed has a finding and no counts."""

    findings: list[tuple[str, str, int, list[str]]]
    counts: dict[str, dict[str, int]]

    @property
    def passed(self) -> bool:
        return all(severity != ERROR for severity, *_ in self.findings)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    files, p = _path(spark, path)
    return files.exists(p)


def _has_mark(spark: SparkSession, path: str) -> bool:
    """Whether the file begins with a byte-order mark, which line readers drop."""
    files, p = _path(spark, path)
    parts = [f.getPath() for f in files.listStatus(p) if f.isFile() and f.getPath().getName()[0] not in "._"]
    for part in parts:  # one, or those of a folder
        stream = files.open(part)
        try:
            if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]:
                return True
        finally:
            stream.close()
    return False


def _not_utf8(spark: SparkSession, path: str) -> bool:
    """Whether any line is no UTF-8; checked on the executors."""
    return not spark.read.option("lineSep", "\n").text(path).where(~F.is_valid_utf8("value")).isEmpty()


def _parsed(spark: SparkSession, path: str, expected: list[str], label: str, findings: list) -> DataFrame | None:
    fatal = lambda check, *examples: findings.append((ERROR, f"{label}: {check}", 1, list(examples)))
    if not _exists(spark, path):
        return fatal("file not found", path)
    if _not_utf8(spark, path):
        return fatal("file is not UTF-8", path)
    head = idlists.header(spark, path)
    if head is None:
        return fatal("file is empty", path)
    if "\t" not in head and "," in head:
        return fatal("header has commas and no tab", head)
    if _has_mark(spark, path) or [c.strip().lower() for c in head.split("\t")] != expected:
        return fatal("unexpected header", head)
    return idlists.id_lists(idlists.body(spark, path))


def validate(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> Report:
    """All checks of a matching file and, where there is one, a candidate file."""
    findings: list[tuple[str, str, int, list[str]]] = []
    counts: dict[str, dict[str, int]] = {}
    source1 = f"{test_dir}/test_source1.tsv"
    if not _exists(spark, source1):
        return Report([(ERROR, "source-1 file not found", 1, [source1])], counts)
    required, targets = idlists.read_ids(spark, source1), None
    if check_ids:
        paths = [f"{test_dir}/test_source{k}.tsv" for k in (2, 3)]
        absent = [p for p in paths if not _exists(spark, p)]
        if absent:
            findings.append((WARNING, "target file not found, ids not checked for existence", len(absent), absent))
        else:
            targets = idlists.match_targets(spark, paths)
    else:
        findings.append((WARNING, "ids not checked for existence", 1, []))
    parsed = {}
    for label, path, expected in (("matches", matching, MATCH_HEADER), ("candidates", candidate, CANDIDATE_HEADER)):
        if label == "candidates" and (not path or not _exists(spark, path)):
            if path:
                findings.append((WARNING, "candidates: file not found", 1, [path]))
            continue
        lists = _parsed(spark, path, expected, label, findings)
        if lists is not None:
            parsed[label] = lists
            counts[label] = row_counts(lists).first().asDict()
            findings += [tuple(r) for r in id_list_findings(lists, required, targets, label).collect()]
    if len(parsed) == 2:
        findings += [tuple(r) for r in summarize({"matches not among the candidates": not_in_candidates(parsed["matches"], parsed["candidates"])}, WARNING).collect()]
    return Report(findings, counts)
