"""python -m recordloom.cli baseline | block | benchmark | validate"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.functions.text import prepare
from recordloom.operators import metrics
from recordloom.operators.blocking import BASELINE, BLOCKERS, block, get_blocker
from recordloom.operators.validate import validate
from recordloom.session import session
from recordloom.sources import records, sinks


def baseline(spark: SparkSession, test_dir: str, out: str) -> None:
    """Exact matches of the ASCII name or address: reads the three test files, writes the matching file."""
    s1, s2, s3 = (records.load_baseline(spark, f"{test_dir}/test_source{k}.tsv") for k in (1, 2, 3))
    sinks.write_tsv(sinks.matching_results(s1, block(s1, records.corpus_union(s2, s3), BASELINE)), out, single_file=True)


def block_files(spark: SparkSession, test_dir: str, out: str, method: str) -> None:
    """The candidate file of any blocker."""
    s1, s2, s3 = (records.load_source(spark, f"{test_dir}/test_source{k}.tsv") for k in (1, 2, 3))
    sinks.write_tsv(sinks.candidate_pairs(s1, block(s1, records.corpus_union(s2, s3), method)), out, single_file=True)


def benchmark(spark: SparkSession, root: str, method: str, sample_size: int = 10_000, out: str = "experiments/results.csv") -> DataFrame:
    """Recall and sizes of a blocker's candidates for the first training records; appends a row to the log.

    The corpus is cached and counted as read, which is loading, and as prepared, which
    stands for building an index.
    """
    paths = records.dataset_paths(root)
    blocker = get_blocker(method)
    s1 = records.sample_s1(records.load_source(spark, paths["source1"]), sample_size)
    truth = records.truth_of_sample(records.load_ground_truth(spark, paths["ground_truth"]), s1)
    loading = time.time()
    loaded = records.corpus_union(records.load_source(spark, paths["source2"]), records.load_source(spark, paths["source3"])).cache()
    loaded.count()
    corpus = prepare(loaded).cache()
    began = time.time()
    corpus.count()
    indexed = time.time()
    pairs = blocker.candidates(prepare(s1), corpus).cache()
    n = pairs.count()
    queried = time.time()
    found = metrics.blocking_metrics(s1, pairs, truth)
    row = found.select(
        F.lit(method).alias("method"),
        F.lit(sample_size).alias("sample_size"),
        *[F.col(c).cast("double").alias(c) for c in schemas.METRICS],
        F.lit(indexed - began).alias("index_time"),
        F.lit(queried - indexed).alias("query_time"),
    )
    sinks.append_bench_log(row, out)
    sinks.show_metrics(row)
    print(f"load_time: {began - loading:.2f}, queries_per_second: {s1.count() / max(queried - indexed, 1e-9):.1f}, pairs: {n}")
    corpus.unpersist()
    loaded.unpersist()
    pairs.unpersist()
    return row


def check(spark: SparkSession, matching: str, candidate: str, test_dir: str, check_ids: bool) -> int:
    """Prints the report; 0 if no error was found."""
    report = validate(spark, matching, candidate, test_dir, check_ids)
    for label, counts in report.counts.items():
        print(f"{label}: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
    for severity, what, n, examples in report.findings:
        print(f"{severity}: {what} ({n})" + (f": {', '.join(map(str, examples))}" + (" ..." if n > len(examples) else "") if examples else ""))
    print("passed" if report.passed else "failed")
    return int(not report.passed)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recordloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("baseline", "block"):
        p = sub.add_parser(name)
        p.add_argument("--test-dir", "-t", default="dataset/test")
        p.add_argument("--out", default=f"output/{'matching_results' if name == 'baseline' else 'candidate_pairs'}.tsv")
        if name == "block":
            p.add_argument("--method", default="hybrid", choices=list(BLOCKERS))
    p = sub.add_parser("benchmark")
    p.add_argument("--root", default="dataset")
    p.add_argument("--method", required=True, choices=list(BLOCKERS))
    p.add_argument("--sample-size", type=int, default=10_000)
    p.add_argument("--out", default="experiments/results.csv")
    p = sub.add_parser("validate")
    p.add_argument("--matching", "-m", default="output/matching_results.tsv")
    p.add_argument("--candidate", "-c", default="output/candidate_pairs.tsv")
    p.add_argument("--test-dir", "-t", default="dataset/test")
    p.add_argument("--check-ids", action="store_true")
    a = parser.parse_args(argv)
    spark = session()
    if a.command == "baseline":
        baseline(spark, a.test_dir, a.out)
    elif a.command == "block":
        block_files(spark, a.test_dir, a.out, a.method)
    elif a.command == "benchmark":
        benchmark(spark, a.root, a.method, a.sample_size, a.out)
    else:
        return check(spark, a.matching, a.candidate, a.test_dir, a.check_ids)
    return 0


if __name__ == "__main__":
    sys.exit(main())
