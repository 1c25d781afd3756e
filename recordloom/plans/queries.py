"""The registered queries of the linkage engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import features, text
from recordloom.operators import blocking, matching, metrics, validate
from recordloom.plans import fixtures as fx
from recordloom.session import new_folder
from recordloom.sources import records, sinks
from recordloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Thresholds of the sweep, and the size of the sample.
THRESHOLDS = [0.2, 0.4, 0.6, 0.8, 1.0]
SAMPLE = 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _all(spark: SparkSession, d: str) -> DataFrame:
    return fx.s1(spark, d).unionByName(fx.corpus(spark, d))


def _joined(c: Column) -> Column:
    return F.concat_ws(",", c)


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


def _scalar(name: str, make: Callable[[], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _all(spark, d).select("entity_id", make().alias("value"))

    QUERIES[name] = run


_scalar("clean_string", lambda: text.clean_string(F.col("business_name")))
_scalar("normalize_name", lambda: text.normalize_name(F.col("business_name")))
_scalar("normalize_name_stripped", lambda: text.normalize_name_stripped(F.col("business_name")))
_scalar("normalize_address", lambda: text.normalize_address(F.col("business_address")))
_scalar("normalize_ascii", lambda: text.normalize_ascii(F.col("business_name")))
_scalar("normalize_country", lambda: text.normalize_country(F.col("country")))
_scalar("name_address_key", lambda: text.build_name_address_key(F.col("business_name"), F.col("business_address")))
_scalar("tokenize", lambda: _joined(text.tokenize(text.normalize_name(F.col("business_address")))))
_scalar("extract_numbers", lambda: _joined(text.extract_numbers(F.col("business_address"))))


# --- sources ----------------------------------------------------------------


@query
def scan_records(spark: SparkSession, d: str) -> DataFrame:
    return fx.s1(spark, d).select("entity_id", "business_name", "business_address", "country")


@query
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    return records.corpus_union(fx.s2(spark, d), fx.s3(spark, d))


@query
def ground_truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return records.truth_pairs(fx.truth(spark, d))


@query
def sample_s1(spark: SparkSession, d: str) -> DataFrame:
    return records.sample_s1(fx.s1(spark, d), SAMPLE)


@query
def ground_truth_sample(spark: SparkSession, d: str) -> DataFrame:
    return records.truth_of_sample(ground_truth_pairs(spark, d), sample_s1(spark, d))


@query
def count_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.count_rows(fx.corpus(spark, d))


@query
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return records.holdout(fx.s1(spark, d)).select("entity_id", "is_holdout")


# --- blocking ---------------------------------------------------------------


def candidates(spark: SparkSession, d: str, blocker: str | blocking.Blocker) -> DataFrame:
    return blocking.block(fx.s1(spark, d), fx.corpus(spark, d), blocker)


def _blocked(key: str, blocker: str | blocking.Blocker) -> None:
    QUERIES[key] = lambda spark, d: candidates(spark, d, blocker)


_blocked("block_exact_name", "exact_name")
_blocked("block_exact_address", "exact_address")
_blocked("block_exact_name_global", "exact_name_global")
_blocked("block_exact_address_global", "exact_address_global")
_blocked("block_stripped_name", "stripped_name")
_blocked("block_name_address", "name_address")
_blocked("block_hybrid", "hybrid")
_blocked("block_token_name", "token_name")
_blocked("block_token_address", "token_address")
_blocked("block_token_global", "token_global")
#: With a bound that the fixture reaches, so that the fallback to the rarest token runs.
_blocked("block_token_name_bounded", blocking.TokenBlocker(min_overlap=3, max_df=20))
_blocked("baseline_matches", "baseline")


@query
def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return blocking.token_document_frequency(text.prepare(fx.corpus(spark, d)), "name_tokens")


@query
def stream_exact_name(spark: SparkSession, d: str) -> DataFrame:
    """Source-1 records that arrive as a stream, against the standing corpus; all that has arrived is worked off."""
    folder, s1 = new_folder(spark, "stream"), fx.s1(spark, d)
    s1.write.parquet(f"{folder}/in")
    pairs = incremental.link_stream(spark.readStream.schema(s1.schema).parquet(f"{folder}/in"), fx.corpus(spark, d))
    run = pairs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{folder}/out")


# --- output and metrics -----------------------------------------------------


@query
def matching_results(spark: SparkSession, d: str) -> DataFrame:
    return sinks.matching_results(fx.s1(spark, d), candidates(spark, d, "exact_name"))


@query
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.candidate_pairs(fx.s1(spark, d), candidates(spark, d, "hybrid"))


@query
def baseline_results(spark: SparkSession, d: str) -> DataFrame:
    return sinks.matching_results(fx.s1(spark, d), candidates(spark, d, "baseline"))


@query
def f05_per_entity(spark: SparkSession, d: str) -> DataFrame:
    scores = metrics.f05_per_entity(fx.s1(spark, d), candidates(spark, d, "hybrid"), ground_truth_pairs(spark, d))
    return scores.select("source1_entity_id", _r("f05").alias("f05"))


@query
def f05_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.f05_macro(fx.s1(spark, d), candidates(spark, d, "hybrid"), ground_truth_pairs(spark, d)).select(_r("f05_macro").alias("f05_macro"))


@query
def blocking_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.blocking_metrics(fx.s1(spark, d), candidates(spark, d, "hybrid"), ground_truth_pairs(spark, d))
    return found.select(*[_r(c).alias(c) for c in found.columns])


@query
def reduction_ratio(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.reduction_ratio(fx.s1(spark, d), fx.corpus(spark, d), candidates(spark, d, "hybrid"))
    return found.select("pairs", _r("reduction_ratio").alias("reduction_ratio"))


@query
def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return metrics.false_positives(candidates(spark, d, "hybrid"), ground_truth_pairs(spark, d))


@query
def false_negatives(spark: SparkSession, d: str) -> DataFrame:
    return metrics.false_negatives(candidates(spark, d, "hybrid"), ground_truth_pairs(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s1, corpus = text.prepare(fx.s1(spark, d)), text.prepare(fx.corpus(spark, d))
    pairs = blocking.get_blocker("hybrid").candidates(s1, corpus)
    return _with_tokens(pairs, s1, corpus).select("source1_entity_id", "entity_id", _r(features.jaccard(F.col("a"), F.col("b"))).alias("score"))


def _with_tokens(pairs: DataFrame, s1: DataFrame, corpus: DataFrame) -> DataFrame:
    a = s1.select(F.col("entity_id").alias("source1_entity_id"), F.col("name_tokens").alias("a"), F.col("name_key").alias("na"))
    b = corpus.select("entity_id", F.col("name_tokens").alias("b"), F.col("name_key").alias("nb"))
    return pairs.join(a, "source1_entity_id").join(b, "entity_id")


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.threshold_sweep(fx.s1(spark, d), _scored(spark, d), ground_truth_pairs(spark, d), THRESHOLDS)
    return found.select("threshold", _r("f05_macro").alias("f05_macro"))


@query
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(threshold_sweep(spark, d))


# --- features ---------------------------------------------------------------


@query
def feature_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumnRenamed("score", "jaccard")


@query
def feature_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    s1, corpus = text.prepare(fx.s1(spark, d)), text.prepare(fx.corpus(spark, d))
    pairs = _with_tokens(blocking.get_blocker("hybrid").candidates(s1, corpus), s1, corpus)
    return pairs.select("source1_entity_id", "entity_id", _r(features.levenshtein_similarity(F.col("na"), F.col("nb"))).alias("levenshtein"))


@query
def feature_indel_ratio(spark: SparkSession, d: str) -> DataFrame:
    s1, corpus = text.prepare(fx.s1(spark, d)), text.prepare(fx.corpus(spark, d))
    pairs = _with_tokens(blocking.get_blocker("hybrid").candidates(s1, corpus), s1, corpus)
    return pairs.select("source1_entity_id", "entity_id", _r(features.indel_ratio(F.col("na"), F.col("nb"))).alias("ratio"))


@query
def feature_tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    s1, corpus = text.prepare(fx.s1(spark, d)), text.prepare(fx.corpus(spark, d))
    pairs = blocking.get_blocker("hybrid").candidates(s1, corpus)
    every = s1.unionByName(corpus)
    left, right = (features.tfidf_vectors(every, "entity_id", "name_tokens", pairs.select(F.col(c).alias("id"))) for c in ("source1_entity_id", "entity_id"))
    return features.tfidf_cosine(pairs, left, right).withColumn("tfidf_cosine", _r("tfidf_cosine"))


@query
def feature_shared_numbers(spark: SparkSession, d: str) -> DataFrame:
    numbers = lambda df, name, key: df.select(F.col("entity_id").alias(key), text.extract_numbers(F.col("business_address")).alias(name))
    pairs = candidates(spark, d, "hybrid")
    both = pairs.join(numbers(fx.s1(spark, d), "a", "source1_entity_id"), "source1_entity_id").join(numbers(fx.corpus(spark, d), "b", "entity_id"), "entity_id")
    return both.select("source1_entity_id", "entity_id", features.shared_numbers(F.col("a"), F.col("b")).alias("shared"))


@query
def feature_same_country(spark: SparkSession, d: str) -> DataFrame:
    side = lambda df, name, key: df.select(F.col("entity_id").alias(key), text.normalize_country(F.col("country")).alias(name))
    both = candidates(spark, d, "exact_name_global").join(side(fx.s1(spark, d), "a", "source1_entity_id"), "source1_entity_id").join(side(fx.corpus(spark, d), "b", "entity_id"), "entity_id")
    return both.select("source1_entity_id", "entity_id", features.same_country(F.col("a"), F.col("b")).alias("same"))


@query
def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matches of held-out records by a classifier and a threshold that the other records gave."""
    s1, corpus, truth = records.holdout(fx.s1(spark, d)), fx.corpus(spark, d), ground_truth_pairs(spark, d)
    return matching.match_holdout(s1, corpus, candidates(spark, d, "hybrid"), truth, THRESHOLDS)


# --- validation -------------------------------------------------------------


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.damaged(sinks.matching_results(fx.s1(spark, d), ground_truth_pairs(spark, d)))
    ids = F.when(F.trim("matched_entity_ids") != "", F.split("matched_entity_ids", ",")).otherwise(F.array().cast("array<string>"))
    return rows.select(F.monotonically_increasing_id().alias("at"), "source1_entity_id", ids.alias("ids"), F.lit(False).alias("malformed"), F.lit(0).alias("line"))


def _required(spark: SparkSession, d: str) -> DataFrame:
    return fx.s1(spark, d).select(F.col("entity_id").alias("id")).distinct()


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return fx.corpus(spark, d).select(F.col("entity_id").alias("id")).distinct()


@query
def validate_missing(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_rows(_damaged(spark, d), _required(spark, d))


@query
def validate_extra(spark: SparkSession, d: str) -> DataFrame:
    return validate.extra_rows(_damaged(spark, d), _required(spark, d))


@query
def validate_unknown(spark: SparkSession, d: str) -> DataFrame:
    return validate.unknown_ids(_damaged(spark, d), _targets(spark, d))


@query
def validate_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return validate.listed_ids(_damaged(spark, d)).where("kind <> 'target'")


@query
def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    lists = _damaged(spark, d)
    found = validate.duplicate_rows(lists).withColumn("kind", F.lit("row"))
    return found.unionByName(validate.repeated_in_list(lists).withColumn("kind", F.lit("list")))


@query
def validate_subset(spark: SparkSession, d: str) -> DataFrame:
    candidates_ = sinks.matching_results(fx.s1(spark, d), candidates(spark, d, "hybrid"))
    ids = F.when(F.col("matched_entity_ids") != "", F.split("matched_entity_ids", ",")).otherwise(F.array().cast("array<string>"))
    own = candidates_.select(F.lit(0).alias("at"), "source1_entity_id", ids.alias("ids"), F.lit(False).alias("malformed"))
    truth = sinks.matching_results(fx.s1(spark, d), ground_truth_pairs(spark, d))
    return validate.not_in_candidates(truth.select(F.lit(0).alias("at"), "source1_entity_id", ids.alias("ids"), F.lit(False).alias("malformed")), own)


@query
def submission_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_counts(_damaged(spark, d))


@query
def validation_findings(spark: SparkSession, d: str) -> DataFrame:
    found = validate.id_list_findings(_damaged(spark, d), _required(spark, d), _targets(spark, d), "matches")
    return found.select("severity", "check", "n", F.concat_ws(",", "examples").alias("examples"))
