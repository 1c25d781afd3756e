"""Fixed schemas; nothing is inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RECORD = _strings("entity_id", "business_name", "business_address", "country")
GROUND_TRUTH = _strings("source1_entity_id", "matched_entity_ids")
MATCHES = _strings("source1_entity_id", "matched_entity_ids")
CANDIDATES = _strings("source1_entity_id", "candidate_entity_ids")
PAIRS = _strings("source1_entity_id", "entity_id")

METRICS = ("candidate_recall", "avg_candidates", "median_candidates", "p90_candidates", "p95_candidates", "p99_candidates", "zero_candidate_rate")
BENCH_LOG = T.StructType(
    [T.StructField("method", T.StringType()), T.StructField("sample_size", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in (*METRICS, "index_time", "query_time")]
)
