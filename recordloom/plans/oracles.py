"""The same results in SQL that DuckDB runs, for the queries of ``plans.queries``."""

from __future__ import annotations

from recordloom.functions.text import ABBREVIATIONS, COUNTRY_ALIASES, KEY_SEPARATOR, LEGAL_SUFFIXES, NULL_WORDS
from recordloom.operators.blocking import MAX_DF
from recordloom.plans import fixtures as fx
from recordloom.plans.queries import SAMPLE, THRESHOLDS


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _map(values: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    t = _trim(f"coalesce({x}, '')")
    return f"CASE WHEN lower({t}) IN ({_strings(NULL_WORDS)}) THEN '' ELSE {t} END"


def name(x: str) -> str:
    words = rf"regexp_replace(replace(lower({clean(x)}), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return _trim(rf"regexp_replace({words}, '\s+', ' ', 'g')")


def stripped(x: str) -> str:
    return f"regexp_replace({name(x)}, '((^| )({'|'.join(LEGAL_SUFFIXES)}))+$', '')"


def address(x: str) -> str:
    token = r"regexp_replace(t, '^0+(\d)', '\1')"
    return f"array_to_string(list_transform(string_split({name(x)}, ' '), lambda t: coalesce({_map(ABBREVIATIONS)}[{token}], {token})), ' ')"


def country(x: str) -> str:
    low = _trim(f"lower({clean(x)})")
    return f"coalesce({_map(COUNTRY_ALIASES)}[{low}], {low})"


def ascii_form(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def tokens(normal: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({normal}, ' '), lambda t: length(t) >= 2)))"


def numbers(x: str) -> str:
    bare = rf"regexp_replace({clean(x)}, '(^|[^\p{{L}}\p{{N}}_])0+(\d)', '\1\2', 'g')"
    return rf"list_sort(list_distinct(regexp_extract_all({bare}, '\d+')))"


_ALL = "(SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([fx.CTES, *more]) + "\n" + body


def _scalar(value: str) -> str:
    return _with(f"SELECT entity_id, {value} AS value FROM {_ALL} t")


def _prepared(records: str) -> str:
    n, a = name("business_name"), name("business_address")
    return f"""SELECT entity_id, {country("country")} AS country, {n} AS name_key, {stripped("business_name")} AS stripped_key, {address("business_address")} AS address_key,
  {tokens(n)} AS name_tokens, {tokens(a)} AS address_tokens, {ascii_form("business_name")} AS ascii_name, {ascii_form("business_address")} AS ascii_address,
  {numbers("business_address")} AS numbers FROM {records} r"""


_PREPARED = [
    f"p1 AS ({_prepared('s1')})",
    f"p AS ({_prepared('(SELECT * FROM s2 UNION ALL SELECT * FROM s3)')})",
    "pairs AS (SELECT DISTINCT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS entity_id FROM truth WHERE matched_entity_ids <> '')",
]


def _key_join(key: str, with_country: bool = True) -> str:
    both = " AND a.country = b.country" if with_country else ""
    return f"SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id FROM p1 a JOIN p b ON a.{key} = b.{key}{both} WHERE a.{key} <> ''"


_HYBRID = f"hybrid AS ({_key_join('name_key')} UNION {_key_join('address_key')})"


def _token_join(column: str, with_country: bool = True, min_overlap: int = 2, max_df: int = MAX_DF) -> str:
    c = "country" if with_country else "'GLOBAL'"
    return _with(
        f"SELECT DISTINCT s AS source1_entity_id, e AS entity_id FROM shared WHERE n >= {min_overlap} OR (nv < {min_overlap} AND n = nv)",
        *_PREPARED,
        f"q AS (SELECT entity_id AS s, {c} AS c, unnest({column}) AS t FROM p1)",
        f"ix AS (SELECT entity_id AS e, {c} AS c, unnest({column}) AS t FROM p)",
        "df AS (SELECT c, t, count(*) AS df FROM ix GROUP BY c, t)",
        f"ranked AS (SELECT s, q.c, q.t, df, count(*) FILTER (df <= {max_df}) OVER (PARTITION BY s) AS nv, row_number() OVER (PARTITION BY s ORDER BY df, q.t) AS rn FROM q JOIN df ON q.c = df.c AND q.t = df.t)",
        f"valid AS (SELECT s, c, t, greatest(nv, 1) AS nv FROM ranked WHERE df <= {max_df} OR (nv = 0 AND rn = 1))",
        "shared AS (SELECT s, e, nv, count(*) AS n FROM valid JOIN ix ON valid.c = ix.c AND valid.t = ix.t GROUP BY s, e, nv)",
    )


def _lists(pairs: str, column: str) -> str:
    return f"""SELECT s1.entity_id AS source1_entity_id, coalesce(l.ids, '') AS {column}
FROM s1 LEFT JOIN (SELECT source1_entity_id, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM (SELECT DISTINCT * FROM {pairs} x) y GROUP BY source1_entity_id) l ON l.source1_entity_id = s1.entity_id"""


def _counts(predicted: str) -> str:
    return f"""counts AS (
  SELECT s1.entity_id AS s, count(DISTINCT h.entity_id) AS np, any_value(coalesce(t.nt, 0)) AS nt, count(DISTINCT CASE WHEN g.entity_id IS NOT NULL THEN h.entity_id END) AS ns
  FROM s1 LEFT JOIN {predicted} h ON h.source1_entity_id = s1.entity_id
  LEFT JOIN pairs g ON g.source1_entity_id = h.source1_entity_id AND g.entity_id = h.entity_id
  LEFT JOIN (SELECT source1_entity_id, count(*) AS nt FROM pairs GROUP BY 1) t ON t.source1_entity_id = s1.entity_id
  GROUP BY s1.entity_id)"""


_F05 = "CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN np = 0 OR ns = 0 THEN 0.0 ELSE 1.25 * (ns / np) * (ns / nt) / (0.25 * (ns / np) + ns / nt) END"
_F05 = f"CAST({_F05} AS DOUBLE)"

_JACCARD = "round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6)"
_SCORED = f"""scored AS (SELECT source1_entity_id, entity_id, CAST({_JACCARD} AS DOUBLE) AS score FROM (
  SELECT h.*, p1.name_tokens AS a, p.name_tokens AS b FROM hybrid h JOIN p1 ON p1.entity_id = h.source1_entity_id JOIN p ON p.entity_id = h.entity_id) x)"""

_SWEEP = f"""sweep AS (
  SELECT threshold, round(avg({_F05}), 6) AS f05_macro FROM (
    SELECT k.threshold, s1.entity_id, count(z.entity_id) AS np, any_value(coalesce(t.nt, 0)) AS nt, count(g.entity_id) AS ns
    FROM s1 CROSS JOIN (SELECT CAST(unnest([{", ".join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold) k
    LEFT JOIN scored z ON z.source1_entity_id = s1.entity_id AND z.score >= k.threshold
    LEFT JOIN pairs g ON g.source1_entity_id = z.source1_entity_id AND g.entity_id = z.entity_id
    LEFT JOIN (SELECT source1_entity_id, count(*) AS nt FROM pairs GROUP BY 1) t ON t.source1_entity_id = s1.entity_id
    GROUP BY k.threshold, s1.entity_id) x GROUP BY threshold)"""

_IDLIST = "CASE WHEN trim(matched_entity_ids) <> '' THEN string_split(matched_entity_ids, ',') ELSE [] END"
_DAMAGED = [
    f"results AS ({_lists('pairs', 'matched_entity_ids')})",
    f"damaged AS ({fx.DAMAGE})",
    f"lists AS (SELECT source1_entity_id, {_IDLIST} AS ids FROM damaged)",
    "listed AS (SELECT DISTINCT unnest(ids) AS id FROM lists)",
    "kinds AS (SELECT id, CASE WHEN starts_with(id, 'S1-') THEN 'self' WHEN NOT (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) THEN 'foreign' ELSE 'target' END AS kind FROM listed)",
    "targets AS (SELECT entity_id AS id FROM s2 UNION SELECT entity_id FROM s3)",
]
_OFFENDERS = {
    "missing": "SELECT entity_id AS offender FROM s1 WHERE entity_id NOT IN (SELECT source1_entity_id FROM lists)",
    "extra": "SELECT DISTINCT source1_entity_id AS offender FROM lists WHERE source1_entity_id NOT IN (SELECT entity_id FROM s1)",
    "unknown": "SELECT id AS offender FROM kinds WHERE kind = 'target' AND id NOT IN (SELECT id FROM targets)",
    "row": "SELECT source1_entity_id AS offender FROM lists GROUP BY 1 HAVING count(*) > 1",
    "list": "SELECT DISTINCT source1_entity_id AS offender FROM lists WHERE len(ids) <> len(list_distinct(ids))",
    "self": "SELECT id AS offender FROM kinds WHERE kind = 'self'",
    "foreign": "SELECT id AS offender FROM kinds WHERE kind = 'foreign'",
}


def _validation(body: str, *more: str) -> str:
    return _with(body, _PREPARED[2], *_DAMAGED, *more)


def _finding(check: str, offenders: str) -> str:
    return f"""SELECT 'error' AS severity, 'matches: {check}' AS "check", n, examples FROM (
  SELECT count(*) AS n, array_to_string(list_sort(list(offender ORDER BY offender))[1:5], ',') AS examples FROM ({offenders}) o) x WHERE n > 0"""


_TFIDF = [
    "docs AS (SELECT entity_id, unnest(name_tokens) AS t FROM (SELECT entity_id, name_tokens FROM p1 UNION ALL SELECT entity_id, name_tokens FROM p) x)",
    "idf AS (SELECT t, ln((1 + (SELECT count(*) FROM p1) + (SELECT count(*) FROM p)) / (1 + count(*))) + 1 AS w FROM docs GROUP BY t)",
    "unit AS (SELECT entity_id, sqrt(sum(w * w)) AS len FROM docs JOIN idf USING (t) GROUP BY entity_id)",
    "vec AS (SELECT docs.entity_id, t, w / len AS v FROM docs JOIN idf USING (t) JOIN unit ON unit.entity_id = docs.entity_id)",
]


def _q(*percent: tuple[str, float]) -> str:
    return ", ".join(f"round(quantile_cont(np, {q}), 6) AS {n}" for n, q in percent)


ORACLES: dict[str, str] = {
    "clean_string": _scalar(clean("business_name")),
    "normalize_name": _scalar(name("business_name")),
    "normalize_name_stripped": _scalar(stripped("business_name")),
    "normalize_address": _scalar(address("business_address")),
    "normalize_ascii": _scalar(ascii_form("business_name")),
    "normalize_country": _scalar(country("country")),
    "name_address_key": _with(
        f"SELECT entity_id, CASE WHEN n <> '' AND a <> '' THEN n || '{KEY_SEPARATOR}' || a ELSE '' END AS value FROM (SELECT entity_id, {name('business_name')} AS n, {address('business_address')} AS a FROM {_ALL} t) x"
    ),
    "tokenize": _scalar(f"array_to_string({tokens(name('business_address'))}, ',')"),
    "extract_numbers": _scalar(f"array_to_string({numbers('business_address')}, ',')"),
    "scan_records": _with("SELECT entity_id, business_name, business_address, country FROM s1"),
    "corpus_union": _with("SELECT * FROM s2 UNION ALL SELECT * FROM s3"),
    "ground_truth_pairs": _with("SELECT * FROM pairs", _PREPARED[2]),
    "sample_s1": _with(f"SELECT * FROM s1 ORDER BY entity_id LIMIT {SAMPLE}"),
    "ground_truth_sample": _with(f"SELECT * FROM pairs WHERE source1_entity_id IN (SELECT entity_id FROM s1 ORDER BY entity_id LIMIT {SAMPLE})", _PREPARED[2]),
    "holdout_split": _with("SELECT entity_id, CAST('0x' || substring(md5(entity_id), 1, 7) AS BIGINT) % 10000 < 1000 AS is_holdout FROM s1"),
    "count_rows": _with("SELECT (SELECT count(*) FROM s2) + (SELECT count(*) FROM s3) AS rows"),
    "block_exact_name": _with(_key_join("name_key"), *_PREPARED),
    "stream_exact_name": _with(_key_join("name_key"), *_PREPARED),
    "block_exact_address": _with(_key_join("address_key"), *_PREPARED),
    "block_exact_name_global": _with(_key_join("name_key", False), *_PREPARED),
    "block_exact_address_global": _with(_key_join("address_key", False), *_PREPARED),
    "block_stripped_name": _with(_key_join("stripped_key"), *_PREPARED),
    "block_name_address": _with(
        "SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id FROM p1 a JOIN p b ON a.name_key = b.name_key AND a.address_key = b.address_key WHERE a.name_key <> '' AND a.address_key <> ''", *_PREPARED
    ),
    "block_hybrid": _with("SELECT * FROM hybrid", *_PREPARED, _HYBRID),
    "baseline_matches": _with(f"{_key_join('ascii_name', False)} UNION {_key_join('ascii_address', False)}", *_PREPARED),
    "block_token_name": _token_join("name_tokens"),
    "block_token_address": _token_join("address_tokens"),
    "block_token_global": _token_join("name_tokens", with_country=False),
    "block_token_name_bounded": _token_join("name_tokens", min_overlap=3, max_df=20),
    "token_document_frequency": _with("SELECT country, token, count(*) AS df FROM (SELECT country, unnest(name_tokens) AS token FROM p) t GROUP BY country, token", *_PREPARED),
    "matching_results": _with(_lists(f"({_key_join('name_key')})", "matched_entity_ids"), *_PREPARED),
    "candidate_pairs": _with(_lists("hybrid", "candidate_entity_ids"), *_PREPARED, _HYBRID),
    "baseline_results": _with(_lists(f"({_key_join('ascii_name', False)} UNION {_key_join('ascii_address', False)})", "matched_entity_ids"), *_PREPARED),
    "f05_per_entity": _with(f"SELECT s AS source1_entity_id, round({_F05}, 6) AS f05 FROM counts", *_PREPARED, _HYBRID, _counts("hybrid")),
    "f05_macro": _with(f"SELECT round(avg({_F05}), 6) AS f05_macro FROM counts", *_PREPARED, _HYBRID, _counts("hybrid")),
    "blocking_metrics": _with(
        f"SELECT round(sum(ns) / sum(nt), 6) AS candidate_recall, round(avg(np), 6) AS avg_candidates, {_q(('median_candidates', 0.5), ('p90_candidates', 0.9), ('p95_candidates', 0.95), ('p99_candidates', 0.99))}, round(avg(CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_candidate_rate FROM counts",
        *_PREPARED, _HYBRID, _counts("hybrid"),
    ),
    "reduction_ratio": _with(
        "SELECT (SELECT count(*) FROM hybrid) AS pairs, round(1 - (SELECT count(*) FROM hybrid) / ((SELECT count(*) FROM s1) * ((SELECT count(*) FROM s2) + (SELECT count(*) FROM s3))), 6) AS reduction_ratio", *_PREPARED, _HYBRID
    ),
    "false_positives": _with("SELECT * FROM hybrid EXCEPT SELECT * FROM pairs", *_PREPARED, _HYBRID),
    "false_negatives": _with("SELECT * FROM pairs EXCEPT SELECT * FROM hybrid", *_PREPARED, _HYBRID),
    "threshold_sweep": _with("SELECT * FROM sweep", *_PREPARED, _HYBRID, _SCORED, _SWEEP),
    "best_threshold": _with("SELECT * FROM sweep ORDER BY f05_macro DESC, threshold LIMIT 1", *_PREPARED, _HYBRID, _SCORED, _SWEEP),
    "feature_jaccard": _with("SELECT source1_entity_id, entity_id, score AS jaccard FROM scored", *_PREPARED, _HYBRID, _SCORED),
    "feature_levenshtein": _with(
        "SELECT source1_entity_id, h.entity_id, round(CASE WHEN greatest(length(p1.name_key), length(p.name_key)) > 0 THEN 1 - levenshtein(p1.name_key, p.name_key) / greatest(length(p1.name_key), length(p.name_key)) ELSE 1.0 END, 6) AS levenshtein FROM hybrid h JOIN p1 ON p1.entity_id = h.source1_entity_id JOIN p ON p.entity_id = h.entity_id",
        *_PREPARED, _HYBRID,
    ),
    "feature_tfidf_cosine": _with(
        "SELECT h.source1_entity_id, h.entity_id, round(coalesce(any_value(d.dot), 0.0), 6) AS tfidf_cosine FROM hybrid h LEFT JOIN (SELECT source1_entity_id, h.entity_id, sum(a.v * b.v) AS dot FROM hybrid h JOIN vec a ON a.entity_id = h.source1_entity_id JOIN vec b ON b.entity_id = h.entity_id AND a.t = b.t GROUP BY 1, 2) d ON d.source1_entity_id = h.source1_entity_id AND d.entity_id = h.entity_id GROUP BY 1, 2",
        *_PREPARED, _HYBRID, *_TFIDF,
    ),
    "feature_shared_numbers": _with(
        "SELECT source1_entity_id, h.entity_id, len(list_intersect(p1.numbers, p.numbers)) > 0 AS shared FROM hybrid h JOIN p1 ON p1.entity_id = h.source1_entity_id JOIN p ON p.entity_id = h.entity_id", *_PREPARED, _HYBRID
    ),
    "feature_same_country": _with(
        f"SELECT source1_entity_id, h.entity_id, p1.country = p.country AND p1.country <> '' AS same FROM ({_key_join('name_key', False)}) h JOIN p1 ON p1.entity_id = h.source1_entity_id JOIN p ON p.entity_id = h.entity_id", *_PREPARED
    ),
    "validate_missing": _validation(_OFFENDERS["missing"]),
    "validate_extra": _validation(_OFFENDERS["extra"]),
    "validate_unknown": _validation(_OFFENDERS["unknown"]),
    "validate_prefixes": _validation("SELECT id, kind FROM kinds WHERE kind <> 'target'"),
    "validate_duplicates": _validation(f"SELECT offender, 'row' AS kind FROM ({_OFFENDERS['row']}) a UNION ALL SELECT offender, 'list' FROM ({_OFFENDERS['list']}) b"),
    "validate_subset": _with("SELECT DISTINCT source1_entity_id AS offender FROM (SELECT * FROM pairs EXCEPT SELECT * FROM hybrid) x", *_PREPARED, _HYBRID),
    "submission_row_counts": _validation("SELECT count(*) AS n_rows, count(*) FILTER (len(ids) = 0) AS n_empty, count(*) FILTER (len(ids) > 0) AS n_filled FROM lists"),
    "validation_findings": _validation(
        "\nUNION ALL ".join(
            _finding(check, _OFFENDERS[kind])
            for check, kind in (
                ("source-1 row repeated", "row"), ("id repeated in a list", "list"), ("source-1 id in a list", "self"), ("id of neither S2- nor S3-", "foreign"),
                ("required source-1 row missing", "missing"), ("source-1 row not required", "extra"), ("id in no target file", "unknown"),
            )
        )
    ),
}
