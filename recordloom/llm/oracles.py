"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from recordloom.llm.license_texts import NOTICES, STATEMENTS, license_of
from recordloom.llm.licenses import COMMENT, LEAST_TERMS, PARAGRAPHS, TERM, THRESHOLD
from recordloom.llm.sentence_dedup import LEAST, MIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) l WHERE len(w) >= k) t),
hits AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw USING (k, win)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) t GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


#: Windows of 200 bytes are 400 hex digits, told apart by MD5.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
segments AS (SELECT doc_id, n, a, substring(h, 2 * a + 1, 1398) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n - 199, 500)) AS a FROM d WHERE n >= 200) t),
w AS (SELECT doc_id, a + i AS i, md5(substring(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, a, unnest(range(0, least(500, n - 199 - a))) AS i FROM segments) t),
hit AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
b AS (SELECT doc_id, unnest(range(0, n)) AS j, unnest(regexp_extract_all(h, '..')) AS c FROM d),
near AS (SELECT b.doc_id, j, c, max(i) OVER (PARTITION BY b.doc_id ORDER BY j) AS i FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i = b.j),
gone AS (SELECT doc_id, j, c, coalesce(j - i < 200, false) AS g FROM near),
runs AS (SELECT doc_id, j, c, g, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM gone),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(c, '' ORDER BY j) FILTER (WHERE NOT g) AS kept
  FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""


def _repeats(units: str, same: str, ends: str, counts: str, separator: str) -> str:
    """First occurrences stay, whatever later runs of units cover goes. A run from unit i on has the units to ``ends``, if ``counts``."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {units} AS u FROM documents),
e AS (SELECT doc_id, text, u, {same} AS s FROM d),
c AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\n\\x0B\\x0C]+'))) AS words FROM e),
starts AS (SELECT doc_id, s, words, unnest(range(1, len(s) + 1)) AS i FROM c),
ended AS (SELECT doc_id, i, s, {ends} AS j FROM starts),
w AS (SELECT doc_id, i, j - i + 1 AS n, array_to_string(s[i : j], chr(10)) AS r FROM ended WHERE j <= len(s)),
o AS (SELECT *, row_number() OVER (PARTITION BY n, r ORDER BY doc_id, i) AS k FROM w WHERE {counts}),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM o WHERE k > 1),
p AS (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS j FROM d),
kept AS (SELECT p.doc_id, string_agg(u[j], {separator} ORDER BY j) AS t FROM p WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = p.doc_id AND hit.j = p.j) GROUP BY p.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(u) AS BIGINT) AS n_units, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""


OP10 = _repeats("string_split(coalesce(text, ''), chr(10))", "u", "i + 2", "length(trim(r, ' ' || chr(9) || chr(10) || chr(13))) > 0", "chr(10)")
OP8 = _repeats(
    r"regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!? \t\r\n]*|[.!?\n]+[ \t\r\n]*')",
    "list_transform(u, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))",
    # the first k units from i on that hold enough words; one past the end where there are none
    f"coalesce(list_position(list_transform(range({LEAST}, len(s) - i + 2), lambda k: list_sum(words[i : i + k - 1]) >= {MIN_WORDS}), true) + i + {LEAST} - 2, len(s) + 1)",
    "true",
    "''",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    """Unit kinds: 0 for lines, held against statements; 1 for headers and licence files, held against all templates."""
    every = [(0, k, t) for k, t in STATEMENTS.items()] + [(1, k, t) for k, t in (STATEMENTS | NOTICES).items()]
    rows = ", ".join(f"({kind}, {_quoted(k)}, {_quoted(license_of(k))}, {_quoted(t)})" for kind, k, t in every)
    words = rf"regexp_extract_all(lower({{}}), '{TERM}')"
    lines = "string_split(text, chr(10))"
    return f"""
WITH templates(kind, name, license, text) AS (VALUES {rows}),
tt AS (SELECT kind, name, w, count(*) AS f FROM (SELECT kind, name, unnest({words.format("text")}) AS w FROM templates) t GROUP BY ALL),
size AS (SELECT kind, count(*) AS n FROM templates GROUP BY kind),
idf AS (SELECT kind, w, ln((1.0 + any_value(n)) / (1 + count(DISTINCT name))) + 1 AS i FROM tt JOIN size USING (kind) GROUP BY kind, w),
tv AS (SELECT kind, name, w, f * i AS v FROM tt JOIN idf USING (kind, w)),
tl AS (SELECT kind, name, sqrt(sum(v * v)) AS len FROM tv GROUP BY kind, name),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, ltrim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)) AS start,
         coalesce(source, 'unknown') || '/' || (doc_id // 4096) AS d2, '/' || (doc_id // 256) AS d3, '/' || (doc_id // 16) AS d4
  FROM documents),
f AS (
  SELECT doc_id, text, start, doc_id % 16 = 0 AS is_license_file,
         CASE WHEN doc_id % 4096 = 0 THEN d2 WHEN doc_id % 256 = 0 THEN d2 || d3 ELSE d2 || d3 || d4 END AS dir FROM d),
headed AS (
  SELECT doc_id, text, {lines} AS ls, coalesce(list_position(list_transform({lines}, lambda x: regexp_matches(x, '{COMMENT}')), false), 0) AS after
  FROM f WHERE NOT is_license_file AND start <> '' AND regexp_matches(start, '{COMMENT}') AND NOT starts_with(start, '/*')),
blocks AS (
  SELECT doc_id, text AS b FROM f WHERE is_license_file
  UNION ALL SELECT doc_id, split_part(start, '*/', 1) FROM f WHERE NOT is_license_file AND starts_with(start, '/*')
  UNION ALL SELECT doc_id, split_part(start, '-->', 1) FROM f WHERE NOT is_license_file AND starts_with(start, '<!--')
  UNION ALL SELECT doc_id, split_part(start, '\"\"\"', 2) FROM f WHERE NOT is_license_file AND starts_with(start, '\"\"\"')
  UNION ALL SELECT doc_id, array_to_string(CASE WHEN after > 0 THEN ls[1 : after - 1] ELSE ls END, chr(10)) FROM headed),
units AS (
  SELECT doc_id, 0 AS kind, unnest({lines}) AS u, unnest(range(len({lines}))) AS k FROM f
  UNION ALL SELECT doc_id, 1, b, -1 FROM blocks
  UNION ALL SELECT doc_id, 1, u, row_number() OVER () AS k FROM (SELECT doc_id, unnest(string_split_regex(b, '{PARAGRAPHS}')) AS u FROM blocks) t),
ut AS (SELECT doc_id, kind, k, w, count(*) AS n FROM (SELECT doc_id, kind, k, unnest({words.format("u")}) AS w FROM units) t GROUP BY ALL),
uv AS (SELECT doc_id, ut.kind, k, ut.w, ut.n * coalesce(i, ln(1.0 + size.n) + 1) AS v, i IS NOT NULL AS known FROM ut JOIN size ON size.kind = ut.kind LEFT JOIN idf ON idf.kind = ut.kind AND idf.w = ut.w),
ul AS (SELECT doc_id, kind, k, sqrt(sum(v * v)) AS len FROM uv GROUP BY ALL HAVING count(*) FILTER (WHERE known) >= {LEAST_TERMS}),
cosine AS (
  SELECT doc_id, kind, k, name, round(sum(uv.v * tv.v) / (any_value(ul.len) * any_value(tl.len)), 6) AS similarity
  FROM uv JOIN tv USING (kind, w) JOIN ul USING (doc_id, kind, k) JOIN tl USING (kind, name) GROUP BY doc_id, kind, k, name),
best AS (
  SELECT doc_id, license AS own_license, similarity
  FROM (SELECT doc_id, license, similarity, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) AS r
        FROM cosine JOIN (SELECT DISTINCT name, license FROM templates) n USING (name) WHERE similarity >= {THRESHOLD}) t WHERE r = 1),
g AS (SELECT f.*, own_license, similarity FROM f LEFT JOIN best USING (doc_id)),
grants AS (SELECT dir AS up, own_license AS lic FROM g WHERE is_license_file AND own_license IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, own_license) = 1),
climb AS (SELECT DISTINCT dir, n, array_to_string(string_split(dir, '/')[1:n], '/') AS up FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM g) t),
near AS (SELECT dir, up, lic FROM climb JOIN grants USING (up) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC) = 1)
SELECT doc_id, is_license_file, own_license, similarity, coalesce(own_license, lic) AS license,
       CASE WHEN own_license IS NULL THEN up END AS inherited_from
FROM g LEFT JOIN near USING (dir)
"""


OP1 = _licenses()
