"""Licence scan of a file tree, with DataFrame operations only.

Units of a file are sparse TF-IDF vectors, held against template vectors:

- every line, against short statements (``license_texts.STATEMENTS``);
- the header, which is the leading comment, and a licence file's whole text, each as a
  whole and paragraph by paragraph, against all templates, with the headers, titles
  and texts of licences (``license_texts.NOTICES``) among them.

Inverse document frequencies come from the templates that a unit is held against (a
term in none of them has the largest). A file's own licence is that of the template with
the largest cosine, if it reaches ``THRESHOLD``; a unit with a single term of templates (the
German word "mit") doesn't count. A file without one inherits from the
nearest ancestor directory whose licence file (LICENSE, LICENCE, COPYING, NOTICE,
UNLICENSE, also LICENSE-MIT, COPYING.LESSER) has one.

A leading comment is what stands before the end of a leading ``/* */``, ``<!-- -->`` or
triple-quoted stretch, or else the leading lines that are blank or begin with a mark of
comments (``COMMENT``). A line without letters of A-Z or digits ends a paragraph.

Most lines are dismissed without a vector. A line is looked at only if it holds an
anchor, and the anchors are chosen so that no template has a share of ``THRESHOLD``
of its length outside of them: by Cauchy-Schwarz, a line without an anchor cannot
reach the threshold. The units left are bounded by a cosine whose length takes terms of no
template by number only, and only those beyond it are counted exactly.

Defined cases: a null text is empty and has no licence; a null path is a file of no
directory; a path without a slash stands in the directory '', the root of all relative
paths; absolute paths have a root of their own; equal cosines go to the alphabetically
first licence, then to the first unit; of several licence files in one directory the
largest cosine counts, then the first licence; repeated rows get equal results; further
columns pass through, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize
from recordloom.llm.license_texts import NOTICES, STATEMENTS, license_of

#: The least cosine, and the fewest different terms of templates in a unit that counts.
THRESHOLD, LEAST_TERMS = 0.75, 2
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
TEMPLATES = STATEMENTS
#: Fixed patterns that the SQL check shares.
COMMENT = r"^[ \t\r]*(?:#|//|--|;|%|\*|$)"
PARAGRAPHS = r"\n[^A-Za-z0-9\n]*\n"
LICENSE_FILE = r"^(?:unlicense|licen[sc]e|copying|notice)(?:-[a-z0-9.+]+)*(?:\..*)?$"

#: Words that any text has, the last choice for an anchor.
COMMON = ("a", "all", "and", "by", "has", "in", "into", "is", "of", "the", "this", "to", "under", "use")


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


class Templates:
    """Template vectors: term weights, lengths and anchors."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD) -> None:
        counts = {k: Counter(terms_of(t)) for k, t in templates.items()}
        df = Counter(t for c in counts.values() for t in c)
        n = len(templates)
        self.unseen = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in sorted(df.items())}
        self.vectors = {k: {t: f * self.idf[t] for t, f in sorted(c.items())} for k, c in sorted(counts.items())}
        self.length = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in self.vectors.items()}
        self.threshold = threshold
        anchors = set(df)
        for t, _ in sorted(df.items(), key=lambda x: (x[0] not in COMMON, len(x[0]), -x[1], x[0])):  # long words are rare in other texts
            rest = anchors - {t}
            if all(math.sqrt(sum(w * w for u, w in v.items() if u not in rest)) < threshold * self.length[k] * (1 - 1e-9) for k, v in self.vectors.items()):
                anchors = rest
        self.anchors = sorted(anchors)

    def anchor_pattern(self) -> str:
        """Matches where a term that is an anchor stands, in lower case."""
        return r"(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in self.anchors) + r")(?![a-z0-9])"


def all_templates() -> Templates:
    return Templates(STATEMENTS | NOTICES)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def _doubles(values) -> Column:
    """An array literal, folded from one string."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _matches(terms: Column, t: Templates) -> Column:
    """The (similarity, license) structs of a unit's terms that reach the threshold; null for most units.

    Terms of no template count by their number alone at first: u distinct ones among o
    have a squared length of at least max(u, o * o / u) each way they repeat.
    """
    vocabulary = F.split(F.lit(",".join(t.idf)), ",")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = lambda tf, weights: total(F.zip_with(tf, _doubles(weights), lambda a, b: a * b))
    names = list(t.vectors)
    per_term = {k: [v.get(u, 0.0) * t.idf[u] for u in t.idf] for k, v in t.vectors.items()}

    def with_tf(terms: Column, known: Column, tf: Column) -> Column:
        unknown = F.array_except(terms, vocabulary)
        u, o = F.size(unknown), F.size(terms) - F.size(known)
        least = F.when(u > 0, F.greatest(u.cast("double"), o * o / u)).otherwise(0.0)
        square = total(F.zip_with(tf, _doubles(t.idf.values()), lambda a, b: a * b * a * b))
        return _let(
            F.struct(square.alias("square"), least.alias("least"), F.array(*[dot(tf, per_term[k]) / t.length[k] for k in names]).alias("dots"), unknown.alias("unknown")),
            lambda s: F.when(
                (F.size(F.array_distinct(known)) >= LEAST_TERMS) & (F.array_max(s["dots"]) >= F.lit(t.threshold - 1e-6) * F.sqrt(s["square"] + t.unseen**2 * s["least"])),
                _let(
                    F.sqrt(s["square"] + t.unseen**2 * total(F.transform(s["unknown"], lambda x: F.pow(F.size(F.filter(terms, lambda y: y == x)).cast("double"), F.lit(2.0))))),
                    lambda length: F.array(*[F.struct(F.round(F.get(s["dots"], k) / length, 6).alias("similarity"), F.lit(license_of(n)).alias("license")) for k, n in enumerate(names)]),
                ),
            ),
        )

    def with_terms(terms: Column) -> Column:
        known = F.filter(terms, lambda x: F.array_contains(vocabulary, x))
        return _let(known, lambda k: _let(F.transform(vocabulary, lambda v: F.size(F.filter(k, lambda x: x == v)).cast("double")), lambda tf: with_tf(terms, k, tf)))

    return _let(terms, with_terms)


def _header(text: Column) -> Column:
    """The leading comment of a text; null where there is none."""
    start = F.ltrim(text, F.lit(" \t\r\n"))
    lines = F.split(text, "\n", -1)
    after = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False).cast("int")
    marked = F.when(after > 0, F.slice(lines, F.lit(1), after - 1)).otherwise(lines)
    return (
        F.when(start.startswith("/*"), F.split_part(start, F.lit("*/"), F.lit(1)))
        .when(start.startswith("<!--"), F.split_part(start, F.lit("-->"), F.lit(1)))
        .when(start.startswith('"""'), F.split_part(start, F.lit('"""'), F.lit(2)))
        .when(start.rlike(COMMENT) & (start != ""), F.array_join(marked, "\n"))
    )


def own_licenses(files: DataFrame, templates: Templates, notices: Templates | None = None) -> DataFrame:
    """``files`` (path, text, ...) with ``own_license``, ``similarity`` and ``is_license_file`` added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.lower(F.element_at(F.split(F.col("path"), "/"), -1))
    pattern = templates.anchor_pattern()
    hopeful = F.when(F.lower(text).rlike(pattern), F.filter(F.split(text, "\n", -1), lambda u: F.lower(u).rlike(pattern))).otherwise(F.array().cast("array<string>"))
    scored = files.withColumn("is_license_file", F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)))
    whole = F.when(F.col("is_license_file"), text).otherwise(_header(text))
    parts = F.concat(F.array(F.col("__rl_block")), F.split("__rl_block", PARAGRAPHS, -1))
    scored = scored.withColumns({"__rl_units": hopeful, "__rl_block": whole})
    scored = scored.withColumn("__rl_blocks", F.coalesce(F.array_distinct(parts), F.array().cast("array<string>")))
    of = lambda units, t: F.flatten(F.filter(F.transform(units, lambda u: _matches(F.regexp_extract_all(F.lower(u), F.lit(TERM), F.lit(0)), t)), lambda m: m.isNotNull()))
    matches = F.concat(of("__rl_units", templates), of("__rl_blocks", notices or all_templates()))
    scored = scored.withColumn("__rl_found", F.filter(matches, lambda m: m["similarity"] >= templates.threshold))
    # the largest similarity, then the first licence
    top = F.array_max(F.transform("__rl_found", lambda m: m["similarity"]))
    first = F.array_min(F.transform(F.filter("__rl_found", lambda m: m["similarity"] == top), lambda m: m["license"]))
    return scored.withColumns({"own_license": first, "similarity": top}).drop("__rl_units", "__rl_block", "__rl_blocks", "__rl_found")


def scan(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """``files`` (path, text, ...) with own_license, similarity, is_license_file, license and inherited_from for the text.

    The texts are read once: what was found is written to the shared folder before
    directories are joined.
    """
    files = files.drop("own_license", "similarity", "is_license_file", "license", "inherited_from")
    own = materialize(own_licenses(files, templates or Templates(TEMPLATES)).drop("text"), "licenses")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    own = own.withColumns({"__rl_dir": directory, "__rl_absolute": F.col("path").startswith("/")})
    grants = (
        own.where(F.col("is_license_file") & F.col("own_license").isNotNull() & F.col("__rl_dir").isNotNull())
        .groupBy(F.col("__rl_dir").alias("__rl_grant"), "__rl_absolute")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("own_license").alias("l"))).alias("best"))
        .select("__rl_grant", "__rl_absolute", F.col("best.l").alias("__rl_license"))
    )
    parts = F.split("__rl_dir", "/")
    above = F.transform(F.sequence(F.col("__rl_absolute").cast("int"), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path")))
    tree = own.select("__rl_dir", "__rl_absolute").where(F.col("__rl_dir").isNotNull()).distinct()
    climbed = tree.select(F.col("__rl_dir").alias("__rl_of"), "__rl_absolute", F.explode(above).alias("up")).select("__rl_of", "__rl_absolute", F.col("up.depth").alias("depth"), F.col("up.path").alias("__rl_grant"))
    nearest = (
        climbed.join(grants, ["__rl_grant", "__rl_absolute"])
        .groupBy("__rl_of", "__rl_absolute")
        .agg(F.max(F.struct("depth", "__rl_grant", "__rl_license")).alias("near"))
        .select("__rl_of", F.col("__rl_absolute").alias("__rl_of_absolute"), F.col("near.__rl_grant").alias("__rl_from"), F.col("near.__rl_license").alias("__rl_inherited"))
    )
    joined = own.join(nearest, (own["__rl_dir"] == nearest["__rl_of"]) & (own["__rl_absolute"] == nearest["__rl_of_absolute"]), "left")
    names = [*(c for c in files.columns if c != "text"), "is_license_file", "own_license", "similarity"]
    return joined.select(
        *[own[c] for c in names],
        F.coalesce("own_license", "__rl_inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("__rl_from")).alias("inherited_from"),
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """Where a document stands in the corpus tree: source / 4096s / 256s / 16s / file.

    The first document of each directory is its licence file.
    """
    whole = lambda d: F.floor(doc_id / F.lit(d)).cast("string")
    up = [F.coalesce(source, F.lit("unknown")), whole(4096), whole(256), whole(16)]
    at = lambda n, name: F.concat_ws("/", *up[:n], name)
    starts = lambda d: F.pmod(doc_id, F.lit(d)) == 0
    return (
        F.when(starts(4096), at(2, F.lit("LICENSE")))
        .when(starts(256), at(3, F.lit("LICENSE")))
        .when(starts(16), at(4, F.lit("LICENSE")))
        .when(doc_id.isNotNull(), at(4, F.concat(doc_id.cast("string"), F.lit(".txt"))))
    )
