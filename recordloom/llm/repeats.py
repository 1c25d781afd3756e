"""Repeated runs of consecutive units (lines, sentences) in a corpus.

A run is known by a 96-bit hash. Runs are counted globally, with partial sums
before the shuffle, and the first occurrence in (doc_id, text, position) order is
kept with the count. The repeated hashes are written to the shared folder; the runs
that occur again are then found by a join in which each hash stands once on one
side, so adaptive execution can split a hot run's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize

#: A row's identity: rows of equal doc_id and text are one document.
KEY = ("doc_id", "text_hash")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, text) of each row; a null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def windows(rows: DataFrame, units: Column, width: int) -> DataFrame:
    """(doc_id, text_hash, at, n, h, g): each run of ``width`` units from unit ``at`` on that isn't blank throughout."""
    rows = rows.select(*KEY, units.alias("units")).where(F.size("units") >= width)
    text = lambda i: F.concat_ws("\n", *[F.get("units", i + k) for k in range(width)])
    made = F.transform(F.sequence(F.lit(0), F.size("units") - width), lambda i: F.struct(i.alias("at"), text(i).alias("t")))
    runs = rows.select(*KEY, F.explode(made).alias("r")).where(F.length(F.btrim("r.t", F.lit(" \t\r\n"))) > 0)
    return runs.select(*KEY, "r.at", F.lit(width).alias("n"), F.xxhash64("r.t").alias("h"), F.hash("r.t").alias("g"))


def covered_units(runs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered): the units inside any run that occurred before.

    ``runs`` is (doc_id, text_hash, at, n, h, g) and is read twice.
    """
    place = lambda: F.struct(*KEY, "at")
    seen = materialize(runs.groupBy("h", "g").agg(F.count("*").alias("times"), F.min(place()).alias("first")).where("times > 1").drop("times"), "repeats")
    later = runs.join(seen, ["h", "g"]).where(~place().eqNullSafe(F.col("first")))
    spans = later.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    return spans.select(*KEY, covered.alias("covered"))


def with_covered(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """``docs`` with the array ``__rl_covered`` (null where nothing is covered); names of this prefix are reserved."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    side = covered.select(F.col("doc_id").alias("__rl_doc"), F.col("text_hash").alias("__rl_hash"), F.col("covered").alias("__rl_covered"))
    joined = docs.join(side, (docs["doc_id"].cast("long").eqNullSafe(side["__rl_doc"])) & (key == side["__rl_hash"]), "left")
    return joined.select(*docs.columns, "__rl_covered")


#: The columns of the result of a dedup before they are named.
N_UNITS, N_REMOVED, KEPT = "__rl_n", "__rl_removed", "__rl_kept"


def with_results(docs: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` with n_units, n_removed and kept_text, which replace columns of ``docs`` that are so named."""
    added = {"n_units": N_UNITS, "n_removed": N_REMOVED, "kept_text": KEPT}
    return done.select(*[c for c in docs.columns if c not in added], *[F.col(v).alias(k) for k, v in added.items()])
