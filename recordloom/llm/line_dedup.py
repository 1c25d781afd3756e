"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines, as they are. Windows are counted over the
whole table; every occurrence of a window after its first, in (doc_id, text,
position) order, covers its three lines, covered positions are merged, and covered
lines are removed. A first occurrence is removed only where a window that overlaps
it is itself a later one.

Defined cases: a null text is empty; a text of fewer than three lines has no
window and stays; windows of blank lines only are layout and don't count; rows of
equal doc_id and text are one document, so a repeated row neither covers nor
spares the other; a null doc_id comes before all others; further columns pass
through untouched (``dedup_lines`` replaces those named like its own results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.repeats import KEPT, N_REMOVED, N_UNITS, covered_units, keyed, windows, with_covered, with_results

WIDTH = 3


def lines(text: Column | None = None) -> Column:
    """The lines of a text; an empty text is one empty line."""
    return F.split(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")), "\n", -1)


def _dedup(docs: DataFrame, width: int) -> DataFrame:
    covered = covered_units(windows(keyed(docs), lines(), width))
    rows = with_covered(docs, covered).withColumn("__rl_lines", lines())
    hit = F.col("__rl_covered").isNotNull()
    left = F.array_except(F.sequence(F.lit(0), F.size("__rl_lines") - 1), F.col("__rl_covered"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__rl_lines", i)), "\n")
    return rows.select(
        *docs.columns,
        F.size("__rl_lines").cast("long").alias(N_UNITS),
        F.when(hit, F.size("__rl_covered")).otherwise(0).cast("long").alias(N_REMOVED),
        F.when(hit, kept).otherwise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(KEPT),
    )


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with n_units (lines), n_removed and kept_text added."""
    return with_results(docs, _dedup(docs, width))


def rewrite(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with covered lines cut out of ``text`` and ``n_chars`` set anew.

    A document all of whose lines were covered goes; it has nothing left.
    """
    hit = F.col(N_REMOVED) > 0
    done = _dedup(docs, width).where(~hit | (F.col(N_REMOVED) < F.col(N_UNITS)))
    values = {"text": F.when(hit, F.col(KEPT)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(hit, F.char_length(KEPT)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])
