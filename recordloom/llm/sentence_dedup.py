"""Substring dedup by sliding spans of sentences.

A sentence runs to its closing marks (``.``, ``!``, ``?``) or line end, with the
blanks after them; a text's sentences joined are the text. From every sentence on a
run is hashed: the fewest consecutive sentences, ``LEAST`` of them at least, that hold
``MIN_WORDS`` words. So a run is of several sentences always, and of as many as it takes
to tell a passage from a chance agreement of short lines. Hashes meet globally, and
every sentence inside a run that is not its first occurrence, in (doc_id, text,
position) order, is removed. Sentences are compared without the blanks around them.

A passage that holds no two whole sentences, or too few words in them, has no run.

Defined cases: a null text is empty; a text of one sentence or of fewer words has no
run and stays; rows of equal doc_id and text are one document; a null doc_id comes before all others; further columns pass through
untouched, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.llm.common import pieces
from recordloom.llm.repeats import KEPT, KEY, N_REMOVED, N_UNITS, covered_units, keyed, with_covered, with_results

LEAST, MIN_WORDS = 2, 16
BATCH_BYTES = 2 << 20
#: A fixed pattern that the SQL check shares.
SENTENCE = r"[^.!?\n]+[.!? \t\r\n]*|[.!?\n]+[ \t\r\n]*"
_sentences = re.compile(SENTENCE.encode()).findall
_BLANK = b" \t\r\n"


def runs_of(text: bytes, least: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, what is hashed) of each run."""
    units = [s.strip(_BLANK) for s in _sentences(text)]
    words = [0, *accumulate(len(s.split()) for s in units)]
    out = []
    for i in range(len(units) - least + 1):
        j = max(i + least, bisect_left(words, words[i] + min_words))
        if j > len(units):
            break
        out.append((i, j - i, b"%d\n%s" % (j - i, b"\n".join(units[i:j]))))
    return out


def span_runs(docs: DataFrame, least: int, min_words: int) -> DataFrame:
    """(doc_id, text_hash, at, n, h, g) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in pieces(batches, "text", BATCH_BYTES):
            found = [runs_of(t, least, min_words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            flat = [r for own in found for r in own]
            hashes = np.frombuffer(b"".join([xxh3_128_digest(t) for _, _, t in flat]), [("h", "<i8"), ("g", "<i4"), ("_", "<i4")])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(owner) for c in KEY),
                    pa.array([i for i, _, _ in flat], pa.int32()),
                    pa.array([n for _, n, _ in flat], pa.int32()),
                    pa.array(hashes["h"]),
                    pa.array(hashes["g"]),
                ],
                [*KEY, "at", "n", "h", "g"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, at int, n int, h long, g int")


def dedup_sentences(docs: DataFrame, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_units (sentences), n_removed and kept_text added."""
    rows = with_covered(docs, covered_units(span_runs(docs, least, min_words)))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(N_UNITS, T.LongType()), T.StructField(N_REMOVED, T.LongType()), T.StructField(KEPT, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            units, gone, kept = [], [], []
            for text, covered in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__rl_covered").to_pylist()):
                own = _sentences(text or b"")
                out = set(covered or ())
                units.append(len(own))
                gone.append(len(out))
                kept.append(b"".join([s for i, s in enumerate(own) if i not in out]) if out else text or b"")
            columns = [pa.array(units, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, N_UNITS, N_REMOVED, KEPT])

    return with_results(docs, rows.mapInArrow(run, schema))
