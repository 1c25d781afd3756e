"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions, and answers where there are any) are normalised:
A-Z lower-cased, words are the runs of digits, letters and characters beyond
ASCII. Their windows of ten consecutive words, or the whole item where it is
shorter, are the automaton's patterns. Each document is normalised byte for byte,
scanned once, and every hit is mapped back to word numbers and to offsets in the
original text.

The patterns are the only data that every worker holds. They go out in blocks of
at most ``block_chars`` characters; a benchmark within one block (a few million
characters) needs one pass, a larger one a pass a block. Neither an automaton nor
what the driver holds at a time grows with the benchmark.

Defined cases: a null text has no words; an item without words has no window; item ids
of any type are taken as strings and a null one as the empty string; a
window in several items counts for each; repeated rows of documents give repeated
results and repeated benchmark rows change nothing; an empty benchmark hits
nothing; further columns are dropped (``contaminated_spans``) or kept
(``drop_contaminated``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize, pieces, texts

WINDOW = 10
BLOCK_CHARS = 4_000_000
BATCH_BYTES = 4 << 20

_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in set(_KEPT) else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

HITS = "array<struct<first:int,last:int,start:int,end:int,items:array<string>>>"


def windows(text: str, width: int = WINDOW) -> set[str]:
    """The normalised windows of one benchmark text; characters stand for UTF-8 bytes."""
    words = text.encode().translate(_TABLE).split()
    if not words:
        return set()
    width = min(width, len(words))
    return {b" ".join(words[i : i + width]).decode("latin-1") for i in range(len(words) - width + 1)}


class Scanner:
    """The automaton over one block of (window, items)."""

    def __init__(self, patterns: list[tuple[str, list[str]]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for window, items in patterns:
            self.automaton.add_word(f" {window} ", (window.count(" ") + 1, items))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        """(number of words, maximal runs of hit words)."""
        same = text.translate(_TABLE)
        words = same.split()
        if self.empty or not words:
            return len(words), []
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), []
        spaces = np.cumsum(np.frombuffer(line, np.uint8) == 0x20)
        runs: list[dict] = []
        ends = [(int(spaces[end]) - 2, n, items) for end, (n, items) in found]
        for first, last, items in sorted((last - n + 1, last, items) for last, n, items in ends):
            if runs and first <= runs[-1]["last"] + 1:
                runs[-1]["last"] = max(last, runs[-1]["last"])
                runs[-1]["items"].update(items)
            else:
                runs.append({"first": first, "last": last, "items": set(items)})
        raw = np.frombuffer(same, np.uint8) != 0x20
        edge = np.diff(np.concatenate([[False], raw, [False]]).astype(np.int8))
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        starts, ends_at = chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]
        for r in runs:
            r |= {"start": int(starts[r["first"]]), "end": int(ends_at[r["last"]]), "items": sorted(r["items"])}
        return len(words), runs


_made: dict[str, Scanner] = {}


def _scanner(digest: str, patterns: list[tuple[str, list[str]]]) -> Scanner:
    """One automaton per worker, kept between tasks."""
    if digest not in _made:
        _made.clear()
        _made[digest] = Scanner(patterns)
    return _made[digest]


def _blocks(benchmark: DataFrame, width: int, block_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Blocks of (window, items), each of about ``block_chars`` characters, collected one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(windows(text, width))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.string())], ["item_id", "window"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = items.mapInArrow(run, "item_id string, window string").groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    total = made.agg(F.sum(F.length("window") + 8 * F.size("items"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    made = materialize(made, "decontaminate-windows") if n > 1 else made
    for k in range(n):
        own = made if n == 1 else made.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        yield sorted((r["window"], list(r["items"])) for r in own.collect())


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, n_words, hits): the runs of document words inside benchmark windows.

    A hit has its first and last word number, its character span [start, end) in
    the original text, and the ids of the items whose windows occur there.
    ``benchmark`` is (item_id, text).
    """
    found, before = texts(docs).withColumn("hits", F.array().cast(HITS)), None
    for k, block in enumerate(_blocks(benchmark, width, block_chars)):
        if k:
            found = materialize(found.drop("n_words"), "decontaminate")
            before.destroy()  # what it was used for is written
        found, before = _scan(found, block)
    return found


def _scan(docs: DataFrame, block: list[tuple[str, list[str]]]) -> tuple[DataFrame, Broadcast]:
    schema = f"doc_id long, text string, n_words long, hits {HITS}"
    digest = hashlib.sha256(repr(block).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(digest, shared.value)
        for batch in pieces(batches, "text", BATCH_BYTES):
            out = [scanner.scan(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            hits = [before + own for before, (_, own) in zip(batch.column("hits").to_pylist(), out)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array([n for n, _ in out], pa.int64()), pa.array(hits, _hits_type())],
                ["doc_id", "text", "n_words", "hits"],
            )

    return docs.select("doc_id", "text", "hits").mapInArrow(run, schema), shared


@lru_cache(maxsize=1)
def _hits_type() -> pa.DataType:
    ints = [pa.field(k, pa.int32()) for k in ("first", "last", "start", "end")]
    return pa.list_(pa.struct([*ints, pa.field("items", pa.list_(pa.string()))]))


def n_hit(hits: Column) -> Column:
    """The number of words in any hit; runs of several passes may overlap."""
    alone = F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1)
    words = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["first"], h["last"])))))
    return F.when(F.size(hits) < 2, alone).otherwise(words.cast("long"))


def items_of(hits: Column) -> Column:
    """The distinct items of all hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents in which a window occurs; all columns stay.

    The scan's input is the document row itself, so a document is judged on its
    own text even where doc_ids repeat.
    """
    schema, names, before = docs.schema, docs.columns, None
    for k, block in enumerate(_blocks(benchmark, width, block_chars)):
        if k:
            docs = materialize(docs, "decontaminate")
            before.destroy()  # what it was used for is written
        digest = hashlib.sha256(repr(block).encode()).hexdigest()
        shared = before = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], digest=digest, shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(digest, shared.value)
            for batch in pieces(batches, "text", BATCH_BYTES):
                clean = [not scanner.scan(t or b"")[1] for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield batch.filter(pa.array(clean))

        docs = docs.select(*names).mapInArrow(run, schema)
    return docs
