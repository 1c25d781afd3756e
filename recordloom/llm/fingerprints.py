"""One-permutation MinHash fingerprints of documents.

Every shingle of five words is hashed once. The top bits choose one of
``BINS`` bins, each bin keeps its least hash, an empty bin takes the value of the
first filled bin in a fixed pseudo-random order of its own (optimal
densification), and the low ``BITS`` bits of each bin's value, mixed with the bin's
number, are packed into the fingerprint, so that a value copied to several bins
doesn't agree in all of them by one chance. Two fingerprints agree in a bin by chance with probability
2**-BITS, which ``likeness`` corrects for.

Defined cases: a null text is empty; a text without words has the fingerprint of
``BINS`` zero bins, likeness 1 to its like and 0 to any other text; a text of one
to four words is one shingle; equal texts have equal fingerprints whatever their
ids; rows of equal doc_id are ordered by text; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import partitions, pieces, texts
from recordloom.llm.shingles import mix, shingles

WIDTH, BINS, BITS = 5, 512, 4
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000
#: Documents of one range of the ordered pass, on average up to ``MOST_RANGES`` of them (rows are
#: sorted with spilling and read as a stream, so a range may be large) and, where there are few
#: partitions' worth, at least. Ids sampled for each range's bound.
DOCS_PER_RANGE, LEAST_DOCS, MOST_RANGES, SAMPLED = 4096, 256, 10_000, 200


@lru_cache(maxsize=64)
def _tries(t: int) -> np.ndarray:
    """The bin that each empty bin looks at in its t-th try."""
    return (mix(np.arange(BINS, dtype=np.uint64) + np.uint64((t + 1) * 0x632BE59BD9B4E019 % (1 << 64))) % np.uint64(BINS)).astype(np.int64)


def bins(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of each bin, number of filled bins) for each text."""
    hashes, at = shingles(values, WIDTH)
    n = len(values)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    np.minimum.at(least, owner * BINS + (hashes >> shift).astype(np.int64), hashes & np.uint64((1 << 48) - 1))
    least = least.reshape(n, BINS)
    filled = least != np.iinfo(np.uint64).max
    count = filled.sum(axis=1)
    alone = np.flatnonzero(count == 1)
    least[alone] = least[alone].min(axis=1, keepdims=True)
    row, bin_ = np.nonzero(~filled & (count > 1)[:, None])
    t = 0
    while len(row):
        seen = _tries(t)[bin_]
        hit = filled[row, seen]
        least[row[hit], bin_[hit]] = least[row[hit], seen[hit]]
        row, bin_, t = row[~hit], bin_[~hit], t + 1
    # a value that stands in several bins must not agree in all of them by one chance
    low = (mix(least + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[count == 0] = 0
    return low, count


def packed(low: np.ndarray) -> list[str]:
    """The bins' low bits as lower-case hex, first bin first."""
    per = 8 // BITS
    out = np.zeros((len(low), BINS // per), np.uint8)
    for k in range(per):
        out |= low[:, k::per] << np.uint8(BITS * (per - 1 - k))
    return [x.tobytes().hex() for x in out]


def likeness(a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard likeness of the texts' shingle sets, row by row."""
    by_chance = 2.0**-BITS
    estimate = np.clip(((a == b).mean(axis=1) - by_chance) / (1 - by_chance), 0, 1)
    return np.where((count_a == 0) | (count_b == 0), ((count_a == 0) & (count_b == 0)).astype(float), estimate)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES, BATCH_ROWS):
            low, _ = bins(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed(low))], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _longs(values: list[int]) -> Column:
    """An array literal, folded from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """The index of the last of the ascending ``bounds`` that is at most ``value``; two levels, so few comparisons a row."""
    step = max(1, int(len(bounds) ** 0.5))
    block = F.size(F.filter(_longs(bounds[::step]), lambda x: x <= value)) - 1
    inner = F.slice(_longs(bounds), block * step + 1, F.lit(step))
    return (block * step + F.size(F.filter(inner, lambda x: x <= value)) - 1).cast("int")


def _with_successors(docs: DataFrame, docs_per_range: int) -> tuple[DataFrame, int]:
    """Rows (range, follows, doc_id, text) and the number of ranges.

    Ranges of doc_id begin at existing ids. The row that begins a range is also
    sent to the range before it, marked ``follows``.
    """
    rows = texts(docs)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = rows.select("doc_id").count()
    wanted = min(MOST_RANGES, max(1, min(partitions(docs.sparkSession), n // LEAST_DOCS), -(-n // docs_per_range)))
    shares = F.split(F.lit(",".join(str(k / wanted) for k in range(wanted))), ",").cast("array<double>")
    # a sample only sets where ranges begin: at ids that are there
    sampled = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (SAMPLED * wanted)))) == 0, key)
    least, cuts = rows.select(F.min(key), F.percentile_approx(sampled, shares, F.lit(max(10_000, 20 * wanted)))).first()
    bounds = sorted({least, *(cuts or [])}) if n else [0]
    own = _range_of(key, bounds)
    begins = F.get(_longs(bounds), F.col("own")) == key
    at = lambda r, follows: F.struct(r.alias("range"), F.lit(follows).alias("follows"))
    before = F.when(F.col("own") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("own") - 1)
    rows = rows.withColumn("own", own)
    rows = rows.select("doc_id", "text", F.explode(F.when(begins, F.array(at(F.col("own"), False), at(before, True))).otherwise(F.array(at(F.col("own"), False)))).alias("at"))
    return rows.select("at.range", "at.follows", "doc_id", "text"), len(bounds)


def edit_with_next(docs: DataFrame, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """Fingerprints of each text, of the text edited with its successor, and their likeness.

    The edited text is the document without its last floor(n / 2) code points,
    followed by as many first code points (or all) of the next document by
    doc_id (null first, then ascending); the last document is followed by the
    first.

    Texts move once: rows go to ranges of doc_id whose bounds are existing ids, so
    the row that follows a range is known without a second pass. The driver holds
    the bounds only.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def made(seq: list[tuple[int | None, str]], pairs: list[int]) -> pa.RecordBatch:
        edited = [(a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode() for a, b in ((seq[i][1], seq[i + 1][1]) for i in pairs)]
        low, filled = bins([t.encode() for _, t in seq])
        low_e, filled_e = bins(edited)
        own, after = np.array(pairs), np.array(pairs) + 1
        columns = [
            pa.array([seq[i][0] for i in pairs], pa.int64()),
            pa.array([len(seq[i][1]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array(packed(low[own])),
            pa.array(packed(low_e)),
            pa.array(likeness(low[own], low_e, filled[own], filled_e)),
            pa.array(likeness(low[own], low[after], filled[own], filled[after])),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, pairs, size, ended = [], [], 0, None
        open_range = None
        for batch in batches:
            for r, follows, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ended == r:
                    continue  # further rows of the following id
                if open_range == r:
                    pairs.append(len(seq) - 1)
                seq.append((doc_id, text))
                size += len(text)
                open_range, ended = (None, r) if follows else (r, ended)
                if pairs and (size > BATCH_BYTES or len(seq) > BATCH_ROWS):
                    yield made(seq, pairs)
                    seq, pairs, size = seq[-1:], [], len(text)
        if pairs:
            yield made(seq, pairs)

    rows, ranges = _with_successors(docs, docs_per_range)
    placed = rows.repartitionById(ranges, "range").sortWithinPartitions("range", "follows", F.col("doc_id").asc_nulls_first(), "text")
    return placed.mapInArrow(run, schema)
