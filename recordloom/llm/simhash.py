"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where over half of the XXH64 hashes of a text's
shingles have it set. Two documents are linked if their fingerprints differ in at
most ``RADIUS`` bits; a document's class is what links reach.

Only distinct fingerprints are compared. Those within two bits agree in at least
two of four 16-bit blocks, so each one is filed under the six pairs of its blocks,
and only files with several members are compared. Inside a file the fingerprints
stand vertically: one row of 64-bit words for each of the 64 bit positions. A
query's distances to all others are counted in carry-save form, two bits and an
overflow for each lane, a bit plane at a time; a block of lanes is abandoned as
soon as all of them have overflowed. What a query finds leaves the file's
unvisited lanes, so a file of m members gives at most m - 1 links, a spanning
forest of its links, and no pair is written twice.

A file of over ``FILE_LIMIT`` members is filed anew by a block of its remaining
bits, exactly, since two bits cannot touch all three of them; after two such levels
a file's fingerprints can differ in 15 bits only, so its size is bounded.

Defined cases: a null text is empty; a text without words has fingerprint zero and
is linked like any other; fewer words than a shingle are one shingle; repeated
rows are linked; further columns are dropped (``classes``) or kept
(``keep_one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize, pieces, texts
from recordloom.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
BATCH_BYTES = 2 << 20
FILE_LIMIT = 4096
#: Bits of the blocks at each level: 4 of 16 bits (two must agree), then three
#: blocks of the bits that remain (one must agree).
BLOCKS = [(0, 16), (16, 32), (32, 48), (48, 64)]


def fingerprints(values: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    at = np.zeros(len(values) + 1, np.int64)
    for k, text in enumerate(values):
        words = text.lower().split()
        if words:
            line, n = b" ".join(words), max(1, len(words) - width + 1)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: n - 1].tolist()]
            stops = (ends[-n:] - 1).tolist()
            hashes += [xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops)]
        at[k + 1] = len(hashes)
    out = np.zeros(len(values), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        over = 2 * ones > np.diff(at)[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES, 20_000):
            fp = fingerprints(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


_LANES = 64


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of every value, 64 values a word."""
    n = -(-len(values) // _LANES) * _LANES
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, query: int, lanes: np.ndarray, order: list[int]) -> np.ndarray:
    """The lanes (a mask of bits) among ``lanes`` whose value differs from ``query`` in at most two bits.

    ``order`` has the bit positions that can differ. Counters are kept carry-save:
    ``one`` and ``two`` are the count's bits, ``over`` is set from three on. Words
    whose lanes are all over are abandoned.
    """
    live = np.flatnonzero(lanes)
    one = np.zeros(len(live), np.uint64)
    two, over = one.copy(), ~lanes[live]
    for k, p in enumerate(order):
        differ = planes[p, live]
        if query >> p & 1:
            differ = ~differ
        carry = one & differ
        one ^= differ
        over |= two & carry | (two & one)
        two ^= carry
        if k % 8 == 7:
            rest = np.flatnonzero(~over)
            if len(rest) < len(live):
                live, one, two, over = live[rest], one[rest], two[rest], over[rest]
                if not len(live):
                    break
    out = np.zeros(len(lanes), np.uint64)
    out[live] = ~over
    return out


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit by bit, the sum of three planes as (ones, twos)."""
    either = a ^ b
    return either ^ c, a & b | either & c


def beyond(planes: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of ``lanes``, those that differ from their query in more than ``radius`` bits; other lanes are set too.

    ``planes`` and ``query`` are (bits, words), the bits a multiple of eight. Counters
    are kept carry-save: eight planes are summed by full adders into ones, twos and
    fours, and what carries into the eights ripples up. They begin so that the last
    of them overflows at ``radius + 1``. Words whose lanes are all over are abandoned.
    """
    full = np.uint64((1 << 64) - 1)
    bits = max(3, radius.bit_length())
    start = (1 << bits) - 1 - radius
    live = np.flatnonzero(lanes)
    out = np.full(len(lanes), full)
    count = [np.full(len(live), full if start >> k & 1 else 0, np.uint64) for k in range(bits)]
    over = ~lanes[live]
    planes, query = planes[:, live], query[:, live]
    for at in range(0, len(planes), 8):
        x = planes[at : at + 8] ^ query[at : at + 8]
        one, a = _full_add(count[0], x[0], x[1])
        one, b = _full_add(one, x[2], x[3])
        two, c = _full_add(count[1], a, b)
        one, a = _full_add(one, x[4], x[5])
        count[0], b = _full_add(one, x[6], x[7])
        count[1], d = _full_add(two, a, b)
        count[2], carry = _full_add(count[2], c, d)
        for k in range(3, bits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        rest = np.flatnonzero(~over)
        if not len(rest):
            return out
        if 2 * len(rest) < len(live):
            live, over, planes, query = live[rest], over[rest], planes[:, rest], query[:, rest]
            count = [c[rest] for c in count]
    out[live] = over
    return out


def spanning_forests(prints: np.ndarray, first: np.ndarray, radius: int) -> np.ndarray:
    """Links (i, j) between rows of ``prints`` (n, words of 64 bits), a spanning forest of the pairs within ``radius`` in each file.

    File f has the rows first[f]:first[f + 1]. All files advance together: in each
    step every file that has unvisited rows holds one row, a found one first, against
    them; what it finds is visited. A file of m rows gives at most m - 1 links.
    """
    width = 64 * prints.shape[1]
    links = []
    sizes = np.diff(first)
    two = first[:-1][sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= radius
    links.append(np.stack([two[near], two[near] + 1], axis=1))
    files = np.flatnonzero(sizes > 2)
    words = -(-sizes[files] // _LANES)
    at = np.concatenate([[0], np.cumsum(words)])  # each file's words
    rows = np.concatenate([np.arange(first[f], first[f + 1]) for f in files]) if len(files) else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(files)), sizes[files])
    lane = _LANES * at[own] + rows - first[files][own]
    bits = np.zeros((_LANES * at[-1], width), np.uint8)
    bits[lane] = np.unpackbits(np.ascontiguousarray(prints[rows]).view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.reshape(at[-1], _LANES, width).transpose(2, 0, 1).reshape(width, -1), axis=1, bitorder="little")).view(np.uint64)
    row_of = np.zeros(_LANES * at[-1], np.int64)
    row_of[lane] = rows
    fresh = np.zeros(_LANES * at[-1], bool)
    fresh[lane] = True
    found = np.zeros(_LANES * at[-1], bool)
    while fresh.any():
        # of each file the first found lane, or else the first fresh one
        order = np.where(found, 0, np.where(fresh, 1, 2)) * (1 << 40) + np.arange(len(fresh))
        query = np.minimum.reduceat(order, _LANES * at[:-1]) & (1 << 40) - 1
        found[query] = fresh[query] = False
        mask = np.repeat((bits[query].T.astype(np.uint64) * np.uint64((1 << 64) - 1)), np.diff(at), axis=1)
        lanes = np.packbits(fresh, bitorder="little").view(np.uint64)
        hit = np.unpackbits((~beyond(planes, mask, lanes, radius)).view(np.uint8), bitorder="little").astype(bool)
        met = np.flatnonzero(hit)
        owner = np.searchsorted(_LANES * at, met, "right") - 1
        links.append(np.stack([row_of[query[owner]], row_of[met]], axis=1))
        fresh[met], found[met] = False, True
        open_ = np.maximum.reduceat(fresh, _LANES * at[:-1])
        if 2 * open_.sum() < len(open_):  # only files with unvisited rows go on
            keep = np.repeat(np.repeat(open_, np.diff(at)), _LANES)
            planes = planes[:, keep[::_LANES]]
            bits, row_of, fresh, found = bits[keep], row_of[keep], fresh[keep], found[keep]
            at = np.concatenate([[0], np.cumsum(np.diff(at)[open_])])
    return np.concatenate(links)


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``values``: (least value reached first, other)."""
    n = len(values)
    if n == 2:
        a, b = int(values[0]), int(values[1])
        return [(a, b)] if (a ^ b).bit_count() <= RADIUS else []
    planes = _planes(values)
    same = np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values)
    order = [p for p in range(64) if int(same) >> p & 1]
    lanes = np.packbits(np.pad(np.ones(n, np.uint8), (0, -n % _LANES)), bitorder="little").view(np.uint64)
    links = []
    for root in range(n):
        if not int(lanes[root // _LANES]) >> (root % _LANES) & 1:
            continue
        lanes[root // _LANES] &= ~np.uint64(1 << (root % _LANES))
        todo = [root]
        while todo:
            i = todo.pop()
            found = within(planes, int(values[i]), lanes, order)
            if found.any():
                lanes &= ~found
                near = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
                links += [(int(values[root]), int(values[j])) for j in near]
                todo += near.tolist()
    return links


def _bits(fp: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _thirds(rest: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The bits of ``rest`` cut into three blocks."""
    bits = [p for a, b in rest for p in range(a, b)]
    cut = [bits[k * len(bits) // 3 : (k + 1) * len(bits) // 3] for k in range(3)]
    out = []
    for block in cut:
        runs: list[list[int]] = []
        for p in block:
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        out.append([(a, b) for a, b in runs])
    return out


def _key(fp: Column, block: list[tuple[int, int]]) -> Column:
    """The bits of ``block`` side by side in a long; at most 32 of them."""
    key, at = F.lit(0).cast("long"), 0
    for a, b in block:
        key = key.bitwiseOR(F.shiftleft(_bits(fp, a, b), at))
        at += b - a
    return key


def _filed(rows: DataFrame, tables: list[tuple[int, list[tuple[int, int]]]], *within_key: str) -> DataFrame:
    """Each fingerprint under its tables: (table, key, fp).

    ``tables`` are (number, bits of the key). Keys are hashed; files that meet by
    a collision cost a comparison and add no link.
    """
    made = [F.struct(F.lit(t).alias("table"), F.xxhash64(*within_key, _key(F.col("fp"), block)).alias("key")) for t, block in tables]
    return rows.select("fp", F.explode(F.array(*made)).alias("f")).select("f.table", "f.key", "fp")


def _compared(files: DataFrame) -> DataFrame:
    """The links inside each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            links: list[tuple[int, int]] = []
            for members in pdf["fps"]:
                links += spanning_links(np.unique(np.asarray(members, np.int64).view(np.uint64)))
            if links:
                both = np.array(links, np.uint64).view(np.int64)
                yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    grouped = files.groupBy("table", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return grouped.select("fps").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps`` (fp), enough to connect every class.

    ``fps`` is read several times; give a written table.
    """
    pairs = list(combinations(range(4), 2))
    files = _filed(fps, [(t, [BLOCKS[i], BLOCKS[j]]) for t, (i, j) in enumerate(pairs)])
    rests = [[b for k, b in enumerate(BLOCKS) if k not in p] for p in pairs]
    found = None
    for level in range(3):
        sizes = materialize(files.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-files")
        big = sizes.where(F.col("n") > file_limit)
        last = level == 2 or big.isEmpty()
        small = sizes if last else sizes.where(F.col("n") <= file_limit)
        own = _compared(files.join(small.select("table", "key"), ["table", "key"]))
        found = own if found is None else found.unionByName(own)
        if last:
            return found
        hot = files.join(big.select("table", "key"), ["table", "key"])
        again, rests_now = None, []
        for t, rest in enumerate(rests):
            thirds = _thirds(rest)
            part = _filed(hot.where(F.col("table") == t), [(len(rests_now) + k, block) for k, block in enumerate(thirds)], "table", "key")
            again = part if again is None else again.unionByName(part)
            rests_now += [[x for j, b in enumerate(thirds) if j != k for x in b] for k in range(3)]
        files, rests = materialize(again, "simhash-refiled"), rests_now
    raise AssertionError


def classes(docs: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hex digits and the smallest doc_id reachable."""
    printed = materialize(fingerprint_documents(docs), "simhash-documents")
    least = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = components(links(least.select("fp"), file_limit), "simhash-components")
    of = least.join(joined, least.fp == joined.node).select("fp", "least", "root")
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(roots, "root").select("fp", "component_id")
    of_each = materialize(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-classes")
    return printed.join(of_each, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id; all columns stay.

    Rows without a doc_id stay. Of rows that repeat a doc_id all or none stay.
    """
    kept = classes(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
