"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else,
in the same document or another, is removed; strings are judged on the input.

1. Anchors. Among the ``ANCHOR``-byte strings inside a window of ``LENGTH`` bytes
   the one of least hash is the window's anchor, so equal windows have equal
   anchors at equal distances. Consecutive windows of one anchor form a context. A
   context whose anchor occurs once in the corpus holds no repeated window; all
   others go on. Equal contexts are merged and counted.
2. Shards. Contexts go to shards by their anchor, so equal windows meet. Each shard's
   text gets a suffix array (Larsson-Sadakane) and common prefixes (Kasai). Windows
   that stand together with common prefixes of ``LENGTH`` are one string, and one
   that occurs twice, counted with its contexts, is repeated.
3. Merging. Contexts of an anchor with over ``HOT`` of them, as any common passage has,
   are dealt over several shards. Such a shard also writes its distinct windows in
   suffix order; the shards' runs are merged by binary search, and windows that meet an
   equal one there are repeated too. Very long runs are cut into parts by a hash of the
   window, so equal windows are in the same part.
4. The repeated windows of a document are joined to it and its bytes cut.

Texts are read three times and cross the network twice, compressed; nothing is
gathered on the driver but sums. Anchors (64 bits) and contexts (64 more within an
anchor) are told apart by hash, documents by doc_id and a hash of the text, windows by
their bytes.

Defined cases: a null text is empty; a text of under ``LENGTH`` bytes keeps all of
them; repeated rows are documents like any others, so each one's strings start
elsewhere, but are searched once; further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, materialize, pieces, texts
from recordloom.llm.shingles import mix
from recordloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH, ANCHOR = 200, 88
#: Contexts of one anchor in one shard; bytes of a shard; windows of a merged part.
HOT, SHARD_BYTES, PART_WINDOWS = 128, 2 << 20, 1 << 16
BATCH_BYTES = 1 << 20
_POSITION_BITS = 32
#: What a document is known by: its doc_id and a hash of its text.
KEY = ("doc", "of")


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _side_by_side(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on in one word; as many places as hold eight."""
    n = max(0, len(data) - 7)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= data[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    return out


class Spans:
    """Hashes of any spans of eight bytes or more of a text, as differences of polynomial prefix sums.

    The sums are over mixed words of eight bytes, not over bytes: regular texts
    (Thue-Morse words) make polynomials in the bytes agree modulo 2**64.
    """

    def __init__(self, data: np.ndarray, base: int = 0xC2B2AE3D27D4EB4F) -> None:
        size = 1 << max(21, len(data).bit_length())
        power, self.inverse = _powers(size, base)
        values = mix(_side_by_side(data) + np.uint64(base))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - 7] - self.sums[start]) * self.inverse[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by block-wise running minima."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def contexts(values: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The contexts of each text: owner, anchor hash ``ah``, context hash ``ch``, first window ``lo`` and number of windows ``n``."""
    sizes = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    first = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(values)), counts)
    if not len(owner):
        return {k: np.zeros(0, np.int64) for k in ("owner", "ah", "ch", "lo", "n")}
    spans = Spans(data)
    place = np.arange(len(data) - anchor + 1)
    hashes = spans.of(place, place + anchor)
    low = np.uint64((1 << _POSITION_BITS) - 1)  # of equal upper bits the first counts, wherever the window stands
    least = _sliding_least(hashes & ~low | place.astype(np.uint64), length - anchor + 1)
    at = (least & low).astype(np.int64)  # of each window: its anchor
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
    at = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(window)))
    lo, at, owner = window[begin], at[begin], owner[begin]
    ch = spans.of(lo, lo + n + length - 1) + (n * 65536 + at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return {"owner": owner, "ah": hashes[at].view(np.int64), "ch": mix(ch).view(np.int64), "lo": lo - first[owner], "n": n}


def _segments(values: list[bytes], length: int, limit: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """(segments, owners, offsets), about ``limit`` bytes at a time.

    A longer text is cut into segments that overlap by one byte less than a
    window, so each of its windows is in one of them.
    """
    found: tuple[list[bytes], list[int], list[int]] = ([], [], [])
    size = 0
    for i, v in enumerate(values):
        for at in range(0, max(1, len(v) - length + 1), limit):
            segment = v[at : at + limit + length - 1]
            for kept, x in zip(found, (segment, i, at)):
                kept.append(x)
            size += len(segment)
            if size >= limit:
                yield found
                found, size = ([], [], []), 0
    if found[0]:
        yield found


def _anchor_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(ah, ch, doc, of, lo, n) of every context of every row of (doc, of, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            for parts, owners, offsets in _segments(batch.column("text").cast(pa.binary()).to_pylist(), length, BATCH_BYTES):
                found = contexts(parts, length, anchor)
                owner, lo = np.array(owners)[found["owner"]], found["lo"] + np.array(offsets)[found["owner"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["ah"], pa.int64()), pa.array(found["ch"], pa.int64()), *(batch.column(k).take(pa.array(owner, pa.int64())) for k in KEY), pa.array(lo, pa.int32()), pa.array(found["n"], pa.int16())],
                    ["ah", "ch", *KEY, "lo", "n"],
                )

    return docs.select(*KEY, "text").mapInArrow(run, "ah long, ch long, doc long, of long, lo int, n short")


def _compressed(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and the text as a zstandard frame ``z``, for the shuffles."""
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in kept) + ", z binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text", BATCH_BYTES):
            z = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(z, pa.binary())], [*kept, "z"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


_CONTEXT = "shard long, ah long, ch long, times long, hot int, n short, bytes binary"


def _cut_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(shard, ah, ch, times, hot, n, bytes) of the contexts listed with each compressed text."""
    names = ["shard", "ah", "ch", "times", "hot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "z", BATCH_BYTES // 4):
            lists = batch.column("wanted")
            flat, counts = lists.flatten(), lists.value_lengths().to_pylist()
            at, los, ns, cut = 0, flat.field("lo").to_pylist(), flat.field("n").to_pylist(), []
            for z, k in zip(batch.column("z").to_pylist(), counts):
                text = expand.decompress(z)
                cut += [text[lo : lo + n + length - 1] for lo, n in zip(los[at : at + k], ns[at : at + k])]
                at += k
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(cut, pa.binary())], [*names, "bytes"])

    return rows.select("z", "wanted").mapInArrow(run, _CONTEXT)


def repeated_windows(parts: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(repeated, context, window, place, order) over all windows of the contexts ``parts``, which occur ``times`` each.

    ``place`` is where a window stands in the joined parts; ``order`` numbers distinct windows in suffix order.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = sizes - length + 1
    data = np.frombuffer(b"".join(parts), np.uint8)
    context = np.repeat(np.arange(len(parts)), counts)
    window = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.cumsum(sizes) - sizes)[context] + window
    sa, rank = suffix_array(data)
    run = np.cumsum(common_prefixes(data, sa, length) < length)
    order = run[rank[place]]
    total = np.bincount(order, weights=times[context], minlength=int(run[-1]) + 1)
    return total[order] >= 2, context, window, place, order


def _spans_of(mask: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, alternating."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()


#: A run's windows: the context, the window in it, and whether the shard knows it to be repeated.
_MEMBER = [("ch", "<i8"), ("w", "<i2"), ("known", "<i2")]
_FOUND = "ah long, ch long, spans array<int>, part int, members binary, windows binary"


def _search_shard(table: pa.Table, length: int) -> pa.Table:
    """Repeated windows of one shard's contexts, and the runs to merge of its dealt anchors."""
    import zstandard

    table = table.combine_chunks()
    contents = table.column("bytes").to_pylist()
    ah, ch, hot = (table.column(c).to_numpy() for c in ("ah", "ch", "hot"))
    repeated, context, window, place, order = repeated_windows(contents, table.column("times").to_numpy(), length)
    # runs of repeated windows, cut where a context ends
    follows = np.zeros(len(repeated), bool)
    follows[1:] = repeated[:-1] & (context[1:] == context[:-1])
    ends = np.flatnonzero(repeated & ~np.append(follows[1:] & repeated[1:], False))
    begins = np.flatnonzero(repeated & ~follows)
    spans = np.stack([window[begins], window[ends] + 1], axis=1).astype(np.int32)
    own, counts = np.unique(context[begins], return_counts=True)
    listed = [x.ravel().tolist() for x in np.split(spans, np.cumsum(counts)[:-1])] if len(own) else []
    out: dict[str, list] = {"ah": ah[own].tolist(), "ch": ch[own].tolist(), "spans": listed, "part": [-1] * len(own), "members": [None] * len(own), "windows": [None] * len(own)}
    if hot.any():
        data = np.frombuffer(b"".join(contents), np.uint8)
        every, hashes, press = np.lib.stride_tricks.sliding_window_view(data, length), Spans(data), zstandard.ZstdCompressor(level=1)
        which = np.flatnonzero(hot[context] > 0)
        # of equal windows one is enough to tell the others, which are known to be repeated
        by_anchor = np.lexsort((order[which], ah[context[which]]))
        which = which[by_anchor]
        owner = ah[context[which]]
        first = np.ones(len(which), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (order[which][1:] != order[which][:-1])
        which, owner = which[first], owner[first]
        parts = hot[context[which]].astype(np.uint64)
        part = ((hashes.of(place[which], place[which] + length) >> np.uint64(32)) * parts >> np.uint64(32)).astype(np.int64)
        by_part = np.lexsort((np.arange(len(which)), part, owner))
        which, owner, part = which[by_part], owner[by_part], part[by_part]
        members = np.zeros(len(which), _MEMBER)
        members["ch"], members["w"], members["known"] = ch[context[which]], window[which], repeated[which]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (part[1:] != part[:-1])) + 1
        for at in np.split(np.arange(len(which)), cut):
            strings = press.compress(np.ascontiguousarray(every[place[which[at]]]).tobytes())
            for c, v in zip(out, (int(owner[at[0]]), 0, [], int(part[at[0]]), members[at].tobytes(), strings)):
                out[c].append(v)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def merge_sorted(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two runs (windows in order, members) as one: the places of the second by binary search in the first."""
    places = np.searchsorted(x[0], y[0], "right") + np.arange(len(y[0]))
    rest = np.ones(len(x[0]) + len(y[0]), bool)
    rest[places] = False
    out = []
    for a, b in zip(x, y):
        both = np.empty(len(rest), a.dtype)
        both[places], both[rest] = b, a
        out.append(both)
    return out[0], out[1]


def _merge_runs(table: pa.Table, length: int) -> pa.Table:
    """Windows of one anchor and part that occur in several shards' runs."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    runs = [(np.frombuffer(expand(x), f"S{length}"), np.frombuffer(m, _MEMBER)) for x, m in zip(table.column("windows").to_pylist(), table.column("members").to_pylist())]
    while len(runs) > 1:
        runs = [merge_sorted(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    windows, members = runs[0]
    same = np.zeros(len(windows) + 1, bool)
    same[1:-1] = windows[1:] == windows[:-1]
    found = members[(same[1:] | same[:-1]) & (members["known"] == 0)]
    found = found[np.lexsort((found["w"], found["ch"]))]
    cut = np.flatnonzero(found["ch"][1:] != found["ch"][:-1]) + 1
    groups = [g for g in np.split(found, cut) if len(g)]
    spans = []
    for g in groups:
        mask = np.zeros(int(g["w"].max()) + 1, bool)
        mask[g["w"]] = True
        spans.append(_spans_of(mask))
    a = table.column("ah")[0].as_py()
    return pa.table({"ah": pa.array([a] * len(groups), pa.int64()), "ch": pa.array([int(g["ch"][0]) for g in groups], pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32()))})


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """The result for each compressed text with its spans of repeated windows."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<int>, ends array<int>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "z", BATCH_BYTES):
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            lists = batch.column("found")
            parts, counts = lists.flatten(), np.array([0 if k is None else k for k in lists.value_lengths().to_pylist()])
            spans, sizes = parts.field("spans"), parts.field("spans").value_lengths().to_numpy(zero_copy_only=False)
            edges = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(parts.field("lo").to_numpy(zero_copy_only=False), sizes)
            last = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)] if len(counts) else []
            before = 0
            for doc_id, z, upto in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), last):
                text, own, before = expand.decompress(z), edges[before:upto], upto
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, own[::2], 1)
                np.add.at(edge, own[1::2] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cut = _spans_of(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if cut else text
                for c, v in zip(out, (doc_id, len(text), len(text) - len(kept), len(cut) // 2, cut[::2], cut[1::2], kept)):
                    out[c].append(v)
            types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return rows.select("doc_id", "z", "found").mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept) for each row.

    ``starts`` and ``ends`` bound the removed byte runs, ``kept`` has the bytes left.
    """
    rows = texts(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "of": F.xxhash64("text", "doc_id")})
    found = materialize(_anchor_rows(rows, length, anchor), "substring-all")
    several = found.groupBy("ah").agg(F.count("*").alias("times")).where("times > 1").select("ah")
    several = materialize(several, "substring-anchors")
    listed = materialize(found.join(several, "ah"), "substring-contexts")
    discard(found, several)
    distinct = listed.groupBy("ah", "ch").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "lo", "n")).alias("one"))
    distinct = materialize(distinct.select("ah", "ch", "times", "one.*"), "substring-distinct")
    total = distinct.agg(F.sum(F.col("n") + F.lit(length - 1))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    crowded = distinct.groupBy("ah").agg(F.count("*").alias("members"), F.sum("n").alias("windows")).where(F.col("members") > hot)
    # of such an anchor: the shards that its contexts are dealt over, and the parts that its windows are merged in
    crowded = materialize(crowded, "substring-hot")
    dealt = distinct.join(crowded, "ah", "left")
    salt = F.coalesce(F.pmod("ch", F.ceil(F.col("members") / F.lit(hot))), F.lit(0))
    parts = F.coalesce(F.ceil(F.col("windows") / F.lit(PART_WINDOWS)), F.lit(0)).cast("int")
    shard = F.pmod(F.xxhash64("ah", salt), F.lit(shards))
    wanted = dealt.select(*KEY, F.struct(shard.alias("shard"), "ah", "ch", "times", parts.alias("hot"), "lo", "n").alias("w"))
    wanted = wanted.groupBy(*KEY).agg(F.collect_list("w").alias("wanted"))
    cut = _cut_contexts(_compressed(rows, [*KEY]).join(wanted, [*KEY]).dropDuplicates([*KEY]), length)
    searched = materialize(cut.groupBy("shard").applyInArrow(lambda t: _search_shard(t, length), _FOUND), "substring-found")
    discard(distinct, crowded)
    local = searched.where("part < 0").select("ah", "ch", "spans")
    merged = searched.where("part >= 0").groupBy("ah", "part").applyInArrow(lambda t: _merge_runs(t, length), "ah long, ch long, spans array<int>")
    repeated = listed.select("ah", "ch", *KEY, "lo").join(local.unionByName(merged), ["ah", "ch"])
    of_doc = repeated.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "spans")).alias("found"))
    return _removed(_compressed(rows, [*KEY, "doc_id"]).join(of_doc, [*KEY], "left"), length)
