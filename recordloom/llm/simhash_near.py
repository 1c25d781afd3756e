"""SimHash near-dedup at five-word shingles and a likeness of 0.8.

Two documents are linked if the Jaccard likeness of their sets of ``WIDTH``-word
shingles is ``LIKENESS`` or more; a document's class is what links reach. 64 bits
and a radius of two (``simhash``) cannot tell that, so a fingerprint has ``BITS``
bits here and the radius is wide enough for any pair of that likeness; the exact
sets of those within it decide.

1. Files. Texts of equal sets are compared once. A set is filed under ``BANDS`` bands,
   each the hash of ``ROWS`` MinHash values; a pair of likeness s shares none of them
   with probability (1 - s**ROWS)**BANDS, 5e-8 at 0.8.
2. Bit-sliced comparison. Inside each file the fingerprints stand vertically and are
   compared as in ``simhash.spanning_forests``: a file of m members gives at most m - 1
   links, each of which is then held against the exact sets. A file of over
   ``FILE_LIMIT`` members is dealt over several, each with the same few heads.
3. A link that the sets refuse may have hidden another, so files that still hold
   several classes are compared ``TURNS`` times, with other first members; pairs
   across classes that are left after that meet by one of their rarest shingles, at
   places that leave enough of both sets to be alike. By prefix and position this
   loses no link.

A pair of likeness 0.8 differs in 15 % of the bits (19 of 128, deviation 4), sets of
four and five shingles in 19 % (24 of 128, deviation 4.4).

Defined cases: a null text is empty; texts without words are one class; a text of one
to four words is one shingle; A-Z are lower-cased; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, give_back, materialize, pieces
from recordloom.llm.graph import components
from recordloom.llm.repeats import KEY, keyed
from recordloom.llm.shingles import mix, shingles
from recordloom.llm.simhash import FILE_LIMIT, spanning_forests

WIDTH = 5
#: The likeness from which documents are linked, as a fraction.
LIKENESS = (4, 5)
BANDS, ROWS, TURNS = 32, 4, 2
BITS, RADIUS, HEADS = 128, 44, 4
BATCH_BYTES, BATCH_ROWS = 1 << 20, 2000
#: Members of the files that are compared together.
TOGETHER = 1 << 14

_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of all texts, in ascending order in each."""
    hashes, at = shingles(values, WIDTH)
    sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
    return np.concatenate([hashes[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def signatures(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(identity of each set, its bands); a set without members has identity and bands zero."""
    n = len(at) - 1
    identity, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return identity, bands
    begin = at[some]
    identity[some] = mix(np.add.reduceat(mix(hashes), begin) + np.diff(at)[some].astype(np.uint64))
    for b in range(BANDS):
        value = np.full(len(some), b + 1, np.uint64)
        for salt in _SALTS[b * ROWS : (b + 1) * ROWS]:
            value = mix(value + np.minimum.reduceat((hashes ^ salt) * (salt | np.uint64(1)), begin))
        bands[some, b] = value
    return identity, bands


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of each set, words of 64 bits: a bit is 1 where over half of the members have it set."""
    out = np.zeros((len(at) - 1, BITS // 64), np.uint64)
    some = np.flatnonzero(np.diff(at))
    for k in range(BITS // 64 if len(some) else 0):
        bits = np.unpackbits(mix(hashes + _SALTS[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * ones > np.diff(at)[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, n, fp, bands) of each row: its set's identity, size, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES, BATCH_ROWS):
            hashes, at = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            identity, bands = signatures(hashes, at)
            prints = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(identity), [None, pa.py_buffer(fingerprints(hashes, at))]).cast(pa.binary())
            ends = np.arange(len(identity) + 1) * BANDS
            columns = [pa.array(identity.view(np.int64)), pa.array(np.diff(at)), prints, _lists(np.ascontiguousarray(bands).ravel(), ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *columns], [*KEY, "s", "n", "fp", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, s long, n long, fp binary, bands array<long>")


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, n, members) of the rows of ``wanted`` (doc_id, text_hash, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES, BATCH_ROWS):
            hashes, at = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(np.diff(at)), _lists(hashes, at)], ["s", "n", "members"])

    rows, side = keyed(docs), wanted.select(F.col("doc_id").alias("__rl_doc"), F.col("text_hash").alias("__rl_hash"), "s")
    found = rows.join(side, rows["doc_id"].eqNullSafe(side["__rl_doc"]) & (rows["text_hash"] == side["__rl_hash"]))
    return found.select("s", "text").mapInArrow(run, "s long, n long, members array<long>").dropDuplicates(["s"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are alike enough."""
    of = lambda k: sets.select(F.col("s").alias(k), F.col("n").alias(f"n_{k}"), F.col("members").alias(f"of_{k}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    part, whole = LIKENESS
    return pairs.join(of("a"), "a").join(of("b"), "b").where(whole * both >= part * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _classed(filed: DataFrame, roots: DataFrame) -> DataFrame:
    """``filed`` (key, s, fp) with c, in the files that hold several classes."""
    rows = filed.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").select("key", "s", "fp", F.coalesce("root", "s").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return rows.join(mixed, "key")


def _sliced(rows: DataFrame, turn: int, file_limit: int) -> DataFrame:
    """(a, b): the members of each file that the bit-sliced comparison links, across classes.

    Members stand in the order of a hash, the same one in all files in turn 0, so
    that files with the same members give the same links.
    """
    order = F.xxhash64("s", F.lit(turn), *(["key"] if turn else []))
    member = F.struct(order.alias("o"), "s", "c", "fp")
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / F.lit(file_limit)))
    crowded = materialize(sizes.where("parts > 1"), "simhash-crowded")
    dealt = rows.join(crowded.select("key", "parts"), "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64(F.lit(turn), "s"), "parts"), F.lit(0)).alias("part"), member.alias("x"))
    firsts = rows.join(crowded.select("key", "parts"), "key").groupBy("key", "parts")
    heads = firsts.agg(*[F.min(F.struct(F.xxhash64("s", F.lit(turn), F.lit(k)).alias("by"), member.alias("x"))).alias(f"h{k}") for k in range(HEADS)])
    heads = heads.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.explode(F.array(*[F.col(f"h{k}.x") for k in range(HEADS)])).alias("x"))
    files = dealt.unionByName(heads).groupBy("key", "part").agg(F.array_sort(F.collect_set("x")).alias("xs")).where(F.size("xs") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("xs").value_lengths().to_numpy()
            flat = batch.column("xs").flatten()
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
                own = flat.slice(int(ends[at]), int(ends[to] - ends[at]))
                prints = np.frombuffer(b"".join(own.field("fp").to_pylist()), np.uint64).reshape(len(own), -1)
                i, j = spanning_forests(prints, ends[at : to + 1] - ends[at], RADIUS).T
                s, c = own.field("s").to_numpy(), own.field("c").to_numpy()
                i, j = i[c[i] != c[j]], j[c[i] != c[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[i], s[j])), pa.array(np.maximum(s[i], s[j]))], ["a", "b"])
                at = to
        give_back()

    return files.select("xs").mapInArrow(run, "a long, b long").distinct()


def _by_rarest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs across classes of ``rows`` that can be alike, by their first common shingle, rarest first.

    The shingles up to that one are of one set only, so min(n_a - i, n_b - j) is the most they have in common.
    """
    part, whole = LIKENESS
    of = sets.join(rows.select("s", "c").distinct(), "s").select("s", "c", F.explode("members").alias("m"))
    times = of.groupBy("m").agg(F.count("*").alias("times"))
    ranked = of.join(times, "m").groupBy("s", "c").agg(F.sort_array(F.collect_list(F.struct("times", "m"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.floor(F.size("ranked") * F.lit(whole - part) / whole).cast("int") + 1)
    placed = ranked.select("s", "c", F.size("ranked").alias("n"), F.posexplode(first).alias("i", "x")).where("x.times > 1")
    placed = materialize(placed.select(F.col("x.m").alias("m"), "s", "c", "n", "i"), "simhash-rarest")
    mixed = placed.groupBy("m").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("m")
    placed = placed.join(mixed, "m")
    side = lambda k: placed.select("m", F.col("s").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("c", "n", "i")])
    left = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    fits = (whole + part) * left >= part * (F.col("n_a") + F.col("n_b"))
    a, b = side("a"), side("b")
    # a place that leaves too little of its own set meets nothing
    able = lambda k: whole * (F.col(f"n_{k}") - F.col(f"i_{k}")) >= part * F.col(f"n_{k}")
    return a.where(able("a")).join(b.where(able("b")), "m").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits).select("a", "b").distinct()


def links(signed: DataFrame, docs: DataFrame, turns: int = TURNS, file_limit: int = FILE_LIMIT) -> DataFrame:
    """(node, root) of the sets that are linked: the smallest identity reachable.

    ``signed`` is a written table of ``_signed(docs)``.
    """
    spark = docs.sparkSession
    filed = signed.select(F.explode("bands").alias("key"), "s", "fp").distinct()
    crowded = filed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    filed = materialize(filed.join(crowded, "key"), "simhash-bands")
    chosen = signed.join(filed.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.min(F.struct(*KEY)).alias("k"))
    sets = materialize(_members(docs, chosen.select("k.*", "s")), "simhash-sets")
    found, roots = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")
    for turn in range(turns + 1):
        before, filed = filed, materialize(_classed(filed.drop("c"), roots), "simhash-mixed")
        discard(before)
        if filed.isEmpty():
            break
        pairs = materialize(_sliced(filed, turn, file_limit) if turn < turns else _by_rarest(filed, sets), "simhash-pairs")
        found = materialize(found.unionByName(_alike(pairs, sets)), "simhash-links")
        roots = components(found, "simhash-components")
        discard(pairs)
    discard(filed, sets)
    return roots


def keep_one_of_each(docs: DataFrame, turns: int = TURNS, file_limit: int = FILE_LIMIT) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id, then text hash; null ids come last."""
    signed = materialize(_signed(docs), "simhash-signed")
    roots = links(signed, docs, turns, file_limit)
    classed = signed.join(roots, signed["s"] == roots["node"], "left").select(*KEY, F.coalesce("root", "s").alias("c"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    firsts = classed.groupBy("c").agg(F.min(place).alias("first")).select("first.doc_id", "first.text_hash")
    times = signed.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1")
    again = times.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.lit(True).alias("again"))
    kept = firsts.join(again, firsts["doc_id"].eqNullSafe(again["d"]) & (firsts["text_hash"] == again["h"]), "left")
    kept = materialize(kept.select(F.col("doc_id").alias("__rl_doc"), F.col("text_hash").alias("__rl_hash"), F.coalesce("again", F.lit(False)).alias("__rl_again")), "simhash-kept")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__rl_doc"]) & (key == kept["__rl_hash"]))
    # only rows that are repeated as a whole move again
    single = joined.where(~F.col("__rl_again")).select(*docs.columns)
    repeated = joined.where("__rl_again").dropDuplicates(["__rl_doc", "__rl_hash"]).select(*docs.columns)
    return single.unionByName(repeated)
