"""Pairs of a query and a record whose token lists overlap, counted cell by cell.

A cell is a part of a country's queries against a block of its records. Each record goes to
every part and each query to every block, so what is shuffled grows with the records and
not with the tokens that pairs share: a pair is counted in one cell, in memory, and
leaves it once, with no shuffle after it. Queries of equal tokens are counted once and
records of equal tokens are one position; both come back as lists, which the engine unfolds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a country's queries at most, of so many queries or more; so often a record is sent.
PARTS, PART_ROWS = 32, 1024
#: Records in a block at most, about. Parquet's dictionary of a column ends at 1 MB, some 80,000 ids, past which each pair
#: is written with its ids in full; and ids of 16 bits, as over 32,768 of them have, stand on whole bytes and so compress.
BLOCK_ROWS = 64_000
#: Queries that share a row of equal tokens at most; ids of one batch from Python, about.
SLICE, BATCH_IDS = 256, 200_000
#: Tasks of the counting at most.
TASKS = 1000
#: Records of a list from Python, about; what stands together in a column then repeats within a short stretch.
RUN = 128
#: A token on more than one position of so many has a vector of counts instead of a list.
DENSE = 16


def overlapping(asked: DataFrame, held: DataFrame, n_asked: DataFrame, n_held: DataFrame, min_overlap: int) -> DataFrame:
    """(source1_entity_id, entity_id) that share ``min_overlap`` tokens, or all of a query's if it has fewer.

    ``asked`` is (source1_entity_id, country, tokens) and ``held`` (entity_id, country, tokens),
    one row each for an id and country; a token counts as often as it stands on both. ``n_asked``
    and ``n_held`` are (country, n), the rows of a country, about; only the sum of cells reaches the driver.
    """
    parts = F.least(F.lit(PARTS), F.ceil(F.col("n") / PART_ROWS))
    sizes = n_asked.select("country", parts.cast("int").alias("parts"), F.ceil(F.col("n") / BLOCK_ROWS).alias("salts"))
    sizes = sizes.join(n_held.select("country", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "country")
    n_cells = sizes.agg(F.sum(F.col("parts").cast("long") * F.col("blocks"))).first()[0] or 1
    before = F.sum(F.col("parts").cast("long") * F.col("blocks")).over(W.orderBy("country").rowsBetween(W.unboundedPreceding, -1))
    grid = sizes.withColumn("base", F.coalesce(before, F.lit(0)))

    # block by block, so that a task of several cells has few records in its file
    cell = (F.col("base") + F.col("block") * F.col("parts") + F.col("part")).alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # structs, since a list of ids leaves nulls out
    ids = lambda name: F.collect_list(F.struct(F.col(name).alias("id"))).alias("ids")

    queries = asked.join(grid, "country").withColumn("salt", F.pmod(F.xxhash64("source1_entity_id"), "salts"))
    queries = queries.groupBy("base", "parts", "blocks", "tokens", "salt").agg(ids("source1_entity_id"))
    queries = queries.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / SLICE).cast("int"))))
    queries = queries.withColumns({"sources": F.slice("ids.id", F.col("at") * SLICE + 1, F.lit(SLICE)), "part": F.pmod(F.xxhash64("tokens", "salt", "at"), "parts"), "block": every("blocks")})

    records = held.join(grid, "country").withColumn("block", F.pmod(F.xxhash64("entity_id"), "blocks"))
    records = records.groupBy("base", "parts", "blocks", "block", "tokens").agg(ids("entity_id")).withColumn("part", every("parts"))

    none = lambda df: F.lit(None).cast(T.ArrayType(df.schema["entity_id" if "entity_id" in df.columns else "source1_entity_id"].dataType))
    rows = records.select(cell, F.lit(False).alias("asks"), "tokens", none(asked).alias("sources"), F.col("ids.id").alias("entities"))
    rows = rows.unionByName(queries.select(cell, F.lit(True).alias("asks"), "tokens", "sources", none(held).alias("entities")))
    n = min(n_cells, TASKS)
    rows = rows.repartitionById(n, F.floor(F.col("cell") * n / n_cells).cast("int")).sortWithinPartitions("cell", "asks")
    found = rows.mapInArrow(_counting(min_overlap), T.StructType([rows.schema["sources"], rows.schema["entities"]]))
    return found.select(F.explode("sources").alias("source1_entity_id"), "entities").select("source1_entity_id", F.explode("entities").alias("entity_id"))


def _counting(min_overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, records, index = None, [], None
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if start == stop:
                    continue
                if cells[start] != cell:
                    cell, records, index = cells[start], [], None
                part = batch.slice(start, stop - start)
                if not asks[start]:
                    records.append(part)
                elif records or index:
                    index, records = index or _Index(records), []
                    yield from index.matches(part, min_overlap)

    return run


class _Index:
    """The records of a cell by token. Records of equal tokens are one position."""

    def __init__(self, records: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(records)
        tokens, ids = (pa.concat_arrays(table.column(c).chunks) for c in ("tokens", "entities"))
        lengths, coded = pc.list_value_length(tokens).to_numpy(), tokens.flatten().dictionary_encode()
        self.size, self.longest = len(tokens), int(lengths.max(initial=0))
        self.ids, self.members = ids.flatten(), pc.list_value_length(ids).to_numpy()
        self.single = len(self.ids) == self.size
        self.words = coded.dictionary
        code, place = coded.indices.to_numpy(), np.repeat(np.arange(self.size), lengths)
        order = np.lexsort((place, code))
        code, place = code[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])])[: len(code)])
        # a record of several rows may have a token several times
        self.times = np.diff(np.append(first, len(code))).astype(np.uint8 if self.longest < 256 else np.int64)
        self.places = place[first]
        self.starts = np.searchsorted(code[first], np.arange(len(self.words) + 1))
        self.dense: dict[int, np.ndarray] = {}

    def _vector(self, code: int) -> np.ndarray:
        if code not in self.dense:
            a, b = self.starts[code : code + 2]
            self.dense[code] = np.zeros(self.size, self.times.dtype)
            self.dense[code][self.places[a:b]] = self.times[a:b]
        return self.dense[code]

    def _hits(self, codes: np.ndarray, n_tokens: int, min_overlap: int) -> np.ndarray:
        """Places of ``ids`` that share enough."""
        enough = lambda n: (n >= min_overlap) | (n == n_tokens) if n_tokens < min_overlap else n >= min_overlap
        spans = [(c, self.starts[c], self.starts[c + 1]) for c in codes]
        total = sum(b - a for _, a, b in spans)
        if total * DENSE < self.size:
            if not total:
                return np.empty(0, np.int64)
            places, at = np.unique(np.concatenate([self.places[a:b] for _, a, b in spans]), return_inverse=True)
            places = places[enough(np.bincount(at, np.concatenate([self.times[a:b] for _, a, b in spans])))]
            if self.single:
                return places
            shared = np.zeros(self.size, bool)
            shared[places] = True
        else:
            most = self.longest * (1 + n_tokens - len(set(codes.tolist())) if len(codes) else 1)
            n = np.zeros(self.size, np.uint8 if most < 256 else np.int64)
            for c, a, b in spans:
                if (b - a) * DENSE > self.size:
                    n += self._vector(c)
                else:
                    n[self.places[a:b]] += self.times[a:b]
            shared = enough(n)
        return np.flatnonzero(shared if self.single else np.repeat(shared, self.members))

    def matches(self, queries: pa.RecordBatch, min_overlap: int) -> Iterator[pa.RecordBatch]:
        tokens, sources = queries.column("tokens"), queries.column("sources")
        ends = np.cumsum(pc.list_value_length(tokens).to_numpy())
        codes = pc.index_in(tokens.flatten(), value_set=self.words).fill_null(-1).to_numpy()
        rows, hits, held = [], [], 0
        for row, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            own = codes[a:b]
            found = self._hits(own[own >= 0], b - a, min_overlap)
            if len(found):
                rows.append(row)
                hits.append(found)
                held += len(found)
            if held >= BATCH_IDS or held and row == len(ends) - 1:
                yield self._lists(sources, np.array(rows), hits)
                rows, hits, held = [], [], 0

    def _lists(self, sources: pa.Array, rows: np.ndarray, hits: list[np.ndarray]) -> pa.RecordBatch:
        """The hits of all rows, a stretch of the records after the other, in each stretch row by row.

        A list of all of a row's hits goes through all the block's ids before one comes again; in
        a stretch the same few come for row after row, which a file holds in a fraction of the bytes.
        """
        places, lengths = np.concatenate(hits), [len(x) for x in hits]
        stretches = min(-(-len(places) // (RUN * len(rows))), 1 << 15)
        stretch = (places * stretches // len(self.ids)).astype(np.uint16)
        order = np.argsort(stretch, kind="stable")
        places, stretch, row = places[order], stretch[order], np.repeat(rows, lengths)[order]
        starts = np.flatnonzero(np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (row[1:] != row[:-1])]))
        entities = pa.ListArray.from_arrays(pa.array(np.append(starts, len(places)).astype(np.int32)), self.ids.take(pa.array(places)))
        return pa.RecordBatch.from_arrays([sources.take(pa.array(row[starts])), entities], ["sources", "entities"])
