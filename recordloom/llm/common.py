"""What the corpus operators share: inputs, shared folders and batch iteration."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator
from itertools import filterfalse, islice
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import new_folder, release


#: Strings whose ids a worker keeps, beside those of the batch at hand; longer ones are not kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40
#: Bytes of a column after which a worker returns free memory.
GIVE_BACK_BYTES = 8 << 20


class Known[K: (str, bytes)](dict[K, bytes]):
    """The ids of strings met so far; the older half is forgotten when there are too many."""

    def missing(self, lists: Iterable[list[K]]) -> list[K]:
        """The strings of ``lists`` that aren't known, once each."""
        if len(self) > CACHE_ENTRIES:
            for w in list(islice(self, len(self) // 2)):
                del self[w]
        found: set[K] = set()
        for own in lists:
            found.update(filterfalse(self.__contains__, own))
        return list(found)

    def forget_long(self, new: list[K]) -> None:
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            del self[w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as Spark reads it, from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``docs``; a null text is empty, other columns go."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage. ``discard`` deletes it."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[written] = path
    return written


_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize``, once all that reads them is written itself."""
    for df in written:
        release(df.sparkSession, [_path_of.pop(df)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each and at most ``rows`` rows, one row at least.

    Free memory is given back to the system now and then and when the batches are
    done: workers outlive tasks, and a machine has many of them.
    """
    used = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(ends, before + limit, "right"))), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at, before, used = to, int(ends[to - 1]), used + int(ends[to - 1]) - before
            if used >= GIVE_BACK_BYTES:
                give_back()
                used = 0
    give_back()


def give_back() -> None:
    """Return the process's free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_thread() -> None:
    """Keep the tokenizers library to one thread, unless the process says otherwise: a worker has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def hex_of(value: Column, digits: int) -> Column:
    """Lower-case hex of a long's bits, padded to ``digits``."""
    return F.lpad(F.lower(F.hex(value)), digits, "0")
