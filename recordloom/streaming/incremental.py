"""Exact linkage of newly arriving source-1 records against a standing corpus.

The same column functions serve batch and stream. Equal-key joins run as
stream-static joins; blocking by tokens needs a ranking over all of a query's tokens,
so it runs on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.functions.text import prepare
from recordloom.operators.blocking import Blocker


def link_stream(arriving: DataFrame, corpus: DataFrame, key: str = "name_key", unicode: str = "nfkc") -> DataFrame:
    """Pairs of a streaming ``arriving`` and a static ``corpus`` of equal country and key.

    The corpus side is made distinct, so a source-1 record that arrives once gives
    each pair once; no state is kept.
    """
    side = lambda df, name: prepare(df, unicode).select(F.col("entity_id").alias(name), "country", F.col(key).alias("key")).where("key <> ''")
    return side(arriving, "source1_entity_id").join(side(corpus, "entity_id").distinct(), ["country", "key"]).select("source1_entity_id", "entity_id")


def block_stream(arriving: DataFrame, corpus: DataFrame, blocker: Blocker, sink: Callable[[DataFrame, int], None], checkpoint: str, unicode: str = "nfkc") -> StreamingQuery:
    """Any blocker, applied to each micro-batch; ``sink`` gets the pairs and the batch's number."""
    standing = prepare(corpus, unicode)

    def each(batch: DataFrame, number: int) -> None:
        sink(blocker.candidates(prepare(batch, unicode), standing), number)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
