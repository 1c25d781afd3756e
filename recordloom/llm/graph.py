"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize


def components(edges: DataFrame, what: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Alternating large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the smallest it knows. The table never
    outgrows the edges, a node of many neighbours is aggregated before the
    shuffle, and each round is written to the shared folder, so a lost executor
    costs one round. Rounds grow with the logarithm of a component's diameter.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = materialize(edges.select(*pair("a", "b")).where("a <> b").distinct(), what)
    before = None
    for _ in range(rounds):
        marks = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if marks == before or not marks[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = marks
        # large star: each node u joins its neighbours above u to the least of u and all neighbours
        least = now.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        up = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        linked = up.join(least, "u", "left").select(F.coalesce("m", "u").alias("a"), F.col("v").alias("b"))
        # small star: each node u joins itself and its neighbours below u to their least
        least = linked.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        down = linked.join(least.withColumnRenamed("u", "b"), "b").select("a", "b", "m")
        now = materialize(
            down.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(*pair("x", "y")).where("a <> b").distinct(),
            what,
        )
    raise RuntimeError(f"no fixed point after {rounds} rounds")
