"""Connected components of an edge table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestrata.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: every node hands its larger
    neighbours, then all its neighbours, to the smallest node it knows, until
    the edges are stars.  Each step is a partial aggregate and an equi-join on
    the node, so a hub with very many neighbours is split by skew handling; no
    neighbourhood is ever collected.  Steps are stored, so a lost executor costs
    one step.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        floor = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = (
            large.join(floor, F.col("u") == F.col("w"))
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        now = stored(small)
        before, mark = mark, _mark(now)
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them; three numbers reach the driver."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))
    ).first()
    return tuple(row)
