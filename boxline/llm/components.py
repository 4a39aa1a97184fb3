"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import discard, stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """Root (smallest node) of every linked node but the roots themselves: columns ``node``, ``root``.

    ``edges`` has long columns ``a`` and ``b``; loops and repeats are harmless.
    Each round turns every node's edges towards its smallest neighbour, first
    for larger and then for smaller neighbours, and ends when nothing changes.
    Rounds are written tables, so lineage stays short and no link is ever held
    on the driver. Joins on a star's hub are left to AQE's skew join.
    """
    loop = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stored(loop, "edges")
    before = _checksum(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(lowest.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(lowest).distinct(), "edges")
        checksum = _checksum(after)
        discard(current)
        current = after
        if checksum == before:
            break
        before = checksum
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
