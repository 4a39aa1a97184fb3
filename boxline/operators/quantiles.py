"""Exact quantiles that never hold one group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def exact_quantile(df: DataFrame, value: str, prob: float, keys: Sequence[str] = (), weight: str | None = None, name: str = "quantile") -> DataFrame:
    """Quantile with linear interpolation, per group or over all rows.

    Equal values are counted first. Counts are then totalled in buckets of
    nearby values, so that only the one or two buckets which hold the wanted
    ranks are ordered value by value. A bucket spans about 1% of a value's size, so
    a group with a third of all rows is spread over hundreds of buckets.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, v.alias("_v"))
        .agg(times.alias("_n"))
        .withColumn("_b", (F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * 64)).cast("int"))
    )
    # Steps of the logarithm keep order on both sides of zero.
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    spec = Window.partitionBy(*keys).orderBy("_b")
    buckets = buckets.withColumns(
        {
            "_end": F.sum("_bn").over(spec.rowsBetween(Window.unboundedPreceding, 0)),
            "_total": F.sum("_bn").over(Window.partitionBy(*keys)),
        }
    ).withColumns(
        {
            "_start": F.col("_end") - F.col("_bn"),
            "_pos": F.lit(prob) * (F.col("_total") - 1),
        }
    )
    # Ranks count from 0. Keep the buckets that hold floor(pos) or ceil(pos).
    low, high = F.floor("_pos"), F.ceil("_pos")
    within = lambda rank: (rank >= F.col("_start")) & (rank < F.col("_end"))
    buckets = buckets.filter(within(low) | within(high)).select(*keys, "_b", "_start", "_pos")

    join_keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_b"]]
    ranked = counts.alias("c").join(buckets.alias("b"), join_keys).select(*[f"c.{k}" for k in keys], "c._b", "_v", "_n", "_start", "_pos")
    spec = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_to", F.col("_start") + F.sum("_n").over(spec)).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))
    picked = ranked.groupBy(*keys, "_pos").agg(at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"))
    fraction = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction).alias(name))
