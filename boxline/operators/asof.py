"""Nearest row in time, without forming pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest(rows: DataFrame, others: DataFrame, by: Sequence[str], at: Column, other_at: Column, value: str, order: Sequence[str] = (), name: str = "nearest") -> DataFrame:
    """Adds a struct ``name`` (``gap``, the ``order`` columns, ``value``) of the row of ``others`` whose number ``other_at`` is nearest to ``at``.

    Both sides go in one line of numbers for each ``by``; each row sees the last
    other row on its left and on its right. Equal gaps go to the smallest
    ``order`` and ``value``. Rows with nothing to compare with get null; null
    keys are a key like any other, null numbers match nothing.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    keyed = lambda df, number: df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], number.cast("long").alias("_at"), F.struct(*map(F.col, df.columns)).alias("_row"))
    right = keyed(others, other_at).filter("_at is not null")
    right = right.groupBy(*keys, "_at").agg(F.min(F.struct(*[F.col(f"_row.{c}").alias(c) for c in (*order, value)])).alias("_other"))
    left = keyed(rows, at)
    line = left.unionByName(right, allowMissingColumns=True)
    # Other rows come first among equal numbers, in both directions.
    first = F.col("_row").isNotNull()
    sides = {"_left": F.col("_at").asc_nulls_last(), "_right": F.col("_at").desc_nulls_last()}
    for side, direction in sides.items():
        seen = Window.partitionBy(*keys).orderBy(direction, first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        line = line.withColumn(side, F.last(F.when(F.col("_other").isNotNull(), F.struct("_at", "_other")), True).over(seen))
    near = [F.when(F.col(s).isNotNull() & F.col("_at").isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{s}._at")).alias("gap"), F.col(f"{s}._other").alias("other"))) for s in sides]
    best = F.least(*near)
    fields = [best["gap"].alias("gap"), *[best["other"][c].alias(c) for c in (*order, value)]]
    return line.filter(first).select("_row.*", F.when(best.isNotNull(), F.struct(*fields)).alias(name))
