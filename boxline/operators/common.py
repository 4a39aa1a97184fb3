"""Small helpers shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F


# Bucket column of tickets that are laid out by customer: see ``sources/facts.py``.
CUSTOMER_KEY = "customer_key"


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def total(name: str | Column) -> Column:
    """Sum that is 0, not null, when there are no rows."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.sum(c), F.lit(0))


def first_per_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """First row per key.

    An aggregate rather than a window: rows are combined before the shuffle, so
    one key with very many rows stays cheap.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def spread_null_key(key: str | Column, *spread: str) -> Column:
    """Join key whose nulls are spread over many values that match nothing.

    Rows without a key would otherwise all land in one shuffle partition.
    """
    key = F.col(key) if isinstance(key, str) else key
    bucket = F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000none-"), bucket))


def left_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: Iterable[str] = ()) -> DataFrame:
    """Left join on a key that is unique in ``lookup``; nulls never match.

    A lookup below Spark's broadcast limit needs no shuffle. Above it the join
    sorts both sides, nulls are spread, and AQE splits partitions of hot keys.
    Tickets in customer buckets are joined where they are.
    """
    if key == "customer_id" and has(rows, CUSTOMER_KEY):
        own = lookup.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")).withColumnRenamed(key, CUSTOMER_KEY)
        return rows.join(own, CUSTOMER_KEY, "left").select(*rows.columns, *[c for c in lookup.columns if c != key])
    spread = list(spread) or [c for c in ("transaction_id", "order_id") if c in rows.columns]
    keyed = rows.withColumn("_key", spread_null_key(key, *spread) if spread else F.col(key).cast("string"))
    right = lookup.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")).withColumnRenamed(key, "_key")
    return keyed.join(right, "_key", "left").drop("_key")


def ranked(df: DataFrame, *order: str | Column, limit: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1; ``limit`` keeps the first rows only, None keeps all.

    For summaries of one row per group, which one task can order.
    """
    rows = df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def running(*partition: str, order: Iterable[str | Column]) -> Window:
    spec = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def scalars(df: DataFrame, **columns: Column) -> Column:
    """One row of aggregates as a struct-valued scalar subquery.

    Spark runs it once and passes the values on; nothing is collected by hand.
    """
    one = df.agg(*[c.alias(name) for name, c in columns.items()])
    return one.select(F.struct(*columns)).scalar()


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row.

    The row is read once, as one scalar subquery held in a column of its own.
    """
    names = row.columns
    held = df.withColumn("_scalars", row.select(F.struct(*names)).scalar())
    return held.select(*df.columns, *[F.col(f"_scalars.{n}").alias(n) for n in names])


def number_spine(spark, low: int, high: int, name: str) -> DataFrame:
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(name))


def as_date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])
