"""Tickets laid out by season and, inside it, in buckets of customers.

Aggregations and joins by customer read a bucket per task and move no ticket.
The bucket column is ``customer_key``: the customer id, or for tickets without
one a value that matches nothing, so that they are spread over all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from boxline.operators.common import CUSTOMER_KEY, has, spread_null_key
from boxline.sources.publish import _names


SEASONS = ("season_label",)


def bucket_key(customer: Column | str, *spread: Column | str) -> Column:
    """The bucket value of a ticket; one without customer gets a value by ``spread``."""
    return spread_null_key(customer, *spread)


def write_facts(
    tickets: DataFrame, path: str, buckets: int, by: Sequence[str] = SEASONS,
    finish: Callable[[DataFrame], DataFrame] | None = None, key: Column | None = None,
) -> None:
    """Write tickets to a new folder; ``buckets`` should be at least the number of shuffle partitions used later.

    With fewer, Spark prefers to shuffle both sides of a join for the sake of
    more tasks. Each task writes one bucket, one file a season. ``finish`` makes
    tickets of narrower rows after these moved by ``key``, their bucket value.
    """
    def keyed(rows: DataFrame) -> DataFrame:
        spread = [c for c in ("transaction_id", "order_id") if has(rows, c)] or rows.columns
        return rows.withColumn(CUSTOMER_KEY, bucket_key("customer_id", *spread))

    moved = keyed(tickets).repartition(buckets, CUSTOMER_KEY) if finish is None else keyed(finish(tickets.repartition(buckets, key)))
    write_placed(moved, path, buckets, by)


def write_placed(rows: DataFrame, path: str, buckets: int, by: Sequence[str] = SEASONS) -> None:
    """Write rows that lie in their buckets already, such as those read from others. They are not moved."""
    name = f"facts_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, CUSTOMER_KEY)
    writer = writer.partitionBy(*by) if by else writer
    writer.option("path", f"{path}/b{buckets}").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the files stay; each session names them anew


def _layout(spark: SparkSession, path: str) -> str:
    return next(n for n in _names(spark, path) if n[:1] == "b" and n[1:].isdigit())


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Tickets of the same folder without their bucket column, read in parts of any size."""
    return spark.read.parquet(f"{path}/{_layout(spark, path)}").drop(CUSTOMER_KEY)


def read_facts(spark: SparkSession, path: str, by: Sequence[str] = SEASONS) -> DataFrame:
    """Tickets of a folder that ``write_facts`` made, with their buckets known to Spark."""
    layout = _layout(spark, path)
    place, name = f"{path}/{layout}", f"facts_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
    parts = f"PARTITIONED BY ({', '.join(by)}) " if by else ""
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet {parts}CLUSTERED BY ({CUSTOMER_KEY}) INTO {layout[1:]} BUCKETS LOCATION '{place}'")
    if by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
