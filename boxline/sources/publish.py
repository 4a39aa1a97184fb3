"""Sets of tables that are published as one.

A set is written below a version folder of its own, and is visible once a
manifest of the same name is there, which is written last. Readers take the
newest manifest, so they see the former set until a new one is complete,
whatever becomes of the job that writes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from boxline.sources.session import conf, released

KEEP = 3  # published sets that stay for readers who are still at work
ORPHAN_HOURS = 24  # a version without a manifest is given up after so long
# Of files read by a task that writes parts without a shuffle: its rows are sorted by part, which has to fit into memory.
_SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 16 << 20


class Conflict(RuntimeError):
    """Another job published while this one built on the set before."""


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, files = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def published(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published versions, oldest first."""
    return [n for n in _names(spark, f"{folder}/manifests") if n[:1].isdigit()]


def current(spark: SparkSession, folder: str) -> str:
    """Folder of the newest published set, or ``folder`` itself where nothing was published."""
    names = published(spark, folder)
    return f"{folder}/versions/{names[-1]}" if names else folder


def publish(
    tables: Mapping[str, DataFrame], folder: str, layouts: Mapping[str, Sequence[str]] = {}, keep: int = KEEP, after: str | None = None,
    placed: Collection[str] = (),
) -> str:
    """Write tables as one new version and make it the current one; returns its folder.

    ``layouts`` names the columns a table is partitioned by. Rows of ``placed``
    tables come from files that lie by these columns already; they are not
    moved, and each task writes the few parts that it reads. Of two jobs that
    publish at a time, the one that started last is current. Tables that were
    made from the set in folder ``after`` are published only while that is still
    the current one; else ``Conflict`` is raised and nothing is left behind.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    target = f"{folder}/versions/{version}"
    for name, rows in tables.items():
        layout = list(layouts.get(name, ()))
        moved = layout and name not in placed
        # AQE splits and joins the parts of a value to its advisory size, so files are neither tiny nor huge.
        rows = rows.hint("rebalance", *layout) if moved else rows
        with released(spark), conf(spark, {} if moved or not layout else {_SPLIT: str(SPLIT_BYTES)}):
            rows.write.option("compression", "zstd").partitionBy(*layout).parquet(f"{target}/{name}.parquet")
    if after is not None and current(spark, folder) != after:
        place, files = _path(spark, target)
        files.delete(place, True)
        raise Conflict(f"{after} is no longer the newest set")
    draft, files = _path(spark, f"{folder}/manifests/.{version}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    if not files.rename(draft, _path(spark, f"{folder}/manifests/{version}")[0]):
        raise OSError(f"manifest of {target} could not be written")
    expire(spark, folder, keep)
    return target


def expire(spark: SparkSession, folder: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Remove published sets beyond the newest ``keep``, and versions that were never published and are old.

    The manifest goes first, so no reader is sent to a set that is being removed.
    """
    names = published(spark, folder)
    gone = names[: max(len(names) - keep, 0)]
    late = f"{time.time_ns() - int(orphan_hours * 3600e9):020d}"
    orphans = [n for n in _names(spark, f"{folder}/versions") if n not in names and n < late]
    for place in [f"{folder}/manifests/{n}" for n in gone] + [f"{folder}/versions/{n}" for n in (*gone, *orphans)]:
        path, files = _path(spark, place)
        files.delete(path, True)
