"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffles and splits skewed join partitions at run time. Broadcasts
# are left to Spark's own size check (spark.sql.autoBroadcastJoinThreshold).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Do not look up the calling line for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_FOLDERS: dict[str, str] = {}  # folders made for local sessions, by application

_INFER = "spark.sql.constraintPropagation.enabled"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "boxline", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A local folder is made only where the setting is absent and one machine does
    everything, as in tests; on a cluster each executor would see its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        folder = _FOLDERS.get(application) or _FOLDERS.setdefault(application, tempfile.mkdtemp(prefix="boxline-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def conf(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the statements inside, and then those of before."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def released(spark: SparkSession):
    """Writes inside remove their shuffle files as soon as each is done; else they stay until the driver collects garbage."""
    return conf(spark, {_RELEASE: "true"})


def materialise(df: DataFrame, name: str, infer: bool = True) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where several later steps read the same expensive frame. Unlike a
    cache, the files survive the loss of executors. ``infer=False`` skips
    Spark's constraint inference for this one write: over dozens of long text
    parsing expressions it takes far longer than the job.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with released(spark), conf(spark, {} if infer else {_INFER: "false"}):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
