"""Readers and writers of the normalised tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxline.operators.plan_targets import SAVED_SCHEMA, latest_saved
from boxline.sources.publish import Conflict, current, publish

MATCH_DATES = (
    "event_date", "on_sale_date", "early_bird_start", "early_bird_end", "member_presale_start", "member_presale_end",
    "general_public_start", "marketing_start", "marketing_end", "campaign_burst_date",
)
# Tables of a processed load, and the columns they are partitioned by.
PROCESSED = {
    "transactions_normalised": ("season_label",),
    "fixtures_normalised": (),
    "customers_normalised": (),
    "matches": (),
    "daily_sales": (),
    "rejects": (),
}


def read_table(spark: SparkSession, folder: str, name: str, prefer_parquet: bool = True) -> DataFrame:
    """A table stored as parquet or as CSV with a header."""
    folder = current(spark, folder)
    parquet, csv = f"{folder}/{name}.parquet", f"{folder}/{name}.csv"
    readers = [lambda: spark.read.parquet(parquet), lambda: spark.read.option("header", True).csv(csv)]
    if not prefer_parquet:
        readers.reverse()
    try:
        return readers[0]()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return readers[1]()


def _dated(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names if c in df.columns})


def load_matches(spark: SparkSession, folder: str, prefer_parquet: bool = True) -> DataFrame:
    rows = read_table(spark, folder, "matches", prefer_parquet)
    return _dated(rows, MATCH_DATES).withColumn("match_id", F.col("match_id").cast("string"))


def load_daily_sales(spark: SparkSession, folder: str, prefer_parquet: bool = True) -> DataFrame:
    rows = read_table(spark, folder, "daily_sales", prefer_parquet)
    numbers = {c: F.col(c).cast("double") for c in ("daily_sales", "cumulative_sales") if c in rows.columns}
    rows = rows.withColumns({"date": F.col("date").cast("date"), "match_id": F.col("match_id").cast("string"), **numbers})
    return rows.withColumn("days_to_event", F.col("days_to_event").cast("int"))


def write_processed(tables: dict[str, DataFrame], folder: str, placed: Collection[str] = ()) -> None:
    """Replace the processed tables, all of them at once; tickets are laid out by season.

    Tables in ``placed`` are read from files by season, as those of a load are, and need no shuffle for it.
    """
    publish({name: tables[name] for name in PROCESSED}, folder, PROCESSED, placed=placed)


def load_processed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The newest complete set of processed tables plus the planning fixtures among them."""
    version = current(spark, folder)
    tables = {name: spark.read.parquet(f"{version}/{name}.parquet") for name in PROCESSED}
    fixtures = tables["fixtures_normalised"]
    return tables | {"future_fixtures": fixtures.filter(F.col("fixture_status") == "assumed")}


def export_csv(df: DataFrame, path: str) -> None:
    """Export any result with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


_SAVED = ("fixture_id", "base_target", "stretch_target", "saved_at")


def save_targets(rows: DataFrame, path: str, tries: int = 5) -> None:
    """Merge saved targets into the stored ones; the newest row of a fixture counts.

    Each save publishes a new base of one row per fixture in few files and
    removes old ones, so neither files nor reading time grow with the number of
    saves. A save that another one overtook is merged anew with what that left.
    """
    spark = rows.sparkSession
    for left in reversed(range(tries)):
        base = current(spark, path)
        kept = load_targets(spark, path).select(*_SAVED).unionByName(rows.select(*_SAVED))
        try:
            publish({"targets": latest_saved(kept).select(*_SAVED).hint("rebalance")}, path, after=base)
            return
        except Conflict:
            if not left:
                raise


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """Newest saved target per fixture; nothing when there is no usable table."""
    empty = spark.createDataFrame([], SAVED_SCHEMA)
    base = current(spark, path)
    try:
        rows = spark.read.parquet(path if base == path else f"{base}/targets.parquet")
    except AnalysisException:
        return latest_saved(empty)
    if not {"fixture_id", "base_target", "stretch_target"} <= set(rows.columns):
        return latest_saved(empty)
    stamp = F.col("saved_at").cast("timestamp_ntz") if "saved_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = rows.select(F.col("fixture_id").cast("string").alias("fixture_id"), number("base_target"), number("stretch_target"), stamp.alias("saved_at"))
    return latest_saved(rows)
