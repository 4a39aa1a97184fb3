"""Saved fixture targets: drafts, checks, status and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxline.functions.keys import match_label
from boxline.functions.numbers import parse_target

SAVED_SCHEMA = "fixture_id string, base_target double, stretch_target double, saved_at timestamp_ntz"
STRETCH = 1.10
TOLERANCE = 0.01


def issues(base: Column, stretch: Column) -> Column:
    """Problems with a pair of targets as text, null when there are none."""
    found = F.concat_ws(
        "; ",
        F.when(base.isNull(), "Base target must be numeric.").when(base < 0, "Base target must be non-negative."),
        F.when(stretch.isNull(), "Stretch target must be numeric.").when(stretch < 0, "Stretch target must be non-negative."),
        F.when(stretch < base, "Stretch target should be greater than or equal to the base target."),
    )
    return F.nullif(found, F.lit(""))


def validate(drafts: DataFrame) -> DataFrame:
    """Draft rows that cannot be saved, with the reasons."""
    checked = drafts.withColumn("issue", issues(parse_target("base_target"), parse_target("stretch_target")))
    name = F.coalesce("fixture", "fixture_id") if "fixture" in drafts.columns else F.col("fixture_id")
    return checked.filter("issue is not null").select(name.alias("fixture"), "base_target", "stretch_target", "issue")


def to_saved(drafts: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """Draft texts as the rows of the targets table."""
    stamp = saved_at if saved_at is not None else F.current_timestamp().cast("timestamp_ntz")
    number = lambda c: F.coalesce(parse_target(c), F.lit(0.0)).alias(c)
    return drafts.select("fixture_id", number("base_target"), number("stretch_target"), stamp.alias("saved_at"))


def latest_saved(saved: DataFrame) -> DataFrame:
    """Newest saved row per fixture."""
    newest = F.max(F.struct("saved_at", "base_target", "stretch_target")).alias("_s")
    rows = saved.filter("fixture_id is not null").groupBy("fixture_id").agg(newest)
    return rows.select("fixture_id", "_s.base_target", "_s.stretch_target", "_s.saved_at")


def target_values(forecasts: DataFrame, saved: DataFrame) -> DataFrame:
    """Targets in use: saved ones, else the forecast and 10% above it."""
    rows = forecasts.join(saved.withColumnRenamed("fixture_id", "match_id"), "match_id", "left")
    return rows.select(
        "match_id",
        F.coalesce("base_target", "expected").alias("base_target"),
        F.coalesce(F.col("stretch_target"), F.col("expected") * STRETCH).alias("stretch_target"),
    )


def draft_table(forecast_table: DataFrame, saved: DataFrame) -> DataFrame:
    """Editable table: forecasts with saved targets, or defaults to start from."""
    kept = saved.select("fixture_id", F.col("base_target").alias("saved_base_target"), F.col("stretch_target").alias("saved_stretch_target"))
    rows = forecast_table.join(kept, "fixture_id", "left")
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return rows.withColumns(
        {
            "base_target": whole(F.coalesce(F.col("saved_base_target"), F.col("forecasted_sales").cast("double"))),
            "stretch_target": whole(F.coalesce(F.col("saved_stretch_target"), F.col("forecast_10pct_uplift").cast("double"))),
            "target_state": F.when(F.col("saved_base_target").isNotNull(), "Saved targets").otherwise("Missing target"),
        }
    )


def target_status(drafts: DataFrame, saved: DataFrame) -> DataFrame:
    """Missing, Draft / unsaved or Saved for every draft row."""
    kept = saved.select("fixture_id", F.col("base_target").alias("_base"), F.col("stretch_target").alias("_stretch"), F.lit(True).alias("_kept"))
    base, stretch = parse_target("base_target"), parse_target("stretch_target")
    same = (F.abs(F.col("_base") - base) <= TOLERANCE) & (F.abs(F.col("_stretch") - stretch) <= TOLERANCE)
    status = F.when(F.col("_kept").isNull(), "Missing").when(F.coalesce(same, F.lit(False)), "Saved").otherwise("Draft / unsaved")
    return drafts.join(kept, "fixture_id", "left").select(*drafts.columns, status.alias("target_status"))


def target_totals(matches: DataFrame, saved: DataFrame) -> DataFrame:
    """Added-up targets of a scope: null while any fixture has none.

    ``missing`` counts those fixtures; ``missing_labels`` lists them by name,
    one row per fixture, through :func:`missing_labels`.
    """
    rows = matches.select("match_id").join(saved.withColumnRenamed("fixture_id", "match_id"), "match_id", "left")
    missing = F.count_if(F.col("base_target").isNull())
    return rows.agg(
        F.when(missing == 0, F.sum("base_target")).alias("base_target"),
        F.when(missing == 0, F.sum("stretch_target")).alias("stretch_target"),
        missing.alias("missing"),
    )


def missing_labels(matches: DataFrame, saved: DataFrame) -> DataFrame:
    rows = matches.join(saved.withColumnRenamed("fixture_id", "match_id"), "match_id", "left_anti")
    return rows.select("match_id", match_label("competition", "round", "opponent", "event_date").alias("label"))
