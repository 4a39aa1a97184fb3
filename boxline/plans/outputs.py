"""Forecast and target output of many fixtures in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boxline.operators import features, forecast, forest, pace, targets
from boxline.operators.matches import completed_matches, final_sales
from boxline.operators.quantiles import exact_quantile
from boxline.sources.session import materialise

UPLIFT = 0.10


@dataclass(frozen=True)
class FixtureOutputs:
    """Long tables keyed by ``match_id`` (and ``date`` for curves)."""

    matches: DataFrame
    pace: DataFrame
    forecasts: DataFrame
    forecast: DataFrame
    target: DataFrame
    manual: DataFrame
    actual: DataFrame

    def chart(self) -> DataFrame:
        """Forecast, target, manual and actual lines side by side."""
        key = ["match_id", "date"]
        actual = self.actual.groupBy(*key).agg(F.sum("daily_sales").alias("actual_daily"))
        manual = self.manual.select(*key, F.col("target_cumulative").alias("manual_target_cumulative"))
        rows = (
            self.forecast.join(self.target.select(*key, "target_cumulative", "target_daily", "required_daily"), key, "left")
            .join(manual, key, "left")
            .join(actual, key, "left")
        )
        return rows.withColumn("actual_daily", F.coalesce("actual_daily", F.lit(0.0)))


def fixture_outputs(
    selected: DataFrame, matches: DataFrame, daily: DataFrame, forecasts: DataFrame, baseline: Sequence[str] = (), reference=None,
    settings: pace.PaceSettings = pace.PaceSettings(150, 3), uplift: float = UPLIFT,
    assumptions: targets.TargetAssumptions = targets.TargetAssumptions(),
    planning_target: Column | None = None, manual_target: Column | None = None,
) -> FixtureOutputs:
    """Pace, forecast and target curves of the selected matches.

    ``forecasts`` holds ``match_id``, ``expected``, ``lower`` and ``upper``.
    """
    # Three curves read the profile and two read the forecasts: both are small, and written once.
    profile = materialise(pace.pace_profiles(selected, matches, daily, baseline, reference, settings), "pace")
    forecasts = materialise(forecasts, "forecasts")
    actual = daily.join(selected.select("match_id"), "match_id", "left_semi")
    total = planning_target if planning_target is not None else F.col("baseline_target")
    manual = manual_target if manual_target is not None else F.col("manual_target")
    target = targets.target_curves(selected, profile, total, uplift, assumptions=assumptions)
    return FixtureOutputs(
        matches=selected,
        pace=profile,
        forecasts=forecasts,
        forecast=forecast.forecast_curves(selected, actual, profile, forecasts),
        target=targets.required_daily(target, actual),
        manual=targets.target_curves(selected, profile, total, 0.0, manual, assumptions),
        actual=actual,
    )


def fitted(matches: DataFrame, daily: DataFrame, reference=None, settings: forest.ForestSettings = forest.ForestSettings()) -> forest.Forecaster:
    return forest.fit(features.training_rows(matches, daily, reference), settings)


def forest_forecasts(selected: DataFrame, matches: DataFrame, daily: DataFrame, forecaster: forest.Forecaster) -> DataFrame:
    return forest.predict(forecaster, features.latest_snapshots(selected, matches, daily))


def forecast_table(selected: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecast and +10% of every selected fixture."""
    rows = selected.join(forecasts, "match_id")
    return rows.select(
        F.col("match_id").alias("fixture_id"),
        (F.col("fixture_label") if "fixture_label" in selected.columns else F.col("match_id")).alias("fixture"),
        "competition",
        F.col("event_date").cast("date").alias("date"),
        F.coalesce("opponent", F.lit("TBD")).alias("opponent"),
        F.initcap("fixture_status").alias("status"),
        F.bround("expected", 0).cast("bigint").alias("forecasted_sales"),
        F.bround(F.col("expected") * (1 + UPLIFT), 0).cast("bigint").alias("forecast_10pct_uplift"),
    )


def pace_forecasts(selected: DataFrame, matches: DataFrame, daily: DataFrame, reference=None) -> DataFrame:
    """Forecasts without a model: the median of past finals, as for scarce data."""
    done = completed_matches(matches, daily, reference)
    finals = final_sales(daily).filter("final_sales > 0").join(done, "match_id", "left_semi")
    median = exact_quantile(finals, "final_sales", 0.5, name="v").select("v").scalar()
    latest = targets.latest_actuals(daily)
    rows = selected.select("match_id").join(latest, "match_id", "left").withColumn("_median", F.coalesce(median, F.lit(0.0)))
    current = F.coalesce("latest_sales", F.lit(0.0))
    expected = F.greatest("_median", current)
    spread = F.greatest(expected * forest.FALLBACK_SPREAD, F.lit(forest.FALLBACK_MIN))
    return rows.select("match_id", expected.alias("expected"), F.greatest(current, expected - spread).alias("lower"), (expected + spread).alias("upper"))
