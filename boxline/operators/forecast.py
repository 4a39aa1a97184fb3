"""Daily forecast curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boxline.operators.common import running
from boxline.operators.curves import carry_forward, daily_from_running
from boxline.operators.targets import latest_actuals, match_calendar, with_pace

UPLIFT = 1.10


def forecast_curves(matches: DataFrame, daily: DataFrame, pace: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Final-sales forecasts spread over the days still to come.

    Past days follow the actual running total; the rest of the forecast is
    spread by the historical pace of the remaining days.
    """
    rows = with_pace(match_calendar(matches), pace)
    rows = rows.withColumn("historical_daily_share", F.greatest("historical_daily_share", F.lit(0.0)))
    # The highest running total of a day stands for it when it has two windows.
    actual = daily.groupBy("match_id", "date").agg(F.max("cumulative_sales").alias("actual_cumulative"))
    rows = rows.join(actual, ["match_id", "date"], "left").join(latest_actuals(daily), "match_id", "left").join(forecasts, "match_id")
    rows = rows.withColumn("_future", F.coalesce(F.col("date") > F.col("latest_date"), F.lit(True)))

    whole = Window.partitionBy("match_id", "_future")
    weight = F.sum("historical_daily_share").over(whole)
    share = F.when(weight > 0, F.col("historical_daily_share") / weight).otherwise(1 / F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_share", share)
    so_far = F.sum("_share").over(Window.partitionBy("match_id", "_future").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_so_far", so_far)

    current = F.coalesce("latest_sales", F.lit(0.0))
    order = running("match_id", order=["date"])
    lines = {}
    for name in ("expected", "lower", "upper"):
        remaining = F.greatest(F.col(name) - current, F.lit(0.0))
        lines[f"_{name}"] = F.when(F.col("_future"), current + F.col("_so_far") * remaining).otherwise(F.col("actual_cumulative"))
    rows = rows.withColumns(lines)
    rows = rows.withColumns({f"forecast_{n}_cumulative": carry_forward(f"_{n}", order) for n in ("expected", "lower", "upper")})
    spec = Window.partitionBy("match_id").orderBy("date")
    rows = rows.withColumns(
        {
            "expected_forecast_daily": daily_from_running("forecast_expected_cumulative", spec),
            "uplift_10_cumulative": F.col("forecast_expected_cumulative") * UPLIFT,
        }
    )
    return rows.select(
        "match_id", "date", "days_to_event", "historical_daily_share", "actual_cumulative",
        "forecast_expected_cumulative", "forecast_lower_cumulative", "forecast_upper_cumulative",
        "expected_forecast_daily", "uplift_10_cumulative",
    )
