"""Target curves and the run-rate needed to reach them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.operators.common import running

MIN_WEIGHT = 0.000001
FINAL_WEEK = 7
BURST_DAYS = 2
EVE_FACTOR, EVENT_FACTOR = 1.12, 1.24
PHASES = (
    ("early_bird_start", "early_bird_end", 0.35, "early_bird_lift"),
    ("member_presale_start", "member_presale_end", 0.40, "member_presale_lift"),
    ("marketing_start", "marketing_end", 0.45, "marketing_lift"),
)


@dataclass(frozen=True)
class TargetAssumptions:
    """Extra demand expected in each phase of a sale."""

    early_bird_lift: float = 0.16
    member_presale_lift: float = 0.12
    marketing_lift: float = 0.18
    campaign_burst_lift: float = 0.28
    final_week_lift: float = 0.20


def match_calendar(matches: DataFrame, *keep: str) -> DataFrame:
    """One row per match and day from on-sale to the event."""
    event, sale = F.col("event_date").cast("date"), F.col("on_sale_date").cast("date")
    days = F.sequence(F.least(sale, event), event)
    rows = matches.filter(event.isNotNull() & sale.isNotNull()).select("match_id", *keep, event.alias("_event"), F.explode(days).alias("date"))
    return rows.withColumn("days_to_event", F.date_diff("_event", "date")).drop("_event")


def with_pace(calendar: DataFrame, pace: DataFrame) -> DataFrame:
    shares = pace.select("match_id", "days_to_event", "historical_daily_share")
    rows = calendar.join(shares, ["match_id", "days_to_event"], "left")
    return rows.withColumn("historical_daily_share", F.coalesce("historical_daily_share", F.lit(0.0)))


def _ramp(inside: Column, low: float) -> Column:
    """Even steps from ``low`` to 1 over the days inside a phase; ``low`` if it has one day."""
    number = inside.cast("int")
    spec = running("match_id", order=["date"])
    nth = F.sum(number).over(spec)
    count = F.sum(number).over(Window.partitionBy("match_id"))
    step = F.when(count > 1, (nth - 1) / (count - 1)).otherwise(0.0)
    return F.when(inside, F.lit(low) + (1 - low) * step)


def target_curves(
    matches: DataFrame, pace: DataFrame, total: Column, uplift: float = 0.0, manual: Column | None = None,
    assumptions: TargetAssumptions = TargetAssumptions(), today=None,
) -> DataFrame:
    """Daily and running target of every match.

    ``total`` and ``manual`` are columns of ``matches``; a manual target of 0
    counts as not set. A match without dates gets one row on ``today``.
    """
    goal = total.cast("double") * (1 + uplift)
    if manual is not None:
        goal = F.when(F.coalesce(manual, F.lit(0)) != 0, manual.cast("double")).otherwise(goal)
    goal = F.greatest(goal, F.lit(0.0))
    phase_columns = [c for p in PHASES for c in p[:2]]
    keep = [*phase_columns, "campaign_burst_date", "target_total"]
    rows = with_pace(match_calendar(matches.withColumn("target_total", goal), *keep), pace)

    near = Window.partitionBy("match_id").orderBy("date").rowsBetween(-2, 2)
    weight = F.greatest(F.avg("historical_daily_share").over(near), F.lit(MIN_WEIGHT))
    for start, end, low, lift in PHASES:
        inside = F.coalesce((F.col("date") >= F.col(start)) & (F.col("date") <= F.col(end)), F.lit(False))
        weight = weight * F.coalesce(1 + getattr(assumptions, lift) * _ramp(inside, low), F.lit(1.0))
    burst = F.abs(F.date_diff("date", F.col("campaign_burst_date").cast("date"))) <= BURST_DAYS
    left = F.col("days_to_event")
    weight = weight * F.when(burst, 1 + assumptions.campaign_burst_lift).otherwise(1.0)
    weight = weight * F.when(left <= FINAL_WEEK, 1 + assumptions.final_week_lift * (FINAL_WEEK + 1 - left) / (FINAL_WEEK + 1)).otherwise(1.0)
    weight = weight * F.when(left == 1, EVE_FACTOR).when(left == 0, EVENT_FACTOR).otherwise(1.0)

    rows = rows.withColumn("_weight", weight)
    share = F.col("_weight") / F.sum("_weight").over(Window.partitionBy("match_id"))
    rows = rows.withColumn("adjusted_daily_share", share)
    rows = rows.withColumn("target_daily", F.col("adjusted_daily_share") * F.col("target_total"))
    rows = rows.withColumn("target_cumulative", F.sum("target_daily").over(running("match_id", order=["date"])))
    columns = ["match_id", "date", "days_to_event", "historical_daily_share", "adjusted_daily_share", "target_daily", "target_cumulative", "target_total"]
    undated = matches.filter(F.col("event_date").isNull() | F.col("on_sale_date").isNull()).select(
        "match_id",
        (F.lit(today).cast("date") if today is not None else F.current_date()).alias("date"),
        F.lit(0).alias("days_to_event"),
        F.lit(1.0).alias("historical_daily_share"),
        F.lit(1.0).alias("adjusted_daily_share"),
        goal.alias("target_daily"),
        goal.alias("target_cumulative"),
        goal.alias("target_total"),
    )
    return rows.select(*columns).unionByName(undated)


def latest_actuals(daily: DataFrame) -> DataFrame:
    """Last sale day of each match and the running total reached on it."""
    return daily.filter(F.col("match_id").isNotNull()).groupBy("match_id").agg(
        F.max("date").alias("latest_date"),
        F.max(F.struct("date", "cumulative_sales")).getField("cumulative_sales").alias("latest_sales"),
    )


def required_daily(curves: DataFrame, daily: DataFrame) -> DataFrame:
    """Sales still needed per day, from the latest actual to the target."""
    rows = curves.join(latest_actuals(daily), "match_id", "left")
    future = F.coalesce(F.col("date") > F.col("latest_date"), F.lit(False))
    whole = Window.partitionBy("match_id")
    rows = rows.withColumn("_future", future)
    days = F.sum(F.col("_future").cast("int")).over(whole)
    weight = F.sum(F.when(F.col("_future"), F.col("adjusted_daily_share"))).over(whole)
    share = F.when(weight != 0, F.col("adjusted_daily_share") / weight).otherwise(1 / days)
    remaining = F.greatest(F.col("target_total") - F.col("latest_sales"), F.lit(0.0))
    needed = (
        F.when(F.col("latest_date").isNull() | (days == 0), F.col("target_daily"))
        .when(F.col("_future"), share * remaining)
        .otherwise(0.0)
    )
    return rows.withColumn("required_daily", needed).drop("_future", "latest_date", "latest_sales")
