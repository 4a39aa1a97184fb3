"""Projection of a segment's sales over the season from its own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import dates
from boxline.functions.windows import window_of_offset
from boxline.operators.common import number_spine, running, scalars, total
from boxline.operators.curves import chart_length, offset_of
from boxline.operators.filters import TicketFilter, ticket_predicate, value_column
from boxline.operators.summaries import mean_of_season_totals

MIN_SAMPLE = 100
# How the selection is widened, step by step, and how that is told.
LEVELS = (
    ("selected filters", None),
    ("product-level fallback", "demographic filters removed"),
    ("ticket product fallback", "demographic and audience filters removed"),
    ("competition-level fallback", "ticket product, audience, and demographic filters removed"),
    ("all-sales fallback", "all competitions used"),
)


def filter_label(f: TicketFilter) -> str:
    """Short text for what a selection is limited to."""
    parts = [f.ticket_type, f.ticket_class, ", ".join(f.age_bands), ", ".join(f.genders), ", ".join(f.postcodes), f.audience_segment]
    return " + ".join(p for p in parts if p and p != "All") or "all selected filters"


def level_filters(f: TicketFilter) -> list[TicketFilter]:
    base = f.without(season_label=None, fixture_ids=(), as_at=None)
    return [
        base,
        base.without(demographics=True),
        base.without(demographics=True, audience=True),
        base.without(products=True, demographics=True, audience=True),
        base.without(products=True, demographics=True, audience=True, competition="All"),
    ]


def choose_level(history: DataFrame, f: TicketFilter, min_sample: float = MIN_SAMPLE) -> Column:
    """Index of the first level with enough past tickets, as a scalar.

    All levels are measured in one scan.
    """
    value = value_column(f.ticket_status)
    tests = [ticket_predicate(history, level) for level in level_filters(f)]
    sums = history.agg(*[total(F.when(test, F.col(value))).alias(f"s{i}") for i, test in enumerate(tests)])
    level = F.lit(len(tests) - 1)
    for i in reversed(range(len(tests) - 1)):
        level = F.when(F.col(f"s{i}") >= min_sample, i).otherwise(level)
    return sums.select(level.alias("level")).scalar()


def chosen_history(history: DataFrame, f: TicketFilter, level: Column) -> DataFrame:
    """History rows of the chosen level."""
    test = F.lit(False)
    for i, wanted in enumerate(level_filters(f)):
        test = test | ((level == i) & ticket_predicate(history, wanted))
    return history.filter(test)


def smoothed_share(rows: DataFrame, sales: str, days_left: Column) -> DataFrame:
    """Daily share of a season: smoothed history, lifted towards the end."""
    clipped = F.greatest(F.col(sales), F.lit(0.0))
    whole = Window.partitionBy()
    near = F.avg(clipped).over(Window.partitionBy().orderBy("offset").rowsBetween(-3, 3))
    left = F.greatest(days_left, F.lit(0))
    tail = F.when(left.between(7, 21), (21 - left) / 14).otherwise(0.0)
    week = F.when(left.between(0, 7), (8 - left) / 8).otherwise(0.0)
    end = F.when(left == 0, 0.35).when(left == 1, 0.18).otherwise(0.0)
    rows = rows.withColumns({"_near": near, "_sold": F.sum(clipped).over(whole)})
    rows = rows.withColumn("_w", F.col("_near") * (1 + 0.10 * tail + 0.18 * week + end))
    sum_w = F.sum("_w").over(whole)
    even = 1 / F.count(F.lit(1)).over(whole)
    share = F.when((F.col("_sold") > 0) & (sum_w > 0), F.col("_w") / sum_w).otherwise(even)
    return rows.withColumn("daily_share", share).drop("_near", "_sold", "_w")


def merge_actuals(curve: DataFrame, current: DataFrame | None, value: str) -> DataFrame:
    """Add current daily and running sales to a curve."""
    if current is None:
        return curve.withColumns({"actual_daily": F.lit(0.0), "actual_cumulative": F.lit(0.0)})
    daily = current.filter("transaction_date is not null").groupBy(F.col("transaction_date").cast("date").alias("date")).agg(
        F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("actual_daily")
    )
    rows = curve.join(daily, "date", "left").withColumn("actual_daily", F.coalesce("actual_daily", F.lit(0.0)))
    return rows.withColumn("actual_cumulative", F.sum("actual_daily").over(running(order=["date"])))


def required_per_day(target_total: Column, as_at) -> Column:
    """The gap to target spread evenly over the days after the snapshot."""
    at = dates.date_lit(as_at)
    whole = Window.partitionBy()
    so_far = F.sum(F.when(F.col("date") <= at, F.col("actual_daily")).otherwise(0.0)).over(whole)
    days = F.sum((F.col("date") > at).cast("int")).over(whole)
    return F.when(F.col("date") > at, F.greatest(target_total - so_far, F.lit(0.0)) / days).otherwise(0.0)


def segment_projection(
    tickets: DataFrame, history: DataFrame, f: TicketFilter, start, event_date, target: float | Column, as_at,
    planning_label: str, match_id: str | None = None, competition: str = "All", min_sample: float = MIN_SAMPLE, actuals: bool = True,
) -> DataFrame:
    """Projected, target and actual daily sales of a selection.

    ``tickets`` holds the current sales and ``history`` the baseline seasons.
    Every row also carries the contribution and revenue per ticket used.
    """
    value = value_column(f.ticket_status)
    length = chart_length(start, event_date)
    level = choose_level(history, f, min_sample)
    rows = chosen_history(history, f, level).filter("transaction_date is not null and season_label is not null")
    rows = rows.withColumn("offset", offset_of(length)).filter("offset is not null")

    per_day = rows.groupBy("season_label", "offset").agg(total(value).cast("double").alias("sold"), F.sum("gross_revenue").cast("double").alias("revenue"))
    daily = per_day.groupBy("offset").agg(F.sum("sold").alias("historical_sold"))
    spine = number_spine(tickets.sparkSession, 0, length, "offset").join(daily, "offset", "left")
    spine = spine.withColumn("historical_sold", F.coalesce("historical_sold", F.lit(0.0)))
    day = F.date_add(dates.date_lit(start), F.col("offset"))
    curve = smoothed_share(spine, "historical_sold", F.date_diff(dates.date_lit(event_date), day))
    facts = scalars(
        per_day,
        seasons=F.count_distinct("season_label"),
        sold=total("sold"),
        revenue=total("revenue"),
    )
    sold, seasons = facts.getField("sold"), facts.getField("seasons")
    final = F.when(seasons > 0, sold / seasons).otherwise(0.0)
    per_ticket = F.when(sold != 0, facts.getField("revenue") / sold).otherwise(0.0)
    base = mean_of_season_totals(history, value, competition).scalar()
    contribution = F.when(base != 0, final / base * 100).otherwise(100.0)
    goal = (target if isinstance(target, Column) else F.lit(float(target))) * contribution / 100

    curve = curve.select(
        day.alias("date"),
        window_of_offset("offset").alias("sales_window"),
        (F.col("daily_share") * final).alias("forecast_expected_daily"),
        (F.col("daily_share") * goal).alias("target_daily"),
        (F.col("daily_share") * final * per_ticket).alias("forecast_revenue"),
        goal.alias("_goal"),
        final.alias("forecast_final_tickets"),
        contribution.alias("contribution_pct"),
        level.alias("fallback_level"),
    )
    order = running(order=["date"])
    curve = curve.withColumns(
        {
            "forecast_expected_cumulative": F.sum("forecast_expected_daily").over(order),
            "target_cumulative": F.sum("target_daily").over(order),
        }
    )
    current, sold_now = None, F.lit(0.0)
    if actuals:
        own = f.without(season_label=planning_label, as_at=as_at, fixture_ids=(match_id,) if match_id else ())
        current = tickets.filter(ticket_predicate(tickets, own))
        # Sales before the chart starts count here but have no day on it.
        sold_now = current.agg(total(value).cast("double").alias("v")).scalar()
    curve = merge_actuals(curve, current, value).withColumn("actual_by_now", sold_now)
    return curve.withColumn("required_daily", required_per_day(F.col("_goal"), as_at)).drop("_goal")


def projection_summary(curve: DataFrame, history: DataFrame, f: TicketFilter, as_at, min_sample: float = MIN_SAMPLE) -> DataFrame:
    """Totals of a projection and, if it was widened, why."""
    at = dates.date_lit(as_at)
    value = value_column(f.ticket_status)
    level = choose_level(history, f, min_sample)
    sample = chosen_history(history, f, level).agg(total(value).cast("double").alias("v")).scalar()
    row = curve.agg(
        F.max("forecast_final_tickets").alias("forecast_final_tickets"),
        F.sum("forecast_revenue").alias("forecast_final_revenue"),
        F.coalesce(F.max_by("forecast_expected_cumulative", F.when(F.col("date") <= at, F.col("date"))), F.lit(0.0)).alias("expected_by_now"),
        F.max("actual_by_now").alias("actual_by_now"),
        F.max("contribution_pct").alias("contribution_pct"),
        F.max("fallback_level").alias("_level"),
    ).withColumn("sample_size", sample)
    names = F.element_at(F.array(*[F.lit(name) for name, _ in LEVELS]), F.col("_level") + 1)
    whys = F.element_at(F.array(*[F.lit(why or filter_label(f)) for _, why in LEVELS]), F.col("_level") + 1)
    message = F.concat(
        F.lit("Low historical sample for the exact selected group. Using "), names, F.lit(" ("), whys,
        F.lit("). Historical sample is "), F.format_number("sample_size", 0),
        F.lit(f" selected tickets; minimum is {min_sample:,.0f}."),
    )
    used = (F.col("_level") > 0) | (F.col("sample_size") < min_sample)
    return row.withColumns({"fallback_used": used, "fallback_message": message}).drop("_level")
