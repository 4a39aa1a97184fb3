"""Model features from daily sales and match attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boxline.functions import dates
from boxline.functions.numbers import clip
from boxline.operators.matches import completed_matches

# Names of the model inputs, and the match columns that they come from.
CATEGORICAL = (
    "opponent", "venue", "competition", "day_of_week", "event_category", "campaign_theme", "sales_window", "marketing_period",
)
NUMERIC = (
    "season", "round", "days_to_event", "days_on_sale", "sales_progress", "cumulative_sales", "daily_sales",
    "trailing_3_day_sales", "trailing_7_day_sales", "sales_acceleration", "opponent_strength",
    "historical_attendance", "ticket_price", "membership_base", "prior_season_performance", "weather_temp_c",
    "is_public_holiday", "is_campaign_burst", "membership_on_sale", "early_bird_active", "finals_contention",
    "school_holiday", "double_header", "event_month", "is_weekend_event", "days_since_early_bird_start",
)
_FROM_MATCH = (
    "season", "round", "opponent", "venue", "competition", "event_date", "on_sale_date", "early_bird_start",
    "day_of_week", "event_category", "campaign_theme", "opponent_strength", "historical_attendance", "ticket_price",
    "membership_base", "prior_season_performance", "weather_temp_c", "finals_contention", "double_header",
)
WEEKEND = ("Saturday", "Sunday")


def filled(df: DataFrame) -> DataFrame:
    """Features without gaps: "Unknown" for texts, 0 for numbers."""
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in CATEGORICAL if c in df.columns}
    values |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC if c in df.columns}
    return df.withColumns(values)


def sales_features(matches: DataFrame, daily: DataFrame) -> DataFrame:
    """One feature row per daily sales row."""
    rows = daily.join(matches.select("match_id", *_FROM_MATCH), "match_id", "left")
    on_sale = clip(dates.floor_days("date", "on_sale_date").cast("double"), low=0.0)
    length = dates.floor_days("event_date", "on_sale_date")
    length = F.when(length == 0, 1).otherwise(length)
    # Trailing means run over rows, not days: a date can have two windows.
    order = Window.partitionBy("match_id").orderBy("date", F.col("sales_window").asc_nulls_last())
    rows = rows.withColumns(
        {
            "days_on_sale": on_sale,
            "days_since_early_bird_start": dates.floor_days("date", "early_bird_start"),
            "sales_progress": clip(on_sale / length, 0.0, 1.0),
            "event_month": F.month("event_date"),
            "is_weekend_event": F.coalesce(F.col("day_of_week").isin(*WEEKEND).cast("int"), F.lit(0)),
            "trailing_3_day_sales": F.avg("daily_sales").over(order.rowsBetween(-2, 0)),
            "trailing_7_day_sales": F.avg("daily_sales").over(order.rowsBetween(-6, 0)),
            "final_sales": F.max("cumulative_sales").over(Window.partitionBy("match_id")),
        }
    )
    rows = rows.withColumns(
        {
            "sales_acceleration": F.coalesce(F.col("trailing_3_day_sales") - F.lag("trailing_3_day_sales").over(order), F.lit(0.0)),
            "cumulative_share_of_final": F.when(F.col("final_sales") > 0, F.col("cumulative_sales") / F.col("final_sales")).otherwise(0.0),
        }
    )
    return filled(rows)


def training_rows(matches: DataFrame, daily: DataFrame, reference=None) -> DataFrame:
    """Feature rows of completed matches that sold something."""
    done = completed_matches(matches, daily, reference)
    rows = sales_features(matches, daily).join(done, "match_id", "left_semi")
    return rows.filter(F.col("final_sales") > 0)


def latest_snapshots(targets: DataFrame, matches: DataFrame, daily: DataFrame) -> DataFrame:
    """Newest feature row of each target match, or its on-sale defaults."""
    wanted = daily.join(targets.select("match_id"), "match_id", "left_semi")
    rows = sales_features(matches, wanted)
    fields = [c for c in (*NUMERIC, *CATEGORICAL, "date") if c in rows.columns]
    order = F.struct("date", F.coalesce("sales_window", F.lit("")))
    newest = rows.groupBy("match_id").agg(F.max_by(F.struct(*fields), order).alias("_seen"))

    sale, event = F.col("on_sale_date").cast("date"), F.col("event_date").cast("date")
    default = {
        "date": sale,
        "days_to_event": dates.floor_days("event_date", "on_sale_date"),
        "sales_window": F.lit("early-bird"),
        "marketing_period": F.lit("none"),
        "early_bird_active": F.lit(1),
        "event_month": F.month(event),
        "is_weekend_event": F.col("day_of_week").isin(*WEEKEND).cast("int"),
    }
    zero = (
        "days_on_sale", "sales_progress", "cumulative_sales", "daily_sales", "trailing_3_day_sales", "trailing_7_day_sales",
        "sales_acceleration", "is_public_holiday", "is_campaign_burst", "membership_on_sale", "days_since_early_bird_start",
    )
    default |= {c: F.lit(0.0) for c in zero}
    blank = targets.withColumns(default)
    joined = blank.join(newest, "match_id", "left")
    own = lambda c: F.col(c) if c in blank.columns else F.lit(None)
    cast = lambda c: "string" if c in CATEGORICAL else "date" if c == "date" else "double"
    picked = [
        F.when(F.col("_seen").isNotNull(), F.col(f"_seen.{c}")).otherwise(own(c).cast(cast(c))).alias(c) for c in fields
    ]
    return filled(joined.select("match_id", *picked))
