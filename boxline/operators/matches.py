"""Fixtures, ticket-to-fixture matching, forecasting matches and daily sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boxline.functions import dates, keys, seasons
from boxline.functions.numbers import clip, round_hundreds
from boxline.operators.common import column_or, first_per_key, has, running
from boxline.operators.quantiles import exact_quantile

# Fixed values of the planning rules, by competition where they differ.
FAMILY_COMPETITION = "WBBL"
MAIN_COMPETITION = "BBL"
ON_SALE_DAYS = {FAMILY_COMPETITION: 90}
DEFAULT_ON_SALE_DAYS = 120
MAIN_PRICE, OTHER_PRICE = 49.0, 29.0
MAIN_FLOOR, OTHER_FLOOR = 0.58, 0.46
MAIN_TEMP, OTHER_TEMP = 28, 23
MARQUEE_OPPONENTS = "(?i)Sixers|Scorchers|Heat"
HOLIDAYS = ("12-31", "01-26")
NEW_YEAR = "12-31"
DEFAULT_BASELINE = 5000.0

# Columns of the result.
MATCH_COLUMNS = (
    "match_id", "season", "season_label", "competition", "team", "round", "home_match_number",
    "opponent", "venue", "event_date", "on_sale_date", "early_bird_start", "early_bird_end",
    "member_presale_start", "member_presale_end", "general_public_start", "day_of_week",
    "event_category", "campaign_theme", "opponent_strength", "historical_attendance",
    "ticket_price", "membership_base", "prior_season_performance", "weather_temp_c",
    "marketing_start", "marketing_end", "campaign_burst_date", "public_holiday",
    "school_holiday", "double_header", "finals_contention", "baseline_target",
    "manual_target", "planning_season", "fixture_status", "is_assumed", "capacity_total",
)
# Columns of the result.
DAILY_COLUMNS = (
    "match_id", "date", "days_to_event", "daily_sales", "cumulative_sales", "sales_window",
    "marketing_period", "is_public_holiday", "is_campaign_burst", "membership_on_sale",
    "early_bird_active", "school_holiday", "source",
)


def prepare_fixtures(fixtures: DataFrame) -> DataFrame:
    """Fill season, label and id, then keep one row per fixture id."""
    rows = fixtures.filter(F.col("match_date").isNotNull())
    label = F.coalesce("season_label", seasons.season_label_of_date("match_date"))
    rows = rows.withColumn("season_label", label)
    rows = rows.withColumn("season", F.coalesce(F.col("season"), seasons.season_start("season_label")))
    rows = rows.withColumns(
        {
            "fixture_label": keys.fixture_label(
                "competition", "opponent", "match_date", "fixture_status", column_or(rows, "is_assumed", False)
            ),
            "fixture_id": F.coalesce("fixture_id", keys.fixture_id("competition", "season_label", "match_date", "opponent", "venue")),
        }
    )
    order = [c for c in ("source_file", "source_row_number") if has(rows, c)]
    return first_per_key(rows, "fixture_id", *(order or ["match_date", "competition", "opponent"]))


def infer_fixtures(tickets: DataFrame) -> DataFrame:
    """Fixtures implied by the ticket rows, when no fixture list exists."""
    by = ["competition", "season_label", "opponent", "venue", "match_date"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("transaction_date", "transaction_id")))
    rows = (
        tickets.filter(F.col("match_date").isNotNull())
        .groupBy(*by)
        .agg(first("team").alias("team"), first("fixture_name").alias("fixture_name"))
    )
    rows = rows.withColumns(
        {
            "season": seasons.season_start("season_label"),
            "match_time": F.lit(""),
            "day_of_week": dates.day_name("match_date"),
            "is_home_match": F.lit(True),
            "capacity_total": F.lit(None).cast("double"),
            "notes": F.lit("Inferred from ticket export because fixture CSV was unavailable."),
            "fixture_status": F.lit("historical"),
            "is_confirmed": F.lit(False),
            "is_assumed": F.lit(False),
        }
    )
    return rows.withColumns(
        {
            "fixture_label": keys.fixture_label("competition", "opponent", "match_date", "fixture_status", "is_assumed"),
            "fixture_id": keys.fixture_id("competition", "season_label", "match_date", "opponent", "venue"),
        }
    )


def match_tickets(tickets: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Two-stage match of ticket rows to fixtures.

    Score 1.0 when competition, season, opponent, venue and date agree. A row
    still without a fixture takes the one fixture that agrees on all but the
    date, if there is exactly one (0.72). Otherwise 0.
    """
    key = ("competition", "season_label", "opponent", "venue")
    order = F.struct("match_date", "fixture_id")
    exact = (
        fixtures.groupBy(keys.match_key(*key, "match_date").alias("_exact"))
        .agg(F.min_by("fixture_id", order).alias("_exact_id"))
    )
    soft = (
        fixtures.groupBy(keys.match_key(*key).alias("_soft"))
        .agg(F.min("fixture_id").alias("_soft_id"), F.max("fixture_id").alias("_last_id"))
        .filter(F.col("_soft_id") == F.col("_last_id"))
        .drop("_last_id")
    )
    rows = tickets if has(tickets, "fixture_id") else tickets.withColumn("fixture_id", F.lit(None).cast("string"))
    rows = rows.withColumns({"_exact": keys.match_key(*key, "match_date"), "_soft": keys.match_key(*key)})
    rows = rows.join(exact, "_exact", "left").join(soft, "_soft", "left")
    known = F.coalesce("fixture_id", "_exact_id")
    score = (
        F.when(F.col("_exact_id").isNotNull(), 1.0)
        .when(known.isNull() & F.col("_soft_id").isNotNull(), 0.72)
        .otherwise(0.0)
    )
    rows = rows.withColumns({"fixture_match_score": score, "fixture_id": F.coalesce(known, "_soft_id")})
    return rows.drop("_exact", "_soft", "_exact_id", "_soft_id")


def merge_fixtures(fixtures: DataFrame, future: DataFrame, planning_label: str) -> DataFrame:
    """Historical plus future fixtures.

    Future rows of a competition are left out once it has real fixtures in the
    planning season.
    """
    settled = fixtures.filter(
        (F.col("season_label") == planning_label) & F.col("fixture_status").isin("confirmed", "historical")
    ).select("competition").distinct()
    added = future.join(settled, "competition", "left_anti")
    both = fixtures.withColumn("_rank", F.lit(0)).unionByName(added.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, "fixture_id", "_rank", "match_date").drop("_rank")


def forecasting_matches(tickets: DataFrame, fixtures: DataFrame, planning_season: int, planning_label: str) -> DataFrame:
    """Match table with sale phases, price, category and targets."""
    sold = tickets.filter(F.col("fixture_id").isNotNull())
    sales = sold.groupBy("fixture_id").agg(
        F.min("transaction_date").alias("_first_sale"), F.sum("paid_tickets_sold").alias("_paid")
    )
    paid = sold.filter(F.col("paid_tickets_sold") > 0).select(
        "fixture_id", (F.col("gross_revenue").cast("double") / F.col("paid_tickets_sold")).alias("_atp")
    )
    price = exact_quantile(paid, "_atp", 0.5, ["fixture_id"], name="_price")
    rows = fixtures.join(sales, "fixture_id", "left").join(price, "fixture_id", "left")

    main = F.col("competition") == MAIN_COMPETITION
    family = F.col("competition") == FAMILY_COMPETITION
    event = F.col("match_date").cast("date")
    default_sale = F.date_sub(event, F.when(family, ON_SALE_DAYS[FAMILY_COMPETITION]).otherwise(DEFAULT_ON_SALE_DAYS))
    on_sale = F.coalesce(F.col("_first_sale").cast("timestamp_ntz"), default_sale.cast("timestamp_ntz"))
    plus = lambda c, n: F.col(c) + F.make_dt_interval(F.lit(n))
    capacity = F.coalesce(F.col("capacity_total"), F.lit(0.0))

    rows = rows.withColumns(
        {
            "match_id": F.col("fixture_id").cast("string"),
            "season": F.coalesce(column_or(rows, "season", None).try_cast("int"), seasons.season_start("season_label"), F.lit(planning_season)),
            "event_date": event,
            "on_sale_date": on_sale,
            "marketing_start": F.date_sub(event, 28),
            "marketing_end": F.date_sub(event, 10),
            "campaign_burst_date": F.date_sub(event, 7),
            "day_of_week": dates.day_name("match_date"),
            "opponent_strength": F.lit(80),
            "historical_attendance": capacity * 0.55,
            "ticket_price": clip(F.coalesce(F.col("_price"), F.when(main, MAIN_PRICE).otherwise(OTHER_PRICE)), low=0.0),
            "membership_base": F.lit(0),
            "prior_season_performance": F.lit(0),
            "weather_temp_c": F.when(main, MAIN_TEMP).otherwise(OTHER_TEMP),
            "double_header": F.lit(0),
            "finals_contention": F.lit(0),
            "planning_season": F.coalesce((F.col("season_label") == planning_label).cast("int"), F.lit(0)),
        }
    )
    rows = rows.withColumns({"early_bird_start": F.col("on_sale_date"), "early_bird_end": plus("on_sale_date", 20)})
    rows = rows.withColumn("member_presale_start", plus("early_bird_end", 7))
    rows = rows.withColumn("member_presale_end", plus("member_presale_start", 6))
    rows = rows.withColumn("general_public_start", plus("member_presale_end", 1))
    month_day = dates.month_day("event_date")
    category = (
        F.when(month_day == NEW_YEAR, "new-year")
        .when(family, "family")
        .when(F.col("opponent").rlike(MARQUEE_OPPONENTS), "marquee")
        .otherwise("standard")
    )
    floor = capacity * F.when(main, MAIN_FLOOR).otherwise(OTHER_FLOOR)
    baseline = round_hundreds(F.greatest(F.coalesce(F.col("_paid"), F.lit(0.0)) * 1.08, floor))
    rows = rows.withColumns(
        {
            "event_category": category,
            "public_holiday": F.coalesce(month_day.isin(*HOLIDAYS).cast("int"), F.lit(0)),
            "school_holiday": F.coalesce(F.month("event_date").isin(12, 1).cast("int"), F.lit(0)),
            "baseline_target": F.when(baseline < 1, DEFAULT_BASELINE).otherwise(baseline),
            "round": F.row_number().over(Window.partitionBy("season_label", "competition").orderBy("event_date", "match_id")),
        }
    )
    rows = rows.withColumns(
        {
            "campaign_theme": F.when(F.col("event_category") == "new-year", "New Year's Eve Bash").otherwise("Fixture push"),
            "manual_target": round_hundreds(F.col("baseline_target") * 1.08),
            "home_match_number": F.col("round"),
        }
    )
    return match_columns(rows)


def match_columns(rows: DataFrame) -> DataFrame:
    """Fixed column order, with defaults for columns that are absent."""
    default = {"fixture_status": "historical", "is_assumed": False}
    return rows.select(*[column_or(rows, c, default.get(c, 0)).alias(c) for c in MATCH_COLUMNS])


def between(d, start, end):
    """Inclusive date test, false when a bound is missing."""
    inside = (F.col(d) >= F.col(start)) & (F.col(d) <= F.col(end))
    return F.coalesce(inside, F.lit(False))


def daily_sales(tickets: DataFrame, matches: DataFrame, source: str = "real_csv_normalised") -> DataFrame:
    """Sales per fixture, day and sales window with a running total."""
    sold = tickets.filter("fixture_id is not null and transaction_date is not null")
    daily = (
        sold.groupBy("fixture_id", F.col("transaction_date").cast("date").alias("date"), "sales_window")
        .agg(F.sum("paid_tickets_sold").alias("daily_sales"))
    )
    facts = matches.select(
        "match_id", "event_date", "early_bird_start", "early_bird_end", "member_presale_start", "member_presale_end",
        "marketing_start", "marketing_end", "campaign_burst_date", "school_holiday",
    )
    rows = daily.join(facts, daily.fixture_id == facts.match_id, "left")
    spec = running("match_id", order=["date", F.col("sales_window").asc_nulls_last()])
    from_burst = F.abs(F.date_diff("date", "campaign_burst_date"))
    rows = rows.withColumns(
        {
            "days_to_event": F.date_diff(F.col("event_date").cast("date"), F.col("date")),
            "cumulative_sales": F.when(F.col("match_id").isNotNull(), F.sum("daily_sales").over(spec)),
            "marketing_period": F.when(between("date", "marketing_start", "marketing_end"), "active").otherwise("none"),
            "is_public_holiday": F.coalesce(dates.month_day("event_date").isin(*HOLIDAYS).cast("int"), F.lit(0)),
            "is_campaign_burst": F.coalesce((from_burst <= 1).cast("int"), F.lit(0)),
            "membership_on_sale": between("date", "member_presale_start", "member_presale_end").cast("int"),
            "early_bird_active": between("date", "early_bird_start", "early_bird_end").cast("int"),
            "source": F.lit(source),
        }
    )
    return rows.select(*DAILY_COLUMNS)


def fixtures_from_matches(matches: DataFrame, status: str = "historical") -> DataFrame:
    """Fixture view of a match table."""
    assumed = status == "assumed"
    rows = matches.withColumnsRenamed({"match_id": "fixture_id", "event_date": "match_date"})
    rows = rows.withColumns(
        {
            "fixture_status": F.lit(status),
            "is_confirmed": F.lit(not assumed),
            "is_assumed": F.lit(assumed),
            "capacity_total": column_or(rows, "capacity_total", None).cast("double"),
            "notes": F.lit(f"{'Planning' if assumed else 'Historical'} fixture from the match table."),
        }
    )
    rows = rows.withColumn("fixture_label", keys.fixture_label("competition", "opponent", "match_date", "fixture_status", "is_assumed"))
    return rows.select(
        "fixture_id", "season", "season_label", "competition", "team", "opponent", "venue", "match_date", "day_of_week",
        "fixture_label", "capacity_total", "fixture_status", "is_confirmed", "is_assumed", "notes",
    )


def completed_matches(matches: DataFrame, daily: DataFrame, reference=None) -> DataFrame:
    """Ids of matches already played by the reference date, or with a day-0 sale."""
    as_of = dates.date_lit(reference) if reference is not None else daily.agg(F.max("date").alias("v")).scalar()
    played = matches.filter(F.col("event_date") <= as_of).select("match_id")
    seen = daily.filter(F.col("days_to_event") == 0).select("match_id")
    return played.union(seen).filter(F.col("match_id").isNotNull()).distinct()


def final_sales(daily: DataFrame) -> DataFrame:
    """Highest running total per match; refunds can make it differ from the last one."""
    return daily.groupBy("match_id").agg(F.max("cumulative_sales").alias("final_sales"))
