"""Assumed fixtures for a season whose real calendar is not out yet."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import dates, keys, seasons
from boxline.operators.common import column_or, has

# Capacities used when a fixture has none.
CAPACITY_BY_VENUE = {"Adelaide Oval": 53500, "Karen Rolton Oval": 5000, "Hurstville Oval": 9000}
DEFAULT_VENUE = {"BBL": "Adelaide Oval", "WBBL": "Karen Rolton Oval"}
# Pattern assumed for a competition without any history.
FALLBACK = {
    "BBL": (
        ("2025-12-18", "Perth Scorchers"),
        ("2025-12-26", "Brisbane Heat"),
        ("2025-12-31", "Sydney Sixers"),
        ("2026-01-10", "Melbourne Stars"),
        ("2026-01-21", "Hobart Hurricanes"),
    ),
    "WBBL": (
        ("2025-10-12", "Sydney Thunder"),
        ("2025-10-19", "Brisbane Heat"),
        ("2025-10-28", "Perth Scorchers"),
        ("2025-11-04", "Melbourne Renegades"),
        ("2025-11-13", "Sydney Sixers"),
    ),
}
NEW_YEAR_COMPETITION = "BBL"
NEW_YEAR_NUMBER = 3
DEFAULT_TIME = "19:15"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class CalendarPlan:
    """What the assumed calendar is made for."""

    season: int
    label: str
    team: str
    seed: int = 2026
    competitions: tuple[str, ...] = ("BBL", "WBBL")
    capacity_by_venue: Mapping[str, int] = field(default_factory=lambda: CAPACITY_BY_VENUE)


def _map(values: Mapping[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _history(fixtures: DataFrame, plan: CalendarPlan) -> DataFrame:
    date_column = "match_date" if has(fixtures, "match_date") else "event_date"
    d = F.col(date_column).cast("date")
    text = lambda name: column_or(fixtures, name, None).cast("string").alias(name)
    known = fixtures.filter(d.isNotNull()).select(
        F.upper(F.coalesce(column_or(fixtures, "competition", None).cast("string"), F.lit("BBL"))).alias("competition"),
        text("opponent"),
        text("venue"),
        d.alias("match_date"),
        text("match_time"),
        F.coalesce(column_or(fixtures, "day_of_week", None).cast("string"), dates.day_name(d)).alias("day_of_week"),
        column_or(fixtures, "capacity_total", None).cast("double").alias("capacity_total"),
        F.coalesce(column_or(fixtures, "season", None).try_cast("int"), seasons.season_start_of_date(d)).alias("season_start"),
        text("fixture_id"),
    ).filter(F.col("competition").isin(*plan.competitions))
    made = [(c, opponent, day) for c in plan.competitions for day, opponent in FALLBACK.get(c, ())]
    fallback = fixtures.sparkSession.createDataFrame(made, "competition string, opponent string, day string").select(
        "competition",
        "opponent",
        _map(DEFAULT_VENUE, F.col("competition")).alias("venue"),
        F.col("day").cast("date").alias("match_date"),
        F.lit(None).cast("string").alias("match_time"),
        dates.day_name(F.col("day").cast("date")).alias("day_of_week"),
        _map(plan.capacity_by_venue, _map(DEFAULT_VENUE, F.col("competition"))).cast("double").alias("capacity_total"),
        F.lit(plan.season - 1).alias("season_start"),
        F.lit(None).cast("string").alias("fixture_id"),
    )
    missing = fallback.join(known.select("competition").distinct(), "competition", "left_anti")
    return known.unionByName(missing)


def rolled_date(d: Column, season: int) -> Column:
    """Same day in the planning season; late February becomes the 28th."""
    year = F.when(F.month(d) >= 7, season).otherwise(season + 1)
    day = F.when(F.month(d) == 2, F.least(F.day(d), F.lit(28))).otherwise(F.day(d))
    return F.make_date(year, F.month(d), day)


def nearest_weekday(d: Column, name: Column) -> Column:
    """Closest date, at most three days off, that falls on a weekday."""
    wanted = F.coalesce(_map({w: i for i, w in enumerate(WEEKDAYS)}, name), F.weekday(d))
    return F.date_add(d, (F.pmod(wanted - F.weekday(d) + 3, F.lit(7)) - 3).cast("int"))


def assumed_fixtures(fixtures: DataFrame, plan: CalendarPlan) -> DataFrame:
    """Calendar rolled forward from each competition's latest season.

    Opponents are drawn in a repeatable order that depends on the seed.
    """
    history = _history(fixtures, plan)
    latest = history.groupBy("competition").agg(F.max("season_start").alias("season_start"))
    base = history.join(latest, ["competition", "season_start"])
    by = Window.partitionBy("competition")
    base = base.withColumns(
        {
            "number": F.row_number().over(by.orderBy("match_date", "fixture_id", "opponent")),
            "_n": F.count(F.lit(1)).over(by),
        }
    )
    pool = history.filter("opponent is not null and opponent <> ''").select("competition", "opponent").distinct()
    draw = F.row_number().over(by.orderBy(F.xxhash64(F.lit(plan.seed), "opponent"), "opponent")) - 1
    pool = pool.withColumns({"_draw": draw, "_pool": F.count(F.lit(1)).over(by)}).withColumnRenamed("opponent", "_drawn")
    sizes = pool.select("competition", "_pool").distinct()
    base = base.join(sizes, "competition", "left").withColumn("_draw", ((F.col("number") - 1) % F.col("_pool")).cast("int"))
    base = base.join(pool.drop("_pool"), ["competition", "_draw"], "left")

    moved = nearest_weekday(rolled_date(F.col("match_date"), plan.season), F.col("day_of_week"))
    special = (F.col("competition") == NEW_YEAR_COMPETITION) & (F.col("number") == F.least(F.lit(NEW_YEAR_NUMBER), F.col("_n")))
    base = base.withColumn("_date", F.when(special, F.make_date(F.lit(plan.season), F.lit(12), F.lit(31))).otherwise(moved))
    base = base.withColumns(
        {
            "_new_year": (F.col("competition") == NEW_YEAR_COMPETITION) & (dates.month_day("_date") == "12-31"),
            "_venue": F.coalesce("venue", _map(DEFAULT_VENUE, F.col("competition"))),
            "_opponent": F.coalesce("_drawn", F.lit("Opponent TBC")),
        }
    )
    plain_id = F.concat(F.col("competition"), F.lit(f"_{plan.season}_ASSUMED_"), F.lpad(F.col("number").cast("string"), 2, "0"))
    new_year_id = F.concat(F.col("competition"), F.lit(f"_{plan.season}_NYE_ASSUMED"))
    pattern = "fixture generated from historical fixture pattern."
    return base.select(
        F.when(F.col("_new_year"), new_year_id).otherwise(plain_id).alias("fixture_id"),
        F.lit(plan.season).alias("season"),
        F.lit(plan.label).alias("season_label"),
        "competition",
        F.lit(plan.team).alias("team"),
        F.col("_opponent").alias("opponent"),
        F.col("_venue").alias("venue"),
        F.col("_date").alias("match_date"),
        F.coalesce("match_time", F.lit(DEFAULT_TIME)).alias("match_time"),
        dates.day_name("_date").alias("day_of_week"),
        F.lit(True).alias("is_home_match"),
        keys.fixture_label("competition", "_opponent", "_date", F.lit("assumed"), F.lit(True)).alias("fixture_label"),
        F.floor(F.coalesce(F.col("capacity_total"), _map(plan.capacity_by_venue, F.col("_venue")).cast("double"))).cast("double").alias("capacity_total"),
        F.lit("assumed").alias("fixture_status"),
        F.lit(False).alias("is_confirmed"),
        F.lit(True).alias("is_assumed"),
        F.lit("medium").alias("assumption_confidence"),
        F.when(F.col("_new_year"), f"Guaranteed/assumed NYE {pattern}")
        .otherwise(f"Assumed {pattern} Replace once official fixture is available.")
        .alias("notes"),
    )
