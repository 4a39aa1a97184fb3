"""Report summaries over ticket rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import dates, keys, windows
from boxline.functions.numbers import safe_ratio
from boxline.operators.common import attach, has, running, total
from boxline.operators.customers import first_season
from boxline.operators.filters import value_column


def next_fixture(fixtures: DataFrame, as_at, date_column: str = "match_date") -> DataFrame:
    """Where a snapshot stands before its next fixture, as one row.

    ``to_next`` is null without a future fixture; ``same_point`` then counts to
    the last fixture and never goes below 0.
    """
    d = F.col(date_column).cast("date")
    at = dates.date_lit(as_at)
    row = fixtures.agg(F.count(d).alias("n"), F.min(F.when(d >= at, d)).alias("next"), F.max(d).alias("last"))
    return row.select(
        F.date_diff("next", at).alias("to_next"),
        F.greatest(F.coalesce(F.date_diff(F.coalesce("next", "last"), at), F.lit(0)), F.lit(0)).alias("same_point"),
        windows.window_of_snapshot(F.col("n") > 0, F.date_diff("next", at)).alias("current_sales_window"),
    )


def kpi_summary(
    tickets: DataFrame, all_tickets: DataFrame, fixtures: DataFrame,
    forecast_total: float = 0.0, target_total: float = 0.0, as_at=None,
) -> DataFrame:
    """Headline figures as one row. Without ticket rows the figures are 0."""
    pairs = tickets.filter("customer_id is not null and season_label is not null").groupBy("customer_id", "season_label").count()
    busiest = (
        pairs.groupBy("season_label").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.min_by("season_label", F.struct(-F.col("n"), "season_label")).alias("v"))
        .scalar()
    )
    buyers = pairs.select("customer_id").distinct().join(first_season(all_tickets), "customer_id", "left")
    is_new = F.coalesce(F.col("first_season") == F.col("busiest"), F.lit(False))
    loyalty = buyers.withColumn("busiest", busiest).agg(F.count(F.lit(1)).alias("_customers"), F.count_if(is_new).alias("_new"))
    point = next_fixture(fixtures, as_at).select("to_next")
    capacity = fixtures.agg(F.sum("capacity_total").cast("double").alias("_capacity"))

    sums = tickets.agg(
        F.count(F.lit(1)).alias("_rows"),
        total("tickets_sold").cast("double").alias("tickets_sold"),
        total("paid_tickets_sold").cast("double").alias("paid_tickets_sold"),
        total("comp_tickets_sold").cast("double").alias("comps_issued"),
        total("gross_revenue").cast("double").alias("gross_revenue"),
        total("net_revenue").cast("double").alias("net_revenue"),
        F.greatest(F.count_distinct("order_id"), F.lit(1)).alias("_orders"),
        F.count_distinct("customer_id").cast("double").alias("unique_purchasers"),
    )
    for row in (loyalty, point, capacity):
        sums = attach(sums, row)
    paid = F.col("paid_tickets_sold")
    days = F.when(F.col("_rows") > 0, F.coalesce("to_next", F.lit(0))).otherwise(0)
    customers, new = F.col("_customers"), F.col("_new")
    gap = F.greatest(F.lit(float(target_total)) - paid, F.lit(0.0)) / F.greatest(days, F.lit(1))
    required = F.when(F.col("_rows") > 0, gap).otherwise(0.0) if target_total else F.lit(0.0)
    return sums.select(
        "tickets_sold", "paid_tickets_sold", "comps_issued", "gross_revenue", "net_revenue",
        F.when(paid != 0, F.col("gross_revenue") / paid).otherwise(0.0).alias("average_ticket_price"),
        (paid / F.col("_orders")).alias("average_basket_size"),
        "unique_purchasers",
        safe_ratio(customers - new, customers).alias("retention_rate"),
        new.cast("double").alias("new_purchasers"),
        F.lit(float(forecast_total)).alias("forecast_total"),
        F.lit(float(target_total)).alias("target_total"),
        F.lit(float(forecast_total - target_total)).alias("gap_to_target"),
        required.alias("required_daily_run_rate"),
        days.cast("double").alias("days_to_next_fixture"),
        F.when(F.col("_rows") > 0, safe_ratio(F.col("tickets_sold"), F.col("_capacity"), None) * 100).alias("capacity_sold_pct"),
    )


def risk_status(forecast: Column, target: Column) -> Column:
    ratio = forecast / target
    return (
        F.when(forecast.isNull() | target.isNull() | (target <= 0) | (forecast <= 0), "watch")
        .when(ratio >= 1.02, "on track")
        .when(ratio >= 0.92, "watch")
        .otherwise("at risk")
    )


def fixture_summary(tickets: DataFrame, fixtures: DataFrame, matches: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """Sales, target, forecast, gap and risk of each fixture.

    ``forecasts`` holds ``match_id`` and ``expected``.
    """
    sales = tickets.filter(F.col("fixture_id").isNotNull()).groupBy("fixture_id").agg(
        F.sum("tickets_sold").cast("double").alias("sold"),
        F.sum("paid_tickets_sold").cast("double").alias("paid_sold"),
        F.sum("comp_tickets_sold").cast("double").alias("comps"),
        F.sum("gross_revenue").cast("double").alias("gross_revenue"),
        F.count_distinct("customer_id").alias("unique_purchasers"),
    )
    targets = matches.select(F.col("match_id").alias("fixture_id"), F.coalesce("manual_target", "baseline_target").alias("target"))
    rows = fixtures.join(sales, "fixture_id", "left").join(targets, "fixture_id", "left")
    if forecasts is not None:
        rows = rows.join(forecasts.select(F.col("match_id").alias("fixture_id"), F.col("expected").alias("forecast")), "fixture_id", "left")
    else:
        rows = rows.withColumn("forecast", F.lit(0.0))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("sold", "paid_sold", "comps", "gross_revenue", "unique_purchasers", "target", "forecast")}
    rows = rows.withColumns(zero)
    return rows.withColumns(
        {
            "gap": F.col("forecast") - F.col("target"),
            "capacity_sold_pct": safe_ratio(F.col("sold"), F.col("capacity_total"), None) * 100,
            "risk_status": risk_status(F.col("forecast"), F.col("target")),
        }
    )


def _audience_measures() -> list[Column]:
    return [
        F.sum("paid_tickets_sold").cast("double").alias("paid_tickets"),
        F.sum("comp_tickets_sold").cast("double").alias("comps"),
        F.sum("gross_revenue").cast("double").alias("gross_revenue"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("order_id").alias("orders"),
    ]


def _audience_shares(grouped: DataFrame, min_size: int, *per: str) -> DataFrame:
    kept = grouped.filter((F.col("customers") >= min_size) | (F.col("paid_tickets") >= min_size))
    all_paid = F.greatest(F.sum("paid_tickets").over(Window.partitionBy(*per)), F.lit(1.0))
    share = F.col("paid_tickets") / all_paid * 100
    kept = kept.withColumns(
        {
            "average_ticket_price": safe_ratio(F.col("gross_revenue"), F.col("paid_tickets")),
            "average_basket_size": safe_ratio(F.col("paid_tickets"), F.col("orders")),
            "contribution_pct": share,
        }
    )
    status = (
        F.when(F.col("contribution_pct") >= 20, "growth engine")
        .when(F.col("comps") > F.col("paid_tickets") * 0.25, "comp masking risk")
        .otherwise("watch")
    )
    return kept.withColumn("status", status)


def audience_summary(tickets: DataFrame, group_by: str = "ticket_class", min_size: int = 0) -> DataFrame:
    """Paid tickets, comps, revenue, customers and share per group."""
    label = F.coalesce(F.col(group_by).cast("string"), F.lit("Unknown"))
    grouped = tickets.groupBy(label.alias(group_by)).agg(*_audience_measures())
    return _audience_shares(grouped, min_size)


def audience_summaries(tickets: DataFrame, dimensions: Sequence[str], min_size: int = 0) -> DataFrame:
    """The same summary for several dimensions from one scan."""
    labelled = tickets.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("Unknown")) for d in dimensions})
    grouped = labelled.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    # Every label is filled in above, so the one non-null column is the group.
    name = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions])
    rows = grouped.agg(*_audience_measures()).withColumns({"dimension": name, "group_value": F.coalesce(*dimensions)})
    return _audience_shares(rows.drop(*dimensions), min_size, "dimension")


def window_summary(tickets: DataFrame) -> DataFrame:
    """Paid tickets and share per sales window, with a planning weight."""
    grouped = tickets.groupBy(F.coalesce("sales_window", F.lit("unknown")).alias("sales_window")).agg(
        F.sum("paid_tickets_sold").cast("double").alias("paid_tickets"),
        F.sum("comp_tickets_sold").cast("double").alias("comps"),
        F.sum("gross_revenue").cast("double").alias("gross_revenue"),
        F.count_distinct("customer_id").alias("customers"),
    )
    all_paid = F.greatest(F.sum("paid_tickets").over(Window.partitionBy()), F.lit(1.0))
    return grouped.withColumns(
        {
            "window_share_pct": F.col("paid_tickets") / all_paid * 100,
            "recommended_weight": F.when(F.col("sales_window").isin("early-sales", "match-week"), 1.15).otherwise(1.0),
        }
    )


def sales_curve(tickets: DataFrame, status: str) -> DataFrame:
    """Daily and running sales of the measure that fits a ticket status."""
    value = F.coalesce(F.col(value_column(status)).cast("double"), F.lit(0.0))
    daily = (
        tickets.filter(F.col("transaction_date").isNotNull())
        .groupBy(F.col("transaction_date").cast("date").alias("date"))
        .agg(F.sum(value).alias("actual_daily"))
    )
    # One row per calendar day from here on.
    return daily.withColumn("actual_cumulative", F.sum("actual_daily").over(running(order=["date"])))


def season_comparison(matches: DataFrame, daily: DataFrame, competition: str, season_labels: Sequence[str]) -> DataFrame:
    """Running sales of seasons, aligned on days since each season's first sale."""
    chosen = matches.filter((F.col("competition") == competition) & F.col("season_label").isin(list(season_labels)))
    rows = daily.join(chosen.select("match_id", "season_label"), "match_id")
    per_day = rows.groupBy("season_label", "date").agg(F.sum("daily_sales").alias("daily_sales"))
    return per_day.withColumns(
        {
            "actual_cumulative": F.sum("daily_sales").over(running("season_label", order=["date"])),
            "season_day": F.date_diff("date", F.min("date").over(Window.partitionBy("season_label"))),
        }
    )


def scenario_summary(curve: DataFrame) -> DataFrame:
    """Projected finish of each scenario and its gap to plan."""
    last = lambda c: F.max_by(c, "date")
    ends = curve.agg(
        (last("target_cumulative") if has(curve, "target_cumulative") else F.lit(0.0)).alias("_plan"),
        last("forecast_expected_cumulative").alias("ML expected forecast"),
        last("uplift_10_cumulative").alias("10% uplift target"),
        last("manual_target_cumulative").alias("Manual target"),
    )
    names = ["ML expected forecast", "10% uplift target", "Manual target"]
    long = ends.unpivot("_plan", names, "scenario", "projected_finish")
    return long.select("scenario", "projected_finish", (F.col("projected_finish") - F.col("_plan")).alias("gap_to_plan"))


def purchase_window_dates(planning_matches: DataFrame) -> DataFrame:
    """Sale phases of the first planning fixture."""
    phases = ("early_bird_start", "early_bird_end", "member_presale_start", "member_presale_end", "general_public_start")
    first = F.min_by(F.struct(*phases), F.struct("event_date", "match_id"))
    return planning_matches.agg(first.alias("_first")).select("_first.*")


def mean_of_season_totals(tickets: DataFrame, value: str, competition: str = "All") -> DataFrame:
    """Average season total of a measure, optionally of one competition."""
    rows = tickets if competition == "All" else tickets.filter(F.col("competition") == competition)
    seasons_total = rows.filter(F.col("season_label").isNotNull()).groupBy("season_label").agg(total(value).cast("double").alias("v"))
    return seasons_total.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("season_mean"))


def insights(kpis: DataFrame, fixture_rows: DataFrame, audience: DataFrame, label: str) -> DataFrame:
    """One to three sentences, one row each."""
    gap = F.col("gap_to_target")
    plan = kpis.select(
        F.lit(1).alias("position"),
        F.when(
            gap < 0,
            F.concat(
                F.lit("Forecast is "), keys.thousands(F.abs(gap)),
                F.lit(" paid tickets behind the selected target. Required run-rate is "),
                keys.thousands(F.col("required_daily_run_rate")), F.lit(" paid tickets per day."),
            ),
        ).otherwise(
            F.concat(
                F.lit("Forecast is "), keys.thousands(gap),
                F.lit(" paid tickets ahead of the selected target. Protect yield before using discount-led demand."),
            )
        ).alias("insight"),
    )
    worst = fixture_rows.agg(F.min_by(F.struct("fixture_label", "gap"), F.struct("gap", "fixture_id")).alias("w")).filter("w is not null")
    fixture = worst.select(
        F.lit(2).alias("position"),
        F.concat(
            F.lit("Largest fixture watch item: "), F.coalesce("w.fixture_label", F.lit("selected fixture")), F.lit(" is "),
            keys.thousands(F.abs("w.gap")), F.lit(" tickets "),
            F.when(F.col("w.gap") < 0, "behind").otherwise("ahead of"), F.lit(" target."),
        ).alias("insight"),
    )
    best = audience.agg(
        F.min_by(F.struct(F.col(label).alias("name"), "paid_tickets", "contribution_pct"), F.struct(-F.col("paid_tickets"), label)).alias("b")
    ).filter("b is not null")
    group = best.select(
        F.lit(3).alias("position"),
        F.concat(
            F.lit("Biggest visible audience contributor is "), F.col("b.name"), F.lit(" with "), keys.thousands(F.col("b.paid_tickets")),
            F.lit(" paid tickets and "), keys.thousands(F.col("b.contribution_pct"), 1), F.lit("% share."),
        ).alias("insight"),
    )
    return plan.unionByName(fixture).unionByName(group)
