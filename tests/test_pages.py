"""Every report page builds, and its tables have columns."""

from pyspark.sql import functions as F

from boxline.operators import customers as cust
from boxline.operators.filters import TicketFilter
from boxline.operators.plan_targets import SAVED_SCHEMA
from boxline.plans import outputs, pages
from boxline.sources import star

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    m = star.load(spark, SF)
    f = TicketFilter(season_label=star.PLANNING_LABEL, competition="BBL")
    saved = spark.createDataFrame([], SAVED_SCHEMA)
    few = outputs.pace_forecasts(m.planned, m.matches, m.daily)
    labelled = m.planned.join(m.fixtures.select(F.col("fixture_id").alias("match_id"), "fixture_label"), "match_id")
    start, event, base = "2024-08-01", "2025-02-15", star.BASELINE
    made = {
        "historic": pages.historic_sales(m.tickets, m.fixtures, m.matches, f, star.AS_AT),
        "forecasting": pages.fixture_forecasting(outputs.forecast_table(labelled, few), saved),
        "tracker": pages.season_tracker(m.tickets, m.customers, m.fixtures, m.matches, f, star.AS_AT, base, few),
        "fixture": pages.single_fixture(outputs.fixture_outputs(m.planned, m.matches, m.daily, few, base), m.tickets, "2024-3"),
        "breakdown": pages.target_breakdown(m.tickets, m.matches, f, base, start, event, star.AS_AT, saved, 1000.0),
        "planner": pages.marketing_planner(m.tickets, m.customers, m.matches, star.PLANNING_LABEL, "BBL", star.AS_AT, base, 10),
        "planning": pages.audience_planning(m.tickets, m.customers, m.matches, star.PLANNING_LABEL, "BBL", star.AS_AT, base, "ticket_class", 1),
        "tracking": pages.audience_tracking(m.tickets, f, base, start, event, star.AS_AT),
        "recommended": pages.recommended(m.tickets, m.customers, star.PLANNING_LABEL, 5),
        "report": pages.report(m.tickets, m.customers, m.fixtures, m.matches, f, star.AS_AT, base, few, 1000.0, 2000.0),
        "overview": pages.historical_overview(m.tickets, m.fixtures, m.customers, m.matches, m.daily, "BBL", base, star.AS_AT),
        "admin": pages.data_admin(m.tickets, m.fixtures, m.customers, cust.enrich_demographics(m.tickets, m.customers), "2025-01-01"),
    }
    assert all(table.columns for page in made.values() for table in page.values())
    assert made["report"]["insights"].count() == 3
    assert made["breakdown"]["missing"].count() == made["breakdown"]["target_totals"].first().missing > 0
    assert made["forecasting"]["drafts"].filter("target_state = 'Missing target'").count() == made["forecasting"]["status"].count()
    assert made["fixture"]["scenarios"].count() == 3
