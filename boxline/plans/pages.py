"""Report pages: the tables each of them shows, as one dictionary per page."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from boxline.operators.common import ranked
from boxline.operators import curves, filters, index as ix, plan_targets, projection, quality, recommend, summaries
from boxline.operators.filters import TicketFilter, filter_tickets, scoped

AUDIENCE_DIMENSIONS = ("ticket_class", "price_type", "sales_channel")
REPORT_COLUMNS = (
    "analysis_group", "status", "current_paid_tickets", "expected_paid_tickets_by_now", "ticket_index", "paid_ticket_gap",
    "recommended_action",
)

Page = dict[str, DataFrame]


def historic_sales(tickets: DataFrame, fixtures: DataFrame, matches: DataFrame, f: TicketFilter, as_at) -> Page:
    rows = filter_tickets(tickets, f)
    own = scoped(fixtures, f.season_label, f.competition, f.fixture_ids)
    return {
        "kpis": summaries.kpi_summary(rows, tickets, own, as_at=as_at),
        "curve": summaries.sales_curve(rows, f.ticket_status),
        "fixtures": summaries.fixture_summary(rows, own, matches),
    }


def fixture_forecasting(table: DataFrame, saved: DataFrame) -> Page:
    drafts = plan_targets.draft_table(table, saved)
    return {
        "drafts": drafts,
        "status": plan_targets.target_status(drafts, saved),
        "issues": plan_targets.validate(drafts),
    }


def season_tracker(tickets, customers, fixtures, matches, f: TicketFilter, as_at, baseline: Sequence[str], forecasts: DataFrame) -> Page:
    rows = filter_tickets(tickets, replace(f, as_at=as_at))
    own = scoped(fixtures, f.season_label, f.competition)
    segments = ix.expected_index(tickets, customers, matches, f.season_label, f.competition, as_at, "segment", baseline)
    classes = ix.expected_index(tickets, customers, matches, f.season_label, f.competition, as_at, "ticket_class", baseline)
    return {
        "fixtures": summaries.fixture_summary(rows, own, matches, forecasts),
        "audience_index": segments,
        "class_index": classes,
        "highlights": recommend.risk_highlights(segments, classes),
    }


def single_fixture(outputs, tickets: DataFrame, match_id: str) -> Page:
    one = F.col("match_id") == match_id
    return {
        "chart": outputs.chart().filter(one),
        "scenarios": summaries.scenario_summary(outputs.chart().filter(one)),
        "class_drivers": summaries.audience_summary(tickets.filter(F.col("fixture_id") == match_id), "ticket_class"),
    }


def last_season(tickets, matches, f: TicketFilter, start, event_date) -> DataFrame:
    """Sales of a selection in the latest season before the planned one, on the planning calendar."""
    past = tickets.filter(F.col("season_label") == filters.latest_season(matches, f.season_label))
    chosen = filters.filter_tickets(past, replace(f, season_label=filters.ALL, as_at=None))
    return curves.aligned_history(chosen, f.ticket_status, curves.chart_length(start, event_date), start, blend=False, name="last_season")


def target_breakdown(tickets, matches, f: TicketFilter, baseline: Sequence[str], start, event_date, as_at, saved: DataFrame, total: float) -> Page:
    history = tickets.filter(F.col("season_label").isin(list(baseline)))
    planned = scoped(matches, f.season_label, f.competition)
    curve = projection.segment_projection(tickets, history, f, start, event_date, total, as_at, f.season_label, competition=f.competition)
    return {
        "curve": curve,
        "chart": curves.breakdown_chart(curve, plan_targets.target_totals(planned, saved), last_season(tickets, matches, f, start, event_date)),
        "summary": projection.projection_summary(curve, history, f, as_at),
        "target_totals": plan_targets.target_totals(planned, saved),
        "missing": plan_targets.missing_labels(planned, saved),
    }


def marketing_planner(tickets, customers, matches, season_label: str, competition: str, as_at, baseline: Sequence[str], min_marketable: float) -> Page:
    page: Page = {}
    for kind in ix.seg.KINDS:
        page[f"index_{kind}"] = ix.expected_index(tickets, customers, matches, season_label, competition, as_at, kind, baseline)
    page["recommendations"] = recommend.present(
        recommend.marketing_recommendations(page["index_segment"], min_marketable), ("rank", *recommend.RECOMMENDATION_COLUMNS)
    )
    page["windows"] = summaries.window_summary(tickets.filter(F.col("season_label") == season_label))
    page["coverage"] = quality.demographic_coverage(customers)
    return page


def audience_planning(tickets, customers, matches, season_label: str, competition: str, as_at, baseline: Sequence[str], field: str, min_size: float) -> Page:
    return {
        "index": ix.expected_index(tickets, customers, matches, season_label, competition, as_at, "segment", baseline),
        "early_segments": recommend.early_segments(tickets, max(baseline), competition, field, min_size),
    }


def audience_tracking(tickets, f: TicketFilter, baseline: Sequence[str], start, event_date, as_at, target: DataFrame | None = None) -> Page:
    rows = filter_tickets(tickets, replace(f, as_at=as_at))
    history = filter_tickets(
        tickets.filter(F.col("season_label").isin(list(baseline))), replace(f, season_label=None, fixture_ids=(), as_at=None)
    )
    actual = curves.actual_curve(rows, f.ticket_status)
    past = curves.aligned_history(history, f.ticket_status, curves.chart_length(start, event_date), start)
    return {"chart": curves.tracking_chart(actual, past, target), "groups": summaries.audience_summaries(rows, AUDIENCE_DIMENSIONS)}


def recommended(tickets, customers, season_label: str, min_size: int) -> Page:
    return {
        "audiences": recommend.recommended_audiences(customers, tickets, season_label, min_size),
        "windows": summaries.window_summary(tickets),
    }


def report(tickets, customers, fixtures, matches, f: TicketFilter, as_at, baseline: Sequence[str], forecasts: DataFrame, forecast_total: float, target_total: float, max_fixtures: int | None = None, max_groups: int | None = None) -> Page:
    """Content of the printed report; everything, by rank, unless limits are given."""
    rows = filter_tickets(tickets, replace(f, as_at=as_at))
    own = scoped(fixtures, f.season_label, f.competition)
    kpis = summaries.kpi_summary(rows, tickets, own, forecast_total, target_total, as_at)
    summary = summaries.fixture_summary(rows, own, matches, forecasts)
    audience = summaries.audience_summary(rows, "ticket_class")
    page = {
        "kpis": kpis,
        "insights": summaries.insights(kpis, summary, audience, "ticket_class"),
        "fixtures": ranked(summary, "competition", "match_date", "fixture_id", limit=max_fixtures),
    }
    for kind in ("segment", "ticket_type", "ticket_class"):
        rows_of = ix.expected_index(tickets, customers, matches, f.season_label, f.competition, as_at, kind, baseline)
        page[f"index_{kind}"] = recommend.present(ix.in_report_order(rows_of, max_groups), ("rank", *REPORT_COLUMNS))
    return page


def historical_overview(tickets, fixtures, customers, matches, daily, competition: str, seasons: Sequence[str], as_at) -> Page:
    metrics = quality.load_metrics(tickets, fixtures, customers)
    return {
        "kpis": summaries.kpi_summary(tickets, tickets, fixtures, as_at=as_at),
        "fixtures": summaries.fixture_summary(tickets, fixtures, matches),
        "seasons": summaries.season_comparison(matches, daily, competition, seasons),
        "warnings": quality.validation_warnings(tickets, fixtures, customers, metrics),
    }


def data_admin(tickets, fixtures, customers, enriched, today) -> Page:
    metrics = quality.load_metrics(tickets, fixtures, customers)
    return {
        "profile": quality.profile_columns(tickets),
        "metrics": metrics,
        "warnings": quality.validation_warnings(tickets, fixtures, customers, metrics),
        "coverage": quality.demographic_coverage(customers),
        "match_metrics": quality.demographic_match_metrics(enriched, customers),
        "freshness": quality.snapshot_freshness(tickets, today),
    }
