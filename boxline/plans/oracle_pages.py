"""Reference SQL of page tables: each page shows what an operator's own query returns."""

from boxline.plans import oracle_audience, oracle_curves  # noqa: F401
from boxline.plans.oracle import ORACLE

for _page, _query in {
    "page_forecasting_drafts": "target_drafts",
    "page_tracker_highlights": "risk_highlights",
    "page_breakdown_curve": "segment_projection",
    "page_planner_recommendations": "marketing_recommendations",
    "page_planner_coverage": "demographic_coverage",
    "page_planning_early_segments": "early_onsale_segments",
    "page_recommended_windows": "sales_window_summary",
    "page_report_insights": "insight_lines",
    "page_overview_seasons": "season_comparison",
    "page_admin_metrics": "load_metrics",
}.items():
    ORACLE[_page] = ORACLE[_query]
