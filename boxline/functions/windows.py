"""The three sales-window ladders. They have different steps on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxline.functions.dates import floor_days
from boxline.functions.text import col

# Place of each sales window in the season.
WINDOW_ORDER = {
    "on-sale": 0,
    "member-pre-sale": 0,
    "pre-sale": 0,
    "early-sales": 1,
    "early-bird": 1,
    "general-sale": 2,
    "general-public": 2,
    "campaign-window": 3,
    "black-friday": 3,
    "christmas-nye-push": 3,
    "match-week": 4,
}
DEFAULT_ORDER = 2


def window_of_sale(sold_at: Column | str, match_date: Column | str) -> Column:
    """Window of one sale by days left to its match."""
    days = floor_days(match_date, sold_at)
    return (
        F.when(days <= 7, "match-week")
        .when(days <= 28, "campaign-window")
        .when(days <= 75, "general-sale")
        .when(days > 75, "early-sales")
        .otherwise("unknown")
    )


def window_of_snapshot(has_fixtures: Column, days_to_next: Column) -> Column:
    """Window the whole plan is in, by days to the next fixture."""
    return (
        F.when(~has_fixtures, "snapshot-review")
        .when(days_to_next.isNull() | (days_to_next <= 7), "match-week")
        .when(days_to_next <= 35, "campaign-window")
        .when(days_to_next <= 80, "general-sale")
        .otherwise("early-sales")
    )


def window_of_offset(offset: Column | str) -> Column:
    """Window of a projected day, by days since the season went on sale."""
    offset = col(offset)
    return (
        F.when(offset.isNull(), "unknown")
        .when(offset <= 31, "early-sales")
        .when(offset <= 75, "general-sale")
        .when(offset <= 120, "campaign-window")
        .otherwise("match-week")
    )


def window_order(window: Column | str) -> Column:
    token = F.translate(F.lower(F.trim(F.coalesce(col(window), F.lit("")))), "_ ", "--")
    order = F.create_map(*[F.lit(x) for pair in WINDOW_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(order, token), F.lit(DEFAULT_ORDER))


def next_window(window: Column | str) -> Column:
    step = window_order(window) + 1
    return (
        F.when(step == 0, "early-sales")
        .when(step == 1, "general-sale")
        .when(step == 2, "campaign-window")
        .otherwise("match-week")
    )
