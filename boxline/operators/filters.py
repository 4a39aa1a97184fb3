"""Row filters. Each builds one predicate so that it reaches the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from boxline.functions.dates import midnight
from boxline.functions.text import UNKNOWN_LABEL
from boxline.operators.common import has

ALL = "All"
# Fixed value: ages matched as text, so "Under 18" is caught as well.
AGE_18_30 = "18|19|20|21|22|23|24|25|26|27|28|29|30"

PAID_ONLY = "Paid tickets only"
COMPS_ONLY = "Comps only"
REFUNDS = "Refunds / voids"
PAID_AND_COMPS = "Paid + comps"


@dataclass(frozen=True)
class TicketFilter:
    """What a report is limited to. "All" and empty values mean no limit."""

    season_label: str | None = None
    competition: str = ALL
    fixture_ids: tuple[str, ...] = ()
    as_at: dt.date | str | None = None
    audience_segment: str = ALL
    ticket_type: str = ALL
    ticket_class: str = ALL
    section: str = ALL
    sales_channel: str = ALL
    sales_window: str = ALL
    ticket_status: str = PAID_AND_COMPS
    age_bands: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    postcodes: tuple[str, ...] = ()

    def without(self, products: bool = False, demographics: bool = False, audience: bool = False, **changes) -> "TicketFilter":
        """The same filter with some of its parts lifted."""
        if products:
            changes |= {"ticket_type": ALL, "ticket_class": ALL}
        if demographics:
            changes |= {"age_bands": (), "genders": (), "postcodes": ()}
        if audience:
            changes |= {"audience_segment": ALL}
        return replace(self, **changes)


def every(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def audience_predicate(df: DataFrame, segment: str) -> Column | None:
    if segment == "Families" and has(df, "purchaser_family_flag"):
        return flag("purchaser_family_flag")
    if segment == "Marketable" and has(df, "marketing_opt_in"):
        return flag("marketing_opt_in")
    if segment == "18-30s" and has(df, "purchaser_age_band"):
        return F.coalesce(F.col("purchaser_age_band"), F.lit("")).rlike(AGE_18_30)
    if segment == "Returning purchasers" and has(df, "customer_purchase_status"):
        return F.col("customer_purchase_status") == "Returning"
    return None


def status_predicate(status: str) -> Column | None:
    return {
        PAID_ONLY: ~flag("is_comp") & ~flag("is_refund"),
        COMPS_ONLY: flag("is_comp"),
        REFUNDS: flag("is_refund"),
    }.get(status)


def value_column(status: str) -> str:
    """Ticket measure that belongs to a ticket status."""
    return {PAID_ONLY: "paid_tickets_sold", COMPS_ONLY: "comp_tickets_sold"}.get(status, "tickets_sold")


def ticket_predicate(df: DataFrame, f: TicketFilter) -> Column:
    tests: list[Column | None] = []
    if f.season_label and f.season_label != ALL and has(df, "season_label"):
        tests.append(F.col("season_label") == f.season_label)
    if f.competition and f.competition != ALL and has(df, "competition"):
        tests.append(F.col("competition") == f.competition)
    ids = [i for i in f.fixture_ids if i and i != "Tournament total"]
    if ids:
        tests.append(F.col("fixture_id").isin(ids))
    if f.as_at is not None and has(df, "transaction_date"):
        tests.append(F.col("transaction_date") <= midnight(f.as_at))
    for name in ("ticket_type", "ticket_class", "section", "sales_channel", "sales_window"):
        wanted = getattr(f, name)
        if wanted and wanted != ALL and has(df, name):
            tests.append(F.coalesce(F.col(name), F.lit("Unknown")) == wanted)
    tests.append(audience_predicate(df, f.audience_segment))
    tests.append(status_predicate(f.ticket_status))
    tests.append(demographic_predicate(df, f.age_bands, f.genders, f.postcodes))
    return every(t for t in tests if t is not None)


def demographic_predicate(df: DataFrame, age_bands=(), genders=(), postcodes=()) -> Column | None:
    tests = []
    for name, wanted in (("age_band_filter", age_bands), ("gender_filter", genders), ("postcode_filter", postcodes)):
        values = [str(v) for v in wanted or () if str(v)]
        if values and has(df, name):
            tests.append(F.coalesce(F.col(name), F.lit(UNKNOWN_LABEL)).isin(values))
    return every(tests) if tests else None


def filter_tickets(df: DataFrame, f: TicketFilter) -> DataFrame:
    return df.filter(ticket_predicate(df, f))


def scoped(df: DataFrame, season_label: str, competition: str = ALL, fixture_ids=(), include_assumed: bool = True) -> DataFrame:
    """Matches or fixtures of one season."""
    tests = [F.col("season_label") == season_label]
    if competition != ALL:
        tests.append(F.col("competition") == competition)
    if fixture_ids:
        id_column = "match_id" if has(df, "match_id") else "fixture_id"
        tests.append(F.col(id_column).isin([str(i) for i in fixture_ids]))
    if not include_assumed and has(df, "is_assumed"):
        tests.append(~flag("is_assumed"))
    return df.filter(every(tests))


def season_matches(matches: DataFrame, season_label: str, competition: str) -> DataFrame:
    return scoped(matches, season_label, competition).orderBy("event_date")


def history_filters(competition: str, seasons: Iterable[str] | None) -> dict:
    chosen = [s for s in seasons or () if s]
    return {"competition": competition} | ({"season_label": chosen} if chosen else {})


def candidate_predicate(df: DataFrame, filters: Mapping[str, object] | None) -> Column:
    """Predicate from column-to-value pairs; lists mean any of the values."""
    tests = []
    for name, value in (filters or {}).items():
        if value is None or name not in df.columns or (isinstance(value, str) and value in (ALL, "Any")):
            continue
        many = isinstance(value, (list, tuple, set))
        tests.append(F.col(name).isin(list(value)) if many else F.col(name) == value)
    return every(tests)


def filter_options(df: DataFrame, name: str, *excluded: str) -> DataFrame:
    """Sorted distinct non-empty values of a column, for a selector."""
    values = df.select(F.col(name).cast("string").alias("value")).filter("value is not null and value <> ''")
    if excluded:
        values = values.filter(~F.col("value").isin(list(excluded)))
    return values.distinct().orderBy("value")


def latest_season(df: DataFrame, planning_label: str) -> Column:
    """Latest label (in text order) apart from the planning season, as a scalar."""
    return df.filter(F.col("season_label") != planning_label).agg(F.max("season_label").alias("v")).scalar()


@dataclass(frozen=True)
class ProjectionScope:
    """A ticket filter plus the baseline seasons it is compared with."""

    tickets: TicketFilter = field(default_factory=TicketFilter)
    baseline: tuple[str, ...] = ()
