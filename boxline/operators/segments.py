"""Audience segments: overlapping labels a ticket row or customer can carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boxline.functions.numbers import number_or_zero
from boxline.functions.text import text_or_empty, truthy
from boxline.operators.common import has
from boxline.operators.customers import add_behaviour
from boxline.operators.filters import AGE_18_30
from boxline.operators.quantiles import exact_quantile

# How product and window names are recognised.
FAMILY_PRICE = "(?i)family|fam4|fam5"
FAMILY_CLASS = "(?i)family"
GENERAL_CLASS = r"(?i)general admission|\bga\b|hill"
GOLD_CLASS = "(?i)gold"
BOUNDARY_CLASS = "(?i)boundary"
PREMIUM_CLASS = "(?i)platinum|premium"
EARLY_WINDOW = "(?i)early|pre-sale|on-sale"
LATE_WINDOW = "(?i)campaign|match-week|late"
HIGH_BASKET = 12
LOW_BASKET = 3
HIGH_VALUE_QUANTILE = 0.75
COMP_COMPETITION = "WBBL"

# What each segment means, as shown in reports.
DEFINITIONS = {
    "Returning purchasers": "Customers whose first purchase season was before the selected season.",
    "New purchasers": "Customers whose first purchase season is the selected season.",
    "Families": "Family flag or family ticket price/product naming.",
    "18-30s": "Customer age band indicates 18 to 30 where available.",
    "Premium buyers": "Ticket class contains Platinum or Premium.",
    "Gold ticket buyers": "Ticket class contains Gold.",
    "Boundary Zone buyers": "Ticket class contains Boundary Zone.",
    "General Admission buyers": "Ticket class contains General Admission, GA, or Hill.",
    "High basket-size purchasers": "Customer lifetime ticket volume indicates larger baskets.",
    "Low basket-size purchasers": "Customer lifetime ticket volume indicates smaller baskets.",
    "High-value purchasers": "Customer lifetime revenue is in the upper quartile.",
    "Marketable customers": "Marketing, email, or SMS opt-in is true.",
    "Non-marketable customers": "No marketing, email, or SMS opt-in flag is available.",
    "Usual early-window buyers": "Customer usually buys in early-sales, pre-sale, or on-sale windows.",
    "Usual late-window buyers": "Customer usually buys in campaign or match-week windows.",
    "NYE purchasers": "Historical purchase is attached to a 31 December fixture.",
    "WBBL comp recipients": "WBBL rows issued as complimentary tickets.",
    "Paid-ticket-only groups": "Rows representing paid demand, excluding comps and refunds.",
    "Comp-heavy groups": "Rows issued as complimentary tickets.",
}


def string_of(df: DataFrame, name: str) -> Column:
    return text_or_empty(name) if has(df, name) else F.lit("")


def flag_of(df: DataFrame, name: str) -> Column:
    return truthy(name) if has(df, name) else F.lit(False)


def number_of(df: DataFrame, name: str) -> Column:
    return number_or_zero(name) if has(df, name) else F.lit(0.0)


def any_flag(df: DataFrame, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | flag_of(df, name)
    return out


def marketable(df: DataFrame) -> Column:
    return any_flag(df, "marketing_opt_in", "email_opt_in", "sms_opt_in")


def ticket_segments(df: DataFrame, high_value_from: Column) -> dict[str, Column]:
    """Segment label to predicate over ticket rows with customer behaviour."""
    ticket_class, price_type = string_of(df, "ticket_class"), string_of(df, "price_type")
    purchase, window = string_of(df, "customer_purchase_status"), string_of(df, "usual_purchase_window")
    lifetime_tickets, lifetime_revenue = number_of(df, "lifetime_tickets"), number_of(df, "lifetime_revenue")
    comp, opted_in = flag_of(df, "is_comp"), marketable(df)
    age = F.coalesce(F.nullif(string_of(df, "purchaser_age_band"), F.lit("")), string_of(df, "age_band"))
    new_year = F.date_format("match_date", "MM-dd") == "12-31" if has(df, "match_date") else F.lit(False)
    family = any_flag(df, "purchaser_family_flag", "family_flag")
    return {
        "Returning purchasers": purchase == "Returning",
        "New purchasers": purchase == "New",
        "Families": family | price_type.rlike(FAMILY_PRICE) | ticket_class.rlike(FAMILY_CLASS),
        "18-30s": age.rlike(AGE_18_30),
        "Premium buyers": ticket_class.rlike(PREMIUM_CLASS),
        "Gold ticket buyers": ticket_class.rlike(GOLD_CLASS),
        "Boundary Zone buyers": ticket_class.rlike(BOUNDARY_CLASS),
        "General Admission buyers": ticket_class.rlike(GENERAL_CLASS),
        "High basket-size purchasers": lifetime_tickets >= HIGH_BASKET,
        "Low basket-size purchasers": (lifetime_tickets > 0) & (lifetime_tickets <= LOW_BASKET),
        "High-value purchasers": lifetime_revenue >= high_value_from,
        "Marketable customers": opted_in,
        "Non-marketable customers": ~opted_in,
        "Usual early-window buyers": window.rlike(EARLY_WINDOW),
        "Usual late-window buyers": window.rlike(LATE_WINDOW),
        "NYE purchasers": new_year,
        "WBBL comp recipients": (string_of(df, "competition") == COMP_COMPETITION) & comp,
        "Paid-ticket-only groups": ~comp & ~flag_of(df, "is_refund"),
        "Comp-heavy groups": comp,
    }


def customer_segments(df: DataFrame, high_value_from: Column) -> dict[str, Column]:
    """Segment label to predicate over customer rows."""
    ticket_class, window = string_of(df, "preferred_ticket_class"), string_of(df, "usual_purchase_window")
    tickets, revenue = number_of(df, "lifetime_tickets"), number_of(df, "lifetime_revenue")
    opted_in = marketable(df)
    return {
        "Returning purchasers": number_of(df, "seasons_purchased_count") >= 1,
        "Families": flag_of(df, "family_flag"),
        "18-30s": string_of(df, "age_band").rlike(AGE_18_30),
        "Premium buyers": ticket_class.rlike(PREMIUM_CLASS),
        "Gold ticket buyers": ticket_class.rlike(GOLD_CLASS),
        "Boundary Zone buyers": ticket_class.rlike(BOUNDARY_CLASS),
        "General Admission buyers": ticket_class.rlike(GENERAL_CLASS),
        "High basket-size purchasers": tickets >= HIGH_BASKET,
        "Low basket-size purchasers": (tickets > 0) & (tickets <= LOW_BASKET),
        "High-value purchasers": revenue >= high_value_from,
        "Marketable customers": opted_in,
        "Non-marketable customers": ~opted_in,
        "Usual early-window buyers": window.rlike(EARLY_WINDOW),
        "Usual late-window buyers": window.rlike(LATE_WINDOW),
    }


def labels_of(segments: dict[str, Column]) -> Column:
    """Array of the labels a row carries."""
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in segments.items()]))


def high_value_threshold(df: DataFrame, weight: str | None = None) -> Column:
    """Upper-quartile lifetime revenue over the rows, as a scalar."""
    rows = df.select(number_of(df, "lifetime_revenue").alias("_value"), *([weight] if weight else []))
    return exact_quantile(rows, "_value", HIGH_VALUE_QUANTILE, weight=weight, name="v").select("v").scalar()


def audience_sizes(customers: DataFrame) -> DataFrame:
    """Eligible and marketable customers per segment."""
    segments = customer_segments(customers, high_value_threshold(customers))
    rows = customers.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", marketable(customers).alias("_opted"), labels_of(segments).alias("_labels")
    )
    # One row per customer and segment before counting, should an id repeat.
    fanned = rows.select("customer_id", "_opted", F.explode("_labels").alias("analysis_group"))
    once = fanned.groupBy("analysis_group", "customer_id").agg(F.max("_opted").alias("_opted"))
    counted = once.groupBy("analysis_group").agg(
        F.count(F.lit(1)).cast("double").alias("eligible_audience_size"),
        F.count_if("_opted").cast("double").alias("marketable_audience_size"),
    )
    return counted


@dataclass(frozen=True)
class GroupKind:
    """What an index is broken down by."""

    name: str
    uses_segments: bool = False
    product: bool = False


SEGMENT = GroupKind("segment", uses_segments=True)
TICKET_TYPE = GroupKind("ticket_type")
TICKET_CLASS = GroupKind("ticket_class")
SEGMENT_PRODUCT = GroupKind("segment_product", uses_segments=True, product=True)
KINDS = {kind.name: kind for kind in (SEGMENT, TICKET_TYPE, TICKET_CLASS, SEGMENT_PRODUCT)}


def product_of(df: DataFrame, kind: GroupKind) -> Column:
    """Ticket product that a breakdown goes by."""
    names = ("price_type", "ticket_type") if kind is TICKET_TYPE else ("ticket_class",)
    name = next((n for n in names if has(df, n)), None)
    return F.coalesce(F.col(name), F.lit("Unknown")) if name else F.lit("Unknown")


def with_masks(df: DataFrame, kind: GroupKind, keep: list[str], high_value_from: Column | None = None) -> tuple[DataFrame, list[str]]:
    """The kept columns, the product, and the labels of each row as the bits of ``_mask``; and the label of each bit."""
    if not kind.uses_segments:
        return df.select(*keep, product_of(df, kind).alias("_product"), F.lit(1).cast("long").alias("_mask")), []
    segments = ticket_segments(df, high_value_from)
    mask = F.lit(0).cast("long")
    for i, test in enumerate(segments.values()):
        mask = mask + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.select(*keep, product_of(df, kind).alias("_product"), mask.alias("_mask")), list(segments)


def with_groups(df: DataFrame, kind: GroupKind, keep: list[str], high_value_from: Column | None = None) -> DataFrame:
    """One copy of a row per index group it belongs to, with the kept columns only.

    Columns are dropped before the rows multiply.
    """
    product = product_of(df, kind)
    if kind.uses_segments:
        labels = labels_of(ticket_segments(df, high_value_from))
        rows = df.select(*keep, labels.alias("_labels"), product.alias("_product"))
        rows = rows.select(*keep, "_product", F.explode("_labels").alias("analysis_group"))
        if kind.product:
            rows = rows.withColumn("analysis_group", F.concat("analysis_group", F.lit(" x "), "_product"))
        return rows.drop("_product")
    return df.select(*keep, product.alias("analysis_group"))


def segment_fanout(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """One copy of each ticket row per segment it belongs to."""
    rows = add_behaviour(tickets, customers)
    return with_groups(rows, SEGMENT, rows.columns, high_value_threshold(rows))
