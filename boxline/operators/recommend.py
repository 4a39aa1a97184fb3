"""Audience and campaign recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import keys
from boxline.functions.numbers import clip
from boxline.operators.common import column_or, ranked
from boxline.operators.customers import not_yet_purchased
from boxline.operators.filters import ALL
from boxline.operators.segments import marketable

DIAGNOSTIC_SIZE = 250
EARLY_MONTH = 8
EARLY_DAYS = 30

# Columns of the result.
RECOMMENDATION_COLUMNS = (
    "analysis_group", "definition", "marketable_audience_size", "current_unique_purchasers",
    "expected_purchasers_by_now", "actual_purchase_rate", "expected_purchase_rate", "purchase_rate_index",
    "current_paid_tickets", "expected_paid_tickets_by_now", "paid_ticket_gap", "revenue_gap",
    "usual_purchase_window", "current_sales_window", "recommended_action", "suggested_message_angle",
    "suggested_timing", "suggested_ticket_product", "confidence", "rationale", "marketable_note",
)


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Projection to the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def marketing_recommendations(index: DataFrame, min_marketable: float = 5000, limit: int | None = None) -> DataFrame:
    """Campaign-ready groups; with none, groups that are at least worth a look. All of them, by ``rank``, unless limited."""
    ready = F.coalesce("marketable_audience_size", F.lit(0.0)) >= min_marketable
    possible = F.coalesce("eligible_audience_size", F.lit(0.0)) >= min(DIAGNOSTIC_SIZE, min_marketable)
    rows = index.withColumns({"_ready": ready, "_possible": possible})
    rows = rows.withColumn("_any", F.max("_ready").over(Window.partitionBy()))
    note = F.when(
        F.col("_any"), "Campaign-ready marketable audience size meets the selected threshold."
    ).otherwise("Opt-in or marketable size is unavailable/low; use as diagnostic planning evidence.")
    rows = rows.filter(F.when(F.col("_any"), F.col("_ready")).otherwise(F.col("_possible"))).withColumn("marketable_note", note)
    return ranked(rows.drop("_ready", "_possible", "_any"), "status", "paid_ticket_gap", "analysis_group", limit=limit)


def recommended_audiences(customers: DataFrame, tickets: DataFrame, planning_label: str, min_size: int = 5000) -> DataFrame:
    """Marketable customers who have not bought the planning season, by segment.

    Every segment, by ``rank``; ``meets_min_size`` marks the large ones.
    """
    text = lambda name: F.coalesce(F.nullif(column_or(customers, name, "Unknown").cast("string"), F.lit("")), F.lit("Unknown"))
    family = F.coalesce(column_or(customers, "family_flag", False), F.lit(False))
    rows = not_yet_purchased(customers, tickets, planning_label).filter(marketable(customers))
    rows = rows.select(
        "customer_id",
        F.concat_ws(" | ", F.when(family, "Family").otherwise("General"), text("preferred_ticket_class"), text("usual_purchase_window")).alias("segment"),
        text("usual_purchase_window").alias("usual_purchase_window"),
        *[column_or(customers, c, None).cast("double").alias(c) for c in ("lifetime_tickets", "lifetime_revenue", "seasons_purchased_count")],
    )
    grouped = rows.groupBy("segment").agg(
        F.count_distinct("customer_id").alias("audience_size"),
        F.avg("lifetime_tickets").alias("avg_lifetime_tickets"),
        F.avg("lifetime_revenue").alias("avg_lifetime_revenue"),
        F.avg("seasons_purchased_count").alias("seasons_purchased"),
        F.mode("usual_purchase_window", True).alias("usual_purchase_window"),
    )
    grouped = ranked(grouped, F.col("audience_size").desc(), "segment")
    grouped = grouped.withColumn("meets_min_size", F.col("audience_size") >= min_size)

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (
        clip(zero("seasons_purchased"), 0.0, 5.0) * 12
        + clip(zero("avg_lifetime_tickets"), 0.0, 20.0) * 1.7
        + F.log1p(clip(zero("avg_lifetime_revenue"), 0.0)) * 4
    )
    grouped = grouped.withColumn("likelihood_score", clip(score, 0.0, 100.0))
    return grouped.withColumns(
        {
            "estimated_ticket_upside": F.bround(F.col("audience_size") * (F.col("likelihood_score") / 100) * 1.8, 0),
            "confidence": F.when(F.col("audience_size") >= 5000, "high").when(F.col("audience_size") >= 1000, "medium").otherwise("directional"),
            "suggested_timing": F.when(F.col("usual_purchase_window") == "Unknown", "next available sales window").otherwise(F.col("usual_purchase_window")),
            "suggested_message": F.when(
                F.col("segment").rlike("(?i)family"), "Family value, school-holiday timing, and urgency before window close."
            ).otherwise("Availability, group purchase ease, and fixture-specific urgency."),
            "rationale": F.concat(
                keys.thousands(F.col("audience_size")), F.lit(f" marketable customers have not purchased {planning_label}; historic average is "),
                F.coalesce(keys.thousands(F.col("avg_lifetime_tickets"), 1), F.lit("nan")), F.lit(" tickets across "),
                F.coalesce(keys.thousands(F.col("seasons_purchased"), 1), F.lit("nan")), F.lit(" seasons."),
            ),
        }
    )


def early_recommendation(segment: Column) -> Column:
    mentions = lambda *words: F.lower(segment).rlike("|".join(words))
    return (
        F.when(mentions("family", "boundary"), "Use family-value, fixture-date clarity, and early-access urgency in the opening sales window.")
        .when(mentions("gold", "platinum", "premium"), "Use premium availability, seat quality, and scarcity messaging rather than discount framing.")
        .when(mentions("general", "ga", "hill"), "Use simple group attendance, social proof, and easy entry messaging for early on-sale.")
        .when(mentions("female", "male"), "Use broad season-opening creative, then refine with product and fixture preference where available.")
        .otherwise("Prioritise clear fixture choice, value reassurance, and early-window urgency.")
    )


def early_segments(tickets: DataFrame, season_label: str, competition: str, field: str, min_size: float) -> DataFrame:
    """Who buys when a season goes on sale.

    The window is August of the first sales year, or the first 31 days of
    sales when nothing was sold then.
    """
    rows = tickets.filter(F.col("season_label") == season_label)
    if competition != ALL:
        rows = rows.filter(F.col("competition") == competition)
    # Only the season's first sale and its August sales decide the window.
    sold = F.col("transaction_date")
    first = rows.agg(F.min("transaction_date").alias("v")).scalar()
    august = F.make_date(F.year(first), F.lit(EARLY_MONTH), F.lit(1)).cast("timestamp_ntz")
    span = F.make_dt_interval(F.lit(EARLY_DAYS))
    in_august = sold.between(august, august + span)
    any_august = rows.filter(in_august).agg((F.count(F.lit(1)) > 0).alias("v")).scalar()
    early = rows.filter(F.when(any_august, in_august).otherwise(sold.between(first, first + span)))

    label = F.coalesce(F.col(field).cast("string"), F.lit("Unknown"))
    grouped = early.groupBy(label.alias("segment")).agg(
        F.sum("paid_tickets_sold").cast("double").alias("early_paid_tickets"),
        F.sum("gross_revenue").cast("double").alias("early_revenue"),
        F.count_distinct("customer_id").alias("early_customers"),
        F.count_distinct("order_id").alias("_orders"),
    ).filter(F.col("early_paid_tickets") >= min_size)
    paid = F.col("early_paid_tickets")
    all_paid = F.greatest(F.sum(paid).over(Window.partitionBy()), F.lit(1.0))
    return grouped.select(
        F.lit(field).alias("segment_lens"),
        "segment",
        "early_paid_tickets",
        "early_customers",
        "early_revenue",
        F.when(paid != 0, F.col("early_revenue") / paid).alias("early_atp"),
        F.when(F.col("_orders") != 0, paid / F.col("_orders")).alias("early_basket_size"),
        (paid / all_paid * 100).alias("early_share_pct"),
        early_recommendation(F.col("segment")).alias("recommendation"),
    )


RISKY = ("At risk", "Behind", "Watch")


def risk_highlights(audience: DataFrame, ticket_class: DataFrame) -> DataFrame:
    """Up to four headline groups, one row each: of sufficient size, or of any size where no group is sizeable."""
    from boxline.operators.index import status_rank

    fields = ("analysis_group", "status", "paid_ticket_gap", "ticket_index", "usual_purchase_window")
    risky, rank, gap = F.col("status").isin(*RISKY), status_rank(F.col("status")), F.col("paid_ticket_gap")

    def best(index: DataFrame, *wanted: tuple[int, str, Column, list[Column]]) -> DataFrame:
        """The first row of each wanted kind, in one pass over the index."""
        found = []
        for position, name, test, order in wanted:
            # Rows that fail the test have no sort key and never come first.
            key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate((*order, F.col("analysis_group")))])
            sized, any_size = (F.min_by(F.struct(*fields), F.when(t, key)) for t in (test & F.col("meets_min_size"), test))
            row = F.when(F.bool_or("meets_min_size"), sized).otherwise(any_size)
            found.append(F.struct(F.lit(position).alias("position"), F.lit(name).alias("highlight"), row.alias("r")))
        rows = index.agg(F.array(*found).alias("found")).select(F.explode("found").alias("f")).select("f.position", "f.highlight", "f.r")
        return rows.filter("r is not null").select("position", "highlight", "r.*")

    # Risky rows come by gap; equal gaps keep the report's order, most serious first.
    return best(
        audience, (1, "audience watch item", risky, [gap, rank]), (2, "not due yet", F.col("status") == "Not due yet", [gap, -F.col("expected_final_paid_tickets")])
    ).unionByName(
        best(ticket_class, (3, "ticket class watch item", risky, [gap, rank]), (4, "positive trend", F.col("status") == "Ahead", [-F.col("ticket_index"), gap]))
    )
