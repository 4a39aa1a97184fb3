"""Expected-by-now index: sales so far against the same point of past seasons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import dates, keys, windows
from boxline.functions.numbers import safe_index, safe_ratio
from boxline.operators import segments as seg
from boxline.operators.customers import add_behaviour
from boxline.operators.common import CUSTOMER_KEY, has, ranked
from boxline.operators.filters import ALL
from boxline.operators.summaries import next_fixture
from boxline.sources.session import materialise

# Index levels, statuses and their rank in reports.
THRESHOLDS = {"ahead": 1.10, "on_track": 0.95, "watch": 0.85, "behind": 0.70}
STATUS_RANK = {"At risk": 0, "Behind": 1, "Watch": 2, "Not due yet": 3, "On track": 4, "Ahead": 5}
DEFAULT_SEASONS = 3

# Columns of the result.
INDEX_COLUMNS = (
    "analysis_group", "definition", "current_paid_tickets", "current_comps", "current_total_tickets",
    "current_revenue", "current_unique_purchasers", "current_average_basket_size",
    "current_average_ticket_price", "expected_paid_tickets_by_now", "expected_total_tickets_by_now",
    "expected_revenue_by_now", "expected_purchasers_by_now", "expected_final_paid_tickets",
    "eligible_audience_size", "marketable_audience_size", "actual_purchase_rate",
    "expected_purchase_rate", "ticket_index", "revenue_index", "purchaser_index",
    "purchase_rate_index", "paid_ticket_gap", "revenue_gap", "usual_purchase_window",
    "current_sales_window", "status", "confidence", "recommended_action", "suggested_message_angle",
    "suggested_timing", "suggested_ticket_product", "rationale",
)


def baseline_seasons(tickets: DataFrame, current_label: str, wanted: Iterable[str] | None) -> DataFrame:
    """Baseline seasons: the wanted ones that exist, else the latest three."""
    wanted = list(dict.fromkeys(str(s) for s in wanted or ()))
    seen = tickets.filter(F.col("season_label") != current_label).select("season_label").distinct()
    everything = Window.partitionBy()
    seen = seen.withColumns(
        {
            "_wanted": F.col("season_label").isin(wanted) if wanted else F.lit(False),
            "_age": F.row_number().over(everything.orderBy(F.col("season_label").desc())),
        }
    )
    seen = seen.withColumn("_any", F.max("_wanted").over(everything))
    chosen = seen.filter(F.col("_wanted") | (~F.col("_any") & (F.col("_age") <= DEFAULT_SEASONS)))
    return chosen.select("season_label")


_MEASURES = {"paid": "paid_tickets_sold", "comps": "comp_tickets_sold", "tickets": "tickets_sold", "revenue": "gross_revenue"}
_NOW = ("paid", "tickets", "revenue")


def _group_measures(rows: DataFrame, kind: seg.GroupKind, labels: list[str]) -> DataFrame:
    """Sums, purchasers, orders and usual windows per season and group.

    The labels of a row are one bit mask, so the fact table is shuffled once and
    unmultiplied; tickets in customer buckets are not moved at all. What five
    aggregates read is written once. Sums per mask, and the masks of each customer and order, are
    counted before the masks become groups; what multiplies is a count per mask.
    """
    key = ["season_label", "_product"] if kind.product or not kind.uses_segments else ["season_label"]
    place = [CUSTOMER_KEY] if has(rows, CUSTOMER_KEY) else []
    base = rows.groupBy(*place, *key, "_mask", "customer_id", "order_id", "usual_purchase_window", "sales_window", "by_now").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(column).alias(name) for name, column in _MEASURES.items()]
    )
    base = materialise(base.drop(*place), "index")

    def grouped(frame: DataFrame) -> DataFrame:
        """One row per group of each mask."""
        if not kind.uses_segments:
            return frame.withColumnRenamed("_product", "analysis_group").drop("_mask")
        names = F.array_compact(F.array(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(labels)]))
        frame = frame.withColumn("analysis_group", F.explode(names)).drop("_mask")
        return frame.withColumn("analysis_group", F.concat("analysis_group", F.lit(" x "), "_product")).drop("_product") if kind.product else frame

    def members(name: str, column: str) -> list[DataFrame]:
        """How many customers or orders have a row in the group, and how many have one by now."""
        masks = base.filter(F.col(column).isNotNull()).groupBy(*key, column).agg(
            F.bit_or("_mask").alias("_all"), F.coalesce(F.bit_or(F.when(F.col("by_now"), F.col("_mask"))), F.lit(0).cast("long")).alias("_by_now")
        )
        found = [masks.groupBy(*key, F.col("_all").alias("_mask")).agg(F.count(F.lit(1)).alias(name))]
        if name == "purchasers":
            found.append(masks.filter("_by_now <> 0").groupBy(*key, F.col("_by_now").alias("_mask")).agg(F.count(F.lit(1)).alias(f"{name}_now")))
        return [grouped(f).withColumn("_kind", F.lit("sums")) for f in found]

    per_mask = base.groupBy(*key, "_mask", "usual_purchase_window", "sales_window", "by_now").agg(*[F.sum(c).alias(c) for c in ("_n", *_MEASURES)])
    per_mask = grouped(per_mask)
    now = [F.sum(F.when(F.col("by_now"), F.col(c))).alias(f"{c}_now") for c in _NOW]
    sums = per_mask.groupBy("season_label", "analysis_group").agg(*[F.sum(c).alias(c) for c in ("_n", *_MEASURES)], *now).withColumn("_kind", F.lit("sums"))
    modes = [
        per_mask.groupBy("season_label", "analysis_group", F.col(column).alias("_value")).agg(F.sum("_n").alias("_n")).withColumn("_kind", F.lit(name))
        for name, column in (("usual", "usual_purchase_window"), ("window", "sales_window"))
    ]
    parts = sums.withColumn("_value", F.lit(None).cast("string"))
    for part in (*members("purchasers", "customer_id"), *members("orders", "order_id"), *modes):
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts


def index_measures(
    tickets: DataFrame, customers: DataFrame, matches: DataFrame, current_label: str, competition: str, as_at,
    kind: seg.GroupKind, baseline: Iterable[str] | None = None,
) -> DataFrame:
    """Current sales and baseline means per group, in one pass over the tickets, best in their customer buckets."""
    at = dates.date_lit(as_at)
    own = matches.filter(F.col("season_label") == current_label)
    rows = tickets.filter(F.col("transaction_date").isNotNull() & F.col("season_label").isNotNull())
    if competition != ALL:
        own = own.filter(F.col("competition") == competition)
        rows = rows.filter(F.col("competition") == competition)
    point = next_fixture(own, as_at, "event_date").select("same_point", "current_sales_window")
    chosen = baseline_seasons(rows, current_label, baseline).agg(F.array_agg("season_label").alias("v"))
    labels = chosen.scalar()
    is_current = F.col("season_label") == current_label
    rows = rows.filter(
        (is_current & (F.col("transaction_date") <= at.cast("timestamp_ntz"))) | (~is_current & F.array_contains(labels, F.col("season_label")))
    )
    out = dates.floor_days("match_date", "transaction_date")
    days_left = F.col("_days_left")
    by_now = is_current | (days_left <= 0) | (F.coalesce(out, F.lit(-9999)) >= days_left)
    rows = rows.withColumn("_days_left", point.select("same_point").scalar()).withColumn("by_now", by_now).drop("_days_left")

    place = [CUSTOMER_KEY] if has(rows, CUSTOMER_KEY) else []
    values = None
    if kind.uses_segments:
        own_value = ["lifetime_revenue"] if "lifetime_revenue" in rows.columns else []
        values = rows.groupBy(is_current.alias("_current"), "customer_id", *own_value, *place).agg(F.count(F.lit(1)).alias("_weight"))
        values = add_behaviour(values, customers) if customers is not None else values
        values = values.select("_current", "_weight", seg.number_of(values, "lifetime_revenue").alias("_value"))
    if customers is not None:
        rows = add_behaviour(rows, customers)
    if "usual_purchase_window" not in rows.columns:
        rows = rows.withColumn("usual_purchase_window", F.lit(None).cast("string"))
    cut = None
    if kind.uses_segments:
        # Past and current rows each have their own upper quartile. A customer's value counts once for each row.
        cuts = seg.exact_quantile(values, "_value", seg.HIGH_VALUE_QUANTILE, ["_current"], weight="_weight", name="v")
        pick = lambda current: F.max(F.when(F.col("_current") == F.lit(current), F.col("v")))
        both = cuts.agg(F.struct(pick(True).alias("now"), pick(False).alias("past")).alias("s")).scalar()
        rows = rows.withColumn("_cuts", both)
        rows = rows.withColumn("_cut", F.when(is_current, F.col("_cuts.now")).otherwise(F.col("_cuts.past"))).drop("_cuts")
        cut = F.col("_cut")
    keep = [
        "season_label", "customer_id", "order_id", "usual_purchase_window", "sales_window", "by_now",
        "paid_tickets_sold", "comp_tickets_sold", "tickets_sold", "gross_revenue", *place,
    ]
    masked, labels_of_mask = seg.with_masks(rows, kind, keep, cut)
    parts = _group_measures(masked, kind, labels_of_mask)
    # Usual windows are counted over the baseline seasons as a whole.
    past = F.col("season_label") != current_label
    values = parts.groupBy("analysis_group", "_kind", "_value", past.alias("_past")).agg(
        F.sum("_n").alias("_n"),
        *[F.sum(c).alias(c) for c in ("paid", "comps", "tickets", "revenue", "orders", "purchasers")],
        *[F.sum(c).alias(c) for c in ("paid_now", "tickets_now", "revenue_now", "purchasers_now")],
    )
    sums = F.col("_kind") == "sums"
    of = lambda past, c: F.coalesce(F.max(F.when((F.col("_past") == F.lit(past)) & sums, F.col(c))).cast("double"), F.lit(0.0))
    past_mode = lambda kind_name: F.min_by(
        "_value", F.when(F.col("_past") & (F.col("_kind") == kind_name) & F.col("_value").isNotNull(), F.struct(-F.col("_n"), F.col("_value")))
    )
    current = {
        "current_paid_tickets": "paid", "current_comps": "comps", "current_total_tickets": "tickets",
        "current_revenue": "revenue", "current_unique_purchasers": "purchasers", "_orders": "orders",
    }
    expected = {
        "expected_final_paid_tickets": "paid", "_expected_final_purchasers": "purchasers",
        "expected_paid_tickets_by_now": "paid_now", "expected_total_tickets_by_now": "tickets_now",
        "expected_revenue_by_now": "revenue_now", "expected_purchasers_by_now": "purchasers_now",
    }
    groups = values.groupBy("analysis_group").agg(
        *[of(False, c).alias(name) for name, c in current.items()],
        *[of(True, c).alias(name) for name, c in expected.items()],
        F.coalesce(past_mode("usual"), past_mode("window"), F.lit("Unknown")).alias("usual_purchase_window"),
        F.max("_past").alias("_has_past"),
    )
    # A season without the group counts as 0, so every mean has the same divisor.
    groups = groups.withColumn("_n", F.size(labels)).withColumn("current_sales_window", point.select("current_sales_window").scalar())
    means = {name: F.when(F.col("_n") > 0, F.col(name) / F.col("_n")).otherwise(0.0) for name in expected}
    return groups.withColumns(means | {"_seasons": F.when(F.col("_has_past"), F.col("_n")).otherwise(0)})


def segment_status(
    index: Column, actual: Column, expected: Column, final: Column, current: Column, usual: Column,
    thresholds: Mapping[str, float] | None = None,
) -> Column:
    """Status of a group. Late-buying groups are not called behind too early."""
    level = {**THRESHOLDS, **(thresholds or {})}
    due = F.when(final != 0, expected / final).otherwise(0.0)
    later = windows.window_order(usual) > windows.window_order(current)
    return (
        F.when((actual <= 0) & ((expected <= 0) | ((due < 0.08) & later)), "Not due yet")
        .when(later & (due < 0.12) & (index < level["watch"]), "Not due yet")
        .when(expected <= 0, F.when(actual > 0, "Ahead").otherwise("Not due yet"))
        .when(index >= level["ahead"], "Ahead")
        .when(index >= level["on_track"], "On track")
        .when(index >= level["watch"], "Watch")
        .when(index >= level["behind"], "Behind")
        .otherwise("At risk")
    )


def confidence(seasons: Column, final: Column, eligible: Column) -> Column:
    size = F.greatest(final, eligible)
    return (
        F.when((seasons >= 3) & (size >= 5000), "High").when((seasons >= 2) & (size >= 1000), "Medium").otherwise("Directional")
    )


def definition(kind: seg.GroupKind, group: Column) -> Column:
    if kind is seg.TICKET_TYPE:
        return F.concat(F.lit("Ticket type / price type equals "), group, F.lit("."))
    if kind is seg.TICKET_CLASS:
        return F.concat(F.lit("Ticket class equals "), group, F.lit("."))
    known = F.create_map(*[F.lit(x) for pair in seg.DEFINITIONS.items() for x in pair])
    other = (
        "Combined audience segment and ticket product group."
        if kind.product
        else "Aggregated audience segment generated from available ticket and customer fields."
    )
    return F.coalesce(F.try_element_at(known, group), F.lit(other))


def _mentions(group: Column, *words: str) -> Column:
    return F.lower(group).rlike("|".join(words))


def message_angle(group: Column, gap: Column) -> Column:
    return (
        F.when(_mentions(group, "family", "boundary"), "Family value, ease of attendance, and urgency before the window closes.")
        .when(_mentions(group, "gold", "premium", "platinum"), "Premium availability and scarcity, not discounting.")
        .when(_mentions(group, "general admission", "ga"), "Simple group-ticket value and fixture urgency.")
        .when(gap < -1000, "Direct response messaging with a clear fixture and product recommendation.")
        .otherwise("Fixture-specific reminder with availability and timing cues.")
    )


def suggested_product(kind: seg.GroupKind, group: Column) -> Column:
    if kind is seg.TICKET_TYPE:
        return group
    return (
        F.when(_mentions(group, "boundary"), "Boundary Zone")
        .when(_mentions(group, "gold"), "Gold")
        .when(_mentions(group, "premium", "platinum"), "Premium / Platinum")
        .when(_mentions(group, "general admission", "ga"), "General Admission")
        .when(_mentions(group, "family"), "Family ticket products")
        .otherwise("Best available fixture inventory")
    )


def recommendation(kind: seg.GroupKind) -> dict[str, Column]:
    """Action, angle, timing, product and rationale of an index row."""
    group, status = F.col("analysis_group"), F.col("status")
    gap, index = F.col("paid_ticket_gap"), F.col("ticket_index")
    current, usual = F.col("current_sales_window"), F.col("usual_purchase_window")
    waiting, short = status == "Not due yet", status.isin("At risk", "Behind", "Watch")
    ahead = status == "Ahead"
    index_text = keys.thousands(index, 2)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return {
        "recommended_action": F.when(
            waiting, "Monitor now and prepare a later-window reminder rather than treating this group as churned."
        )
        .when(short, "Prioritise this group in the current marketing plan.")
        .when(ahead, "Protect yield and avoid discount-led messaging.")
        .otherwise("Keep planned activity running and watch for mix shifts."),
        "suggested_message_angle": F.when(waiting, "Timing-led reminder when the group reaches its usual purchase window.")
        .when(short, message_angle(group, gap))
        .when(ahead, "Availability, scarcity, and premium positioning.")
        .otherwise("Availability and fixture-specific value."),
        "suggested_timing": F.when(
            waiting, say("Prepare for ", F.when(usual != "Unknown", usual).otherwise(windows.next_window(current)), ".")
        )
        .when(short, say("Act in the ", current, " window."))
        .when(ahead, "Keep active while demand is ahead of expectation.")
        .otherwise(say("Continue through the ", current, " window.")),
        "suggested_ticket_product": suggested_product(kind, group),
        "rationale": F.when(
            waiting,
            say(
                group, " is below full-season conversion, but historical behaviour points to later-window purchasing (",
                usual, "). Current window is ", current, ".",
            ),
        )
        .when(
            short,
            say(
                group, " is ", keys.thousands(F.abs(gap)), " paid tickets ", F.when(gap < 0, "behind").otherwise("ahead of"),
                " expected by now with a ticket index of ", index_text, ".",
            ),
        )
        .when(ahead, say(group, " is ahead of expected paid-ticket volume with a ticket index of ", index_text, "."))
        .otherwise(say(group, " is broadly on track with a ticket index of ", index_text, ".")),
    }


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, status), F.lit(6))


def expected_index(
    tickets: DataFrame, customers: DataFrame, matches: DataFrame, current_label: str, competition: str = ALL, as_at=None,
    kind: str = "segment", baseline: Iterable[str] | None = None, min_size: float = 100,
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """Index of actual against expected-by-now sales for every group; ``meets_min_size`` marks the sizeable ones."""
    group_kind = seg.KINDS[kind]
    rows = index_measures(tickets, customers, matches, current_label, competition, as_at, group_kind, baseline)
    if customers is not None and group_kind.uses_segments:
        rows = rows.join(seg.audience_sizes(customers), "analysis_group", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("eligible_audience_size", "marketable_audience_size")})
    paid, expected = F.col("current_paid_tickets"), F.col("expected_paid_tickets_by_now")
    revenue, purchasers = F.col("current_revenue"), F.col("current_unique_purchasers")
    final, eligible = F.col("expected_final_paid_tickets"), F.col("eligible_audience_size")
    rows = rows.withColumns(
        {
            "eligible_audience_size": F.coalesce(eligible, F.greatest("_expected_final_purchasers", "current_unique_purchasers")),
            "marketable_audience_size": F.coalesce("marketable_audience_size", F.lit(0.0)),
            "current_average_ticket_price": safe_ratio(revenue, paid),
            "current_average_basket_size": safe_ratio(paid, F.col("_orders")),
            "ticket_index": safe_index(paid, expected),
            "revenue_index": safe_index(revenue, F.col("expected_revenue_by_now")),
            "purchaser_index": safe_index(purchasers, F.col("expected_purchasers_by_now")),
            "paid_ticket_gap": paid - expected,
            "revenue_gap": revenue - F.col("expected_revenue_by_now"),
            "definition": definition(group_kind, F.col("analysis_group")),
        }
    )
    rows = rows.withColumns(
        {
            "actual_purchase_rate": safe_ratio(purchasers, eligible),
            "expected_purchase_rate": safe_ratio(F.col("expected_purchasers_by_now"), eligible),
            "status": segment_status(
                F.col("ticket_index"), paid, expected, final, F.col("current_sales_window"), F.col("usual_purchase_window"), thresholds
            ),
            "confidence": confidence(F.col("_seasons"), final, eligible),
        }
    )
    rows = rows.withColumn("purchase_rate_index", safe_index(F.col("actual_purchase_rate"), F.col("expected_purchase_rate")))
    rows = rows.withColumns(recommendation(group_kind))
    return mark_sizeable(rows, min_size).select(*INDEX_COLUMNS, "meets_min_size")


def mark_sizeable(rows: DataFrame, min_size: float) -> DataFrame:
    """Adds ``meets_min_size``; no group is left out."""
    basis = F.greatest("current_paid_tickets", "expected_paid_tickets_by_now", "expected_final_paid_tickets", "eligible_audience_size")
    return rows.withColumn("meets_min_size", F.coalesce(basis >= min_size, F.lit(False)))


def in_report_order(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Most serious groups first, by ``rank``."""
    return ranked(index, status_rank(F.col("status")), "paid_ticket_gap", F.col("expected_final_paid_tickets").desc(), "analysis_group", limit=limit)


def comparison_bars(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups by expected sales, largest first, for actual-against-expected bars."""
    rows = ranked(index, F.col("expected_paid_tickets_by_now").desc(), "analysis_group", limit=limit)
    return rows.select("rank", "analysis_group", "current_paid_tickets", "expected_paid_tickets_by_now")
