"""Customer aggregates, merges and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxline.functions import keys, text
from boxline.functions.dates import month_name
from boxline.operators.common import CUSTOMER_KEY, column_or, first_per_key, has, left_lookup


def first_season(tickets: DataFrame) -> DataFrame:
    """Season of the first purchase, one row per customer."""
    dated = tickets.filter("customer_id is not null and transaction_date is not null and season_label is not null")
    first = F.min_by("season_label", F.struct("transaction_date", "season_label"))
    return _by_customer(dated).agg(first.alias("first_season")).withColumnRenamed(CUSTOMER_KEY, "customer_id")


def _by_customer(rows: DataFrame):
    """Groups of rows that have a customer, by the bucket column where tickets are laid out by it."""
    return rows.groupBy(CUSTOMER_KEY if has(rows, CUSTOMER_KEY) else "customer_id")


def purchase_status(tickets: DataFrame) -> DataFrame:
    """Mark each row New or Returning by the customer's first season.

    Rows without a customer count as Returning; when no row at all can be
    dated, every row is Unknown.
    """
    firsts = first_season(tickets)
    usable = firsts.agg((F.count(F.lit(1)) > 0).alias("v")).scalar()
    joined = left_lookup(tickets, firsts, "customer_id")
    status = F.when(~usable, "Unknown").when(
        F.col("season_label") == F.col("first_season"), "New"
    ).otherwise("Returning")
    return joined.withColumn("customer_purchase_status", status).drop("first_season")


# Aggregate name -> ticket column whose most frequent value it is.
_MODES = {
    "preferred_ticket_type": "ticket_type",
    "preferred_ticket_class": "ticket_class",
    "usual_purchase_month": "_month",
    "usual_purchase_window": "_window",
    "postcode": "purchaser_postcode",
    "age_band": "purchaser_age_band",
    "gender": "purchaser_gender",
}


def lifetime(tickets: DataFrame, salt: str) -> DataFrame:
    """Lifetime aggregates per customer in one pass. Mode ties go to the smallest value."""
    rows = tickets.filter(F.col("customer_id").isNotNull()).withColumns(
        {
            "_month": month_name("transaction_date"),
            "_window": F.coalesce("sales_window", F.lit("unknown")),
        }
    )
    modes = [F.mode(F.col(source), True).alias(name) for name, source in _MODES.items() if source in rows.columns]
    grouped = _by_customer(rows).agg(
        F.min("transaction_date").alias("first_purchase_date"),
        F.max("transaction_date").alias("last_purchase_date"),
        # A distinct count would move the tickets' groups twice.
        F.size(F.collect_set("season_label")).cast("long").alias("seasons_purchased_count"),
        F.sum("tickets_sold").alias("lifetime_tickets"),
        F.sum("gross_revenue").alias("lifetime_revenue"),
        F.max("purchaser_family_flag").alias("family_flag"),
        F.max("marketing_opt_in").alias("marketing_opt_in"),
        *modes,
    ).withColumnRenamed(CUSTOMER_KEY, "customer_id")
    return grouped.withColumns(
        {"anonymised_customer_id": keys.anonymise("customer_id", salt), "has_ticket_history": F.lit(True)}
    )


# Columns found on both sides; the customer file wins where it has a value.
_SHARED = ("postcode", "age_band", "gender", "family_flag", "marketing_opt_in")


def merge_customers(records: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Full outer merge of customer records with their sales aggregates."""
    shared = [c for c in _SHARED if c in records.columns and c in aggregates.columns]
    sales = aggregates.withColumnsRenamed({c: f"{c}_from_sales" for c in shared})
    merged = records.join(sales, ["customer_id", "anonymised_customer_id"], "full")
    merged = merged.withColumns({c: F.coalesce(c, f"{c}_from_sales") for c in shared})
    merged = merged.withColumns(
        {c: F.coalesce(column_or(merged, c, False), F.lit(False)) for c in ("has_customer_record", "has_ticket_history")}
    )
    return merged.drop(*[f"{c}_from_sales" for c in shared])


def customer_table(records: DataFrame | None, tickets: DataFrame, salt: str) -> DataFrame:
    aggregates = lifetime(tickets, salt)
    if records is None:
        return aggregates.withColumn("has_customer_record", F.lit(False))
    return merge_customers(records, aggregates)


def first_records(records: DataFrame) -> DataFrame:
    """First record per customer over several files: by ``_source``, file and content. ``_source`` is dropped."""
    content = F.to_json(F.struct(*sorted(c for c in records.columns if c not in ("_source", "source_file", "customer_id"))))
    return first_per_key(records, "customer_id", "_source", F.coalesce("source_file", F.lit("")), content).drop("_source")


def append_customers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two customer tables; the first one wins on a shared id."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    others = sorted(c for c in both.columns if c not in ("_rank", "customer_id"))
    return first_per_key(both, "customer_id", "_rank", F.to_json(F.struct(*others))).drop("_rank")


_DEMOGRAPHICS = (
    "age", "age_band", "gender", "postcode", "suburb", "state",
    "marketing_opt_in", "email_opt_in", "sms_opt_in", "family_flag",
)
_FILL_TEXT = {
    "purchaser_age_band": "age_band",
    "purchaser_gender": "gender",
    "purchaser_postcode": "postcode",
    "purchaser_suburb": "suburb",
    "purchaser_state": "state",
}
_FILL_FLAG = {
    "marketing_opt_in": "marketing_opt_in",
    "email_opt_in": "email_opt_in",
    "sms_opt_in": "sms_opt_in",
    "purchaser_family_flag": "family_flag",
}


def demographic_filters(df: DataFrame) -> DataFrame:
    """Filter labels in which missing values are a visible bucket."""
    pairs = {
        "age_band_filter": "purchaser_age_band",
        "gender_filter": "purchaser_gender",
        "postcode_filter": "purchaser_postcode",
    }
    blank = F.lit(None).cast("string")
    return df.withColumns(
        {out: text.unknown_bucket(F.col(src) if has(df, src) else blank) for out, src in pairs.items()}
    )


def enrich_demographics(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Add customer demographics to ticket rows; unmatched rows are kept.

    ``demographic_match`` tells whether a customer record was found, and
    ``has_join_id`` whether the row has a usable id at all.
    """
    wanted = [c for c in _DEMOGRAPHICS if c in customers.columns]
    lookup = customers.select(text.join_id("customer_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in wanted])
    lookup = lookup.filter(F.col("_id").isNotNull())
    lookup = first_per_key(lookup, "_id", F.to_json(F.struct(*[f"_{c}" for c in wanted])))
    lookup = lookup.withColumn("_found", F.lit(True))

    rows = tickets.withColumn("_id", text.join_id("customer_id"))
    joined = left_lookup(rows.withColumn("has_join_id", F.col("_id").isNotNull()), lookup, "_id")
    filled = {}
    for target, source in _FILL_TEXT.items():
        if source in wanted:
            filled[target] = text.fill_missing_text(F.col(target) if has(tickets, target) else F.lit(None).cast("string"), f"_{source}")
    for target, source in _FILL_FLAG.items():
        if source in wanted:
            if has(tickets, target):
                filled[target] = F.coalesce(target, f"_{source}")
            else:
                filled[target] = F.col(f"_{source}") if target == source else F.lit(False)
    if "age" in wanted:
        filled["age_filter"] = F.col("_age")
    filled["demographic_match"] = F.coalesce("_found", F.lit(False))
    joined = joined.withColumns(filled).drop("_id", "_found", *[f"_{c}" for c in wanted])
    return demographic_filters(joined)


_BEHAVIOUR = (
    "seasons_purchased_count", "lifetime_tickets", "lifetime_revenue", "preferred_ticket_class",
    "preferred_ticket_type", "usual_purchase_window", "marketing_opt_in", "email_opt_in",
    "sms_opt_in", "family_flag", "age_band",
)


def add_behaviour(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join of customer behaviour; clashing names get ``_customer``.

    Of several records of a customer one counts, so no ticket row is doubled.
    """
    wanted = [c for c in _BEHAVIOUR if c in customers.columns]
    one = customers.select("customer_id", *wanted).filter("customer_id is not null")
    customers = first_per_key(one, "customer_id", F.to_json(F.struct(*wanted))) if wanted else one.distinct()
    rename = {c: f"{c}_customer" for c in wanted if c in tickets.columns}
    return left_lookup(tickets, customers.select("customer_id", *wanted).withColumnsRenamed(rename), "customer_id")


def not_yet_purchased(customers: DataFrame, tickets: DataFrame, season_label: str) -> DataFrame:
    """Customers with no ticket in a season."""
    buyers = tickets.filter((F.col("season_label") == season_label) & F.col("customer_id").isNotNull())
    return customers.join(buyers.select("customer_id").distinct(), "customer_id", "left_anti")
