"""Data-quality checks and load metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.functions import dates, keys
from boxline.functions.numbers import safe_ratio
from boxline.functions.text import clean_text
from boxline.operators.common import CUSTOMER_KEY, has, scalars, total

# Levels at which a load is questioned.
BAD_DATE_SHARE, CUSTOMER_JOIN, FIXTURE_JOIN, DUPLICATE_SHARE = 0.05, 0.5, 0.85, 0.02
LOW_COVERAGE = 40
COVERAGE_FIELDS = ("age_band", "gender", "postcode", "state", "family_flag", "marketing_opt_in", "email_opt_in", "sms_opt_in")
BOOLEAN_WORDS = ("yes", "no", "y", "n", "true", "false", "1", "0")
EXAMPLES, EXAMPLE_CHARS = 3, 48
# A number, with signs of money, brackets and percent anywhere in it.
_SIGNS = "$,()%"
NUMBER = rf"^[\s{_SIGNS}]*+([+-][{_SIGNS}]*+)?([0-9][0-9{_SIGNS}]*+(\.[0-9{_SIGNS}]*+)?|\.[{_SIGNS}]*+[0-9][0-9{_SIGNS}]*+)([eE][{_SIGNS}]*+([+-][{_SIGNS}]*+)?[0-9][0-9{_SIGNS}]*+)?[\s{_SIGNS}]*+$"

SLOTS = 16  # of rows, in the search for the first filled values
FILLED, DATE, NUMERIC, BOOLEAN = 1, 2, 4, 8  # what a cell is, as bits


def _kinds(c: str) -> Column:
    """What a cleaned text can be read as."""
    value = F.col(c)
    # Lower case is never shorter, so longer texts are no such word.
    boolean = (F.length(value) <= max(map(len, BOOLEAN_WORDS))) & F.lower(value).isin(*BOOLEAN_WORDS)
    bit = lambda test, kind: F.when(test, kind).otherwise(0)
    read = bit(dates.parse_date(c).isNotNull(), DATE) + bit(value.rlike(NUMBER), NUMERIC) + bit(boolean, BOOLEAN)
    return F.when(value.isNull(), 0).otherwise(read + FILLED).cast("tinyint")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, row_number: str = "source_row_number") -> DataFrame:
    """Per column: filled and blank counts, examples and a guessed type.

    Everything covers every row. Examples are the first filled values by row
    number, or the smallest ones where rows have no number; rows whose number is
    null come last. One scan tests each cell once, and rows with cells of the
    same kinds are counted together, by slot, before they are taken apart by
    column. It also keeps the first filled row of each slot: the third of these
    numbers is no less than the third of all, so only values up to it can be
    examples, and no other cell is ranked.
    """
    names = [c for c in (columns or df.columns) if c != row_number]
    last = F.lit(2**63 - 1)
    order = F.coalesce(F.col(f"`{row_number}`").cast("long"), last) if has(df, row_number) else F.lit(0).cast("long")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(names)])
    rows = df.select(order.alias("_row"), cells.alias("_cells"))
    value, slot = F.col("value"), F.pmod(F.xxhash64("_row"), F.lit(SLOTS)).alias("_slot")
    texts = df.select(order.alias("_row"), *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(names)])
    texts = texts.select("_row", *[clean_text(f"_{i}").alias(f"_{i}") for i in range(len(names))])
    kinds = F.array(*[_kinds(f"_{i}") for i in range(len(names))]).alias("_kinds")
    # Rows are few kinds of rows: they are counted before any is taken apart into cells.
    per_kind = texts.select("_row", kinds).groupBy("_kinds", slot).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    # The outer form: of the other one Spark infers a test of the array, and would make it twice for each row.
    per_cell = per_kind.select("_slot", "n", "_first", "_last", F.posexplode_outer("_kinds").alias("i", "_kind"))
    of = lambda kind, c="n": F.when(F.col("_kind").bitwiseAND(F.lit(kind)) > 0, F.col(c))
    per_slot = per_cell.groupBy("i", "_slot").agg(
        total("n").alias("rows"), total(of(FILLED)).alias("filled"), total(of(DATE)).alias("dates"), total(of(NUMERIC)).alias("numbers"),
        total(of(BOOLEAN)).alias("booleans"), F.min(of(FILLED, "_first")).alias("first"), F.max(of(FILLED, "_last")).alias("last"),
    )
    sums = per_slot.groupBy("i").agg(
        *[total(c).alias(c) for c in ("rows", "filled", "dates", "numbers", "booleans")],
        # At most one number a slot.
        F.coalesce(F.get(F.array_sort(F.collect_list("first")), F.lit(EXAMPLES - 1)), F.max("last")).alias("bound"),
    )
    # One value for both uses, so that Spark runs the counting scan once: a struct and a bound per column.
    both = F.struct(F.collect_list(F.struct(*sums.columns)).alias("sums"), F.map_from_entries(F.collect_list(F.struct("i", "bound"))).alias("bounds"))
    state = sums.agg(both.alias("v")).scalar()
    early = F.filter("_cells", lambda cell: F.col("_row") <= F.col("_bounds")[cell["i"]])
    # Most rows come after every bound; they are left out before their cells are made.
    most = F.array_max(F.map_values(state.getField("bounds")))
    found = rows.filter(F.col("_row") <= most).withColumn("_bounds", state.getField("bounds")).select("_row", F.inline(early)).withColumn("value", clean_text("raw")).filter(value.isNotNull())
    # The rank limit works before the shuffle too, so a few rows a task and column move.
    place = F.row_number().over(Window.partitionBy("i").orderBy("_row", "value"))
    first = found.withColumn("_place", place).filter(F.col("_place") <= EXAMPLES)
    first = first.groupBy("i").agg(F.array_agg(F.struct("_place", F.substring("value", 1, EXAMPLE_CHARS).alias("v"))).alias("_first"))
    examples = F.coalesce(F.transform(F.sort_array("_first"), lambda e: e.getField("v")), F.array().cast("array<string>"))
    kind = (
        F.when(F.col("filled") == 0, "empty")
        .when(F.col("dates") / F.col("filled") >= 0.75, "date")
        .when(F.col("numbers") / F.col("filled") >= 0.85, "number")
        .when(F.col("booleans") / F.col("filled") >= 0.85, "boolean")
        .otherwise("text")
    )
    counted = df.sparkSession.range(1).select(state.getField("sums").alias("s")).select(F.inline("s"))
    return counted.join(first, "i", "left").select(
        F.get(F.lit(names), F.col("i")).alias("column"), F.col("filled").alias("non_blank"), (F.col("rows") - F.col("filled")).alias("blank"),
        F.concat_ws(", ", examples).alias("example_values"), kind.alias("inferred_type"),
    )


def _sorted_list(c: str) -> Column:
    return F.concat_ws(", ", F.sort_array(F.collect_set(F.col(c).cast("string"))))


def _customer(tickets: DataFrame) -> str:
    return CUSTOMER_KEY if has(tickets, CUSTOMER_KEY) else "customer_id"


def repeated_share(tickets: DataFrame) -> DataFrame:
    """Share of rows that repeat another's transaction, order, fixture and customer, as one row.

    Equal rows share their customer, so tickets in customer buckets are counted
    where they are. The bucket value of a ticket without customer follows from
    its transaction and order.
    """
    keys_of_row = [_customer(tickets), "transaction_id", "order_id", "fixture_id"]
    distinct = tickets.groupBy(*keys_of_row).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"))
    return distinct.select(F.when(F.col("rows") > 0, 1 - F.col("keys") / F.col("rows")).otherwise(0.0).alias("repeated_share"))


def load_metrics(tickets: DataFrame, fixtures: DataFrame, customers: DataFrame) -> DataFrame:
    """Row counts, totals and join rates of a load, as one row."""
    records = customers
    if has(customers, "has_customer_record"):
        records = customers.filter(F.coalesce("has_customer_record", F.lit(False)))
    known = records.filter("customer_id is not null").select("customer_id").distinct().withColumn("_known", F.lit(True))
    # Counted per customer first, so that the join sees each of them once.
    buyers = tickets.filter("customer_id is not null").groupBy(_customer(tickets)).agg(F.count(F.lit(1)).alias("n"))
    buyers = buyers.withColumnRenamed(_customer(tickets), "customer_id")
    joined = scalars(
        buyers.join(known, "customer_id", "left"),
        customers=F.count(F.lit(1)),
        rows=total("n"),
        matched=total(F.when(F.col("_known"), F.col("n"))),
    )
    size = lambda df: df.agg(F.count(F.lit(1)).alias("v")).scalar()
    return tickets.agg(
        F.count(F.lit(1)).alias("ticket_rows"),
        total("paid_tickets_sold").cast("double").alias("paid_ticket_count"),
        total("comp_tickets_sold").cast("double").alias("comp_ticket_count"),
        F.count_if("is_refund").alias("refund_count"),
        total("gross_revenue").cast("double").alias("gross_revenue"),
        total("net_revenue").cast("double").alias("net_revenue"),
        F.coalesce(F.avg(F.col("fixture_id").isNotNull().cast("int")), F.lit(0.0)).alias("fixture_join_rate"),
        keys.date_range_label(F.min("transaction_date"), F.max("transaction_date")).alias("date_range"),
        _sorted_list("competition").alias("competitions"),
        _sorted_list("season_label").alias("seasons"),
    ).withColumns(
        {
            "fixture_rows": size(fixtures),
            "customer_rows": size(customers),
            "unique_customers": joined.getField("customers"),
            "customer_join_rate": safe_ratio(joined.getField("matched"), joined.getField("rows")),
        }
    )


def validation_warnings(tickets: DataFrame, fixtures: DataFrame, customers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Warnings of a load, one row each."""
    copies = repeated_share(tickets).scalar()
    dates_seen = scalars(
        tickets,
        rows=F.count(F.lit(1)),
        no_sale=F.avg(F.col("transaction_date").isNull().cast("int")),
        no_match=F.avg(F.col("match_date").isNull().cast("int")),
    )
    some_customers = customers.agg((F.count(F.lit(1)) > 0).alias("v")).scalar()
    capacities = fixtures.agg((F.count("capacity_total") == 0).alias("v")).scalar()
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 0), F.lit("%"))
    none = F.col("ticket_rows") == 0
    say = lambda test, severity, area, text: F.when(
        test, F.struct(F.lit(severity).alias("severity"), F.lit(area).alias("area"), (text if isinstance(text, Column) else F.lit(text)).alias("message"))
    )
    found = F.array_compact(
        F.array(
            say(none, "warning", "tickets", "No ticket transaction rows are available."),
            say(~none & (dates_seen.getField("no_sale") > BAD_DATE_SHARE), "warning", "dates", "More than 5% of ticket rows have invalid transaction dates."),
            say(
                ~none & (dates_seen.getField("no_match") > BAD_DATE_SHARE), "warning", "dates",
                "More than 5% of ticket rows have no match date. Fixture matching may be weaker.",
            ),
            say(
                ~none & (F.col("customer_join_rate") < CUSTOMER_JOIN) & some_customers, "warning", "customers",
                F.concat(F.lit("Customer join rate is "), percent("customer_join_rate"), F.lit(". Confirm the customer ID mapping.")),
            ),
            say(
                ~none & (F.col("fixture_join_rate") < FIXTURE_JOIN), "warning", "fixtures",
                F.concat(F.lit("Fixture join rate is "), percent("fixture_join_rate"), F.lit(". Some sales may be excluded from fixture-level forecasting.")),
            ),
            say(
                ~none & (copies > DUPLICATE_SHARE), "info", "duplicates",
                "Possible duplicate transaction/order/customer rows detected. This may be normal if the export is seat-level.",
            ),
            say(
                ~none & capacities, "info", "capacity",
                "Fixture capacity was not found. Capacity sold metrics will use manual/default assumptions where available.",
            ),
        )
    )
    return metrics.select(F.explode(found).alias("w")).select("w.*").distinct()


def match_rate_warning(tickets: DataFrame) -> DataFrame:
    """Warning when too few ticket rows found a fixture."""
    rate = F.coalesce(F.avg(F.col("fixture_id").isNotNull().cast("int")), F.lit(0.0))
    row = tickets.agg(rate.alias("_rate")).filter(F.col("_rate") < FIXTURE_JOIN)
    return row.select(
        F.lit("warning").alias("severity"),
        F.lit("fixture matching").alias("area"),
        F.concat(
            F.lit("Fixture join rate is "), F.format_number(F.col("_rate") * 100, 0),
            F.lit("%. Check event names, dates, opponents, and venue mappings."),
        ).alias("message"),
    )


def demographic_coverage(customers: DataFrame) -> DataFrame:
    """Share of customers with a value in each optional field."""
    fields = [c for c in COVERAGE_FIELDS if has(customers, c)]
    counts = customers.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in fields])
    long = counts.unpivot("_rows", fields, "field", "known_records").filter("_rows > 0")
    coverage = F.col("known_records") / F.col("_rows") * 100
    note = F.when(coverage < LOW_COVERAGE, "Low coverage - treat as directional").otherwise("Usable for aggregated planning")
    return long.select("field", "known_records", coverage.alias("coverage_pct"), note.alias("note"))


def known_rate(c: str) -> Column:
    unknown = F.lower(F.coalesce(c, F.lit(""))).isin("unknown / unmatched", "unknown", "unmatched", "nan", "none", "")
    return F.coalesce(F.avg((~unknown).cast("int")), F.lit(0.0))


def demographic_match_metrics(enriched: DataFrame, customers: DataFrame) -> DataFrame:
    """How well ticket rows found customer demographics, as one row."""
    from boxline.functions.text import join_id

    with_id = customers.agg(F.count(join_id("customer_id")).alias("v")).scalar()
    rows = enriched.agg(
        F.count_if("has_join_id").alias("ticketing_rows_with_id"),
        F.count_if("demographic_match").alias("demographic_matched_ticket_rows"),
        known_rate("age_band_filter").alias("age_coverage"),
        known_rate("gender_filter").alias("gender_coverage"),
        known_rate("postcode_filter").alias("postcode_coverage"),
    )
    ids, matched = F.col("ticketing_rows_with_id"), F.col("demographic_matched_ticket_rows")
    return rows.withColumns(
        {
            "customer_rows_with_id": with_id,
            "demographic_unmatched_ticket_rows": F.greatest(ids - matched, F.lit(0)),
            "demographic_match_rate": safe_ratio(matched, ids),
        }
    )


def snapshot_freshness(tickets: DataFrame, today, stale_after: int = 14) -> DataFrame:
    """Age of the newest sale, and whether the extract is out of date."""
    latest = tickets.agg(F.max("transaction_date").cast("date").alias("latest"))
    rows = latest.withColumn("age_days", F.date_diff(dates.date_lit(today), "latest"))
    age = F.col("age_days")
    text = F.concat(F.lit("Latest ticketing extract is "), age.cast("string"), F.lit(" days old."))
    message = (
        F.when(age.isNull(), "No transaction date is available in the uploaded snapshot.")
        .when(age > stale_after, F.concat(text, F.lit(" Upload a fresh snapshot before using this for current decisions.")))
        .when(age < 0, "Latest transaction date is in the future relative to today. Check date parsing and extract timestamps.")
        .otherwise(text)
    )
    return rows.select("age_days", F.coalesce((age > stale_after) | (age < 0), F.lit(True)).alias("is_stale"), message.alias("message"))
