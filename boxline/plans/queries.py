"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from boxline.functions import dates, keys, numbers, seasons, text, windows
from boxline.operators import (
    calendar, curves, customers as cust, features, filters, forest, index as ix, ingest, matches as mt, pace,
    plan_targets, projection, quality, recommend, segments, summaries, targets,
)
from boxline.operators.common import ranked
from boxline.operators.filters import TicketFilter
from boxline.plans import ingestion, outputs, pages
from boxline.sources import star, tables
from boxline.sources.csv import REJECTS, read_export
from boxline.sources.mapping import suggest_mapping
from boxline.sources.session import materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEASON_START = "2024-08-01"
EVENT_DATE = "2025-02-15"
MATCH_ID = "2024-18"
PACE = pace.PaceSettings(150, 3)
SETTINGS = ingest.IngestSettings(star.SALT, "Home side", star.PLANNING_SEASON, star.PLANNING_LABEL)


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: bigint, double to six places, date, string, boolean."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: tidy(build(spark, sf_dir))
    return build


# --- scalar functions -------------------------------------------------------------------------------


@query
def normalise_text(spark, sf_dir):
    """Cleaned text, tokens and labels over whole documents and part names."""
    docs = star.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    parts = star.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") == 1, " N/A ").when(F.col("p_size") == 2, "-").otherwise(F.concat(F.lit("\t "), "p_name", F.lit(" & "), "p_brand", F.lit("  "))).alias("text"),
    )
    rows = docs.unionByName(parts)
    return rows.select(
        "id",
        F.md5(text.clean_text("text")).alias("cleaned"),
        F.md5(text.normalise_token("text")).alias("token"),
        F.md5(text.unknown_bucket("text")).alias("bucket"),
        F.md5(text.join_id("text")).alias("join_key"),
        F.md5(text.fill_missing_text(text.clean_text("text"), F.lit("filled"))).alias("filled"),
    )


@query
def normalise_numbers(spark, sf_dir):
    """Money, bracketed, percentage and flag texts back to values."""
    li = star.line_items(spark, sf_dir)
    money = F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2))
    bracketed = F.concat(F.lit("("), F.format_number("l_quantity", 2), F.lit(")"))
    percent = F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%"))
    flag = F.when(F.col("l_returnflag") == "R", "Opt-In").when(F.col("l_returnflag") == "A", " no ").otherwise("maybe")
    missing = F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string")).otherwise("n/a")
    return li.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").agg(
        F.sum(numbers.parse_number(money).cast("decimal(18,2)")).alias("money"),
        F.sum(numbers.parse_number(bracketed)).alias("bracketed"),
        F.sum(numbers.parse_number(percent)).alias("percent"),
        F.sum(numbers.parse_number(missing, 9.0).cast("decimal(18,2)")).alias("with_default"),
        F.count_if(numbers.parse_bool(flag)).alias("yes"),
        F.max(numbers.parse_target(money)).alias("target"),
    )


@query
def normalise_dates(spark, sf_dir):
    """Order dates printed in several layouts and read back."""
    orders = star.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(14), F.lit(5))
    layouts = ["d/M/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy H:mm", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "d/M/yy"]
    pick = F.pmod("o_orderkey", F.lit(len(layouts)))
    shown = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        shown = F.when(pick == i, F.date_format(d, layout)).otherwise(shown)
    event = F.concat(F.lit("BBL v "), F.col("o_orderpriority"), F.lit(" - "), shown, F.lit(" (gates 6pm)"))
    printed = orders.select("o_orderkey", "o_orderdate", shown.alias("shown"), event.alias("event"))
    read = printed.select("o_orderkey", "o_orderdate", dates.parse_date("shown").alias("parsed"), dates.date_text_in("event").alias("found"))
    aged = read.withColumn("age", dates.age_in_years("parsed", "2026-08-31"))
    return aged.select(
        "o_orderkey",
        F.col("parsed").cast("date").alias("parsed"),
        F.hour("parsed").alias("hour"),
        dates.parse_date("found").cast("date").alias("from_text"),
        dates.month_day("parsed").alias("month_day"),
        dates.day_name("parsed").alias("day_name"),
        dates.month_name("parsed").alias("month_name"),
        F.dayofyear("parsed").alias("day_of_year"),
        dates.floor_days("o_orderdate", "parsed").alias("floor_days"),
        "age",
        dates.age_band("age").alias("age_band"),
    )


@query
def dates_in_documents(spark, sf_dir):
    """First date-shaped text in every document and page."""
    docs = star.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    web = star.table(spark, sf_dir, "pages").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    found = docs.unionByName(web).select("id", dates.date_text_in("text").alias("found"))
    return found.groupBy("found").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("first_id"))


@query
def season_labels(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate") + F.make_ym_interval(F.lit(star.YEAR_SHIFT))
    y = F.year(d)
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Season "), y.cast("string"), F.lit(" - "), ((y + 1) % 100).cast("string")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat((y % 100).cast("string"), F.lit("/"), (y + 1).cast("string")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("Summer "), y.cast("string")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("n/a"))
        .otherwise("Pre-season")
    )
    label = seasons.season_label(raw)
    rows = orders.select(
        raw.alias("raw"), label.alias("label"), seasons.season_label_of_date(d).alias("from_date"),
        seasons.season_start(label).alias("start"), seasons.season_start_year(seasons.season_label_of_date(d)).alias("start_year"),
    )
    return rows.groupBy("raw", "label", "from_date", "start", "start_year").agg(F.count(F.lit(1)).alias("n"))


@query
def anonymise_ids(spark, sf_dir):
    c = star.table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_acctbal") < -900, " NULL ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("\t")))
    return c.select("c_custkey", keys.anonymise(raw, star.SALT).alias("anonymised"))


@query
def fixture_keys(spark, sf_dir):
    """Match keys, id texts and labels of every fixture."""
    fx = star.load(spark, sf_dir).fixtures
    return fx.select(
        "fixture_id",
        keys.match_key("competition", "season_label", "opponent", "venue", "match_date").alias("exact_key"),
        keys.match_key("competition", "season_label", "opponent", "venue").alias("soft_key"),
        keys.fixture_key_text("competition", "season_label", "match_date", "opponent", "venue").alias("id_text"),
        "fixture_label",
    )


@query
def row_ids(spark, sf_dir):
    """Ids of rows without one: the checksum of their text, and their number."""
    c = star.table(spark, sf_dir, "customer")
    return c.select("c_custkey", keys.row_id("txn", "c_custkey", "c_name", "c_mktsegment").alias("row_id"))


@query
def fixture_checksums(spark, sf_dir):
    """Generated fixture ids by the text that their checksum is taken of."""
    fields = ("competition", "season_label", "match_date", "opponent", "venue")
    fx = star.load(spark, sf_dir).fixtures
    return fx.select("fixture_id", keys.fixture_key_text(*fields).alias("id_text"), F.substring_index(keys.fixture_id(*fields), "_", -1).alias("checksum"))


@query
def uploaded_future_fixtures(spark, sf_dir):
    """A list of fixtures uploaded as next season's: all of them assumed."""
    fx = star.load(spark, sf_dir).fixtures
    raw = fx.select("season_label", "venue", "opponent", "competition", F.date_format("match_date", "d/M/yyyy").alias("match_date"))
    rows = ingest.normalise_fixtures(raw, suggest_mapping(raw.columns, "future_fixtures"), "BBL", SETTINGS, assumed=True)
    return rows.select(
        "season", "season_label", "competition", "opponent", "venue", F.col("match_date").cast("date").alias("match_date"),
        "fixture_status", "is_confirmed", "is_assumed", "fixture_label", "notes",
    )


@query
def age_bands(spark, sf_dir):
    c = star.table(spark, sf_dir, "customer")
    age = F.round(F.col("c_acctbal") / 100, 1)
    return c.groupBy(dates.age_band(age).alias("age_band")).agg(F.count(F.lit(1)).alias("customers"))


# --- normalisation ----------------------------------------------------------------------------------


def raw_tickets(spark, sf_dir) -> DataFrame:
    """Ticket rows as a text export with odd headers and formats."""
    tx = star.transactions(spark, sf_dir)
    money = lambda c: F.when(c < 0, F.concat(F.lit("("), F.format_number(-c, 4), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 4)))
    return tx.select(
        F.col("transaction_id").alias("txn_id"),
        F.col("order_id").alias("order_number"),
        F.coalesce(F.concat(F.lit(" "), "customer_id"), F.lit("NULL")).alias("gigya_uid"),
        "competition",
        F.concat("fixture_name", F.lit(" - "), F.date_format("match_date", "d/M/yyyy")).alias("event_name"),
        F.col("opponent").alias("opposition"),
        F.col("venue").alias("stadium"),
        F.when(F.col("price_type") == "Adult", F.replace("season_label", F.lit("/"), F.lit("-"))).alias("season_name"),
        F.date_format("transaction_date", "d/M/yyyy H:mm").alias("transaction_timestamp"),
        F.col("tickets_sold").cast("int").cast("string").alias("quantity"),
        money(F.col("gross_revenue")).alias("total_price"),
        F.col("ticket_type").alias("ticket_category"),
        F.coalesce("ticket_class", F.lit("-")).alias("price_category"),
        F.col("price_type").alias("price_code"),
        F.when(F.col("is_refund"), "REFUNDED").when(F.col("is_comp"), "Complimentary").otherwise("Sold").alias("ticket_status"),
        F.col("sales_channel").alias("channel"),
        F.when(F.col("marketing_opt_in"), "Subscribed").otherwise("opt out").alias("marketing"),
        F.when(F.col("purchaser_family_flag"), "Y").otherwise("N").alias("has_children"),
        F.col("purchaser_postcode").alias("post_code"),
    )


def normalised(spark, sf_dir) -> DataFrame:
    raw = raw_tickets(spark, sf_dir)
    return ingest.normalise_tickets(raw, suggest_mapping(raw.columns, "tickets"), "BBL", SETTINGS)


@query
def ticket_normalise(spark, sf_dir):
    """Text export to typed tickets, totalled by fixture and day."""
    rows = normalised(spark, sf_dir)
    return rows.groupBy("competition", "season_label", "opponent", "venue", "match_date", F.col("transaction_date").cast("date").alias("sold_on")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("customer_id").alias("with_customer"),
        F.sum("tickets_sold").alias("tickets"),
        F.sum(F.col("gross_revenue").cast("decimal(18,4)")).alias("gross"),
        F.sum(F.col("net_revenue").cast("decimal(18,4)")).alias("net"),
        F.count_if("marketing_opt_in").alias("opted_in"),
        F.count_if("purchaser_family_flag").alias("families"),
        F.count("ticket_class").alias("with_class"),
        F.min("season").alias("season"),
        F.max(F.hour("transaction_date")).alias("last_hour"),
    )


@query
def refund_comp_flags(spark, sf_dir):
    return normalised(spark, sf_dir).groupBy("competition", "is_refund", "is_comp", "price_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("paid_tickets_sold").alias("paid"), F.sum("comp_tickets_sold").alias("comps")
    )


@query
def sales_window_infer(spark, sf_dir):
    """The three window ladders and their order."""
    tx = star.load(spark, sf_dir).tickets
    offset = seasons.days_since_season_start("transaction_date", "season_label")
    sale = windows.window_of_sale("transaction_date", "match_date")
    return tx.groupBy(
        "season_label", sale.alias("sale_window"), windows.window_of_offset(offset).alias("offset_window"),
        windows.window_order(sale).alias("window_rank"), windows.next_window(sale).alias("next_window"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query
def forecasting_matches(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return mt.forecasting_matches(m.tickets, m.fixtures, star.PLANNING_SEASON, star.PLANNING_LABEL)


@query
def fixture_normalise(spark, sf_dir):
    """Fixture list as text, normalised and deduplicated."""
    fx = star.load(spark, sf_dir).fixtures
    raw = fx.select(
        "season_label", F.col("venue").alias("stadium"), F.col("opponent").alias("away_team"), "competition",
        F.date_format("match_date", "d/M/yyyy").alias("game_date"), F.concat(F.format_number("capacity_total", 0)).alias("venue_capacity"),
    )
    rows = ingest.normalise_fixtures(raw.unionByName(raw), suggest_mapping(raw.columns, "fixtures"), "BBL", SETTINGS)
    rows = mt.prepare_fixtures(rows)
    back = mt.fixtures_from_matches(rows.withColumnsRenamed({"fixture_id": "match_id", "match_date": "event_date"}))
    return back.select(
        "season", "season_label", "competition", "opponent", "venue", F.col("match_date").cast("date").alias("match_date"),
        "day_of_week", "capacity_total", "fixture_label", "is_confirmed",
    )


@query
def customer_normalise(spark, sf_dir):
    """Customer export as text; repeated ids keep their first row."""
    c = star.table(spark, sf_dir, "customer")
    birth = F.date_sub(F.lit("2006-01-01").cast("date"), F.floor(F.col("c_acctbal") + 1000).cast("int"))
    raw = c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("gigya_uid"), F.date_format(birth, "d/M/yyyy").alias("dob"),
        (F.lit(5000) + F.col("c_nationkey")).cast("string").alias("post_code"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Female").otherwise("null").alias("gender"),
        F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("email_permission"),
        F.lit(1).cast("bigint").alias("source_row_number"),
    )
    again = raw.withColumns({"gender": F.lit("Other"), "source_row_number": F.lit(2).cast("bigint")})
    mapping = suggest_mapping([n for n in raw.columns if n != "source_row_number"], "customers")
    rows = ingest.normalise_customers(raw.unionByName(again), mapping, SETTINGS)
    return rows.select("customer_id", "anonymised_customer_id", "postcode", "age", "age_band", "gender", "email_opt_in", "sms_opt_in")


@query
def csv_round_trip(spark, sf_dir):
    """The text export written as CSV files, read back, mapped and matched."""
    path = new_path(spark, "export-tickets")
    raw_tickets(spark, sf_dir).write.option("header", True).csv(path)
    bundle_tickets, _ = ingestion.normalise(ingestion.read_export(spark, path), ingestion.Source(path, "tickets"), SETTINGS)
    rows = mt.match_tickets(bundle_tickets, star.load(spark, sf_dir).fixtures)
    return rows.groupBy("fixture_id", "sales_window", "fixture_match_score").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("paid_tickets_sold").alias("paid"),
        F.sum(F.col("gross_revenue").cast("decimal(18,4)")).alias("gross"),
        F.count_distinct("source_file", "source_row_number").alias("numbered"),
    )


def mixed_export(spark, sf_dir) -> str:
    """One folder of ticket files that differ in encoding, column order, header names and stray quotes; some rows hold a value too many.

    The files are compressed one by one, as plain text takes several times the disk of the tables it is printed from.
    """
    path = new_path(spark, "export-mixed")
    raw = materialise(raw_tickets(spark, sf_dir), "raw-tickets")
    put = lambda rows, **options: rows.write.mode("append").options(header=True, compression="gzip", **options).csv(path)
    put(raw.filter("price_code = 'Adult'").withColumn("channel", F.concat("channel", F.lit(" é"))))
    # The byte 0x92 is an apostrophe in the Windows code page.
    latin = raw.filter("price_code = 'Group'").withColumn("channel", F.concat("channel", F.lit(" é\u0092")))
    put(latin.select(*reversed(raw.columns)).withColumnRenamed("txn_id", "Sale ID"), encoding="ISO-8859-1")
    rest = raw.filter("price_code not in ('Adult', 'Group')").withColumn("channel", F.concat("channel", F.lit(" 5 row")))
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in raw.columns])
    # Refunds have a value too many.
    line = F.when(F.col("ticket_status") == "REFUNDED", F.concat(quoted, F.lit(",again"))).otherwise(quoted)
    # The first row of each task brings the header, so that every file has one.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rest.select(F.when(first, F.concat(F.lit(",".join(raw.columns) + "\n"), line)).otherwise(line)).write.mode("append").option("compression", "gzip").text(path)
    return path


@query
def csv_mixed_files(spark, sf_dir):
    """A folder of unlike files, read file by file: one row per ticket."""
    path = mixed_export(spark, sf_dir)
    rows, _ = ingestion.normalise(ingestion.read_export(spark, path), ingestion.Source(path, "tickets"), SETTINGS)
    rows = materialise(rows, "mixed", infer=False)
    return rows.select("transaction_id", "order_id", "customer_id", "competition", "opponent", "venue", "tickets_sold", "gross_revenue", "ticket_type", "price_type", "sales_channel")


@query
def load_rejects(spark, sf_dir):
    """Rows of the same folder that fit no column, with their warning."""
    path = mixed_export(spark, sf_dir)
    rejects = ingestion.read_export(spark, path).rejects.select(F.lit("tickets").alias("kind"), F.lit("export").alias("source_file"), "reason", "row")
    return ingestion.reject_warnings(rejects).withColumn("rejected_rows", rejects.agg(F.count(F.lit(1)).alias("v")).scalar())


@query
def customer_files_merge(spark, sf_dir):
    """Two customer files that share ids: one record each, the first file's, and ticket totals as before."""
    m = star.load(spark, sf_dir)
    first = star.customer_file(spark, sf_dir).withColumns({"_source": F.lit(0), "source_file": F.lit("a.csv")})
    second = first.withColumns({"_source": F.lit(1), "source_file": F.lit("b.csv"), "gender": F.lit("Other"), "postcode": F.lit("0000")})
    merged = cust.merge_customers(cust.first_records(second.unionByName(first)), cust.lifetime(m.tickets, star.SALT))
    doubled = merged.unionByName(merged)
    totals = cust.add_behaviour(m.tickets, doubled).groupBy("customer_id").agg(F.count(F.lit(1)).alias("ticket_rows"), F.sum("tickets_sold").alias("tickets"))
    return totals.join(merged.select("customer_id", "gender", "postcode"), "customer_id")


@query
def union_competitions(spark, sf_dir):
    """Ticket files of two competitions put together by column name."""
    tx = star.load(spark, sf_dir).tickets
    one = tx.filter("competition = 'BBL'").select("season_label", "competition", "tickets_sold", "sales_channel")
    two = tx.filter("competition = 'WBBL'").select("competition", "season_label", "tickets_sold")
    both = ingest.combine([one, two])
    return both.groupBy("season_label", "competition", "sales_channel").agg(F.count(F.lit(1)).alias("rows"), F.sum("tickets_sold").alias("tickets"))


@query
def csv_quoted_breaks(spark, sf_dir):
    """All documents written as one export with line breaks inside quotes, and read back by blocks."""
    path = new_path(spark, "export-breaks")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("Customer ID"), F.col("source").alias("Order date"), F.col("text").alias("Note"))
    rows.write.options(header=True, quoteAll=True, escape='"').csv(path)
    note = F.col("note")
    return read_export(spark, path).frame.select(F.col("customer_id").cast("long").alias("doc_id"), F.col("order_date").alias("source"), F.length(note).cast("long").alias("chars"), F.md5(note).alias("text_md5"))


@query
def csv_trial_rows(spark, sf_dir):
    """The first hundred rows of an export, for a trial run of a load."""
    path = new_path(spark, "export-trial")
    rows = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias("Account name"), F.col("c_mktsegment").alias("Order date"))
    rows.repartition(1).sortWithinPartitions("Customer ID").write.option("header", True).csv(path)
    return read_export(spark, path, rows=100).frame.select("source_row_number", "customer_id", "account_name")


@query
def processed_sets(spark, sf_dir):
    """Three loads published one after another, and a fourth that breaks after two tables: the third is what readers see."""
    m, folder = star.load(spark, sf_dir), new_path(spark, "processed-sets")
    rejects = spark.createDataFrame([], f"kind string, {REJECTS}")
    whole = dict(zip(tables.PROCESSED, (m.tickets, m.fixtures, m.customers, m.matches, m.daily, rejects)))
    for season in ("2022/23", "2023/24", star.PLANNING_LABEL):
        kept = {n: t.filter(F.col("season_label") <= season) if n in ("transactions_normalised", "matches") else t for n, t in whole.items()}
        tables.write_processed(kept, folder, placed=star.BY_SEASON)
    try:
        broken = whole["customers_normalised"].withColumn("customer_id", F.raise_error(F.lit("interrupted")).cast("string"))
        tables.write_processed({**whole, "transactions_normalised": whole["transactions_normalised"].limit(0), "customers_normalised": broken}, folder, placed=star.BY_SEASON)
    except PySparkException:
        pass
    seen = tables.load_processed(spark, folder)
    tickets = seen["transactions_normalised"].groupBy("season_label").agg(F.count(F.lit(1)).alias("rows"), F.sum("paid_tickets_sold").alias("paid"))
    return tickets.join(seen["matches"].groupBy("season_label").agg(F.count(F.lit(1)).alias("matches")), "season_label", "left")


# --- stored tables ----------------------------------------------------------------------------------


@query
def processed_round_trip(spark, sf_dir):
    """The processed tables written, laid out by season, and read back."""
    m, folder = star.load(spark, sf_dir), new_path(spark, "processed-copy")
    rejects = spark.createDataFrame([], f"kind string, {REJECTS}")
    held = (m.tickets, m.fixtures, m.customers, m.matches, m.daily, rejects)
    tables.write_processed(dict(zip(tables.PROCESSED, held)), folder, placed=star.BY_SEASON)
    back = tables.load_processed(spark, folder)["transactions_normalised"]
    return back.groupBy("season_label").agg(F.count(F.lit(1)).alias("rows"), F.sum("paid_tickets_sold").alias("paid"), F.count_distinct("customer_id").alias("buyers"))


@query
def daily_sales_csv(spark, sf_dir):
    """Daily sales exported as CSV and loaded from there."""
    folder = new_path(spark, "csv-daily")
    tables.export_csv(daily_sales(spark, sf_dir), f"{folder}/daily_sales.csv")
    return tables.load_daily_sales(spark, folder, prefer_parquet=False).select("match_id", "date", "days_to_event", "daily_sales", "cumulative_sales")


@query
def matches_csv(spark, sf_dir):
    """Matches exported as CSV and loaded from there, with dates again."""
    folder = new_path(spark, "csv-matches")
    tables.export_csv(star.load(spark, sf_dir).matches, f"{folder}/matches.csv")
    return tables.load_matches(spark, folder, prefer_parquet=False).select("match_id", "season_label", "opponent", "event_date", "on_sale_date")


# --- filters ----------------------------------------------------------------------------------------


@query
def filter_transactions(spark, sf_dir):
    f = TicketFilter(
        season_label="2023/24", competition="BBL", as_at="2024-03-31", ticket_class="Unknown", audience_segment="Families",
        ticket_status=filters.PAID_ONLY,
    )
    rows = filters.filter_tickets(star.load(spark, sf_dir).tickets, f)
    return rows.select("transaction_id", "order_id", "ticket_type", "paid_tickets_sold", "gross_revenue", "sales_window")


@query
def filter_statuses(spark, sf_dir):
    """Every ticket status and audience against the whole table."""
    tx = star.load(spark, sf_dir).tickets
    tests = {}
    for status in (filters.PAID_ONLY, filters.COMPS_ONLY, filters.REFUNDS, filters.PAID_AND_COMPS):
        for audience in ("All", "Families", "Marketable", "18-30s", "Returning purchasers"):
            tests[f"{status} | {audience}"] = filters.ticket_predicate(tx, TicketFilter(ticket_status=status, audience_segment=audience))
    counts = tx.agg(F.lit(1).alias("k"), *[F.count_if(t).alias(name) for name, t in tests.items()])
    return counts.unpivot("k", list(tests), "selection", "rows").drop("k")


@query
def filter_demographics(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = cust.enrich_demographics(m.tickets, m.customers)
    f = TicketFilter(age_bands=("18-30", text.UNKNOWN_LABEL), genders=("Female", text.UNKNOWN_LABEL))
    rows = filters.filter_tickets(rows, f)
    return rows.groupBy("age_band_filter", "gender_filter", "season_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tickets_sold").alias("tickets")
    )


@query
def scoped_matches(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return filters.scoped(m.matches, star.PLANNING_LABEL, "WBBL").select("match_id", "event_date", "opponent", "round", "is_assumed")


@query
def season_match_list(spark, sf_dir):
    """Matches of a season in order."""
    return filters.season_matches(star.load(spark, sf_dir).matches, star.PLANNING_LABEL, "BBL").select("match_id", "opponent", "venue", "round")


@query
def completed_matches(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return mt.completed_matches(m.matches, m.daily)


@query
def season_options(spark, sf_dir):
    return filters.filter_options(star.load(spark, sf_dir).tickets, "season_label", star.PLANNING_LABEL)


# --- joins ------------------------------------------------------------------------------------------


@query
def fixture_match_two_stage(spark, sf_dir):
    """Exact, soft and failed matches. Some rows lose their date or opponent first."""
    m = star.load(spark, sf_dir)
    rows = m.tickets.withColumns(
        {
            "fixture_id": F.when(F.col("sales_channel") == "Phone", F.col("fixture_id")),
            "match_date": F.when(F.col("price_type") != "Junior", F.col("match_date")),
            "opponent": F.when(F.col("price_type") != "Group", F.upper("opponent")),
        }
    )
    return mt.match_tickets(rows, m.fixtures).groupBy("fixture_id", "fixture_match_score").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tickets_sold").alias("tickets")
    )


@query
def demographic_enrich(spark, sf_dir):
    m = star.load(spark, sf_dir)
    bare = m.tickets.drop("purchaser_age_band", "purchaser_gender", "purchaser_postcode").withColumn(
        "customer_id", F.concat(F.lit(" "), F.lower("customer_id"), F.lit(" "))
    )
    rows = cust.enrich_demographics(bare, star.customer_file(spark, sf_dir))
    return rows.groupBy("age_band_filter", "gender_filter", "postcode_filter", "purchaser_state", "demographic_match").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("paid_tickets_sold").alias("paid"), F.count_if("email_opt_in").alias("email"),
        F.count_if("sms_opt_in").alias("sms"), F.sum("age_filter").alias("ages"),
    )


@query
def demographic_match_metrics(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = cust.enrich_demographics(m.tickets, m.customers)
    return quality.demographic_match_metrics(rows, m.customers)


@query
def customer_outer_merge(spark, sf_dir):
    m = star.load(spark, sf_dir)
    records = star.customer_file(spark, sf_dir).filter("postcode <> '5007'")
    merged = cust.merge_customers(records, cust.lifetime(m.tickets, star.SALT))
    return merged.select(
        "customer_id", "anonymised_customer_id", "postcode", "age_band", "gender", "family_flag", "marketing_opt_in", "email_opt_in",
        "has_customer_record", "has_ticket_history", "lifetime_tickets", "seasons_purchased_count",
    )


@query
def customer_append(spark, sf_dir):
    """Two customer lists merged; the first wins."""
    records = star.customer_file(spark, sf_dir).select("customer_id", "postcode", "gender")
    extra = star.customer_file(spark, sf_dir).select("customer_id", F.lit("0000").alias("postcode"), "state")
    return cust.append_customers(records.filter("gender is not null"), extra)


@query
def not_yet_purchased_anti(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return cust.not_yet_purchased(m.customers, m.tickets, star.PLANNING_LABEL).select("customer_id", "preferred_ticket_class", "marketing_opt_in")


@query
def merge_fixtures(spark, sf_dir):
    """History plus assumed fixtures, less those of competitions with real ones."""
    fx = star.load(spark, sf_dir).fixtures
    past = fx.filter("season_label < '2024/25'")
    settled = fx.filter("season_label = '2024/25' and competition = 'BBL'").withColumn("fixture_status", F.lit("confirmed"))
    future = fx.filter("season_label = '2024/25'").withColumn("fixture_id", F.concat("fixture_id", F.lit("-a")))
    merged = mt.merge_fixtures(past.unionByName(settled), future, star.PLANNING_LABEL)
    return merged.select("fixture_id", "season_label", "competition", "fixture_status")


# --- aggregations -----------------------------------------------------------------------------------


@query
def daily_sales(spark, sf_dir):
    m = star.load(spark, sf_dir)
    matches = mt.forecasting_matches(m.tickets, m.fixtures, star.PLANNING_SEASON, star.PLANNING_LABEL)
    return mt.daily_sales(m.tickets, matches)


@query
def customer_lifetime(spark, sf_dir):
    return cust.lifetime(star.load(spark, sf_dir).tickets, star.SALT)


@query
def infer_fixtures(spark, sf_dir):
    rows = star.load(spark, sf_dir).tickets.withColumn("team", F.lit("Home side"))
    return mt.infer_fixtures(rows).select(
        "competition", "season_label", "opponent", "venue", "match_date", "team", "fixture_name", "season", "day_of_week", "fixture_label"
    )


@query
def ticket_price_median(spark, sf_dir):
    m = star.load(spark, sf_dir)
    paid = m.tickets.filter("paid_tickets_sold > 0").select("fixture_id", (F.col("gross_revenue").cast("double") / F.col("paid_tickets_sold")).alias("atp"))
    return segments.exact_quantile(paid, "atp", 0.5, ["fixture_id"], name="median_price")


@query
def quantile_whole_table(spark, sf_dir):
    return segments.exact_quantile(star.load(spark, sf_dir).tickets, "gross_revenue", 0.75, name="upper_quartile")


def bucketed(spark, sf_dir) -> DataFrame:
    """All tickets laid out by customer inside each season, and read back."""
    return star.bucketed(spark, sf_dir)


@query
def customer_lifetime_bucketed(spark, sf_dir):
    """Lifetime aggregates without moving a ticket."""
    return cust.lifetime(bucketed(spark, sf_dir), star.SALT)


@query
def purchase_status_bucketed(spark, sf_dir):
    """New and returning buyers without moving a ticket by customer."""
    tx = bucketed(spark, sf_dir).drop("customer_purchase_status")
    return cust.purchase_status(tx).groupBy("season_label", "customer_purchase_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.sum("tickets_sold").alias("tickets")
    )


@query
def purchase_status(spark, sf_dir):
    tx = star.load(spark, sf_dir).tickets.drop("customer_purchase_status")
    return cust.purchase_status(tx).groupBy("season_label", "customer_purchase_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.sum("tickets_sold").alias("tickets")
    )


@query
def kpi_summary(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = TicketFilter(season_label=star.PLANNING_LABEL, as_at=star.AS_AT)
    rows = filters.filter_tickets(m.tickets, f)
    planned = filters.scoped(m.fixtures, star.PLANNING_LABEL)
    return summaries.kpi_summary(rows, m.tickets, planned, 120000.0, 150000.0, star.AS_AT)


def typical_forecasts(m: star.Model) -> DataFrame:
    return outputs.pace_forecasts(m.planned, m.matches, m.daily)


@query
def fixture_sales_summary(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = summaries.fixture_summary(m.snapshot, m.fixtures, m.matches, typical_forecasts(m))
    return rows.select(
        "fixture_id", "competition", "match_date", "sold", "paid_sold", "comps", "gross_revenue", "unique_purchasers", "target", "forecast",
        "gap", "capacity_sold_pct", "risk_status",
    )


@query
def audience_summary(spark, sf_dir):
    rows = filters.filter_tickets(star.load(spark, sf_dir).tickets, TicketFilter(competition="BBL"))
    return summaries.audience_summary(rows, "ticket_class", 100)


@query
def audience_grouping_sets(spark, sf_dir):
    return summaries.audience_summaries(star.load(spark, sf_dir).tickets, pages.AUDIENCE_DIMENSIONS)


@query
def sales_window_summary(spark, sf_dir):
    return summaries.window_summary(star.load(spark, sf_dir).tickets)


@query
def current_window(spark, sf_dir):
    fx = star.load(spark, sf_dir).fixtures
    steps = ["2024-07-15", "2024-08-20", "2024-09-10", "2024-09-28", "2025-03-01", "2025-06-01"]
    rows = None
    for step in steps:
        row = summaries.next_fixture(filters.scoped(fx, star.PLANNING_LABEL), step).select(F.lit(step).alias("as_at"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def window_dates(spark, sf_dir):
    return summaries.purchase_window_dates(star.load(spark, sf_dir).planned)


@query
def season_mean(spark, sf_dir):
    tx = star.load(spark, sf_dir).tickets.filter(F.col("season_label").isin(list(star.BASELINE)))
    return summaries.mean_of_season_totals(tx, "paid_tickets_sold", "BBL")


@query
def insight_lines(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = TicketFilter(season_label=star.PLANNING_LABEL, as_at=star.AS_AT)
    rows, planned = filters.filter_tickets(m.tickets, f), filters.scoped(m.fixtures, star.PLANNING_LABEL)
    kpis = summaries.kpi_summary(rows, m.tickets, planned, 120000.0, 150000.0, star.AS_AT)
    fixtures = summaries.fixture_summary(rows, planned, m.matches, typical_forecasts(m))
    return summaries.insights(kpis, fixtures, summaries.audience_summary(rows, "ticket_class"), "ticket_class")


# --- segments and index -----------------------------------------------------------------------------


@query
def segment_fanout(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return segments.segment_fanout(m.tickets, m.customers).groupBy("analysis_group", "season_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("paid_tickets_sold").alias("paid"), F.count_distinct("customer_id").alias("customers")
    )


@query
def segment_audience_sizes(spark, sf_dir):
    return segments.audience_sizes(star.load(spark, sf_dir).customers)


def index_of(spark, sf_dir, kind: str, competition: str = "All", min_size: float = 100, baseline=star.BASELINE) -> DataFrame:
    m = star.load(spark, sf_dir)
    return ix.expected_index(bucketed(spark, sf_dir), m.customers, m.matches, star.PLANNING_LABEL, competition, star.AS_AT, kind, baseline, min_size)


@query
def expected_index_segment(spark, sf_dir):
    return index_of(spark, sf_dir, "segment")


@query
def expected_index_ticket_type(spark, sf_dir):
    return index_of(spark, sf_dir, "ticket_type", "BBL")


@query
def expected_index_ticket_class(spark, sf_dir):
    return index_of(spark, sf_dir, "ticket_class", "BBL", baseline=None)


@query
def expected_index_segment_product(spark, sf_dir):
    return index_of(spark, sf_dir, "segment_product")


@query
def marketing_recommendations(spark, sf_dir):
    rows = recommend.marketing_recommendations(index_of(spark, sf_dir, "segment"), 300)
    return recommend.present(rows, ("rank", *recommend.RECOMMENDATION_COLUMNS))


@query
def comparison_bars(spark, sf_dir):
    return ix.comparison_bars(index_of(spark, sf_dir, "segment_product"))


@query
def index_report_order(spark, sf_dir):
    """Every segment in the order of the report."""
    return ix.in_report_order(index_of(spark, sf_dir, "segment")).select("rank", "analysis_group", "status", "paid_ticket_gap")


@query
def report_fixtures(spark, sf_dir):
    """Every fixture of the printed report in its order."""
    return ranked(fixture_sales_summary(spark, sf_dir), "competition", "match_date", "fixture_id").select("rank", "fixture_id", "risk_status")


@query
def risk_highlights(spark, sf_dir):
    return recommend.risk_highlights(index_of(spark, sf_dir, "segment"), index_of(spark, sf_dir, "ticket_class"))


@query
def risk_highlights_small_scope(spark, sf_dir):
    """Headline groups where none is sizeable."""
    small = lambda kind: index_of(spark, sf_dir, kind).withColumn("meets_min_size", F.lit(False))
    return recommend.risk_highlights(small("segment"), small("ticket_class"))


@query
def recommended_audiences(spark, sf_dir):
    m = star.load(spark, sf_dir)
    # An early cut-off leaves customers who have not bought yet.
    early = m.tickets.filter(F.col("transaction_date") <= dates.midnight("2024-08-15"))
    return recommend.recommended_audiences(m.customers, early, star.PLANNING_LABEL, 20)


@query
def early_onsale_segments(spark, sf_dir):
    return recommend.early_segments(star.load(spark, sf_dir).tickets, "2023/24", "All", "ticket_class", 10)


# --- curves -----------------------------------------------------------------------------------------


@query
def transaction_curve(spark, sf_dir):
    return summaries.sales_curve(star.load(spark, sf_dir).tickets, filters.PAID_AND_COMPS)


@query
def season_comparison(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return summaries.season_comparison(m.matches, m.daily, "BBL", [*star.BASELINE, star.PLANNING_LABEL])


def history(m: star.Model) -> DataFrame:
    return m.tickets.filter(F.col("season_label").isin(list(star.BASELINE)))


@query
def aligned_history_curve(spark, sf_dir):
    m = star.load(spark, sf_dir)
    length = curves.chart_length(SEASON_START, EVENT_DATE)
    blended = curves.aligned_history(history(m), filters.PAID_ONLY, length, SEASON_START)
    latest = curves.aligned_history(history(m), filters.PAID_ONLY, length, SEASON_START, blend=False, name="last_season")
    return blended.join(latest, "date")


@query
def fixture_history_curve(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return curves.fixture_history(m.tickets, "2023-7", filters.PAID_AND_COMPS, curves.chart_length(SEASON_START, EVENT_DATE), SEASON_START)


@query
def actual_curve_gapfill(spark, sf_dir):
    tx = star.load(spark, sf_dir).tickets.filter("fixture_id = '2024-7'")
    return curves.actual_curve(tx, filters.COMPS_ONLY)


@query
def tracking_chart(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = TicketFilter(season_label=star.PLANNING_LABEL, competition="BBL")
    return pages.audience_tracking(m.tickets, f, star.BASELINE, SEASON_START, EVENT_DATE, star.AS_AT)["chart"]


@query
def pace_profile(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return pace.pace_profiles(m.planned, m.matches, m.daily, star.BASELINE, settings=PACE)


@query
def comparable_matches(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = pace.comparable_matches(m.matches, m.daily, MATCH_ID, {"competition": "WBBL", "season_label": list(star.BASELINE)})
    return rows.select("rank", "match_id", "season_label", "opponent", "similarity", "final_sales")


@query
def nearest_historical_fixture(spark, sf_dir):
    return curves.nearest_fixtures(star.load(spark, sf_dir).fixtures, star.PLANNING_LABEL, "All", "2024-12-31")


@query
def last_season_equivalent(spark, sf_dir):
    fx = star.load(spark, sf_dir).fixtures
    latest = filters.latest_season(fx, star.PLANNING_LABEL)
    return curves.last_season_equivalent(fx, latest, "BBL", "NATION_12", "2024-12-20")


@query
def season_equivalents(spark, sf_dir):
    """All planned matches and the fixtures of last season that stand for them."""
    m = star.load(spark, sf_dir)
    return curves.season_equivalents(m.planned, m.fixtures, filters.latest_season(m.fixtures, star.PLANNING_LABEL))


@query
def nearest_past_fixtures(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return curves.nearest_past_fixtures(m.planned, m.fixtures, star.PLANNING_LABEL)


@query
def last_season_curves(spark, sf_dir):
    """Last season's sales beside every planned match, on its chart."""
    m = star.load(spark, sf_dir)
    return curves.equivalent_curves(m.tickets, m.planned, season_equivalents(spark, sf_dir), filters.PAID_AND_COMPS, SEASON_START)


@query
def target_curve(spark, sf_dir):
    m = star.load(spark, sf_dir)
    profile = pace.pace_profiles(m.planned, m.matches, m.daily, star.BASELINE, settings=PACE)
    return targets.target_curves(m.planned, profile, F.col("baseline_target"), 0.10)


def planned_outputs(m: star.Model, which: DataFrame | None = None) -> outputs.FixtureOutputs:
    which = which if which is not None else m.planned
    return outputs.fixture_outputs(which, m.matches, m.daily, typical_forecasts(m), star.BASELINE)


@query
def required_daily(spark, sf_dir):
    return planned_outputs(star.load(spark, sf_dir)).target.select("match_id", "date", "target_daily", "required_daily")


@query
def forecast_curve(spark, sf_dir):
    return planned_outputs(star.load(spark, sf_dir)).forecast


@query
def match_chart(spark, sf_dir):
    chart = planned_outputs(star.load(spark, sf_dir)).chart()
    chart = curves.scaled_manual(chart, 9000.0, "match_id")
    return chart.select(
        "match_id", "date", "forecast_expected_cumulative", "target_cumulative", "required_daily", "manual_target_cumulative", "actual_daily"
    )


@query
def season_rollup(spark, sf_dir):
    m = star.load(spark, sf_dir)
    o = planned_outputs(m, curves.first_home_matches(m.planned, 10))
    return curves.season_rollup(o.target, o.forecast, o.manual, o.actual)


@query
def scenario_summary(spark, sf_dir):
    m = star.load(spark, sf_dir)
    o = planned_outputs(m)
    return summaries.scenario_summary(curves.season_rollup(o.target, o.forecast, o.manual, o.actual))


FAMILY = TicketFilter(competition="BBL", ticket_class="Family Zone", audience_segment="Families", ticket_status=filters.PAID_ONLY)


@query
def segment_projection(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return projection.segment_projection(
        m.tickets, history(m), FAMILY, SEASON_START, EVENT_DATE, 50000.0, star.AS_AT, star.PLANNING_LABEL, competition="BBL"
    )


@query
def projection_fallback(spark, sf_dir):
    """A selection with too little history is widened step by step."""
    m = star.load(spark, sf_dir)
    f = TicketFilter(competition="WBBL", ticket_class="Gold", ticket_type="Brand#0", age_bands=("18-30",), audience_segment="Families")
    rows = cust.enrich_demographics(m.tickets, m.customers)
    past = rows.filter(F.col("season_label").isin(list(star.BASELINE)))
    curve = projection.segment_projection(rows, past, f, SEASON_START, EVENT_DATE, 50000.0, star.AS_AT, star.PLANNING_LABEL, competition="WBBL")
    return projection.projection_summary(curve, past, f, star.AS_AT)


@query
def target_breakdown(spark, sf_dir):
    m = star.load(spark, sf_dir)
    curve = projection.segment_projection(
        m.tickets, history(m), FAMILY, SEASON_START, EVENT_DATE, 50000.0, star.AS_AT, star.PLANNING_LABEL, competition="BBL", actuals=False
    )
    facts = curve.agg(F.max("forecast_final_tickets").alias("final"), F.max("contribution_pct").alias("pct"))
    final, pct = facts.select("final").scalar(), facts.select("pct").scalar()
    return curves.scaled_targets(curve, final, pct, {"base": 60000.0, "stretch": 75000.0})


@query
def visible_lines(spark, sf_dir):
    """Chosen lines of the target breakdown; those it lacks are left out."""
    return curves.visible_lines(target_breakdown(spark, sf_dir), ["Stretch", "Forecast", "Actual"])


@query
def target_breakdown_chart(spark, sf_dir):
    """Saved base and stretch targets of one arena's fixtures and last season's sales beside the projection."""
    m = star.load(spark, sf_dir)
    f = replace(FAMILY, season_label=star.PLANNING_LABEL, competition="BBL")
    curve = projection.segment_projection(
        m.tickets, history(m), FAMILY, SEASON_START, EVENT_DATE, 50000.0, star.AS_AT, star.PLANNING_LABEL, competition="BBL", actuals=False
    )
    totals = plan_targets.target_totals(m.planned.filter("venue = 'AMERICA Arena'"), saved(spark, sf_dir))
    return curves.breakdown_chart(curve, totals, pages.last_season(m.tickets, m.fixtures, f, SEASON_START, EVENT_DATE))


# --- model ------------------------------------------------------------------------------------------


@query
def training_snapshots(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = features.training_rows(m.matches, m.daily)
    return rows.select("match_id", "date", *features.NUMERIC, *features.CATEGORICAL, "final_sales", "cumulative_share_of_final")


@query
def latest_snapshots(spark, sf_dir):
    m = star.load(spark, sf_dir)
    rows = features.latest_snapshots(m.planned, m.matches, m.daily)
    return rows.select("match_id", "date", "days_to_event", "days_on_sale", "cumulative_sales", "trailing_7_day_sales", "sales_window", "is_weekend_event")


_MODELS: dict[tuple[str, str], forest.Forecaster] = {}


def fitted_model(spark, sf_dir) -> forest.Forecaster:
    """The forest of these tables, grown once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        m = star.load(spark, sf_dir)
        _MODELS[key] = outputs.fitted(m.matches, m.daily)
    return _MODELS[key]


@query
def forest_forecast(spark, sf_dir):
    """Rows only: forests of two libraries differ."""
    m = star.load(spark, sf_dir)
    return outputs.forest_forecasts(m.planned, m.matches, m.daily, fitted_model(spark, sf_dir))


@query
def feature_importance(spark, sf_dir):
    """Rows only."""
    m = star.load(spark, sf_dir)
    rows = features.training_rows(m.matches, m.daily)
    return forest.feature_importance(fitted_model(spark, sf_dir), rows)


@query
def forest_invariants(spark, sf_dir):
    """What holds of every forecast, whatever library grew the forest."""
    m = star.load(spark, sf_dir)
    rows = forest_forecast(spark, sf_dir).join(sold_so_far(m), "match_id", "left")
    sold = F.coalesce("sold", F.lit(0.0))
    holds = {
        "expected_covers_sold": F.col("expected") >= sold, "lower_covers_sold": F.col("lower") >= sold,
        "upper_covers_expected": F.col("upper") >= F.col("expected"), "upper_covers_lower": F.col("upper") >= F.col("lower"),
    }
    return rows.select("match_id", *[test.alias(name) for name, test in holds.items()])


def sold_so_far(m) -> DataFrame:
    """What the model takes as sold: the newest daily row of each planned match."""
    return features.latest_snapshots(m.planned, m.matches, m.daily).select("match_id", F.col("cumulative_sales").alias("sold"))


@query
def forest_fallback(spark, sf_dir):
    """Forecasts from fewer than ten training rows: the median of their finals."""
    m = star.load(spark, sf_dir)
    rows = ranked(features.training_rows(m.matches, m.daily), "match_id", "date", F.col("sales_window"), limit=forest.MIN_ROWS - 1)
    return outputs.forest_forecasts(m.planned, m.matches, m.daily, forest.fit(rows.drop("rank")))


@query
def importance_invariants(spark, sf_dir):
    """Importances add up to one and are ranked without gaps."""
    rows = feature_importance(spark, sf_dir)
    total = F.round(F.sum("importance"), 3).alias("total")
    return rows.agg(total, (F.max("rank") == F.count(F.lit(1))).alias("ranked"), (F.min("importance") >= 0).alias("not_negative"))


@query
def fixture_forecast_table(spark, sf_dir):
    m = star.load(spark, sf_dir)
    labelled = m.upcoming.join(m.fixtures.select(F.col("fixture_id").alias("match_id"), "fixture_label"), "match_id")
    return outputs.forecast_table(labelled, typical_forecasts(m))


@query
def model_forecast_table(spark, sf_dir):
    """The forecast table of all planned fixtures fed by the fitted forest; its numbers by what they must hold."""
    m = star.load(spark, sf_dir)
    labelled = m.planned.join(m.fixtures.select(F.col("fixture_id").alias("match_id"), "fixture_label"), "match_id")
    rows = outputs.forecast_table(labelled, forest_forecast(spark, sf_dir)).join(sold_so_far(m).withColumnRenamed("match_id", "fixture_id"), "fixture_id", "left")
    up = F.col("forecast_10pct_uplift") - F.col("forecasted_sales") * 1.1
    return rows.select(
        "fixture_id", "fixture", "competition", "date", "opponent", "status",
        (F.col("forecasted_sales") >= F.floor(F.coalesce("sold", F.lit(0.0)))).alias("covers_sold"), (F.abs(up) <= 1.05).alias("uplift_of_ten_percent"),
    )


# --- planning ---------------------------------------------------------------------------------------


@query
def future_calendar(spark, sf_dir):
    fx = star.load(spark, sf_dir).fixtures
    plan = calendar.CalendarPlan(2025, "2025/26", "Home side")
    return calendar.assumed_fixtures(fx, plan).select(
        "fixture_id", "season_label", "competition", "venue", "match_date", "day_of_week", "capacity_total", "fixture_status", "notes"
    )


def drafts(spark, sf_dir) -> DataFrame:
    """Targets as typed by a planner, some of them wrong."""
    mts = star.load(spark, sf_dir).matches
    return mts.select(
        F.col("match_id").alias("fixture_id"),
        F.when(F.col("round") % 7 == 0, "abc").when(F.col("round") % 5 == 0, "-5").otherwise(F.format_number("baseline_target", 0)).alias("base_target"),
        F.when(F.col("round") % 4 == 0, "$10").otherwise(F.concat(F.lit("$"), F.format_number("manual_target", 0))).alias("stretch_target"),
    )


@query
def target_validation(spark, sf_dir):
    return plan_targets.validate(drafts(spark, sf_dir))


def saved(spark, sf_dir) -> DataFrame:
    """Targets table after two saves; a third of the fixtures has none."""
    path = new_path(spark, "targets")
    rows = drafts(spark, sf_dir).join(star.load(spark, sf_dir).fixtures.select("fixture_id", "venue"), "fixture_id")
    rows = rows.filter("venue not in ('AFRICA Arena', 'ASIA Arena')")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    tables.save_targets(plan_targets.to_saved(rows, stamp("2024-10-01 09:00:00")), path)
    changed = rows.filter("venue = 'EUROPE Arena'").withColumn("base_target", F.lit("1,000"))
    tables.save_targets(plan_targets.to_saved(changed, stamp("2024-10-02 09:00:00")), path)
    return tables.load_targets(spark, path)


@query
def target_status(spark, sf_dir):
    return plan_targets.target_status(drafts(spark, sf_dir), saved(spark, sf_dir))


@query
def target_totals(spark, sf_dir):
    m = star.load(spark, sf_dir)
    kept = saved(spark, sf_dir)
    whole = plan_targets.target_totals(m.planned, kept).withColumn("scope", F.lit("all"))
    some = plan_targets.target_totals(m.planned.filter("venue = 'AMERICA Arena'"), kept).withColumn("scope", F.lit("america"))
    return whole.unionByName(some)


@query
def missing_target_labels(spark, sf_dir):
    """Names of planned fixtures without saved targets."""
    return plan_targets.missing_labels(star.load(spark, sf_dir).planned, saved(spark, sf_dir))


@query
def target_drafts(spark, sf_dir):
    m = star.load(spark, sf_dir)
    table = outputs.forecast_table(m.planned, typical_forecasts(m))
    return plan_targets.draft_table(table, saved(spark, sf_dir)).drop("fixture")


# --- data quality -----------------------------------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    """Counts, types and first values of every column of an export whose rows are numbered by order and line."""
    key = F.split("txn_id", "-")
    number = F.get(key, F.lit(0)).cast("long") * 8 + F.get(key, F.lit(1)).cast("long")
    return quality.profile_columns(raw_tickets(spark, sf_dir).withColumn("source_row_number", number))


@query
def load_metrics(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return quality.load_metrics(m.tickets, m.fixtures, m.customers)


def warnings_of(tickets: DataFrame, m: star.Model) -> DataFrame:
    """Warnings of a load whose group tickets lack match and fixture."""
    known = F.col("price_type") != "Group"
    bare = tickets.withColumns({c: F.when(known, F.col(c)) for c in ("match_date", "fixture_id")})
    found = quality.validation_warnings(bare, m.fixtures, m.customers, quality.load_metrics(bare, m.fixtures, m.customers))
    return found.unionByName(quality.match_rate_warning(bare))


@query
def validation_warnings(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return warnings_of(m.tickets, m)


@query
def validation_warnings_bucketed(spark, sf_dir):
    """The same warnings, repeated rows counted without moving a ticket."""
    return warnings_of(bucketed(spark, sf_dir), star.load(spark, sf_dir))


@query
def repeated_rows(spark, sf_dir):
    """Share of repeated rows when every fourth line of an order is sent twice."""
    times = F.when(F.col("transaction_id").endswith("-4"), 2).otherwise(1)
    return quality.repeated_share(bucketed(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), times))))


@query
def demographic_coverage(spark, sf_dir):
    return quality.demographic_coverage(star.load(spark, sf_dir).customers)


@query
def snapshot_freshness(spark, sf_dir):
    m = star.load(spark, sf_dir)
    stale = quality.snapshot_freshness(m.snapshot, "2025-01-15").withColumn("case", F.lit("stale"))
    fresh = quality.snapshot_freshness(m.snapshot, "2024-11-20").withColumn("case", F.lit("fresh"))
    ahead = quality.snapshot_freshness(m.tickets, "2024-11-20").withColumn("case", F.lit("ahead"))
    return stale.unionByName(fresh).unionByName(ahead)


# --- pages ------------------------------------------------------------------------------------------


@query
def page_forecasting_drafts(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return pages.fixture_forecasting(outputs.forecast_table(m.planned, typical_forecasts(m)), saved(spark, sf_dir))["drafts"].drop("fixture")


@query
def page_tracker_highlights(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = TicketFilter(season_label=star.PLANNING_LABEL)
    return pages.season_tracker(bucketed(spark, sf_dir), m.customers, m.fixtures, m.matches, f, star.AS_AT, star.BASELINE, typical_forecasts(m))["highlights"]


@query
def page_breakdown_curve(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = replace(FAMILY, season_label=star.PLANNING_LABEL, competition="BBL")
    return pages.target_breakdown(m.tickets, m.matches, f, star.BASELINE, SEASON_START, EVENT_DATE, star.AS_AT, saved(spark, sf_dir), 50000.0)["curve"]


def planner(spark, sf_dir) -> pages.Page:
    m = star.load(spark, sf_dir)
    return pages.marketing_planner(bucketed(spark, sf_dir), m.customers, m.matches, star.PLANNING_LABEL, "All", star.AS_AT, star.BASELINE, 300)


@query
def page_planner_recommendations(spark, sf_dir):
    return planner(spark, sf_dir)["recommendations"]


@query
def page_planner_coverage(spark, sf_dir):
    return planner(spark, sf_dir)["coverage"]


@query
def page_planning_early_segments(spark, sf_dir):
    m = star.load(spark, sf_dir)
    page = pages.audience_planning(bucketed(spark, sf_dir), m.customers, m.matches, star.PLANNING_LABEL, "All", star.AS_AT, star.BASELINE, "ticket_class", 10)
    return page["early_segments"]


@query
def page_recommended_windows(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return pages.recommended(m.tickets, m.customers, star.PLANNING_LABEL, 20)["windows"]


@query
def page_report_insights(spark, sf_dir):
    m = star.load(spark, sf_dir)
    f = TicketFilter(season_label=star.PLANNING_LABEL)
    return pages.report(bucketed(spark, sf_dir), m.customers, m.fixtures, m.matches, f, star.AS_AT, star.BASELINE, typical_forecasts(m), 120000.0, 150000.0)["insights"]


@query
def page_overview_seasons(spark, sf_dir):
    m = star.load(spark, sf_dir)
    page = pages.historical_overview(m.tickets, m.fixtures, m.customers, m.matches, m.daily, "BBL", [*star.BASELINE, star.PLANNING_LABEL], star.AS_AT)
    return page["seasons"]


@query
def page_admin_metrics(spark, sf_dir):
    m = star.load(spark, sf_dir)
    return pages.data_admin(m.tickets, m.fixtures, m.customers, cust.enrich_demographics(m.tickets, m.customers), star.AS_AT)["metrics"]
