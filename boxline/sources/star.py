"""Ticket model over the star-schema tables (lineitem, orders, ...).

One line item is one ticket row. Order dates are moved on by a fixed number of
years so that seasons fall in the 2000s, as the season rules expect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxline.functions import dates, keys, seasons, windows
from boxline.operators import customers, matches
from boxline.operators.common import CUSTOMER_KEY
from boxline.sources import facts
from boxline.sources.session import new_path, released

YEAR_SHIFT = 24
PLANNING_LABEL = "2024/25"
PLANNING_SEASON = 2024
AS_AT = "2024-11-15"
BASELINE = ("2021/22", "2022/23", "2023/24")
SALT = "boxline"

TICKET_CLASS = {
    "STANDARD": "General Admission",
    "ECONOMY": "The Hill",
    "MEDIUM": "Boundary Zone",
    "LARGE": "Gold",
    "PROMO": "Platinum Lounge",
    "SMALL": "Family Zone",
}
PRICE_TYPE = {
    "1-URGENT": "Adult",
    "2-HIGH": "Concession",
    "3-MEDIUM": "Fam4 pass",
    "4-NOT SPECIFIED": "Junior",
    "5-LOW": "Group",
}
CHANNEL = {"O": "Online", "F": "Box office", "P": "Phone"}
STATUS = {"R": "Refunded", "A": "Active", "N": "Confirmed"}
CAPACITY = {"AFRICA Arena": 10000, "AMERICA Arena": 20000, "ASIA Arena": 30000, "EUROPE Arena": 40000}
TICKET_COLUMNS = (
    "transaction_id", "order_id", "customer_id", "transaction_date", "competition", "opponent", "venue", "tickets_sold", "is_refund", "is_comp",
    "gross_revenue", "price_paid", "ticket_type", "ticket_class", "price_type", "section", "sales_channel", "status", "purchaser_postcode",
    "purchaser_age_band", "purchaser_gender", "purchaser_family_flag", "marketing_opt_in", "season", "season_label", "match_date", "fixture_id",
    "fixture_name", "net_revenue", "paid_tickets_sold", "comp_tickets_sold", "sales_window",
)


# Columns that come from the joined tables as they are.
MOVED = (
    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "reversed_sale", "l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority",
    "c_nationkey", "c_mktsegment", "marketing_opt_in", "p_brand", "ticket_class", "n_nationkey", "n_name", "r_regionkey", "r_name",
)
# Processed tables whose files lie by season in a load.
BY_SEASON = ("transactions_normalised",)


def pick(c: Column, values: dict) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compact row per ticket: what the columns of a ticket are made of, its customer, date and season."""
    return dated(joined(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows before their texts are made: ids are numbers, and nothing is there twice, so they move as few bytes as can be.

    Each lookup is joined by itself, so that Spark sees its own size; joined
    with each other first, small ones look too large to be sent to all tasks.
    Parts come before orders, while the rows are narrowest, and what follows
    from one table alone is found before its rows move.
    """
    customer = table(spark, sf_dir, "customer").withColumn("marketing_opt_in", F.col("c_acctbal") > 0)
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    part = table(spark, sf_dir, "part").withColumn("ticket_class", F.when(F.col("p_size") < 50, pick(F.col("p_type"), TICKET_CLASS)))
    lines = line_items(spark, sf_dir).withColumn("reversed_sale", (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.06))
    rows = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select("l_orderkey", "o_custkey", "o_orderdate", *MOVED)


def dated(rows: DataFrame) -> DataFrame:
    """Rows of ``joined`` with their order and customer as texts, their date and season."""
    sold_at = F.col("o_orderdate") + F.make_ym_interval(F.lit(YEAR_SHIFT)) + F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 3)
    return rows.select(_order().alias("order_id"), _buyer().alias("customer_id"), sold_at.alias("transaction_date"), seasons.season_label_of_date(sold_at).alias("season_label"), *MOVED)


def _order() -> Column:
    return F.col("l_orderkey").cast("string")


def _buyer() -> Column:
    guest = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return F.when(~guest, F.concat(F.lit("C"), F.col("o_custkey").cast("string")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised ticket rows."""
    return described(sales(spark, sf_dir))


def described(rows: DataFrame, *kept: str) -> DataFrame:
    """All columns of a ticket from its compact row, and those ``kept`` as they are."""
    refund = F.col("l_returnflag") == "R"
    comp = (F.col("l_discount") == 0) & ~refund
    tickets = F.when(F.col("reversed_sale"), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    sign = F.when(F.col("reversed_sale"), -1).otherwise(1)
    gross = (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")

    base = rows.select(
        F.concat("order_id", F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        "order_id",
        "customer_id",
        "transaction_date",
        F.when(F.col("r_regionkey") <= 2, "BBL").otherwise("WBBL").alias("competition"),
        F.col("n_name").alias("opponent"),
        F.concat("r_name", F.lit(" Arena")).alias("venue"),
        F.col("n_nationkey").alias("_n"),
        tickets.alias("tickets_sold"),
        refund.alias("is_refund"),
        comp.alias("is_comp"),
        F.when(comp, F.lit(0).cast("decimal(18,4)")).otherwise(gross).alias("gross_revenue"),
        F.when(comp, F.lit(0.0)).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_paid"),
        F.col("p_brand").alias("ticket_type"),
        "ticket_class",
        pick(F.col("o_orderpriority"), PRICE_TYPE).alias("price_type"),
        F.concat(F.lit("Bay "), F.col("l_linestatus")).alias("section"),
        pick(F.col("o_orderstatus"), CHANNEL).alias("sales_channel"),
        pick(F.col("l_returnflag"), STATUS).alias("status"),
        (F.lit(5000) + F.col("c_nationkey")).cast("string").alias("purchaser_postcode"),
        demographic_age_band(F.col("c_nationkey")).alias("purchaser_age_band"),
        demographic_gender(F.col("c_mktsegment")).alias("purchaser_gender"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("purchaser_family_flag"),
        "marketing_opt_in",
        "season_label",
        *kept,
    )
    season = seasons.season_start_of_date("transaction_date")
    dated = base.withColumns(
        {
            "season": season,
            "match_date": F.date_add(F.make_date(season, F.lit(10), F.lit(1)), (F.col("_n") * 7 + F.col("_n") % 3 - 1).cast("int")),
            "fixture_id": F.concat(season.cast("string"), F.lit("-"), F.col("_n").cast("string")),
            "fixture_name": F.concat("competition", F.lit(" v "), "opponent"),
            "net_revenue": F.col("gross_revenue"),
            "paid_tickets_sold": F.when(F.col("is_comp"), 0.0).otherwise(F.col("tickets_sold")),
            "comp_tickets_sold": F.when(F.col("is_comp"), F.greatest(F.col("tickets_sold"), F.lit(0.0))).otherwise(0.0),
        }
    )
    return dated.withColumn("sales_window", windows.window_of_sale("transaction_date", "match_date")).select(*TICKET_COLUMNS, *kept)


def demographic_age_band(nation: Column) -> Column:
    return (
        F.when(nation < 5, "Under 18").when(nation < 10, "18-30").when(nation < 15, "31-45").when(nation < 20, "46-60")
    )


def demographic_gender(segment: Column) -> Column:
    return F.when(segment == "AUTOMOBILE", "Male").when(segment == "BUILDING", "Female")


def fixtures(tickets: DataFrame) -> DataFrame:
    """Fixture list, one row per fixture the tickets are for."""
    keyed = ["fixture_id", "season", "season_label", "competition", "opponent", "venue", "match_date"]
    rows = tickets.filter(F.col("season") <= PLANNING_SEASON).select(*keyed).distinct()
    assumed = F.col("season") == PLANNING_SEASON
    return (
        rows.withColumn("team", F.lit("Home side"))
        .withColumn("day_of_week", dates.day_name("match_date"))
        .withColumn("capacity_total", pick(F.col("venue"), CAPACITY).cast("double"))
        .withColumn("fixture_status", F.when(assumed, "assumed").otherwise("historical"))
        .withColumn("is_confirmed", ~assumed)
        .withColumn("is_assumed", assumed)
        .withColumn("fixture_label", keys.fixture_label("competition", "opponent", "match_date", "fixture_status", "is_assumed"))
    )


def customer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic records, one row per customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"),
        keys.anonymise(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), SALT).alias("anonymised_customer_id"),
        (F.lit(5000) + F.col("c_nationkey")).cast("string").alias("postcode"),
        F.concat(F.lit("Suburb "), F.col("c_nationkey").cast("string")).alias("suburb"),
        F.when(F.col("c_nationkey") % 2 == 0, "SA").otherwise("NSW").alias("state"),
        (F.lit(18.0) + F.col("c_nationkey")).alias("age"),
        demographic_age_band(F.col("c_nationkey")).alias("age_band"),
        demographic_gender(F.col("c_mktsegment")).alias("gender"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("family_flag"),
        (F.col("c_acctbal") > 0).alias("marketing_opt_in"),
        (F.col("c_acctbal") > 2000).alias("email_opt_in"),
        (F.col("c_acctbal") > 5000).alias("sms_opt_in"),
        F.lit(True).alias("has_customer_record"),
    )


@dataclass(frozen=True)
class Model:
    """The processed ticket model. Each table is written when it is first asked for, with those that it is made of.

    ``tickets`` holds everything; ``snapshot`` what was sold by the snapshot
    date. Matches and daily sales belong to the snapshot.
    """

    spark: SparkSession
    sf_dir: str

    @property
    def tickets(self) -> DataFrame:
        return facts.read_plain(self.spark, _written(self.spark, self.sf_dir, "tickets"))

    @property
    def fixtures(self) -> DataFrame:
        return self._read("fixtures")

    @property
    def customers(self) -> DataFrame:
        return self._read("customers")

    @property
    def matches(self) -> DataFrame:
        return self._read("matches")

    @property
    def daily(self) -> DataFrame:
        return self._read("daily")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(_written(self.spark, self.sf_dir, name))

    def write(self) -> Model:
        """Write all tables that are not there yet."""
        for name in TABLES:
            _written(self.spark, self.sf_dir, name)
        return self

    @property
    def snapshot(self) -> DataFrame:
        return at_snapshot(self.tickets)

    @property
    def planned(self) -> DataFrame:
        return self.matches.filter(F.col("season_label") == PLANNING_LABEL)

    @property
    def upcoming(self) -> DataFrame:
        return self.planned.filter(F.col("event_date") > dates.date_lit(AS_AT))


def at_snapshot(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.col("transaction_date") <= dates.midnight(AS_AT))


# Tables of a load, each after those that it is made of.
TABLES = ("sold", "tickets", "fixtures", "customers", "matches", "daily")
_LOADED: dict[tuple[str, str], tuple[str, set[str]]] = {}  # folder of a data directory, and its written tables


def load(spark: SparkSession, sf_dir: str) -> Model:
    """Processed tables of a data directory, each written once per application.

    Tickets are laid out by season, so season filters prune files.
    """
    return Model(spark, sf_dir)


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tickets with their customer buckets known to Spark."""
    return facts.read_facts(spark, _written(spark, sf_dir, "tickets"))


def _written(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a table, written now if this application has not done so."""
    key = (spark.sparkContext.applicationId, sf_dir)
    folder, done = _LOADED.setdefault(key, (new_path(spark, "processed"), set()))
    if name not in done:
        with released(spark):
            _write(spark, sf_dir, folder, name)
        done.add(name)
    return f"{folder}/{name}"


def _write(spark: SparkSession, sf_dir: str, folder: str, name: str) -> None:
    """Tickets move once, as compact rows, to the bucket of their customer; status, all columns and lifetimes are found there.

    Fixtures, matches and daily sales need no customer's history: they are
    totalled from the compact rows where the tickets are not written.
    """
    made = lambda table: _written(spark, sf_dir, table)
    read = lambda table: spark.read.parquet(made(table))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = _LOADED[spark.sparkContext.applicationId, sf_dir][1]

    def rows() -> DataFrame:
        if "tickets" in done:
            return facts.read_plain(spark, made("tickets"))
        return described(facts.read_plain(spark, made("sold")))

    if name == "sold":
        # Texts are made in the bucket, from which nothing moves any more.
        facts.write_facts(joined(spark, sf_dir), f"{folder}/sold", buckets, by=(), finish=dated, key=facts.bucket_key(_buyer(), _order()))
        return
    if name == "tickets":
        marked = customers.purchase_status(facts.read_facts(spark, made("sold"), by=()))
        facts.write_placed(described(marked, "customer_purchase_status", CUSTOMER_KEY), f"{folder}/tickets", buckets)
        return
    if name == "fixtures":
        # One pass: it does not pay to lay out the rows for fixtures alone.
        table = fixtures(rows() if "sold" in done else transactions(spark, sf_dir))
    elif name == "customers":
        table = customers.merge_customers(customer_file(spark, sf_dir), customers.lifetime(facts.read_facts(spark, made("tickets")), SALT))
    elif name == "matches":
        snapshot = at_snapshot(rows())
        table = matches.forecasting_matches(snapshot, read("fixtures"), PLANNING_SEASON, PLANNING_LABEL)
    else:
        planned = read("matches")
        table = matches.daily_sales(at_snapshot(rows()), planned)
    table.write.mode("overwrite").parquet(f"{folder}/{name}")
