"""Parsing that looks at each value once gives what the plain rules give, on odd texts."""

from pyspark.sql import functions as F

from boxline.functions import dates, numbers, seasons, text
from boxline.functions.text import BOM
from boxline.operators import ingest
from boxline.plans.queries import SETTINGS

ODD = [None, "", " ", "-", " - ", "NULL", "n/a ", "nanx", "~x", "x~", "é", " a　", f"{BOM}a", f"a{BOM}b ", f"{BOM} none", "a b", "\ta", "a\n", "ab "]


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")


def test_named_column_is_cleaned_like_an_expression(spark):
    df = rows(spark, ODD).select(
        text.clean_text("v").alias("a"), text.clean_text(F.concat("v", F.lit(""))).alias("b"), text.strip("v").alias("c"), text.strip(F.col("v")).alias("d")
    )
    for r in df.collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_numbers_on_odd_texts(spark):
    cases = {
        "$1,234.50": 1234.5, "(5)": -5.0, "($ 5)": None, "( 5 )": None, "(-5)": None, " 7 ": 7.0, "12%": 12.0, "1.": 1.0, ".5": 0.5, "1e3": 1000.0,
        "1d": None, "NaN": None, "-": None, "": None, "$ 5 ": 5.0, "5\n": 5.0, "4 5": None, "+3": 3.0,
    }
    got = rows(spark, list(cases)).select("v", numbers.parse_number("v", None).alias("n")).collect()
    assert {r.v: r.n for r in got} == cases


def test_dates_on_odd_texts(spark):
    cases = {
        " 5/2/2024 13:05": "2024-02-05 13:05:00", "13/13/2024": None, "2/13/2024": "2024-02-13 00:00:00", "2024-13-02": "2024-02-13 00:00:00",
        "1/2/2024 5:30 pm": "2024-02-01 17:30:00", "1/2/24": "2024-02-01 00:00:00", "1/2/75": "1975-02-01 00:00:00", "2024/3/4": "2024-03-04 00:00:00",
        "5 Feb 2024": "2024-02-05 00:00:00", "1/2/20245": None, "round 3": None,
    }
    got = rows(spark, list(cases)).select("v", dates.parse_date("v").cast("string").alias("a"), dates.parse_date(F.concat("v", F.lit(""))).cast("string").alias("b")).collect()
    assert {r.v: r.a for r in got} == cases and {r.v: r.b for r in got} == cases


def test_ticket_texts_are_not_parsed_once_for_each_use(spark):
    raw = spark.createDataFrame([("BBL v X - 5/2/2024", "3", "2023-24")], "event_name string, quantity string, season string")
    mapping = {"event_name": "event_name", "tickets_sold": "quantity", "season": "season"}
    out = ingest.normalise_tickets(raw, mapping, "BBL", SETTINGS)
    kept = out.select("match_date", "season_label", "tickets_sold")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # The date is sought in the event by three patterns, each once.
    assert plan.count("([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})") == 1 and seasons._RANGE in plan
    assert [str(x) for x in kept.first()] == ["2024-02-05 00:00:00", "2023/24", "3.0"]
