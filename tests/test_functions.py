import datetime as dt
import hashlib
import zlib

from pyspark.sql import functions as F

from boxline.functions import dates, keys, numbers, seasons, text, windows


def run(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_text(spark):
    assert run(spark, ["﻿ Gold  ", "N/A", "-", "", None, "NaN"], text.clean_text) == ["Gold", None, None, None, None, None]
    assert run(spark, ["﻿Gigya UID!", "  A--b  ", None], text.normalise_token) == ["gigya_uid", "a_b", ""]
    assert run(spark, [" GIGYA-001 ", "null", None], text.join_id) == ["gigya-001", None, None]
    assert run(spark, [" x ", None, "nan"], text.unknown_bucket) == ["x", text.UNKNOWN_LABEL, text.UNKNOWN_LABEL]
    assert run(spark, ["Unknown", "a", None], lambda c: text.fill_missing_text(c, F.lit("f"))) == ["f", "a", "f"]


def test_numbers(spark):
    got = run(spark, ["$1,234.50", "(12.00)", "12%", "", "abc", "1d", None, "1e3", "(-5)"], lambda c: numbers.parse_number(c, -1))
    assert got == [1234.5, -12.0, 12.0, -1, -1, -1, -1, 1000.0, -1]
    assert run(spark, ["Opt-In", "no", "perhaps", None], numbers.parse_bool) == [True, False, False, False]
    assert run(spark, ["12,500", " $9000 ", "", "x"], numbers.parse_target) == [12500.0, 9000.0, None, None]
    assert run(spark, [5450.0, 5550.0, 49.0], numbers.round_hundreds, "double") == [5400.0, 5600.0, 0.0]


def test_safe_index(spark):
    df = spark.createDataFrame([(80.0, 100.0), (5.0, 0.0), (0.0, 0.0)], "a double, e double")
    assert [r[0] for r in df.select(numbers.safe_index(F.col("a"), F.col("e"))).collect()] == [0.8, 1.25, 0.0]
    assert [r[0] for r in df.select(numbers.display_index(F.col("a"), F.col("e"))).collect()] == [0.8, 0.0, 0.0]


def test_dates(spark):
    d = dt.datetime
    cases = {
        "2019-12-01": d(2019, 12, 1), "01/12/2019": d(2019, 12, 1), "1/13/2024": d(2024, 1, 13), "5/6/85": d(1985, 6, 5),
        "3 Oct 1998": d(1998, 10, 3), "Oct 3, 1998": d(1998, 10, 3), "31/12/2024 7:15 PM": d(2024, 12, 31, 19, 15),
        "15-Jan-2025 19:15": d(2025, 1, 15, 19, 15), "2019-13-01": d(2019, 1, 13), "31/02/2024": None, "hello": None, "n/a": None,
    }
    assert run(spark, list(cases), dates.parse_date) == list(cases.values())
    assert run(spark, ["03/04/2024"], lambda c: dates.parse_date(c, day_first=False)) == [d(2024, 3, 4)]
    assert run(spark, ["BBL v Sixers - 15/01/2025", "on 2025-01-15", "none"], dates.date_in_text) == [d(2025, 1, 15), d(2025, 1, 15), None]


def test_floor_days_and_window(spark):
    rows = [(d, dt.date(2025, 1, 15)) for d in (dt.datetime(2025, 1, 14, 10), dt.datetime(2025, 1, 15, 10), dt.datetime(2024, 12, 31), dt.datetime(2024, 10, 1))]
    df = spark.createDataFrame(rows, "s timestamp_ntz, m date")
    got = df.select(dates.floor_days("m", "s"), windows.window_of_sale("s", "m")).collect()
    assert [tuple(r) for r in got] == [(0, "match-week"), (-1, "match-week"), (15, "campaign-window"), (106, "early-sales")]


def test_seasons(spark):
    raw = ["2024-25", "24/25", "Season 2024 / 2025", "Summer 2024", "Pre-season", "null", "1999/00"]
    assert run(spark, raw, seasons.season_label) == ["2024/25", "2024/25", "2024/25", "2024/25", "Pre-season", None, "1999/00"]
    assert run(spark, ["1999/00", "2024/25"], seasons.season_start) == [None, 2024]
    assert run(spark, ["1999/00", "x"], seasons.season_start_year) == [1999, None]
    assert run(spark, [dt.date(2025, 6, 30), dt.date(2025, 7, 1)], seasons.season_label_of_date, "date") == ["2024/25", "2025/26"]


def test_keys(spark):
    want = hashlib.sha256(b"salt:a1").hexdigest()[:16]
    assert run(spark, [" a1 ", "null"], lambda c: keys.anonymise(c, "salt")) == [want, None]
    df = spark.createDataFrame([("BBL", "2024/25", dt.date(2025, 1, 15), "Sydney Sixers", "Oval")], "c string, s string, d date, o string, v string")
    crc = zlib.crc32(b"BBL|2024/25|2025-01-15|Sydney Sixers|Oval") & 0xFFFFFFFF
    row = df.select(keys.fixture_id("c", "s", "d", "o", "v"), keys.match_key("c", "s", "o", "v", "d")).first()
    assert tuple(row) == (f"BBL_{crc:08x}", "bbl|2024_25|sydney_sixers|oval|20250115")


def test_ages(spark):
    assert run(spark, [17.0, 18.0, 31.0, 60.0, 61.0, None], dates.age_band, "double") == ["Under 18", "18-30", "31-45", "46-60", "61+", None]
    assert run(spark, [dt.date(1996, 8, 31)], lambda c: dates.age_in_years(c, "2026-08-31"), "date") == [30.0]


def test_window_ladders(spark):
    assert run(spark, [31, 32, 75, 76, 121], windows.window_of_offset, "int") == ["early-sales", "general-sale", "general-sale", "campaign-window", "match-week"]
    assert run(spark, ["Early Bird", "match_week", "Unknown", None], windows.window_order) == [1, 4, 2, 2]
    assert run(spark, ["early-sales", "match-week"], windows.next_window) == ["campaign-window", "match-week"]


def test_only_texts_that_begin_like_dates_are_rewritten(spark):
    d = dt.datetime
    cases = {
        "  26/7/2024 12:00 ": d(2024, 7, 26, 12), "2024.7.6": None, "6.7.2024": d(2024, 7, 6), "2024/7/6 x": None, "July 6, 2024": d(2024, 7, 6), "6-Jul-2024 9:05": d(2024, 7, 6, 9, 5),
        "005 Jul 2024": d(2024, 7, 5), "1/2/2024 3:04 pm": d(2024, 2, 1, 15, 4), "General Admission": None, "Brand#5": None, "12345-6": None, "MIDDLE EAST Arena 2024": None, "v 6/7/2024": None, "-": None,
    }
    assert run(spark, list(cases), dates.parse_date) == list(cases.values())
    plan = spark.range(1).select(dates.parse_date(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("(?i)^([+-]?[0-9]|[a-z]+ [0-9])") < plan.index("try_to_timestamp" if "try_to_timestamp" in plan else "gettimestamp")
