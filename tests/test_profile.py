"""The column profile counts kinds of rows before it takes them apart, and its shortened tests read the same texts."""

import random
import re

from pyspark.sql import functions as F

from boxline.functions import dates
from boxline.operators import quality

TEXTS = ["1/2/2024", " 2024-01-31 ", "12 Jan 2024", "Feb 3, 2024", "3/4/24 1:05 pm", "99-12-31", "12-34", "12-3 abc", "$1,200.50", "(3%)", "1e5", ".", "+", "- 5", "5002",
         "Yes", " FALSE", "﻿1", "0", "n/a", "-", "", None, "İ", "maybe", "falsely", " tRuE ", "a\nb", "2024-02-30", "13/25/2024", "7am", "1 2 3am"]


def test_profile_of_odd_cells(spark):
    """Every cell counts, whatever stands beside it; rows come twice, and some have no number."""
    r = random.Random(3)
    rows = [(r.choice([i, i // 2, None]), *[r.choice(TEXTS) for _ in range(4)]) for i in range(400)]
    frame = spark.createDataFrame(rows + rows[:50], "source_row_number long, a string, b string, c string, d string")
    made = quality.profile_columns(frame)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and re.search(r"Generate posexplode.*?Aggregate \[_kinds", plan, re.S)  # counted first
    assert "_kinds" not in "".join(re.findall(r"Filter.*", plan))  # and tested once
    got = {x["column"]: x for x in made.collect()}
    cells = frame.select(F.coalesce("source_row_number", F.lit(2**63 - 1)).alias("n"), "a", "b", "c", "d").collect()
    space = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    clean = lambda v: None if v is None or (v := v.replace("﻿", "").strip(space)).lower() in ("", "null", "none", "nan", "nat", "#n/a", "n/a", "-") else v
    for c in "abcd":
        filled = sorted((x["n"], v) for x in cells if (v := clean(x[c])) is not None)
        assert (got[c]["non_blank"], got[c]["blank"]) == (len(filled), len(cells) - len(filled))
        assert got[c]["example_values"] == ", ".join(v[:48] for _, v in filled[:3])


def test_dates_by_name_and_by_value(spark):
    """A column given by its name is read where a date is possible, and that leaves out none."""
    r = random.Random(4)
    days, gaps, months = ["1", "01", "12", "31", "5", "69", "99", "2024", "1970"], ["/", ".", "-", " ", ", ", ""], ["Jan", "january", "FEB", "sept", "x", "7", "12", "13", "am"]
    tails, heads = ["", " 10:05", "T10:05:00", " 3:15 PM", " 3:15pm", "Z", " \n", "+01:00", " 2024"], ["", "", " ", "\t\n", "\xa0", "+", "-", "x"]
    pick = lambda *lists: "".join(map(r.choice, lists))
    texts = TEXTS + [pick(heads, days, gaps, months + days, gaps, days, tails) if r.random() < 0.8 else pick(heads, months, gaps, days, gaps, days, tails) for _ in range(20000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    read = frame.select("t", dates.parse_date("t").alias("named"), dates.parse_date(F.col("t")).alias("plain"))
    assert read.filter("NOT named <=> plain").isEmpty() and read.filter("named IS NOT NULL").count() > 100


def test_numbers_with_signs(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("0012.+-eE$,()% \nx") for _ in range(r.randint(0, 9))) for _ in range(30000)]
    old = F.translate("t", "$,()%", "").rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    both = spark.createDataFrame([(t,) for t in texts], "t string").select("t", old.alias("old"), F.col("t").rlike(quality.NUMBER).alias("new"))
    assert both.filter("old <> new").isEmpty() and both.filter("new").count() > 1000
