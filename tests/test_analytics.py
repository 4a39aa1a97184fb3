"""Exact small cases and invariants of the analytic operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxline.operators import (
    calendar, curves, customers as cust, forecast, index as ix, matches as mt, pace, plan_targets, quality, recommend, summaries, targets,
)
from boxline.operators.filters import COMPS_ONLY, PAID_AND_COMPS, PAID_ONLY, TicketFilter, filter_tickets
from boxline.operators.projection import projection_summary, segment_projection
from boxline.operators.quantiles import exact_quantile

D = dt.date


def tickets(spark, *changes):
    """One past and one current row, with changes."""
    base = dict(
        season_label="2025/26", competition="BBL", transaction_date="2025-10-01", match_date="2025-12-31", customer_id="hist-1", order_id="h1",
        transaction_id="x1", fixture_id="f1", paid_tickets_sold=100.0, tickets_sold=100.0, comp_tickets_sold=0.0, gross_revenue=5000.0, net_revenue=5000.0,
        price_type="Adult", ticket_type="Public", ticket_class="Gold", sales_window="general-sale", customer_purchase_status="Returning",
        purchaser_family_flag=False, is_comp=False, is_refund=False, marketing_opt_in=True,
    )
    now = base | dict(
        season_label="2026/27", transaction_date="2026-10-01", match_date="2026-12-31", customer_id="cur-1", order_id="c1", transaction_id="x2",
        paid_tickets_sold=80.0, tickets_sold=80.0, gross_revenue=4200.0,
    )
    rows = [base, now] if not changes else [(base | c) for c in changes]
    kinds = {str: "string", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return df.withColumns({"transaction_date": F.col("transaction_date").cast("timestamp_ntz"), "match_date": F.col("match_date").cast("date")})


def test_index_exact(spark):
    m = spark.createDataFrame([("2026/27", "BBL", D(2026, 12, 31)), ("2025/26", "BBL", D(2025, 12, 31))], "season_label string, competition string, event_date date")
    args = (tickets(spark), None, m, "2026/27", "BBL", "2026-10-01")
    row = ix.expected_index(*args, kind="ticket_class", baseline=["2025/26"], min_size=0).filter("analysis_group = 'Gold'").first()
    assert (row.expected_paid_tickets_by_now, row.current_paid_tickets, row.ticket_index, row.status) == (100, 80, 0.8, "Behind")
    row = ix.expected_index(*args, kind="ticket_type", baseline=["2025/26"], min_size=0).filter("analysis_group = 'Adult'").first()
    assert row.paid_ticket_gap == -20
    # Nothing is big enough: the largest groups are shown all the same.
    assert ix.expected_index(*args, kind="ticket_class", min_size=1e9).count() == 1


def test_not_due_yet(spark):
    status = ix.segment_status(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1000.0, "early-sales", "match-week")])
    assert spark.range(1).select(status).first()[0] == "Not due yet"


def test_freshness(spark):
    row = quality.snapshot_freshness(tickets(spark, {"transaction_date": "2026-01-01"}), "2026-02-01").first()
    assert row.is_stale and row.age_days == 31
    assert quality.snapshot_freshness(tickets(spark).filter("false"), "2026-02-01").first().is_stale


def test_sales_curves(spark):
    rows = tickets(spark, {}, {"paid_tickets_sold": 80.0}, {"paid_tickets_sold": 0.0, "comp_tickets_sold": 12.0})
    assert summaries.sales_curve(rows, PAID_ONLY).agg(F.max("actual_cumulative")).first()[0] == 180
    assert summaries.sales_curve(rows, COMPS_ONLY).agg(F.max("actual_cumulative")).first()[0] == 12


def test_gap_fill_and_tracking(spark):
    rows = tickets(spark, {"transaction_date": "2026-08-03", "tickets_sold": 10.0}, {"transaction_date": "2026-08-05", "tickets_sold": 15.0})
    actual = curves.actual_curve(rows, PAID_AND_COMPS)
    assert [r.actual_daily for r in actual.orderBy("date").collect()] == [10, 0, 15]
    past = curves.aligned_history(tickets(spark, {"transaction_date": "2025-08-01", "comp_tickets_sold": 42.0}), COMPS_ONLY, 2, "2026-08-01")
    assert [r.historical_cumulative for r in past.orderBy("date").collect()] == [42, 42, 42]
    chart = curves.tracking_chart(actual, past, None).orderBy("date").collect()
    assert [r.date for r in chart] == [D(2026, 8, 3), D(2026, 8, 4), D(2026, 8, 5)]
    assert [r.historical_cumulative for r in chart] == [42, 42, 42]


def test_visible_lines(spark):
    chart = spark.sql("SELECT date'2026-08-01' AS date, 100 AS forecast_expected_cumulative, 110 AS forecast_plus_10_cumulative, 105 AS base_cumulative, 125 AS stretch_cumulative, 50 AS actual_cumulative")
    assert curves.visible_lines(chart, ["Base", "Stretch", "Forecast +10%", "Forecast"]).columns == ["date", *[c for c in chart.columns[1:3]], "stretch_cumulative", "base_cumulative"]
    assert curves.visible_lines(chart, ["Base", "unknown"], keys=()).first().asDict() == {"base_cumulative": 105}
    assert curves.visible_lines(chart, ["Base"], "daily").columns == ["date"]


def test_early_segments(spark):
    rows = tickets(spark, {"transaction_date": "2025-08-10", "ticket_class": "Boundary Zone"}, {"paid_tickets_sold": 7.0})
    got = recommend.early_segments(rows, "2025/26", "BBL", "ticket_class", 1).collect()
    assert [(r.segment, r.early_paid_tickets) for r in got] == [("Boundary Zone", 100)]


def test_demographic_join(spark):
    rows = tickets(spark, {"customer_id": " GIGYA-001 ", "paid_tickets_sold": 2.0}, {"customer_id": "unknown-customer"}, {"customer_id": "x"})
    rows = rows.withColumn("customer_id", F.when(F.col("customer_id") != "x", F.col("customer_id")))
    people = spark.createDataFrame([("gigya-001", "18-30", "Female", "5000")], "customer_id string, age_band string, gender string, postcode string")
    joined = cust.enrich_demographics(rows, people)
    metrics = quality.demographic_match_metrics(joined, people).first()
    assert joined.count() == 3
    assert (metrics.ticketing_rows_with_id, metrics.demographic_matched_ticket_rows, metrics.demographic_match_rate) == (2, 1, 0.5)
    chosen = filter_tickets(joined, TicketFilter(age_bands=("18-30",), genders=("Female",), postcodes=("5000",)))
    assert chosen.agg(F.sum("paid_tickets_sold")).first()[0] == 2
    assert joined.filter("age_band_filter = 'Unknown / unmatched'").count() == 2


def test_target_checks(spark):
    drafts = spark.createDataFrame([("a", "12,500", "13000"), ("b", "10000", "9000"), ("c", "x", "-1")], "fixture_id string, base_target string, stretch_target string")
    bad = {r.fixture: r.issue for r in plan_targets.validate(drafts).collect()}
    assert set(bad) == {"b", "c"} and bad["b"].startswith("Stretch target should be")
    saved = plan_targets.to_saved(drafts.filter("fixture_id <> 'c'"))
    changed = drafts.withColumn("base_target", F.when(F.col("fixture_id") == "b", "1").otherwise(F.col("base_target")))
    assert {r.fixture_id: r.target_status for r in plan_targets.target_status(changed, saved).collect()} == {"a": "Saved", "b": "Draft / unsaved", "c": "Missing"}


def match_rows(spark, rows):
    base = dict(
        match_id="m", season=2024, season_label="2024/25", competition="BBL", venue="Oval", opponent="A", event_category="standard", day_of_week="Friday",
        opponent_strength=80, round=1, event_date=D(2024, 12, 20), on_sale_date=dt.datetime(2024, 12, 1), early_bird_start=dt.datetime(2024, 12, 1),
        early_bird_end=dt.datetime(2024, 12, 5), member_presale_start=dt.datetime(2024, 12, 6), member_presale_end=dt.datetime(2024, 12, 7),
        marketing_start=D(2024, 12, 8), marketing_end=D(2024, 12, 15), campaign_burst_date=D(2024, 12, 13), baseline_target=1000.0,
    )
    kinds = {"season": "int", "opponent_strength": "int", "round": "int", "event_date": "date", "baseline_target": "double"}
    kind = lambda k: kinds.get(k) or ("date" if k.startswith(("marketing", "campaign")) else "timestamp_ntz" if isinstance(base[k], dt.datetime) else "string")
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], ", ".join(f"{k} {kind(k)}" for k in base))


def flat_pace(spark, match_id="m", days=150):
    return spark.range(days + 1).select(F.lit(match_id).alias("match_id"), F.col("id").cast("int").alias("days_to_event"), F.lit(1 / (days + 1)).alias("historical_daily_share"))


def test_target_curve(spark):
    m = match_rows(spark, [{}])
    rows = targets.target_curves(m, flat_pace(spark), F.lit(30000.0), 0.10).orderBy("date").collect()
    assert rows[-1].target_cumulative == pytest.approx(33000)
    rows = targets.target_curves(m, flat_pace(spark), F.col("baseline_target")).orderBy("date").collect()
    by_day = {r.date: r.target_daily for r in rows}
    assert sum(by_day.values()) == pytest.approx(1000) and len(rows) == 20
    assert by_day[D(2024, 12, 15)] > by_day[D(2024, 12, 8)] and by_day[D(2024, 12, 20)] > by_day[D(2024, 12, 1)]
    late = match_rows(spark, [{"on_sale_date": dt.datetime(2024, 12, 31), "event_date": D(2024, 12, 1)}])
    only = targets.target_curves(late, flat_pace(spark), F.lit(10000.0)).collect()
    assert [(r.date, r.target_daily) for r in only] == [(D(2024, 12, 1), 10000.0)]
    # A manual target of 0 counts as not set; missing dates give one flat row.
    assert targets.target_curves(m, flat_pace(spark), F.lit(500.0), 0.0, F.lit(0)).first().target_total == 500
    undated = m.withColumn("event_date", F.lit(None).cast("date"))
    flat = targets.target_curves(undated, flat_pace(spark), F.lit(500.0), today="2024-12-02").collect()
    assert [(r.date, r.target_cumulative) for r in flat] == [(D(2024, 12, 2), 500.0)]


def test_forecast_invariants(spark):
    m = match_rows(spark, [{}])
    daily = spark.createDataFrame([("m", D(2024, 12, 1), 5.0, 5.0), ("m", D(2024, 12, 3), 5.0, 10.0)], "match_id string, date date, daily_sales double, cumulative_sales double")
    f = spark.createDataFrame([("m", 100.0, 90.0, 120.0)], "match_id string, expected double, lower double, upper double")
    rows = forecast.forecast_curves(m, daily, flat_pace(spark), f).orderBy("date").collect()
    line = [r.forecast_expected_cumulative for r in rows]
    assert line[:3] == [5, 5, 10] and line[-1] == pytest.approx(100) and all(a <= b + 1e-9 for a, b in zip(line, line[1:]))
    assert all(r.forecast_lower_cumulative <= r.forecast_expected_cumulative <= r.forecast_upper_cumulative for r in rows)


def brute_pace(ms, daily, target, baseline, window, reference, minimum=3):
    """Pace profile of one target, candidate by candidate."""
    done = [m for m in ms if m["event_date"] <= reference]
    tiers = [
        [m for m in done if m["competition"] == target["competition"] and m["season_label"] in baseline],
        [m for m in done if m["competition"] == target["competition"]],
    ]
    pool = next((t for t in tiers if len(t) >= minimum), done)
    pool = [m for m in pool if m["match_id"] != target["match_id"]] or done
    oldest = min(m["season"] for m in pool)
    num, den, used = np.zeros(window + 1), 0.0, 0
    for m in pool:
        mine = [d for d in daily if d[0] == m["match_id"]]
        final = max((d[3] for d in mine), default=0)
        if final <= 0:
            continue
        w = 1 + 0.45 * (m["venue"] == target["venue"]) + 0.25 * (m["competition"] == target["competition"]) + 0.35 * (m["event_category"] == target["event_category"])
        w += 0.15 * (m["day_of_week"] == target["day_of_week"]) + 0.35 * (m["opponent"] == target["opponent"])
        w += np.clip(0.35 - abs(m["opponent_strength"] - target["opponent_strength"]) / 300, 0, 0.35) + np.clip(0.15 - abs(m["round"] - target["round"]) / 50, 0, 0.15)
        w *= 1 + 0.04 * (m["season"] - oldest)
        share = np.zeros(window + 1)
        for _, left, sold, _ in mine:
            if 0 <= left <= window:
                share[left] += sold / final
        num, den, used = num + w * share, den + w, used + 1
    profile = np.clip(num / den, 0, None) if used else np.ones(window + 1)
    return (profile / profile.sum() if profile.sum() else np.full(window + 1, 1 / (window + 1))), used


def test_pace_against_brute_force(spark):
    rng = np.random.default_rng(7)
    ms, daily = [], []
    for i in range(40):
        season = int(rng.integers(2020, 2025))
        ms.append(dict(
            match_id=f"m{i}", season=season, season_label=f"{season}/{(season + 1) % 100}", competition=["BBL", "WBBL", "CUP"][min(int(rng.integers(0, 8)) // 3, 2)],
            venue=str(rng.choice(["a", "b", "c"])), opponent=str(rng.choice(["x", "y", "z"])), event_category=str(rng.choice(["standard", "family"])),
            day_of_week=str(rng.choice(["Friday", "Sunday"])), opponent_strength=int(rng.integers(0, 300)), round=int(rng.integers(1, 20)),
            event_date=D(season, 12, int(rng.integers(1, 28))),
        ))
        total = 0.0
        for left in sorted(rng.choice(60, 12, replace=False), reverse=True):
            sold = float(rng.integers(-3, 20)) if i != 5 else -1.0
            total += sold
            daily.append((f"m{i}", int(left), sold, total))
    # Two lone matches: one alone in its competition, one with nobody of its own before it.
    ms[0] |= {"competition": "SOLO"}
    frame = match_rows(spark, ms)
    d = spark.createDataFrame([(a, b, c, e, D(2024, 1, 1)) for a, b, c, e in daily], "match_id string, days_to_event int, daily_sales double, cumulative_sales double, date date")
    d = d.filter("days_to_event <> 0")
    daily = [x for x in daily if x[1] != 0]
    for baseline in (["2022/23", "2023/24"], ["2020/21"]):
        got = pace.pace_profiles(frame, frame, d, baseline, D(2024, 6, 1), pace.PaceSettings(40, 3)).toPandas()
        for m in ms:
            mine = got[got.match_id == m["match_id"]].sort_values("days_to_event")
            want, used = brute_pace(ms, daily, m, baseline, 40, D(2024, 6, 1))
            assert mine.historical_sample_size.iloc[0] == used, m
            np.testing.assert_allclose(mine.historical_daily_share.to_numpy(), want, atol=1e-9)
            assert mine.sort_values("days_to_event").historical_cumulative_share.iloc[0] == pytest.approx(1)


def test_quantiles_exact(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", float(v)) for v in np.round(rng.normal(0, 1000, 3000), 2)]
    rest = [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.integers(-5, 5, 200))]
    df = spark.createDataFrame([*hot, *rest, ("hot", None)], "k string, v double")
    for p in (0.0, 0.1, 0.5, 0.75, 1.0):
        got = {r.k: r["quantile"] for r in exact_quantile(df, "v", p, ["k"]).collect()}
        for k in got:
            assert got[k] == pytest.approx(np.quantile([v for kk, v in hot + rest if kk == k], p))
        assert exact_quantile(df, "v", p).first()[0] == pytest.approx(np.quantile([v for _, v in hot + rest], p))


def test_calendar(spark):
    rows = [("BBL_1", 2025, "2025/26", "BBL", "Home", o, "Oval", d, 9000) for o, d in (("A", D(2025, 12, 18)), ("B", D(2025, 12, 26)), ("C", D(2026, 2, 28)))]
    fx = spark.createDataFrame(rows, "fixture_id string, season int, season_label string, competition string, team string, opponent string, venue string, match_date date, capacity_total int")
    plan = calendar.CalendarPlan(2026, "2026/27", "Home")
    made = calendar.assumed_fixtures(fx, plan).collect()
    assert sorted(map(str, made)) == sorted(map(str, calendar.assumed_fixtures(fx, plan).collect()))
    bbl = sorted((r for r in made if r.competition == "BBL"), key=lambda r: r.match_date)
    assert [r.match_date for r in bbl] == [D(2026, 12, 17), D(2026, 12, 25), D(2026, 12, 31)]
    assert {r.opponent for r in bbl} == {"A", "B", "C"} and sum("NYE" in r.fixture_id for r in bbl) == 1
    assert sum(r.competition == "WBBL" for r in made) == 5


def test_projection_orders_groups(spark):
    season = lambda n, **c: {"season_label": "2025/26", "transaction_date": "2025-09-01", "tickets_sold": n, "paid_tickets_sold": n, **c}
    rows = tickets(spark, season(1000.0, price_type="Family", ticket_type="Family"), season(250.0, ticket_type="Adult"), {"season_label": "2026/27", "transaction_date": "2026-08-05", "ticket_type": "Family"})
    past = rows.filter("season_label = '2025/26'")
    total = {}
    for kind in ("Family", "Adult", "Nothing"):
        f = TicketFilter(competition="BBL", ticket_type=kind)
        curve = segment_projection(rows, past, f, "2026-08-01", "2026-12-31", 1000.0, "2026-08-10", "2026/27")
        total[kind] = projection_summary(curve, past, f, "2026-08-10").first()
        assert curve.agg(F.sum("forecast_expected_daily")).first()[0] == pytest.approx(total[kind].forecast_final_tickets)
    assert total["Family"].forecast_final_tickets == 1000 and total["Adult"].forecast_final_tickets == 250
    assert not total["Family"].fallback_used and total["Nothing"].fallback_used and "competition-level" in total["Nothing"].fallback_message
    assert total["Family"].actual_by_now == 100


def test_last_season_curve(spark):
    rows = tickets(spark, {"transaction_date": "2025-08-01", "tickets_sold": 30.0}, {"transaction_date": "2025-08-02", "tickets_sold": 45.0})
    curve = curves.fixture_history(rows, "f1", PAID_AND_COMPS, 5, "2026-08-01").orderBy("date").collect()
    assert curve[0].historic_comparison_daily == 30 and curve[-1].historic_comparison_cumulative == 75


def test_purchase_status_without_dates(spark):
    rows = tickets(spark).withColumn("transaction_date", F.lit(None).cast("timestamp_ntz"))
    assert {r.customer_purchase_status for r in cust.purchase_status(rows).collect()} == {"Unknown"}
    rows = tickets(spark, {}, {"season_label": "2026/27", "transaction_date": "2026-10-01"}, {"customer_id": "z"})
    rows = rows.withColumn("customer_id", F.when(F.col("customer_id") != "z", F.col("customer_id")))
    got = {(r.season_label, r.customer_id): r.customer_purchase_status for r in cust.purchase_status(rows).collect()}
    assert got == {("2025/26", "hist-1"): "New", ("2026/27", "hist-1"): "Returning", ("2025/26", None): "Returning"}


def test_match_keeps_rows_and_soft_needs_one(spark):
    fx = spark.createDataFrame(
        [("f1", "BBL", "2025/26", "A", "Oval", D(2025, 12, 1)), ("f2", "BBL", "2025/26", "B", "Oval", D(2025, 12, 2)), ("f3", "BBL", "2025/26", "B", "Oval", D(2025, 12, 9))],
        "fixture_id string, competition string, season_label string, opponent string, venue string, match_date date",
    )
    rows = tickets(spark, {"match_date": "2025-12-01"}, {"match_date": "2025-11-30"}, {"match_date": "2025-11-30"}).drop("fixture_id")
    rows = rows.withColumns({"venue": F.lit("oval "), "opponent": F.lit("A")})
    rows = rows.union(rows.limit(1).withColumns({"opponent": F.lit("b"), "match_date": F.lit(None).cast("date")}))
    got = sorted((str(r.fixture_id), r.fixture_match_score) for r in mt.match_tickets(rows, fx).collect())
    assert got == [("None", 0.0), ("f1", 0.72), ("f1", 0.72), ("f1", 1.0)]


def test_profile_examples_come_from_all_rows(spark):
    from boxline.operators.quality import profile_columns

    rows = [(n, None if n < 9000 else f"{n} tickets", "5" if n % 2 else " ") for n in range(1, 9011)]
    frame = spark.createDataFrame(rows, "source_row_number long, late string, number string")
    got = {r["column"]: r for r in profile_columns(frame).collect()}
    assert got["late"].example_values == "9000 tickets, 9001 tickets, 9002 tickets" and got["late"].non_blank == 11
    assert got["number"].example_values == "5, 5, 5" and got["number"].inferred_type == "number" and got["number"].blank == 4505
    unnumbered = {r["column"]: r for r in profile_columns(frame.drop("source_row_number")).collect()}
    assert unnumbered["late"].example_values == "9000 tickets, 9001 tickets, 9002 tickets"
    assert profile_columns(frame.where("late is null").select("late")).first().example_values == ""
