"""Reference SQL for curves, pace, targets, forecasts, features, planning and data quality."""

from __future__ import annotations

from boxline.plans.oracle import AS_AT, BASE, ORACLE, PLAN, entry, part, r6

# Model inputs, written out here on their own.
CATEGORICAL = (
    "opponent", "venue", "competition", "day_of_week", "event_category", "campaign_theme", "sales_window", "marketing_period",
)
NUMERIC = (
    "season", "round", "days_to_event", "days_on_sale", "sales_progress", "cumulative_sales", "daily_sales",
    "trailing_3_day_sales", "trailing_7_day_sales", "sales_acceleration", "opponent_strength", "historical_attendance",
    "ticket_price", "membership_base", "prior_season_performance", "weather_temp_c", "is_public_holiday", "is_campaign_burst",
    "membership_on_sale", "early_bird_active", "finals_contention", "school_holiday", "double_header", "event_month",
    "is_weekend_event", "days_since_early_bird_start",
)

START = "DATE '2024-08-01'"
LENGTH = 198  # days from 1 August 2024 to 15 February 2025
OFFSET = f"least(greatest(date_diff('day', make_date(season, 8, 1), CAST(transaction_date AS DATE)), 0), {LENGTH})"
SPINE = f"(SELECT CAST(unnest(range(0, {LENGTH + 1})) AS BIGINT) AS o)"

entry(
    "transaction_curve",
    f"""
SELECT date, {r6("v")} AS actual_daily, {r6("sum(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)")} AS actual_cumulative
FROM (SELECT CAST(transaction_date AS DATE) AS date, sum(tickets_sold) AS v FROM tx GROUP BY 1)""",
    "tx",
)
entry(
    "season_comparison",
    f"""
SELECT season_label, date, {r6("v")} AS daily_sales, {r6("sum(v) OVER (PARTITION BY season_label ORDER BY date ROWS UNBOUNDED PRECEDING)")} AS actual_cumulative,
  date_diff('day', min(date) OVER (PARTITION BY season_label), date) AS season_day
FROM (SELECT season_label, date, sum(daily_sales) AS v FROM dl JOIN mt USING (match_id) WHERE competition = 'BBL' AND season_label IN ({BASE}, '{PLAN}') GROUP BY 1, 2)""",
    "dl", "mt",
)
part(
    "hist",
    f"SELECT *, {OFFSET} AS o FROM tx WHERE season_label IN ({BASE})",
    "tx",
)


def aligned(name: str, daily: str) -> str:
    return f"""SELECT CAST({START} + CAST(o AS INTEGER) AS DATE) AS date, coalesce(v, 0) AS {name}_daily, sum(coalesce(v, 0)) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS {name}_cumulative
  FROM {SPINE} LEFT JOIN ({daily}) USING (o)"""


def both(name: str) -> str:
    return f"{r6(f'{name}_daily')} AS {name}_daily, {r6(f'{name}_cumulative')} AS {name}_cumulative"


_PAID = "SELECT season_label, o, sum(paid_tickets_sold) AS v FROM hist WHERE NOT is_comp IS NULL GROUP BY 1, 2"
entry(
    "aligned_history_curve",
    f"""
SELECT date, {both("historical")}, {both("last_season")}
FROM ({aligned("historical", f"SELECT o, avg(v) AS v FROM ({_PAID}) GROUP BY 1")}) JOIN ({aligned("last_season", f"SELECT o, v FROM ({_PAID}) WHERE season_label = '2023/24'")}) USING (date)""",
    "hist",
)
entry(
    "fixture_history_curve",
    f"""
SELECT date, {both("historic_comparison")} FROM ({aligned("historic_comparison", f"SELECT {OFFSET} AS o, sum(tickets_sold) AS v FROM tx WHERE fixture_id = '2023-7' GROUP BY 1")})""",
    "tx",
)
entry(
    "actual_curve_gapfill",
    f"""
SELECT date, {r6("v")} AS actual_daily, {r6("sum(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)")} AS actual_cumulative FROM (
  SELECT date, coalesce(v, 0) AS v FROM (
    SELECT CAST(unnest(range(min(CAST(transaction_date AS DATE)), max(CAST(transaction_date AS DATE)) + 1, INTERVAL 1 DAY)) AS DATE) AS date FROM tx WHERE fixture_id = '2024-7')
  LEFT JOIN (SELECT CAST(transaction_date AS DATE) AS date, sum(comp_tickets_sold) AS v FROM tx WHERE fixture_id = '2024-7' GROUP BY 1) USING (date))""",
    "tx",
)
entry(
    "tracking_chart",
    f"""
WITH a AS (SELECT CAST(transaction_date AS DATE) AS date, sum(tickets_sold) AS v FROM sn WHERE season_label = '{PLAN}' AND competition = 'BBL' GROUP BY 1),
s AS (SELECT CAST(unnest(range(min(date), max(date) + 1, INTERVAL 1 DAY)) AS DATE) AS date FROM a),
h AS ({aligned("historical", "SELECT o, avg(v) AS v FROM (SELECT season_label, o, sum(tickets_sold) AS v FROM hist WHERE competition = 'BBL' GROUP BY 1, 2) GROUP BY 1")})
SELECT date, {r6("coalesce(v, 0)")} AS actual_daily, {r6("sum(coalesce(v, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)")} AS actual_cumulative,
  {r6("coalesce(historical_daily, 0)")} AS historical_daily,
  {r6("coalesce(last_value(historical_cumulative IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0)")} AS historical_cumulative
FROM s LEFT JOIN a USING (date) LEFT JOIN h USING (date)""",
    "sn", "hist",
)

# --- pace: every target against every candidate, spelled out ------------------------------------------

part("pool", "SELECT mt.* FROM mt WHERE match_id IN (SELECT match_id FROM done)", "mt", "done")
part(
    "weights",
    f"""
  SELECT t, c, raw * (1 + 0.04 * (season - min(season) OVER (PARTITION BY t))) AS w, n FROM (
    SELECT t.match_id AS t, c.match_id AS c, c.season, count(*) OVER (PARTITION BY t.match_id) AS n,
      1 + CASE WHEN c.venue = t.venue THEN 0.45 ELSE 0 END + CASE WHEN c.competition = t.competition THEN 0.25 ELSE 0 END
        + CASE WHEN c.event_category = t.event_category THEN 0.35 ELSE 0 END + CASE WHEN c.day_of_week = t.day_of_week THEN 0.15 ELSE 0 END
        + CASE WHEN c.opponent = t.opponent THEN 0.35 ELSE 0 END + least(greatest(0.35 - abs(c.opponent_strength - t.opponent_strength) / 300.0, 0), 0.35)
        + least(greatest(0.15 - abs(c.round - t.round) / 50.0, 0), 0.15) AS raw
    FROM (
      SELECT p.*, CASE WHEN (SELECT count(*) FROM pool q WHERE q.competition = p.competition AND q.season_label IN ({BASE})) >= 3 THEN 0
        WHEN (SELECT count(*) FROM pool q WHERE q.competition = p.competition) >= 3 THEN 1 ELSE 2 END AS tier FROM plan p) t
    JOIN pool c ON (tier = 2 OR c.competition = t.competition) AND (tier > 0 OR c.season_label IN ({BASE})) AND c.match_id <> t.match_id)""",
    "plan", "pool",
)
part("days", "SELECT CAST(unnest(range(0, 151)) AS BIGINT) AS days_to_event")
part("shares", "SELECT match_id, days_to_event, sum(daily_sales) / max(final_sales) AS s FROM dl JOIN fin USING (match_id) WHERE final_sales > 0 AND days_to_event BETWEEN 0 AND 150 GROUP BY 1, 2", "dl", "fin")
part(
    "pace",
    """
  SELECT match_id, days_to_event, CASE WHEN total > 0 THEN s / total ELSE 1.0 / 151 END AS share, used, n FROM (
    SELECT *, sum(s) OVER (PARTITION BY match_id) AS total FROM (
      SELECT match_id, days_to_event, used, n, greatest(coalesce(ws, 0) / whole, 0) AS s FROM (
        SELECT t AS match_id, sum(w) AS whole, count(*) AS used, any_value(n) AS n FROM weights JOIN fin ON fin.match_id = c WHERE final_sales > 0 GROUP BY 1) CROSS JOIN days
      LEFT JOIN (SELECT t AS match_id, days_to_event, sum(w * s) AS ws FROM weights JOIN shares ON shares.match_id = c GROUP BY 1, 2) USING (match_id, days_to_event)))""",
    "weights", "fin", "days", "shares",
)
entry(
    "pace_profile",
    f"""
SELECT match_id, days_to_event, {r6("share")} AS historical_daily_share, {r6("sum(share) OVER (PARTITION BY match_id ORDER BY days_to_event DESC ROWS UNBOUNDED PRECEDING)")} AS historical_cumulative_share,
  used AS historical_sample_size, n AS candidate_count FROM pace""",
    "pace",
)
entry(
    "comparable_matches",
    f"""
SELECT row_number() OVER (ORDER BY w DESC, c) AS rank, c AS match_id, season_label, opponent, {r6("w / sum(w) OVER ()")} AS similarity, {r6("final_sales")} AS final_sales
FROM (SELECT * FROM weights WHERE t = '2024-18') JOIN mt ON mt.match_id = c LEFT JOIN fin ON fin.match_id = c""",
    "weights", "mt", "fin",
)
entry(
    "nearest_historical_fixture",
    f"""
SELECT row_number() OVER (ORDER BY abs(dayofyear(match_date) - dayofyear(DATE '2024-12-31')), season_label, match_date, fixture_id) AS rank, fixture_id, competition || ' v ' || opponent || ' | ' || strftime(match_date, '%d %b %Y') || ' | ' || season_label AS label, abs(dayofyear(match_date) - dayofyear(DATE '2024-12-31')) AS day_gap
FROM fx WHERE season_label <> '{PLAN}'""",
    "fx",
)
entry(
    "last_season_equivalent",
    f"""
SELECT fixture_id FROM fx WHERE season_label = (SELECT max(season_label) FROM fx WHERE season_label <> '{PLAN}') AND competition = 'BBL'
ORDER BY opponent = 'NATION_12' DESC, abs(dayofyear(match_date) - dayofyear(DATE '2024-12-20')), match_date LIMIT 1""",
    "fx",
)

# --- targets and forecasts ----------------------------------------------------------------------------

part(
    "cal",
    """
  SELECT p.match_id, CAST(d AS DATE) AS date, date_diff('day', CAST(d AS DATE), event_date) AS days_to_event, coalesce(share, 0) AS hs, p.* EXCLUDE (match_id)
  FROM plan p, unnest(range(least(CAST(on_sale_date AS DATE), event_date), event_date + 1, INTERVAL 1 DAY)) AS u(d)
  LEFT JOIN pace ON pace.match_id = p.match_id AND pace.days_to_event = date_diff('day', CAST(d AS DATE), event_date)""",
    "plan", "pace",
)


def ramp(start: str, end: str, low: float, lift: float) -> str:
    inside = f"CASE WHEN date BETWEEN {start} AND {end} THEN 1 ELSE 0 END"
    n = f"sum({inside}) OVER (PARTITION BY match_id)"
    k = f"sum({inside}) OVER (PARTITION BY match_id ORDER BY date ROWS UNBOUNDED PRECEDING)"
    step = f"CASE WHEN {n} > 1 THEN ({k} - 1) / ({n} - 1) ELSE 0 END"
    return f"CASE WHEN date BETWEEN {start} AND {end} THEN 1 + {lift} * ({low} + {1 - low} * ({step})) ELSE 1 END"


part(
    "shape",
    f"""
  SELECT *, w / sum(w) OVER (PARTITION BY match_id) AS share FROM (
    SELECT *, greatest(avg(hs) OVER (PARTITION BY match_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0.000001)
      * {ramp("early_bird_start", "early_bird_end", 0.35, 0.16)} * {ramp("member_presale_start", "member_presale_end", 0.40, 0.12)} * {ramp("marketing_start", "marketing_end", 0.45, 0.18)}
      * CASE WHEN abs(date_diff('day', campaign_burst_date, date)) <= 2 THEN 1.28 ELSE 1 END * CASE WHEN days_to_event <= 7 THEN 1 + 0.20 * (8 - days_to_event) / 8 ELSE 1 END
      * CASE days_to_event WHEN 1 THEN 1.12 WHEN 0 THEN 1.24 ELSE 1 END AS w FROM cal)""",
    "cal",
)


def target_part(name: str, total: str) -> None:
    part(
        name,
        f"""
  SELECT match_id, date, days_to_event, hs, share, share * ({total}) AS target_daily, ({total}) AS target_total,
    sum(share * ({total})) OVER (PARTITION BY match_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS target_cumulative FROM shape""",
        "shape",
    )


target_part("tc", "baseline_target * 1.1")
target_part("mc", "CASE WHEN manual_target <> 0 THEN manual_target ELSE baseline_target END")
entry(
    "target_curve",
    f"""
SELECT match_id, date, days_to_event, {r6("hs")} AS historical_daily_share, {r6("share")} AS adjusted_daily_share, {r6("target_daily")} AS target_daily,
  {r6("target_cumulative")} AS target_cumulative, {r6("target_total")} AS target_total FROM tc""",
    "tc",
)
part("latest", "SELECT match_id, latest_date, latest_sales FROM typical", "typical")
part(
    "rq",
    """
  SELECT match_id, date, target_daily, target_cumulative,
    CASE WHEN latest_date IS NULL OR max(date) OVER (PARTITION BY match_id) <= latest_date THEN target_daily
         WHEN date > latest_date THEN share / sum(CASE WHEN date > latest_date THEN share END) OVER (PARTITION BY match_id) * greatest(target_total - latest_sales, 0) ELSE 0 END AS required_daily
  FROM tc LEFT JOIN latest USING (match_id)""",
    "tc", "latest",
)
entry("required_daily", f"SELECT match_id, date, {r6('target_daily')} AS target_daily, {r6('required_daily')} AS required_daily FROM rq", "rq")


def line(name: str) -> str:
    return (
        f"coalesce(last_value(CASE WHEN future THEN cur + so_far * greatest({name} - cur, 0) ELSE actual_cumulative END IGNORE NULLS) "
        f"OVER (PARTITION BY match_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS f_{name}"
    )


part(
    "fc",
    f"""
  SELECT *, f_expected - lag(f_expected, 1, 0) OVER (PARTITION BY match_id ORDER BY date) AS step, f_expected * 1.1 AS uplift FROM (
    SELECT match_id, date, days_to_event, hs, actual_cumulative, {line("expected")}, {line("lower")}, {line("upper")} FROM (
      SELECT *, sum(CASE WHEN weight > 0 THEN hs / weight ELSE 1.0 / n END) OVER (PARTITION BY match_id, future ORDER BY date ROWS UNBOUNDED PRECEDING) AS so_far FROM (
        SELECT *, sum(hs) OVER (PARTITION BY match_id, future) AS weight, count(*) OVER (PARTITION BY match_id, future) AS n FROM (
          SELECT cal.match_id, cal.date, cal.days_to_event, hs, actual_cumulative, expected, lower, upper, latest_sales AS cur, coalesce(cal.date > latest_date, true) AS future
          FROM cal JOIN typical USING (match_id) LEFT JOIN (SELECT match_id, date, max(cumulative_sales) AS actual_cumulative FROM dl GROUP BY 1, 2) USING (match_id, date)))))""",
    "cal", "typical", "dl",
)
entry(
    "forecast_curve",
    f"""
SELECT match_id, date, days_to_event, {r6("hs")} AS historical_daily_share, {r6("actual_cumulative")} AS actual_cumulative, {r6("f_expected")} AS forecast_expected_cumulative,
  {r6("f_lower")} AS forecast_lower_cumulative, {r6("f_upper")} AS forecast_upper_cumulative, {r6("step")} AS expected_forecast_daily, {r6("uplift")} AS uplift_10_cumulative FROM fc""",
    "fc",
)
part("ad", "SELECT match_id, date, sum(daily_sales) AS actual_daily FROM dl WHERE match_id IN (SELECT match_id FROM plan) GROUP BY 1, 2", "dl", "plan")
entry(
    "match_chart",
    f"""
SELECT match_id, date, {r6("f_expected")} AS forecast_expected_cumulative, {r6("rq.target_cumulative")} AS target_cumulative, {r6("required_daily")} AS required_daily,
  {r6("mc.target_cumulative / arg_max(mc.target_cumulative, date) OVER (PARTITION BY match_id) * 9000")} AS manual_target_cumulative, {r6("coalesce(actual_daily, 0)")} AS actual_daily
FROM fc LEFT JOIN rq USING (match_id, date) LEFT JOIN mc USING (match_id, date) LEFT JOIN ad USING (match_id, date)""",
    "fc", "rq", "mc", "ad",
)
_SEASON = ("actual_daily", "target_daily", "required_daily", "forecast_expected_daily", "forecast_lower_daily", "forecast_upper_daily", "uplift_10_daily", "manual_target_daily")


def rollup_part(name: str, ids: str) -> None:
    step = lambda c: f"greatest(coalesce({c} - lag({c}) OVER (PARTITION BY match_id ORDER BY date), {c}), 0)"
    part(
        name,
        f"""
  SELECT *, {", ".join(f"sum({c}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c.replace('_daily', '_cumulative')}" for c in _SEASON)} FROM (
    SELECT date, {", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _SEASON)} FROM (
      SELECT match_id, date, actual_daily, rq.target_daily, required_daily, mc.target_daily AS manual_target_daily, {step("f_expected")} AS forecast_expected_daily, {step("f_lower")} AS forecast_lower_daily,
        {step("f_upper")} AS forecast_upper_daily, {step("uplift")} AS uplift_10_daily
      FROM rq FULL JOIN fc USING (match_id, date) FULL JOIN mc USING (match_id, date) FULL JOIN ad USING (match_id, date) WHERE match_id IN ({ids})) GROUP BY 1)""",
        "rq", "fc", "mc", "ad", "plan",
    )


rollup_part("roll", "SELECT match_id FROM plan WHERE round <= 10")
rollup_part("roll_all", "SELECT match_id FROM plan")
_ALL = [x for c in _SEASON for x in (c, c.replace("_daily", "_cumulative"))]
entry("season_rollup", f"SELECT date, {', '.join(f'{r6(c)} AS {c}' for c in _ALL)} FROM roll", "roll")
entry(
    "scenario_summary",
    f"""
WITH e AS (SELECT * FROM roll_all ORDER BY date DESC LIMIT 1)
SELECT 'ML expected forecast' AS scenario, {r6("forecast_expected_cumulative")} AS projected_finish, {r6("forecast_expected_cumulative - target_cumulative")} AS gap_to_plan FROM e
UNION ALL SELECT '10% uplift target', {r6("uplift_10_cumulative")}, {r6("uplift_10_cumulative - target_cumulative")} FROM e
UNION ALL SELECT 'Manual target', {r6("manual_target_cumulative")}, {r6("manual_target_cumulative - target_cumulative")} FROM e""",
    "roll_all",
)

# --- projection -----------------------------------------------------------------------------------------


def projection_part(name: str, src: str, test: str, value: str, base_test: str) -> None:
    left = f"greatest({LENGTH} - o, 0)"
    part(
        name,
        f"""
  SELECT CAST({START} + CAST(o AS INTEGER) AS DATE) AS date, o, w / sum(w) OVER () AS share, final, per_ticket, final / base * 100 AS pct FROM (
    SELECT o, avg(greatest(v, 0)) OVER (ORDER BY o ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) * (1 + 0.10 * CASE WHEN {left} BETWEEN 7 AND 21 THEN (21 - {left}) / 14 ELSE 0 END
        + 0.18 * CASE WHEN {left} <= 7 THEN (8 - {left}) / 8 ELSE 0 END + CASE {left} WHEN 0 THEN 0.35 WHEN 1 THEN 0.18 ELSE 0 END) AS w FROM (
      SELECT o, coalesce(v, 0) AS v FROM {SPINE} LEFT JOIN (SELECT o, sum({value}) AS v FROM {src} WHERE {test} GROUP BY 1) USING (o))),
    (SELECT sum({value}) / count(DISTINCT season_label) AS final, CAST(sum(gross_revenue) AS DOUBLE) / sum({value}) AS per_ticket FROM {src} WHERE {test}),
    (SELECT avg(v) AS base FROM (SELECT season_label, sum({value}) AS v FROM {src} WHERE {base_test} GROUP BY 1))""",
        src,
    )


_FAMILY = "competition = 'BBL' AND ticket_class = 'Family Zone' AND purchaser_family_flag AND NOT is_comp AND NOT is_refund"
projection_part("pj", "hist", _FAMILY, "paid_tickets_sold", "competition = 'BBL'")
entry(
    "segment_projection",
    f"""
WITH a AS (SELECT CAST(transaction_date AS DATE) AS date, sum(paid_tickets_sold) AS v FROM sn WHERE season_label = '{PLAN}' AND {_FAMILY} GROUP BY 1),
c AS (SELECT pj.*, share * final AS fd, share * 50000 * pct / 100 AS td, 50000 * pct / 100 AS goal, coalesce(v, 0) AS ad FROM pj LEFT JOIN a USING (date))
SELECT date, CASE WHEN o <= 31 THEN 'early-sales' WHEN o <= 75 THEN 'general-sale' WHEN o <= 120 THEN 'campaign-window' ELSE 'match-week' END AS sales_window, {r6("fd")} AS forecast_expected_daily,
  {r6("td")} AS target_daily, {r6("fd * per_ticket")} AS forecast_revenue, {r6("final")} AS forecast_final_tickets, {r6("pct")} AS contribution_pct, CAST(0 AS BIGINT) AS fallback_level,
  {r6("sum(fd) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)")} AS forecast_expected_cumulative, {r6("sum(td) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)")} AS target_cumulative,
  {r6("ad")} AS actual_daily, {r6("sum(ad) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)")} AS actual_cumulative, {r6("(SELECT coalesce(sum(v), 0) FROM a)")} AS actual_by_now,
  {r6(f"CASE WHEN date > DATE '{AS_AT}' THEN greatest(goal - sum(CASE WHEN date <= DATE '{AS_AT}' THEN ad ELSE 0 END) OVER (), 0) / sum(CASE WHEN date > DATE '{AS_AT}' THEN 1 ELSE 0 END) OVER () ELSE 0 END")} AS required_daily
FROM c""",
    "pj", "sn",
)
# The exact selection, and the one without demographics, may be too small: see the level.
part(
    "hist_dx",
    f"SELECT *, {OFFSET} AS o FROM dx WHERE season_label IN ({BASE})",
    "dx",
)
_LEVELS = (
    "competition = 'WBBL' AND ticket_class = 'Gold' AND ticket_type = 'Brand#0' AND purchaser_family_flag AND age_band_filter = '18-30'",
    "competition = 'WBBL' AND ticket_class = 'Gold' AND ticket_type = 'Brand#0' AND purchaser_family_flag",
    "competition = 'WBBL' AND ticket_class = 'Gold' AND ticket_type = 'Brand#0'",
    "competition = 'WBBL'",
    "true",
)
_WHY = (
    ("selected filters", "Brand#0 + Gold + 18-30 + Families"),
    ("product-level fallback", "demographic filters removed"),
    ("ticket product fallback", "demographic and audience filters removed"),
    ("competition-level fallback", "ticket product, audience, and demographic filters removed"),
    ("all-sales fallback", "all competitions used"),
)
part(
    "lv",
    "SELECT CASE " + " ".join(f"WHEN coalesce(sum(CASE WHEN {t} THEN tickets_sold END), 0) >= 100 THEN {i}" for i, t in enumerate(_LEVELS[:4])) + " ELSE 4 END AS lvl FROM hist_dx",
    "hist_dx",
)
part(
    "hist_lv",
    "SELECT h.* FROM hist_dx h, lv WHERE CASE lvl " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_LEVELS)) + " END",
    "hist_dx", "lv",
)
part("base_w", "SELECT avg(v) AS b FROM (SELECT season_label, sum(tickets_sold) AS v FROM hist_dx WHERE competition = 'WBBL' GROUP BY 1)", "hist_dx")
projection_part("pf", "hist_lv", "true", "tickets_sold", "true")
_LVL = "(SELECT lvl FROM lv)"
_SAMPLE = "(SELECT coalesce(sum(tickets_sold), 0) FROM hist_lv)"
entry(
    "projection_fallback",
    f"""
WITH c AS (SELECT *, share * final AS fd FROM pf)
SELECT {r6("max(final)")} AS forecast_final_tickets, {r6("sum(fd * per_ticket)")} AS forecast_final_revenue, {r6(f"sum(CASE WHEN date <= DATE '{AS_AT}' THEN fd ELSE 0 END)")} AS expected_by_now,
  {r6(f"coalesce((SELECT sum(tickets_sold) FROM dx WHERE season_label = '{PLAN}' AND transaction_date <= TIMESTAMP '{AS_AT}' AND {_LEVELS[0]}), 0)")} AS actual_by_now,
  {r6("max(final) / (SELECT b FROM base_w) * 100")} AS contribution_pct, {r6(_SAMPLE)} AS sample_size, {_LVL} > 0 OR {_SAMPLE} < 100 AS fallback_used,
  'Low historical sample for the exact selected group. Using ' || CASE {_LVL} {" ".join(f"WHEN {i} THEN '{a} ({b})'" for i, (a, b) in enumerate(_WHY))} END || '. Historical sample is ' ||
    format('{{:,}}', CAST({_SAMPLE} AS BIGINT)) || ' selected tickets; minimum is 100.' AS fallback_message FROM c""",
    "pf", "dx", "lv", "hist_lv", "base_w",
)
entry(
    "target_breakdown",
    f"""
SELECT date, {", ".join(f"{r6(f'share * final * {k}')} AS {n}_daily, {r6(f'sum(share * final * {k}) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)')} AS {n}_cumulative"
    for n, k in (("forecast_expected", "1"), ("forecast_plus_10", "1.1"), ("base", "(60000 * pct / 100 / final)"), ("stretch", "(75000 * pct / 100 / final)")))} FROM pj""",
    "pj",
)

ORACLE["visible_lines"] = f"SELECT date, forecast_expected_cumulative, stretch_cumulative FROM ({ORACLE['target_breakdown']})"

# --- features and planning ------------------------------------------------------------------------------

_ORDER = "PARTITION BY match_id ORDER BY date, sales_window"
part(
    "feat",
    f"""
  SELECT *, coalesce(trailing_3_day_sales - lag(trailing_3_day_sales) OVER ({_ORDER}), 0) AS sales_acceleration FROM (
    SELECT dl.*, mt.* EXCLUDE (match_id, school_holiday), greatest(date_floor_days(on_sale_date, date), 0) AS days_on_sale, date_floor_days(early_bird_start, date) AS days_since_early_bird_start,
      least(greatest(greatest(date_floor_days(on_sale_date, date), 0) / CASE date_floor_days(on_sale_date, event_date) WHEN 0 THEN 1 ELSE date_floor_days(on_sale_date, event_date) END, 0), 1) AS sales_progress,
      month(event_date) AS event_month, CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend_event,
      avg(daily_sales) OVER ({_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trailing_3_day_sales, avg(daily_sales) OVER ({_ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_7_day_sales,
      max(cumulative_sales) OVER (PARTITION BY match_id) AS final_sales, 0 AS membership_base, 0 AS prior_season_performance, 0 AS finals_contention, 0 AS double_header
    FROM dl LEFT JOIN mt USING (match_id))""".replace("date_floor_days(on_sale_date, date)", "CAST(floor(date_diff('microsecond', on_sale_date, CAST(date AS TIMESTAMP)) / 86400000000.0) AS BIGINT)")
    .replace("date_floor_days(early_bird_start, date)", "CAST(floor(date_diff('microsecond', early_bird_start, CAST(date AS TIMESTAMP)) / 86400000000.0) AS BIGINT)")
    .replace("date_floor_days(on_sale_date, event_date)", "CAST(floor(date_diff('microsecond', on_sale_date, CAST(event_date AS TIMESTAMP)) / 86400000000.0) AS BIGINT)"),
    "dl", "mt",
)
entry(
    "training_snapshots",
    f"""
SELECT match_id, date, {", ".join(f"{r6(f'coalesce({c}, 0)')} AS {c}" for c in NUMERIC)}, {", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATEGORICAL)}, {r6("final_sales")} AS final_sales,
  {r6("cumulative_sales / final_sales")} AS cumulative_share_of_final FROM feat WHERE final_sales > 0 AND match_id IN (SELECT match_id FROM done)""",
    "feat", "done",
)
entry(
    "latest_snapshots",
    f"""
SELECT p.match_id, coalesce(f.date, CAST(p.on_sale_date AS DATE)) AS date,
  {r6("coalesce(f.days_to_event, floor(date_diff('microsecond', p.on_sale_date, CAST(p.event_date AS TIMESTAMP)) / 86400000000.0))")} AS days_to_event, {r6("coalesce(f.days_on_sale, 0)")} AS days_on_sale,
  {r6("coalesce(f.cumulative_sales, 0)")} AS cumulative_sales, {r6("coalesce(f.trailing_7_day_sales, 0)")} AS trailing_7_day_sales, coalesce(f.sales_window, 'early-bird') AS sales_window,
  {r6("CASE WHEN p.day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END")} AS is_weekend_event
FROM plan p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY date DESC, sales_window DESC) AS rn FROM feat) f ON f.match_id = p.match_id AND rn = 1""",
    "plan", "feat",
)
part(
    "ft",
    """
  SELECT match_id AS fixture_id, fixture_label AS fixture, competition, event_date AS date, opponent, CASE WHEN fixture_status = 'assumed' THEN 'Assumed' ELSE 'Historical' END AS status,
    CAST(round_even(expected, 0) AS BIGINT) AS forecasted_sales, CAST(round_even(expected * 1.1, 0) AS BIGINT) AS forecast_10pct_uplift FROM plan JOIN typical USING (match_id)""",
    "plan", "typical",
)
entry("fixture_forecast_table", f"SELECT * FROM ft WHERE date > DATE '{AS_AT}'", "ft")
part(
    "fut",
    """
  SELECT *, CASE WHEN competition = 'BBL' AND number = least(3, n) THEN DATE '2025-12-31'
    ELSE rolled + CAST(((wd - (dayofweek(rolled) + 6) % 7 + 3 + 7) % 7) - 3 AS INTEGER) END AS d FROM (
    SELECT *, make_date(CASE WHEN month(match_date) >= 7 THEN 2025 ELSE 2026 END, month(match_date), CASE WHEN month(match_date) = 2 THEN least(day(match_date), 28) ELSE day(match_date) END) AS rolled,
      (dayofweek(match_date) + 6) % 7 AS wd, row_number() OVER (PARTITION BY competition ORDER BY match_date, fixture_id) AS number, count(*) OVER (PARTITION BY competition) AS n
    FROM fx WHERE season = (SELECT max(season) FROM fx f2 WHERE f2.competition = fx.competition))""",
    "fx",
)
entry(
    "future_calendar",
    f"""
SELECT CASE WHEN ny THEN competition || '_2025_NYE_ASSUMED' ELSE competition || '_2025_ASSUMED_' || lpad(CAST(number AS VARCHAR), 2, '0') END AS fixture_id, '2025/26' AS season_label, competition, venue,
  d AS match_date, dayname(d) AS day_of_week,
  {r6("coalesce(capacity_total, NULL)")} AS capacity_total, 'assumed' AS fixture_status,
  CASE WHEN ny THEN 'Guaranteed/assumed NYE fixture generated from historical fixture pattern.'
    ELSE 'Assumed fixture generated from historical fixture pattern. Replace once official fixture is available.' END AS notes
FROM (SELECT *, competition = 'BBL' AND strftime(d, '%m-%d') = '12-31' AS ny FROM fut)""",
    "fut",
)
_BASE_TEXT = "CASE WHEN round % 7 = 0 THEN 'abc' WHEN round % 5 = 0 THEN '-5' ELSE format('{:,}', CAST(baseline_target AS BIGINT)) END"
_STRETCH_TEXT = "CASE WHEN round % 4 = 0 THEN '$10' ELSE '$' || format('{:,}', CAST(manual_target AS BIGINT)) END"
part(
    "dr",
    f"""
  SELECT match_id AS fixture_id, venue, season_label, {_BASE_TEXT} AS base_target, {_STRETCH_TEXT} AS stretch_target,
    CASE WHEN round % 7 = 0 THEN NULL WHEN round % 5 = 0 THEN -5.0 ELSE baseline_target END AS b, CASE WHEN round % 4 = 0 THEN 10.0 ELSE manual_target END AS s FROM mt""",
    "mt",
)
part(
    "sv",
    """
  SELECT fixture_id, CASE WHEN venue = 'EUROPE Arena' THEN 1000.0 ELSE coalesce(b, 0) END AS sb, s AS ss FROM dr WHERE venue NOT IN ('AFRICA Arena', 'ASIA Arena')""",
    "dr",
)
entry(
    "target_validation",
    """
SELECT fixture_id AS fixture, base_target, stretch_target, concat_ws('; ', CASE WHEN b IS NULL THEN 'Base target must be numeric.' WHEN b < 0 THEN 'Base target must be non-negative.' END,
  CASE WHEN s < b THEN 'Stretch target should be greater than or equal to the base target.' END) AS issue FROM dr WHERE b IS NULL OR b < 0 OR s < b""",
    "dr",
)
entry(
    "target_status",
    """
SELECT fixture_id, base_target, stretch_target, CASE WHEN sb IS NULL THEN 'Missing' WHEN abs(sb - b) <= 0.01 AND abs(ss - s) <= 0.01 THEN 'Saved' ELSE 'Draft / unsaved' END AS target_status
FROM dr LEFT JOIN sv USING (fixture_id)""",
    "dr", "sv",
)
entry(
    "target_totals",
    f"""
SELECT {r6("CASE WHEN missing = 0 THEN b END")} AS base_target, {r6("CASE WHEN missing = 0 THEN s END")} AS stretch_target, missing, scope FROM (
  SELECT 'all' AS scope, sum(sb) AS b, sum(ss) AS s, count(*) FILTER (sb IS NULL) AS missing FROM plan LEFT JOIN sv ON match_id = fixture_id
  UNION ALL SELECT 'america', sum(sb), sum(ss), count(*) FILTER (sb IS NULL) FROM plan LEFT JOIN sv ON match_id = fixture_id WHERE venue = 'AMERICA Arena')""",
    "plan", "sv",
)
entry(
    "missing_target_labels",
    """
SELECT match_id, competition || ' | M' || round || ' | v ' || opponent || ' | ' || strftime(event_date, '%d %b %Y') AS label
FROM plan LEFT JOIN sv ON match_id = fixture_id WHERE sv.fixture_id IS NULL""",
    "plan", "sv",
)
entry("forest_invariants", "SELECT match_id, true AS expected_covers_sold, true AS lower_covers_sold, true AS upper_covers_expected, true AS upper_covers_lower FROM plan", "plan")
entry("model_forecast_table", "SELECT fixture_id, fixture, competition, date, opponent, status, true AS covers_sold, true AS uplift_of_ten_percent FROM ft", "ft")
entry("importance_invariants", "SELECT CAST(1 AS DOUBLE) AS total, true AS ranked, true AS not_negative FROM (SELECT count(*) AS n FROM plan) WHERE n > 0", "plan")
entry(
    "target_drafts",
    f"""
SELECT fixture_id, competition, date, opponent, status, forecasted_sales, forecast_10pct_uplift, {r6("sb")} AS saved_base_target, {r6("ss")} AS saved_stretch_target,
  CAST(CAST(round_even(coalesce(sb, forecasted_sales), 0) AS BIGINT) AS VARCHAR) AS base_target, CAST(CAST(round_even(coalesce(ss, forecast_10pct_uplift), 0) AS BIGINT) AS VARCHAR) AS stretch_target,
  CASE WHEN sb IS NULL THEN 'Missing target' ELSE 'Saved targets' END AS target_state FROM ft LEFT JOIN sv USING (fixture_id)""",
    "ft", "sv",
)

# --- data quality ---------------------------------------------------------------------------------------

_MONEY = "CASE WHEN gross_revenue < 0 THEN '(' || format('{:,.4f}', -gross_revenue::DOUBLE) || ')' ELSE '$' || format('{:,.4f}', gross_revenue::DOUBLE) END"
_COLUMNS = {
    "txn_id": ("transaction_id", "text"), "order_number": ("order_id", "number"), "gigya_uid": ("customer_id", "text"), "competition": ("competition", "text"),
    "event_name": ("fixture_name || ' - ' || strftime(match_date, '%-d/%-m/%Y')", "text"), "opposition": ("opponent", "text"), "stadium": ("venue", "text"),
    "season_name": ("CASE WHEN price_type = 'Adult' THEN replace(season_label, '/', '-') END", "text"),
    "transaction_timestamp": ("strftime(transaction_date, '%-d/%-m/%Y %-H:%M')", "date"), "quantity": ("CAST(tickets_sold AS INTEGER)::VARCHAR", "number"),
    "total_price": (_MONEY, "number"), "ticket_category": ("ticket_type", "text"), "price_category": ("ticket_class", "text"), "price_code": ("price_type", "text"),
    "ticket_status": ("CASE WHEN is_refund THEN 'REFUNDED' WHEN is_comp THEN 'Complimentary' ELSE 'Sold' END", "text"), "channel": ("sales_channel", "text"),
    "marketing": ("CASE WHEN marketing_opt_in THEN 'Subscribed' ELSE 'opt out' END", "text"), "has_children": ("CASE WHEN purchaser_family_flag THEN 'Y' ELSE 'N' END", "boolean"),
    "post_code": ("purchaser_postcode", "number"),
}
entry(
    "column_profile",
    "WITH numbered AS (SELECT *, CAST(order_id AS BIGINT) * 8 + CAST(split_part(transaction_id, '-', 2) AS BIGINT) AS place FROM tx)\n"
    + "\nUNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count({c}) AS non_blank, count(*) - count({c}) AS blank, "
        f"coalesce(array_to_string(list_transform(min({{'p': place, 'v': {c}}}, 3) FILTER ({c} IS NOT NULL), lambda e: left(e.v, 48)), ', '), '') AS example_values, "
        f"'{k}' AS inferred_type FROM numbered"
        for n, (c, k) in _COLUMNS.items()
    ),
    "tx",
)
entry(
    "load_metrics",
    f"""
SELECT count(*) AS ticket_rows, {r6("sum(paid_tickets_sold)")} AS paid_ticket_count, {r6("sum(comp_tickets_sold)")} AS comp_ticket_count, count(*) FILTER (is_refund) AS refund_count,
  {r6("sum(gross_revenue)")} AS gross_revenue, {r6("sum(gross_revenue)")} AS net_revenue, {r6("count(fixture_id) / count(*)")} AS fixture_join_rate,
  strftime(min(transaction_date), '%Y-%m-%d') || ' to ' || strftime(max(transaction_date), '%Y-%m-%d') AS date_range,
  (SELECT string_agg(DISTINCT competition, ', ' ORDER BY competition) FROM tx) AS competitions, (SELECT string_agg(DISTINCT season_label, ', ' ORDER BY season_label) FROM tx) AS seasons,
  (SELECT count(*) FROM fx) AS fixture_rows, (SELECT count(*) FROM cu) AS customer_rows, count(DISTINCT customer_id) AS unique_customers,
  {r6("count(*) FILTER (customer_id IN (SELECT customer_id FROM cu WHERE has_customer_record)) / count(customer_id)")} AS customer_join_rate FROM tx""",
    "tx", "fx", "cu",
)
entry(
    "validation_warnings",
    """
WITH b AS (SELECT *, CASE WHEN price_type <> 'Group' THEN fixture_id END AS fid FROM tx), r AS (SELECT count(fid) / count(*) AS rate, avg(CASE WHEN fid IS NULL THEN 1 ELSE 0 END) AS gone FROM b)
SELECT 'warning' AS severity, 'dates' AS area, 'More than 5% of ticket rows have no match date. Fixture matching may be weaker.' AS message FROM r WHERE gone > 0.05
UNION ALL SELECT 'warning', 'fixtures', 'Fixture join rate is ' || CAST(round_even(rate * 100, 0) AS INTEGER) || '%. Some sales may be excluded from fixture-level forecasting.' FROM r WHERE rate < 0.85
UNION ALL SELECT 'warning', 'fixture matching', 'Fixture join rate is ' || CAST(round_even(rate * 100, 0) AS INTEGER) || '%. Check event names, dates, opponents, and venue mappings.' FROM r WHERE rate < 0.85
UNION ALL SELECT 'info', 'duplicates', 'Possible duplicate transaction/order/customer rows detected. This may be normal if the export is seat-level.' FROM (
  SELECT 1 - count(*) / sum(n) AS copies FROM (SELECT transaction_id, order_id, fid, customer_id, count(*) AS n FROM b GROUP BY 1, 2, 3, 4)) WHERE copies > 0.02""",
    "tx",
)
ORACLE["validation_warnings_bucketed"] = ORACLE["validation_warnings"]
entry(
    "repeated_rows",
    f"""SELECT {r6("1 - (SELECT count(*) FROM (SELECT DISTINCT transaction_id, order_id, fixture_id, customer_id FROM tx)) / (count(*) + count(*) FILTER (transaction_id LIKE '%-4'))")} AS repeated_share FROM tx""",
    "tx",
)
_COVER = ("age_band", "gender", "postcode", "state", "family_flag", "marketing_opt_in", "email_opt_in", "sms_opt_in")
entry(
    "demographic_coverage",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS known_records, {r6(f'count({c}) / count(*) * 100')} AS coverage_pct, "
        f"CASE WHEN count({c}) / count(*) * 100 < 40 THEN 'Low coverage - treat as directional' ELSE 'Usable for aggregated planning' END AS note FROM cu"
        for c in _COVER
    ),
    "cu",
)
entry(
    "snapshot_freshness",
    f"""
SELECT age AS age_days, age > 14 OR age < 0 AS is_stale, CASE WHEN age > 14 THEN 'Latest ticketing extract is ' || age || ' days old. Upload a fresh snapshot before using this for current decisions.'
  WHEN age < 0 THEN 'Latest transaction date is in the future relative to today. Check date parsing and extract timestamps.' ELSE 'Latest ticketing extract is ' || age || ' days old.' END AS message, "case"
FROM (SELECT date_diff('day', max(CAST(transaction_date AS DATE)), DATE '2025-01-15') AS age, 'stale' AS "case" FROM sn
  UNION ALL SELECT date_diff('day', max(CAST(transaction_date AS DATE)), DATE '2024-11-20'), 'fresh' FROM sn
  UNION ALL SELECT date_diff('day', max(CAST(transaction_date AS DATE)), DATE '2024-11-20'), 'ahead' FROM tx)""",
    "sn", "tx",
)

# --- every planned match at once --------------------------------------------------------------------

part(
    "eqv",
    f"""
  SELECT match_id, equivalent_id, same_opponent, day_gap FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY same_opponent DESC, day_gap, match_date, equivalent_id) AS place FROM (
      SELECT p.match_id, f.fixture_id AS equivalent_id, f.match_date, coalesce(f.opponent, '') = coalesce(p.opponent, '') AS same_opponent, abs(dayofyear(f.match_date) - dayofyear(p.event_date)) AS day_gap
      FROM plan p JOIN fx f ON f.competition = p.competition AND f.season_label = (SELECT max(season_label) FROM fx WHERE season_label <> '{PLAN}'))) WHERE place = 1""",
    "plan", "fx",
)
entry("season_equivalents", "SELECT * FROM eqv", "eqv")
entry(
    "nearest_past_fixtures",
    f"""
SELECT match_id, fixture_id, day_gap FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY day_gap, season_label, match_date, fixture_id) AS place FROM (
    SELECT p.match_id, f.fixture_id, f.season_label, f.match_date, abs(dayofyear(f.match_date) - dayofyear(p.event_date)) AS day_gap
    FROM plan p JOIN fx f ON f.competition = p.competition AND f.season_label <> '{PLAN}')) WHERE place = 1""",
    "plan", "fx",
)
entry(
    "last_season_curves",
    f"""
SELECT match_id, CAST({START} + CAST(o AS INTEGER) AS DATE) AS date, {r6("coalesce(v, 0)")} AS last_season_daily, {r6("sum(coalesce(v, 0)) OVER (PARTITION BY match_id ORDER BY o ROWS UNBOUNDED PRECEDING)")} AS last_season_cumulative
FROM (SELECT match_id, unnest(range(0, n + 1)) AS o FROM (SELECT match_id, greatest(date_diff('day', {START}, CAST(event_date AS DATE)), 30) AS n FROM plan))
LEFT JOIN (
  SELECT match_id, least(greatest(date_diff('day', make_date(tx.season, 8, 1), CAST(transaction_date AS DATE)), 0), greatest(date_diff('day', {START}, CAST(plan.event_date AS DATE)), 30)) AS o, sum(tickets_sold) AS v
  FROM plan JOIN eqv USING (match_id) JOIN tx ON tx.fixture_id = equivalent_id GROUP BY 1, 2) USING (match_id, o)""",
    "plan", "eqv", "tx",
)
entry(
    "forest_fallback",
    f"""
SELECT match_id, {r6("greatest(m, sold)")} AS expected, {r6("greatest(sold, greatest(m, sold) - greatest(greatest(m, sold) * 0.12, 500))")} AS lower, {r6("greatest(m, sold) + greatest(greatest(m, sold) * 0.12, 500)")} AS upper
FROM (SELECT match_id, coalesce(cumulative_sales, 0) AS sold FROM plan LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY date DESC, coalesce(sales_window, '') DESC) AS place FROM dl) d USING (match_id) WHERE coalesce(place, 1) = 1),
  (SELECT median(final_sales) AS m FROM (SELECT final_sales FROM feat WHERE final_sales > 0 AND match_id IN (SELECT match_id FROM done) ORDER BY match_id, date, sales_window LIMIT 9))""",
    "plan", "dl", "feat", "done",
)
entry(
    "target_breakdown_chart",
    f"""
WITH tot AS (SELECT sum(sb) AS b, sum(ss) AS s FROM plan JOIN sv ON match_id = fixture_id WHERE venue = 'AMERICA Arena'),
l AS (SELECT o, sum(paid_tickets_sold) AS v FROM hist WHERE {_FAMILY} AND season_label = (SELECT max(season_label) FROM fx WHERE season_label <> '{PLAN}') GROUP BY 1)
SELECT date, {", ".join(f"{r6(f'share * final * {k}')} AS {n}_daily, {r6(f'sum(share * final * {k}) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)')} AS {n}_cumulative"
    for n, k in (("forecast_expected", "1"), ("forecast_plus_10", "1.1"), ("base", "(b * pct / 100 / final)"), ("stretch", "(s * pct / 100 / final)")))},
  {r6("coalesce(v, 0)")} AS last_season_daily, {r6("sum(coalesce(v, 0)) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING)")} AS last_season_cumulative
FROM pj CROSS JOIN tot LEFT JOIN l USING (o)""",
    "pj", "plan", "sv", "hist", "fx",
)
