"""Reference SQL for the queries, over the same star-schema tables.

Each entry says in plain SQL what its query must return. Shared parts are named
common table expressions; ``needs`` lists the ones an entry builds on.
"""

from __future__ import annotations

from boxline.sources import star

ORACLE: dict[str, str] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}

AS_AT, PLAN = star.AS_AT, star.PLANNING_LABEL
BASE = ", ".join(f"'{s}'" for s in star.BASELINE)


def part(name: str, sql: str, *needs: str) -> None:
    _PARTS[name] = (needs, sql)


def entry(name: str, sql: str, *needs: str) -> None:
    done: dict[str, str] = {}

    def add(part_name: str) -> None:
        if part_name not in done:
            parents, body = _PARTS[part_name]
            for parent in parents:
                add(parent)
            done[part_name] = body

    for need in needs:
        add(need)
    head = ",\n".join(f"{n} AS ({b})" for n, b in done.items())
    sql = sql.strip()
    if head and sql.upper().startswith("WITH "):
        ORACLE[name] = f"WITH {head},\n{sql[5:]}"
    else:
        ORACLE[name] = f"WITH {head}\n{sql}" if head else sql


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def case(expr: str, values: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def label_of(start: str) -> str:
    return f"concat({start}, '/', lpad(CAST(({start} + 1) % 100 AS VARCHAR), 2, '0'))"


def thousands(expr: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({expr} AS DOUBLE), 0) AS BIGINT))"


def window_of(days: str) -> str:
    return (
        f"CASE WHEN {days} <= 7 THEN 'match-week' WHEN {days} <= 28 THEN 'campaign-window' "
        f"WHEN {days} <= 75 THEN 'general-sale' WHEN {days} > 75 THEN 'early-sales' ELSE 'unknown' END"
    )


FLOOR_DAYS = "CAST(floor(date_diff('microsecond', transaction_date, CAST(match_date AS TIMESTAMP)) / 86400000000.0) AS BIGINT)"
AGE_BAND = "CASE WHEN {n} < 5 THEN 'Under 18' WHEN {n} < 10 THEN '18-30' WHEN {n} < 15 THEN '31-45' WHEN {n} < 20 THEN '46-60' END"
GENDER = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Male' WHEN 'BUILDING' THEN 'Female' END"

part(
    "tx0",
    f"""
  SELECT *,
    year(transaction_date) - CASE WHEN month(transaction_date) < 7 THEN 1 ELSE 0 END AS season
  FROM (
    SELECT concat(l_orderkey, '-', l_linenumber) AS transaction_id, CAST(l_orderkey AS VARCHAR) AS order_id,
      CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') THEN concat('C', o_custkey) END AS customer_id,
      o_orderdate + INTERVAL {star.YEAR_SHIFT} YEAR + CAST(l_linenumber * 3 AS INTEGER) * INTERVAL 1 HOUR AS transaction_date,
      CASE WHEN r_regionkey <= 2 THEN 'BBL' ELSE 'WBBL' END AS competition, n_name AS opponent, r_name || ' Arena' AS venue, n_nationkey AS nk,
      CASE WHEN l_returnflag = 'R' AND l_tax >= 0.06 THEN -l_quantity ELSE l_quantity END AS tickets_sold,
      l_returnflag = 'R' AS is_refund, (l_discount = 0 AND l_returnflag <> 'R') AS is_comp,
      CASE WHEN l_discount = 0 AND l_returnflag <> 'R' THEN CAST(0 AS DECIMAL(18, 4))
           ELSE CAST(CASE WHEN l_returnflag = 'R' AND l_tax >= 0.06 THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) END AS gross_revenue,
      p_brand AS ticket_type,
      CASE WHEN p_size < 50 THEN {case("p_type", star.TICKET_CLASS)} END AS ticket_class,
      {case("o_orderpriority", star.PRICE_TYPE)} AS price_type, 'Bay ' || l_linestatus AS section,
      {case("o_orderstatus", star.CHANNEL)} AS sales_channel, {case("l_returnflag", star.STATUS)} AS status,
      CAST(5000 + c_nationkey AS VARCHAR) AS purchaser_postcode, {AGE_BAND.format(n="c_nationkey")} AS purchaser_age_band,
      {GENDER} AS purchaser_gender, c_mktsegment = 'HOUSEHOLD' AS purchaser_family_flag, c_acctbal > 0 AS marketing_opt_in
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
)
part(
    "tx1",
    f"""
  SELECT *, {label_of("season")} AS season_label,
    CAST(make_date(season, 10, 1) + CAST(nk * 7 + nk % 3 - 1 AS INTEGER) AS DATE) AS match_date,
    concat(season, '-', nk) AS fixture_id, competition || ' v ' || opponent AS fixture_name,
    CASE WHEN is_comp THEN 0.0 ELSE tickets_sold END AS paid_tickets_sold,
    CASE WHEN is_comp THEN greatest(tickets_sold, 0.0) ELSE 0.0 END AS comp_tickets_sold
  FROM tx0""",
    "tx0",
)
part("first_season", "SELECT customer_id, min(season_label) AS fs FROM tx1 WHERE customer_id IS NOT NULL GROUP BY 1", "tx1")
part(
    "tx",
    f"""
  SELECT tx1.*, {window_of(FLOOR_DAYS)} AS sales_window, {FLOOR_DAYS} AS days_out,
    CASE WHEN season_label = fs THEN 'New' ELSE 'Returning' END AS customer_purchase_status
  FROM tx1 LEFT JOIN first_season USING (customer_id)""",
    "tx1", "first_season",
)
part("sn", f"SELECT * FROM tx WHERE transaction_date <= TIMESTAMP '{AS_AT}'", "tx")
part(
    "fx",
    f"""
  SELECT *, CASE WHEN season = {star.PLANNING_SEASON} THEN 'assumed' ELSE 'historical' END AS fixture_status,
    season = {star.PLANNING_SEASON} AS is_assumed, dayname(match_date) AS day_of_week, {case("venue", star.CAPACITY)}::DOUBLE AS capacity_total,
    competition || ' v ' || opponent || ' | ' || strftime(match_date, '%d %b %Y') || ' | ' ||
      CASE WHEN season = {star.PLANNING_SEASON} THEN 'TBD / assumed' ELSE 'historical' END AS fixture_label
  FROM (SELECT DISTINCT fixture_id, season, season_label, competition, opponent, venue, match_date FROM tx WHERE season <= {star.PLANNING_SEASON})""",
    "tx",
)
part(
    "cf",
    f"""
  SELECT concat('C', c_custkey) AS customer_id, substr(sha256('{star.SALT}:C' || c_custkey), 1, 16) AS anonymised_customer_id,
    CAST(5000 + c_nationkey AS VARCHAR) AS postcode, 'Suburb ' || c_nationkey AS suburb,
    CASE WHEN c_nationkey % 2 = 0 THEN 'SA' ELSE 'NSW' END AS state, 18.0 + c_nationkey AS age,
    {AGE_BAND.format(n="c_nationkey")} AS age_band, {GENDER} AS gender, c_mktsegment = 'HOUSEHOLD' AS family_flag,
    c_acctbal > 0 AS marketing_opt_in, c_acctbal > 2000 AS email_opt_in, c_acctbal > 5000 AS sms_opt_in
  FROM customer""",
)


def mode_part(name: str, source: str, out: str) -> None:
    part(
        name,
        f"""
  SELECT customer_id, v AS {out} FROM (
    SELECT customer_id, v, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, v) AS rn
    FROM (SELECT customer_id, {source} AS v, count(*) AS n FROM tx WHERE customer_id IS NOT NULL AND {source} IS NOT NULL GROUP BY 1, 2))
  WHERE rn = 1""",
        "tx",
    )


_MODES = {
    "preferred_ticket_type": "ticket_type",
    "preferred_ticket_class": "ticket_class",
    "usual_purchase_month": "monthname(transaction_date)",
    "usual_purchase_window": "sales_window",
    "postcode": "purchaser_postcode",
    "age_band": "purchaser_age_band",
    "gender": "purchaser_gender",
}
for _out, _source in _MODES.items():
    mode_part(f"m_{_out}", _source, _out)
part(
    "lt",
    f"""
  SELECT * FROM (
    SELECT customer_id, min(transaction_date) AS first_purchase_date, max(transaction_date) AS last_purchase_date,
      count(DISTINCT season_label) AS seasons_purchased_count, sum(tickets_sold) AS lifetime_tickets, sum(gross_revenue) AS lifetime_revenue,
      bool_or(purchaser_family_flag) AS family_flag, bool_or(marketing_opt_in) AS marketing_opt_in,
      substr(sha256('{star.SALT}:' || customer_id), 1, 16) AS anonymised_customer_id
    FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)
  {" ".join(f"LEFT JOIN m_{m} USING (customer_id)" for m in _MODES)}""",
    *[f"m_{m}" for m in _MODES],
)


def merged(file_filter: str) -> str:
    return f"""
  SELECT coalesce(c.customer_id, s.customer_id) AS customer_id,
    coalesce(c.anonymised_customer_id, s.anonymised_customer_id) AS anonymised_customer_id,
    coalesce(c.postcode, s.postcode) AS postcode, coalesce(c.age_band, s.age_band) AS age_band, coalesce(c.gender, s.gender) AS gender,
    coalesce(c.family_flag, s.family_flag) AS family_flag, coalesce(c.marketing_opt_in, s.marketing_opt_in) AS marketing_opt_in,
    c.email_opt_in, c.sms_opt_in, c.suburb, c.state, c.age, c.customer_id IS NOT NULL AS has_customer_record, s.customer_id IS NOT NULL AS has_ticket_history,
    s.lifetime_tickets, s.lifetime_revenue, s.seasons_purchased_count, s.preferred_ticket_class, s.preferred_ticket_type, s.usual_purchase_window
  FROM (SELECT * FROM cf WHERE {file_filter}) c FULL JOIN lt s ON c.customer_id = s.customer_id"""


part("cu", merged("true"), "cf", "lt")


def match_part(name: str, src: str) -> None:
    part(
        name,
        f"""
  SELECT *, CASE WHEN event_category = 'new-year' THEN 'New Year''s Eve Bash' ELSE 'Fixture push' END AS campaign_theme,
    round_even(baseline_target * 1.08 / 100, 0) * 100 AS manual_target
  FROM (
    SELECT *, CASE WHEN b < 1 THEN 5000.0 ELSE b END AS baseline_target,
      early_bird_start + INTERVAL 20 DAY AS early_bird_end, early_bird_start + INTERVAL 27 DAY AS member_presale_start,
      early_bird_start + INTERVAL 33 DAY AS member_presale_end, early_bird_start + INTERVAL 34 DAY AS general_public_start
    FROM (
      SELECT f.fixture_id AS match_id, season, season_label, competition, 'Home side' AS team,
        row_number() OVER (PARTITION BY season_label, competition ORDER BY match_date, f.fixture_id) AS round,
        opponent, venue, match_date AS event_date, coalesce(fs, CAST(match_date - CASE WHEN competition = 'WBBL' THEN 90 ELSE 120 END AS TIMESTAMP)) AS on_sale_date,
        coalesce(fs, CAST(match_date - CASE WHEN competition = 'WBBL' THEN 90 ELSE 120 END AS TIMESTAMP)) AS early_bird_start,
        day_of_week, CASE WHEN strftime(match_date, '%m-%d') = '12-31' THEN 'new-year' WHEN competition = 'WBBL' THEN 'family' ELSE 'standard' END AS event_category,
        80 AS opponent_strength, coalesce(capacity_total, 0) * 0.55 AS historical_attendance,
        greatest(coalesce(p, CASE WHEN competition = 'BBL' THEN 49.0 ELSE 29.0 END), 0) AS ticket_price,
        CASE WHEN competition = 'BBL' THEN 28 ELSE 23 END AS weather_temp_c, match_date - 28 AS marketing_start, match_date - 10 AS marketing_end,
        match_date - 7 AS campaign_burst_date, CASE WHEN strftime(match_date, '%m-%d') IN ('12-31', '01-26') THEN 1 ELSE 0 END AS public_holiday,
        CASE WHEN month(match_date) IN (12, 1) THEN 1 ELSE 0 END AS school_holiday,
        round_even(greatest(coalesce(paid, 0) * 1.08, coalesce(capacity_total, 0) * CASE WHEN competition = 'BBL' THEN 0.58 ELSE 0.46 END) / 100, 0) * 100 AS b,
        CASE WHEN season_label = '{PLAN}' THEN 1 ELSE 0 END AS planning_season, fixture_status, is_assumed, capacity_total, fixture_label
      FROM fx f
      LEFT JOIN (SELECT fixture_id, min(transaction_date) AS fs, sum(paid_tickets_sold) AS paid FROM {src} GROUP BY 1) a USING (fixture_id)
      LEFT JOIN (SELECT fixture_id, median(CAST(gross_revenue AS DOUBLE) / paid_tickets_sold) AS p FROM {src} WHERE paid_tickets_sold > 0 GROUP BY 1) q USING (fixture_id)))""",
        "fx", src,
    )


def daily_part(name: str, src: str, matches: str) -> None:
    part(
        name,
        f"""
  SELECT match_id, d AS date, date_diff('day', d, event_date) AS days_to_event, daily_sales,
    CASE WHEN match_id IS NOT NULL THEN sum(daily_sales) OVER (PARTITION BY match_id ORDER BY d, sales_window ROWS UNBOUNDED PRECEDING) END AS cumulative_sales,
    sales_window, CASE WHEN d BETWEEN marketing_start AND marketing_end THEN 'active' ELSE 'none' END AS marketing_period,
    CASE WHEN strftime(event_date, '%m-%d') IN ('12-31', '01-26') THEN 1 ELSE 0 END AS is_public_holiday,
    CASE WHEN abs(date_diff('day', campaign_burst_date, d)) <= 1 THEN 1 ELSE 0 END AS is_campaign_burst,
    CASE WHEN d BETWEEN member_presale_start AND member_presale_end THEN 1 ELSE 0 END AS membership_on_sale,
    CASE WHEN d BETWEEN early_bird_start AND early_bird_end THEN 1 ELSE 0 END AS early_bird_active, school_holiday, 'real_csv_normalised' AS source
  FROM (SELECT fixture_id, CAST(transaction_date AS DATE) AS d, sales_window, sum(paid_tickets_sold) AS daily_sales FROM {src} GROUP BY 1, 2, 3)
  LEFT JOIN {matches} ON match_id = fixture_id""",
        src, matches,
    )


match_part("mt", "sn")
match_part("mt_all", "tx")
daily_part("dl", "sn", "mt")
daily_part("dl_all", "tx", "mt_all")
part("fin", "SELECT match_id, max(cumulative_sales) AS final_sales FROM dl GROUP BY 1", "dl")
part(
    "done",
    "SELECT match_id FROM mt WHERE event_date <= (SELECT max(date) FROM dl) UNION SELECT match_id FROM dl WHERE days_to_event = 0 AND match_id IS NOT NULL",
    "mt", "dl",
)
part("plan", f"SELECT * FROM mt WHERE season_label = '{PLAN}'", "mt")

# --- scalar functions -------------------------------------------------------------------------------

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


_CLEAN = strip_sql("replace(text, chr(65279), '')")
entry(
    "normalise_text",
    f"""
SELECT id, CASE WHEN lower(c) NOT IN ('', 'null', 'none', 'nan', 'nat', '#n/a', 'n/a', '-') THEN md5(c) END AS cleaned,
  md5(trim(regexp_replace(lower(c), '[^a-z0-9]+', '_', 'g'), '_')) AS token,
  md5(CASE WHEN lower(s) IN ('', 'nan', 'none', 'null', '<na>') THEN 'Unknown / unmatched' ELSE s END) AS bucket,
  CASE WHEN lower(s) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN md5(lower(s)) END AS join_key,
  md5(CASE WHEN lower(c) IN ('', 'null', 'none', 'nan', 'nat', '#n/a', 'n/a', '-', 'unknown', 'unmatched', '<na>') THEN 'filled' ELSE c END) AS filled
FROM (
  SELECT id, {_CLEAN} AS c, {strip_sql("text")} AS s FROM (
    SELECT 'd' || doc_id AS id, text FROM documents UNION ALL
    SELECT 'p' || p_partkey, CASE WHEN p_size = 1 THEN ' N/A ' WHEN p_size = 2 THEN '-' ELSE chr(9) || ' ' || p_name || ' & ' || p_brand || '  ' END FROM part))""",
)
entry(
    "normalise_numbers",
    f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_partkey, {r6("sum(l_extendedprice::DECIMAL(18,2))")} AS money, {r6("sum(-l_quantity)")} AS bracketed,
  {r6("sum(round(l_discount * 100, 0))")} AS percent, {r6("sum(CASE WHEN l_tax > 0 THEN l_tax::DECIMAL(18,2) ELSE 9 END)")} AS with_default,
  count(*) FILTER (l_returnflag = 'R') AS yes, {r6("max(l_extendedprice)")} AS target
FROM lineitem GROUP BY 1, 2, 3, 4""",
)
entry(
    "normalise_dates",
    """
SELECT o_orderkey, d AS parsed, CASE WHEN o_orderkey % 7 IN (3, 5) THEN 14 ELSE 0 END AS hour, d AS from_text, strftime(d, '%m-%d') AS month_day,
  dayname(d) AS day_name, monthname(d) AS month_name, dayofyear(d) AS day_of_year, CASE WHEN o_orderkey % 7 IN (3, 5) THEN -1 ELSE 0 END AS floor_days,
  age, CASE WHEN age < 18 THEN 'Under 18' WHEN age <= 30 THEN '18-30' WHEN age <= 45 THEN '31-45' WHEN age <= 60 THEN '46-60' ELSE '61+' END AS age_band
FROM (
  SELECT o_orderkey, o_orderdate::DATE AS d, round_even(date_diff('day', o_orderdate::DATE, DATE '2026-08-31') / 365.25, 0) AS age FROM orders)
""".replace("d AS from_text", "CASE WHEN o_orderkey % 7 <> 4 THEN d END AS from_text"),
)
entry(
    "dates_in_documents",
    r"""
SELECT found, count(*) AS texts, min(id) AS first_id FROM (
  SELECT id, coalesce(nullif(regexp_extract(text, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})', 1), ''),
    nullif(regexp_extract(text, '([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})', 1), ''), nullif(regexp_extract(text, '([0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4})', 1), '')) AS found
  FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'w' || page_id, html FROM pages)) GROUP BY 1""",
)
entry(
    "season_labels",
    f"""
SELECT raw, label, from_date, start::BIGINT AS start, start_year::BIGINT AS start_year, count(*) AS n FROM (
  SELECT {label_of("s")} AS from_date, s AS start_year,
    CASE p WHEN '1-URGENT' THEN concat('Season ', y, ' - ', (y + 1) % 100) WHEN '2-HIGH' THEN concat(y % 100, '/', y + 1)
      WHEN '3-MEDIUM' THEN concat('Summer ', y) WHEN '4-NOT SPECIFIED' THEN 'n/a' ELSE 'Pre-season' END AS raw,
    CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN {label_of("y")} WHEN p = '4-NOT SPECIFIED' THEN NULL ELSE 'Pre-season' END AS label,
    CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN y END AS start
  FROM (SELECT o_orderpriority AS p, year(d) AS y, year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END AS s
        FROM (SELECT *, o_orderdate + INTERVAL {star.YEAR_SHIFT} YEAR AS d FROM orders))) GROUP BY 1, 2, 3, 4, 5""",
)
entry(
    "anonymise_ids",
    f"SELECT c_custkey, CASE WHEN c_acctbal >= -900 THEN substr(sha256('{star.SALT}:' || c_name), 1, 16) END AS anonymised FROM customer",
)
_TOKEN = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
_SOFT = " || '|' || ".join(_TOKEN.format(c=c) for c in ("competition", "season_label", "opponent", "venue"))
entry(
    "fixture_keys",
    f"""
SELECT fixture_id, {_SOFT} || '|' || strftime(match_date, '%Y%m%d') AS exact_key, {_SOFT} AS soft_key,
  competition || '|' || season_label || '|' || strftime(match_date, '%Y-%m-%d') || '|' || opponent || '|' || venue AS id_text, fixture_label FROM fx""",
    "fx",
)
entry(
    "age_bands",
    """
SELECT CASE WHEN age < 18 THEN 'Under 18' WHEN age <= 30 THEN '18-30' WHEN age <= 45 THEN '31-45' WHEN age <= 60 THEN '46-60' ELSE '61+' END AS age_band,
  count(*) AS customers FROM (SELECT round(c_acctbal / 100, 1) AS age FROM customer) GROUP BY 1""",
)

# --- normalisation ----------------------------------------------------------------------------------

# The exported status decides the flags again, so a comp without the word stays a comp by its price.
part(
    "nt",
    """
  SELECT *, gross_revenue AS gross, (tickets_sold < 0 OR gross_revenue < 0 OR is_refund) AS refund,
    ((abs(gross_revenue) <= 0.01 OR is_comp) AND NOT (tickets_sold < 0 OR gross_revenue < 0 OR is_refund)) AS comp FROM tx""",
    "tx",
)
entry(
    "ticket_normalise",
    f"""
SELECT competition, season_label, opponent, venue, strftime(match_date, '%Y-%m-%d %H:%M:%S') AS match_date, CAST(transaction_date AS DATE) AS sold_on, count(*) AS rows,
  count(customer_id) AS with_customer, {r6("sum(tickets_sold)")} AS tickets, {r6("sum(gross)")} AS gross, {r6("sum(gross)")} AS net,
  count(*) FILTER (marketing_opt_in) AS opted_in, count(*) FILTER (purchaser_family_flag) AS families, count(ticket_class) AS with_class, min(season) AS season,
  max(hour(transaction_date)) AS last_hour FROM (SELECT * REPLACE (
    CASE WHEN price_type = 'Adult' THEN season_label ELSE {label_of("(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END)")} END AS season_label) FROM nt) GROUP BY 1, 2, 3, 4, 5, 6""",
    "nt",
)
entry(
    "refund_comp_flags",
    f"""
SELECT competition, refund AS is_refund, comp AS is_comp, price_type, count(*) AS rows, {r6("sum(CASE WHEN comp THEN 0 ELSE tickets_sold END)")} AS paid,
  {r6("sum(CASE WHEN comp THEN greatest(tickets_sold, 0) ELSE 0 END)")} AS comps FROM nt GROUP BY 1, 2, 3, 4""",
    "nt",
)
entry(
    "sales_window_infer",
    """
SELECT season_label, sales_window AS sale_window, CASE WHEN o <= 31 THEN 'early-sales' WHEN o <= 75 THEN 'general-sale' WHEN o <= 120 THEN 'campaign-window' ELSE 'match-week' END AS offset_window,
  CASE sales_window WHEN 'early-sales' THEN 1 WHEN 'general-sale' THEN 2 WHEN 'campaign-window' THEN 3 WHEN 'match-week' THEN 4 ELSE 2 END AS window_rank,
  CASE sales_window WHEN 'early-sales' THEN 'campaign-window' ELSE 'match-week' END AS next_window, count(*) AS rows
FROM (SELECT *, date_diff('day', make_date(season, 8, 1), CAST(transaction_date AS DATE)) AS o FROM tx) GROUP BY 1, 2, 3, 4, 5""",
    "tx",
)
_TS = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
entry(
    "forecasting_matches",
    f"""
SELECT match_id, season, season_label, competition, team, round, round AS home_match_number, opponent, venue, event_date,
  {", ".join(_TS(c) for c in ("on_sale_date", "early_bird_start", "early_bird_end", "member_presale_start", "member_presale_end", "general_public_start"))},
  day_of_week, event_category, campaign_theme, opponent_strength, {r6("historical_attendance")} AS historical_attendance, {r6("ticket_price")} AS ticket_price,
  0 AS membership_base, 0 AS prior_season_performance, weather_temp_c, marketing_start, marketing_end, campaign_burst_date, public_holiday, school_holiday,
  0 AS double_header, 0 AS finals_contention, {r6("baseline_target")} AS baseline_target, {r6("manual_target")} AS manual_target, planning_season, fixture_status, is_assumed,
  {r6("capacity_total")} AS capacity_total FROM mt_all""",
    "mt_all",
)
entry(
    "fixture_normalise",
    f"""
SELECT season, season_label, competition, opponent, venue, match_date, day_of_week, {r6("capacity_total")} AS capacity_total,
  competition || ' v ' || opponent || ' | ' || strftime(match_date, '%d %b %Y') || ' | historical' AS fixture_label, true AS is_confirmed FROM fx""",
    "fx",
)
entry(
    "customer_normalise",
    f"""
SELECT customer_id, anonymised_customer_id, postcode, age, CASE WHEN age < 18 THEN 'Under 18' WHEN age <= 30 THEN '18-30' WHEN age <= 45 THEN '31-45' WHEN age <= 60 THEN '46-60' ELSE '61+' END AS age_band, gender,
  email_opt_in, false AS sms_opt_in FROM (
  SELECT concat('C', c_custkey) AS customer_id, substr(sha256('{star.SALT}:C' || c_custkey), 1, 16) AS anonymised_customer_id, CAST(5000 + c_nationkey AS VARCHAR) AS postcode,
    round_even(date_diff('day', DATE '2006-01-01' - CAST(floor(c_acctbal + 1000) AS INTEGER), DATE '2026-08-31') / 365.25, 0) AS age,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Female' END AS gender, c_acctbal > 0 AS email_opt_in FROM customer)""",
)
entry(
    "csv_round_trip",
    f"""
SELECT fixture_id, sales_window, CASE WHEN fixture_id IS NULL THEN 0.0 ELSE 1.0 END AS fixture_match_score, count(*) AS rows, {r6("sum(CASE WHEN comp THEN 0 ELSE tickets_sold END)")} AS paid, {r6("sum(gross)")} AS gross, count(*) AS numbered
FROM (SELECT * REPLACE (
  CASE WHEN season > {star.PLANNING_SEASON} OR (price_type <> 'Adult' AND season_label <> {label_of("(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END)")}) THEN NULL ELSE fixture_id END AS fixture_id) FROM nt) GROUP BY 1, 2, 3""",
    "nt",
)
_TAIL = "sales_channel || CASE price_type WHEN 'Adult' THEN ' é' WHEN 'Group' THEN ' é’' ELSE ' 5 row' END"
_MIXED = "price_type IN ('Adult', 'Group') OR NOT is_refund"
entry(
    "csv_mixed_files",
    f"""
SELECT transaction_id, order_id, customer_id, competition, opponent, venue, {r6("tickets_sold")} AS tickets_sold, {r6("gross")} AS gross_revenue, ticket_type, price_type, {_TAIL} AS sales_channel
FROM nt WHERE {_MIXED}""",
    "nt",
)
entry(
    "load_rejects",
    f"""
SELECT 'warning' AS severity, 'tickets' AS area, n || ' rows of export were set aside: more values than columns.' AS message, n AS rejected_rows
FROM (SELECT count(*) AS n FROM nt WHERE NOT ({_MIXED})) WHERE n > 0""",
    "nt",
)
entry(
    "customer_files_merge",
    f"""
SELECT customer_id, n AS ticket_rows, tickets, cu.gender, cu.postcode FROM cu JOIN (
  SELECT customer_id, count(*) AS n, {r6("sum(tickets_sold)")} AS tickets FROM tx GROUP BY 1) USING (customer_id)""",
    "cu", "tx",
)
entry(
    "union_competitions",
    f"""
SELECT season_label, competition, CASE WHEN competition = 'BBL' THEN sales_channel END AS sales_channel, count(*) AS rows, {r6("sum(tickets_sold)")} AS tickets
FROM tx GROUP BY 1, 2, 3""",
    "tx",
)

# --- filters ----------------------------------------------------------------------------------------

entry(
    "filter_transactions",
    f"""
SELECT transaction_id, order_id, ticket_type, {r6("paid_tickets_sold")} AS paid_tickets_sold, {r6("gross_revenue")} AS gross_revenue, sales_window FROM tx
WHERE season_label = '2023/24' AND competition = 'BBL' AND transaction_date <= TIMESTAMP '2024-03-31' AND coalesce(ticket_class, 'Unknown') = 'Unknown'
  AND purchaser_family_flag AND NOT is_comp AND NOT is_refund""",
    "tx",
)
_STATUS = {"Paid tickets only": "NOT is_comp AND NOT is_refund", "Comps only": "is_comp", "Refunds / voids": "is_refund", "Paid + comps": "true"}
_AUDIENCE = {
    "All": "true", "Families": "purchaser_family_flag", "Marketable": "marketing_opt_in",
    "18-30s": "regexp_matches(coalesce(purchaser_age_band, ''), '18|19|20|21|22|23|24|25|26|27|28|29|30')", "Returning purchasers": "customer_purchase_status = 'Returning'",
}
entry(
    "filter_statuses",
    "\nUNION ALL ".join(
        f"SELECT '{s} | {a}' AS selection, count(*) AS rows FROM tx WHERE ({st}) AND ({at})" for s, st in _STATUS.items() for a, at in _AUDIENCE.items()
    ),
    "tx",
)
part(
    "dx",
    """
  SELECT tx.*, coalesce(purchaser_age_band, c.age_band, 'Unknown / unmatched') AS age_band_filter,
    coalesce(purchaser_gender, c.gender, 'Unknown / unmatched') AS gender_filter, coalesce(purchaser_postcode, c.postcode, 'Unknown / unmatched') AS postcode_filter,
    c.customer_id IS NOT NULL AS demographic_match, c.email_opt_in AS email, c.sms_opt_in AS sms
  FROM tx LEFT JOIN cu c USING (customer_id)""",
    "tx", "cu",
)
entry(
    "filter_demographics",
    f"""
SELECT age_band_filter, gender_filter, season_label, count(*) AS rows, {r6("sum(tickets_sold)")} AS tickets FROM dx
WHERE age_band_filter IN ('18-30', 'Unknown / unmatched') AND gender_filter IN ('Female', 'Unknown / unmatched') GROUP BY 1, 2, 3""",
    "dx",
)
entry("scoped_matches", f"SELECT match_id, event_date, opponent, round, is_assumed FROM mt WHERE season_label = '{PLAN}' AND competition = 'WBBL'", "mt")
entry("season_match_list", f"SELECT match_id, opponent, venue, round FROM mt WHERE season_label = '{PLAN}' AND competition = 'BBL'", "mt")
entry("completed_matches", "SELECT match_id FROM done", "done")
entry("season_options", f"SELECT DISTINCT season_label AS value FROM tx WHERE season_label <> '{PLAN}'", "tx")

# --- joins ------------------------------------------------------------------------------------------

entry(
    "fixture_match_two_stage",
    f"""
WITH t AS (SELECT *, CASE WHEN sales_channel = 'Phone' THEN fixture_id END AS fid, CASE WHEN price_type <> 'Junior' THEN match_date END AS md,
    CASE WHEN price_type <> 'Group' THEN opponent END AS opp FROM tx)
SELECT fixture_id, score AS fixture_match_score, count(*) AS rows, {r6("sum(tickets_sold)")} AS tickets FROM (
  SELECT tickets_sold, coalesce(fid, CASE WHEN known AND opp IS NOT NULL THEN t.fixture_id END) AS fixture_id,
    CASE WHEN known AND opp IS NOT NULL AND md IS NOT NULL THEN 1.0 WHEN fid IS NULL AND known AND opp IS NOT NULL THEN 0.72 ELSE 0.0 END AS score
  FROM (SELECT t.*, season <= {star.PLANNING_SEASON} AS known FROM t) t) GROUP BY 1, 2""",
    "tx",
)
entry(
    "demographic_enrich",
    f"""
SELECT coalesce(c.age_band, 'Unknown / unmatched') AS age_band_filter, coalesce(c.gender, 'Unknown / unmatched') AS gender_filter,
  coalesce(c.postcode, 'Unknown / unmatched') AS postcode_filter, c.state AS purchaser_state, c.customer_id IS NOT NULL AS demographic_match, count(*) AS rows,
  {r6("sum(paid_tickets_sold)")} AS paid, count(*) FILTER (c.email_opt_in) AS email, count(*) FILTER (c.sms_opt_in) AS sms, {r6("sum(c.age)")} AS ages
FROM tx LEFT JOIN cf c USING (customer_id) GROUP BY 1, 2, 3, 4, 5""",
    "tx", "cf",
)
_KNOWN = "avg(CASE WHEN {c} = 'Unknown / unmatched' THEN 0 ELSE 1 END)"
entry(
    "demographic_match_metrics",
    f"""
SELECT count(customer_id) AS ticketing_rows_with_id, count(*) FILTER (demographic_match) AS demographic_matched_ticket_rows,
  {r6(_KNOWN.format(c="age_band_filter"))} AS age_coverage, {r6(_KNOWN.format(c="gender_filter"))} AS gender_coverage, {r6(_KNOWN.format(c="postcode_filter"))} AS postcode_coverage,
  (SELECT count(customer_id) FROM cu) AS customer_rows_with_id, count(customer_id) - count(*) FILTER (demographic_match) AS demographic_unmatched_ticket_rows,
  {r6("count(*) FILTER (demographic_match) / count(customer_id)")} AS demographic_match_rate FROM dx""",
    "dx", "cu",
)
part("cu_part", merged("postcode <> '5007'"), "cf", "lt")
entry(
    "customer_outer_merge",
    f"""
SELECT customer_id, anonymised_customer_id, postcode, age_band, gender, family_flag, marketing_opt_in, email_opt_in, has_customer_record, has_ticket_history,
  {r6("lifetime_tickets")} AS lifetime_tickets, seasons_purchased_count FROM cu_part""",
    "cu_part",
)
entry(
    "customer_append",
    """
SELECT customer_id, CASE WHEN gender IS NOT NULL THEN postcode ELSE '0000' END AS postcode, gender, CASE WHEN gender IS NULL THEN state END AS state FROM cf""",
    "cf",
)
entry(
    "not_yet_purchased_anti",
    f"""
SELECT customer_id, preferred_ticket_class, marketing_opt_in FROM cu
WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.customer_id = cu.customer_id AND season_label = '{PLAN}')""",
    "cu", "tx",
)
entry(
    "merge_fixtures",
    f"""
SELECT fixture_id, season_label, competition, CASE WHEN season_label = '{PLAN}' THEN 'confirmed' ELSE fixture_status END AS fixture_status FROM fx
WHERE season_label < '{PLAN}' OR competition = 'BBL'
UNION ALL SELECT fixture_id || '-a', season_label, competition, fixture_status FROM fx WHERE season_label = '{PLAN}' AND competition <> 'BBL'""",
    "fx",
)

# --- aggregations -----------------------------------------------------------------------------------

entry(
    "daily_sales",
    f"""
SELECT match_id, date, days_to_event, {r6("daily_sales")} AS daily_sales, {r6("cumulative_sales")} AS cumulative_sales, sales_window, marketing_period, is_public_holiday,
  is_campaign_burst, membership_on_sale, early_bird_active, school_holiday, source FROM dl_all""",
    "dl_all",
)
entry("daily_sales_csv", f"SELECT match_id, date, days_to_event, {r6('daily_sales')} AS daily_sales, {r6('cumulative_sales')} AS cumulative_sales FROM dl_all", "dl_all")
entry(
    "matches_csv",
    """
SELECT match_id, season_label, opponent, strftime(CAST(event_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS event_date,
  strftime(CAST(on_sale_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS on_sale_date FROM mt""",
    "mt",
)
entry(
    "csv_quoted_breaks",
    """
SELECT doc_id, source, length(note) AS chars, md5(note) AS text_md5 FROM (
  SELECT doc_id, source, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN replace(text, chr(13) || chr(10), chr(10)) END AS note FROM documents)""",
)
entry(
    "processed_sets",
    f"""
SELECT season_label, count(*) AS rows, {r6('sum(paid_tickets_sold)')} AS paid, any_value(n) AS matches
FROM tx LEFT JOIN (SELECT season_label, count(*) AS n FROM mt GROUP BY 1) USING (season_label) WHERE season_label <= '{PLAN}' GROUP BY 1""",
    "tx", "mt",
)
entry(
    "processed_round_trip",
    f"SELECT season_label, count(*) AS rows, {r6('sum(paid_tickets_sold)')} AS paid, count(DISTINCT customer_id) AS buyers FROM tx GROUP BY 1",
    "tx",
)
entry(
    "customer_lifetime",
    f"""
SELECT customer_id, {_TS("first_purchase_date")}, {_TS("last_purchase_date")}, seasons_purchased_count, {r6("lifetime_tickets")} AS lifetime_tickets,
  {r6("lifetime_revenue")} AS lifetime_revenue, family_flag, marketing_opt_in, anonymised_customer_id, {", ".join(_MODES)}, true AS has_ticket_history FROM lt""",
    "lt",
)
entry(
    "infer_fixtures",
    """
SELECT DISTINCT competition, season_label, opponent, venue, match_date, 'Home side' AS team, fixture_name, season, dayname(match_date) AS day_of_week,
  competition || ' v ' || opponent || ' | ' || strftime(match_date, '%d %b %Y') || ' | historical' AS fixture_label FROM tx""",
    "tx",
)
entry(
    "ticket_price_median",
    f"SELECT fixture_id, {r6('median(CAST(gross_revenue AS DOUBLE) / paid_tickets_sold)')} AS median_price FROM tx WHERE paid_tickets_sold > 0 GROUP BY 1",
    "tx",
)
entry("quantile_whole_table", f"SELECT {r6('quantile_cont(CAST(gross_revenue AS DOUBLE), 0.75)')} AS upper_quartile FROM tx", "tx")
entry(
    "purchase_status",
    f"""
SELECT season_label, customer_purchase_status, count(*) AS rows, count(DISTINCT customer_id) AS customers, {r6("sum(tickets_sold)")} AS tickets FROM tx GROUP BY 1, 2""",
    "tx",
)
part("now_tx", f"SELECT * FROM sn WHERE season_label = '{PLAN}'", "sn")
part(
    "kpi",
    f"""
  SELECT sum(tickets_sold) AS tickets_sold, sum(paid_tickets_sold) AS paid_tickets_sold, sum(comp_tickets_sold) AS comps_issued,
    CAST(sum(gross_revenue) AS DOUBLE) AS gross_revenue, greatest(count(DISTINCT order_id), 1) AS orders, count(DISTINCT customer_id) AS unique_purchasers,
    count(DISTINCT CASE WHEN fs = '{PLAN}' THEN customer_id END) AS new_purchasers,
    (SELECT min(date_diff('day', DATE '{AS_AT}', match_date)) FROM fx WHERE season_label = '{PLAN}' AND match_date >= DATE '{AS_AT}') AS days,
    (SELECT sum(capacity_total) FROM fx WHERE season_label = '{PLAN}') AS capacity
  FROM now_tx LEFT JOIN first_season USING (customer_id)""",
    "now_tx", "fx", "first_season",
)
entry(
    "kpi_summary",
    f"""
SELECT {r6("tickets_sold")} AS tickets_sold, {r6("paid_tickets_sold")} AS paid_tickets_sold, {r6("comps_issued")} AS comps_issued, {r6("gross_revenue")} AS gross_revenue,
  {r6("gross_revenue")} AS net_revenue, {r6("gross_revenue / paid_tickets_sold")} AS average_ticket_price, {r6("paid_tickets_sold / orders")} AS average_basket_size,
  {r6("unique_purchasers")} AS unique_purchasers, {r6("(unique_purchasers - new_purchasers) / unique_purchasers")} AS retention_rate, {r6("new_purchasers")} AS new_purchasers,
  {r6("120000")} AS forecast_total, {r6("150000")} AS target_total, {r6("-30000")} AS gap_to_target,
  {r6("greatest(150000 - paid_tickets_sold, 0) / greatest(days, 1)")} AS required_daily_run_rate, {r6("days")} AS days_to_next_fixture,
  {r6("tickets_sold / capacity * 100")} AS capacity_sold_pct FROM kpi""",
    "kpi",
)
part(
    "typical",
    """
  SELECT match_id, greatest(med, cur) AS expected, greatest(cur, greatest(med, cur) - greatest(greatest(med, cur) * 0.12, 500)) AS lower,
    greatest(med, cur) + greatest(greatest(med, cur) * 0.12, 500) AS upper, latest_date, cur AS latest_sales
  FROM (
    SELECT p.match_id, latest_date, coalesce(latest_sales, 0) AS cur,
      coalesce((SELECT median(final_sales) FROM fin WHERE final_sales > 0 AND match_id IN (SELECT match_id FROM done)), 0) AS med
    FROM plan p LEFT JOIN (
      SELECT match_id, date AS latest_date, max(cumulative_sales) AS latest_sales FROM dl JOIN (SELECT match_id, max(date) AS date FROM dl GROUP BY 1) USING (match_id, date)
      GROUP BY 1, 2) l USING (match_id))""",
    "plan", "fin", "done", "dl",
)
part(
    "fxs",
    """
  SELECT fixture_id, f.season_label, f.competition, f.match_date, f.fixture_label, coalesce(sold, 0) AS sold, coalesce(paid_sold, 0) AS paid_sold, coalesce(comps, 0) AS comps, coalesce(gross, 0) AS gross_revenue,
    coalesce(buyers, 0) AS unique_purchasers, coalesce(manual_target, 0) AS target, coalesce(expected, 0) AS forecast, f.capacity_total
  FROM fx f LEFT JOIN (
    SELECT fixture_id, sum(tickets_sold) AS sold, sum(paid_tickets_sold) AS paid_sold, sum(comp_tickets_sold) AS comps, sum(gross_revenue) AS gross, count(DISTINCT customer_id) AS buyers
    FROM sn GROUP BY 1) s USING (fixture_id)
  LEFT JOIN (SELECT match_id AS fixture_id, manual_target FROM mt) m USING (fixture_id) LEFT JOIN (SELECT match_id AS fixture_id, expected FROM typical) t USING (fixture_id)""",
    "fx", "sn", "mt", "typical",
)
entry(
    "fixture_sales_summary",
    f"""
SELECT fixture_id, competition, match_date, {r6("sold")} AS sold, {r6("paid_sold")} AS paid_sold, {r6("comps")} AS comps, {r6("gross_revenue")} AS gross_revenue,
  {r6("unique_purchasers")} AS unique_purchasers, {r6("target")} AS target, {r6("forecast")} AS forecast, {r6("forecast - target")} AS gap,
  {r6("CASE WHEN capacity_total > 0 THEN sold / capacity_total * 100 END")} AS capacity_sold_pct,
  CASE WHEN target <= 0 OR forecast <= 0 THEN 'watch' WHEN forecast / target >= 1.02 THEN 'on track' WHEN forecast / target >= 0.92 THEN 'watch' ELSE 'at risk' END AS risk_status FROM fxs""",
    "fxs",
)


entry(
    "report_fixtures",
    """
SELECT row_number() OVER (ORDER BY competition, match_date, fixture_id) AS rank, fixture_id,
  CASE WHEN target <= 0 OR forecast <= 0 THEN 'watch' WHEN forecast / target >= 1.02 THEN 'on track' WHEN forecast / target >= 0.92 THEN 'watch' ELSE 'at risk' END AS risk_status FROM fxs""",
    "fxs",
)


def audience_sql(src: str, groups: str, min_size: int, columns: str, over: str = "") -> str:
    return f"""
SELECT {columns}, {r6("paid")} AS paid_tickets, {r6("comp")} AS comps, {r6("gross")} AS gross_revenue, customers, orders,
  {r6("CASE WHEN paid > 0 THEN CAST(gross AS DOUBLE) / paid ELSE 0 END")} AS average_ticket_price, {r6("CASE WHEN orders > 0 THEN paid / orders ELSE 0 END")} AS average_basket_size,
  {r6("share")} AS contribution_pct, CASE WHEN share >= 20 THEN 'growth engine' WHEN comp > paid * 0.25 THEN 'comp masking risk' ELSE 'watch' END AS status
FROM (SELECT *, paid / greatest(sum(paid) OVER ({over}), 1) * 100 AS share FROM ({groups}) WHERE customers >= {min_size} OR paid >= {min_size})"""


_MEASURES = (
    "sum(paid_tickets_sold) AS paid, sum(comp_tickets_sold) AS comp, sum(gross_revenue) AS gross, "
    "count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders"
)
entry(
    "audience_summary",
    audience_sql("tx", f"SELECT coalesce(ticket_class, 'Unknown') AS ticket_class, {_MEASURES} FROM tx WHERE competition = 'BBL' GROUP BY 1", 100, "ticket_class"),
    "tx",
)
entry(
    "audience_grouping_sets",
    audience_sql(
        "tx",
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, coalesce({d}, 'Unknown') AS group_value, {_MEASURES} FROM tx GROUP BY 1, 2" for d in ("ticket_class", "price_type", "sales_channel")
        ),
        0, "dimension, group_value", "PARTITION BY dimension",
    ),
    "tx",
)
entry(
    "sales_window_summary",
    f"""
SELECT sales_window, {r6("paid")} AS paid_tickets, {r6("comp")} AS comps, {r6("gross")} AS gross_revenue, customers,
  {r6("paid / greatest(sum(paid) OVER (), 1) * 100")} AS window_share_pct, CASE WHEN sales_window IN ('early-sales', 'match-week') THEN 1.15 ELSE 1.0 END AS recommended_weight
FROM (SELECT sales_window, {_MEASURES} FROM tx GROUP BY 1)""",
    "tx",
)
entry(
    "current_window",
    f"""
SELECT as_at, to_next, greatest(coalesce(to_next, to_last), 0) AS same_point,
  CASE WHEN to_next IS NULL OR to_next <= 7 THEN 'match-week' WHEN to_next <= 35 THEN 'campaign-window' WHEN to_next <= 80 THEN 'general-sale' ELSE 'early-sales' END AS current_sales_window
FROM (
  SELECT as_at, min(CASE WHEN match_date >= CAST(as_at AS DATE) THEN date_diff('day', CAST(as_at AS DATE), match_date) END) AS to_next,
    max(date_diff('day', CAST(as_at AS DATE), match_date)) AS to_last
  FROM fx, (SELECT unnest(['2024-07-15', '2024-08-20', '2024-09-10', '2024-09-28', '2025-03-01', '2025-06-01']) AS as_at) WHERE season_label = '{PLAN}' GROUP BY 1)""",
    "fx",
)
entry(
    "window_dates",
    f"""
SELECT {", ".join(_TS(c) for c in ("early_bird_start", "early_bird_end", "member_presale_start", "member_presale_end", "general_public_start"))}
FROM plan ORDER BY event_date, match_id LIMIT 1""",
    "plan",
)
entry(
    "season_mean",
    f"SELECT {r6('avg(v)')} AS season_mean FROM (SELECT season_label, sum(paid_tickets_sold) AS v FROM tx WHERE season_label IN ({BASE}) AND competition = 'BBL' GROUP BY 1)",
    "tx",
)
entry(
    "insight_lines",
    f"""
SELECT 1 AS position, 'Forecast is 30,000 paid tickets behind the selected target. Required run-rate is ' ||
  {thousands("greatest(150000 - paid_tickets_sold, 0) / greatest(days, 1)")} || ' paid tickets per day.' AS insight FROM kpi
UNION ALL SELECT * FROM (SELECT 2, 'Largest fixture watch item: ' || fixture_label || ' is ' || {thousands("abs(forecast - target)")} || ' tickets ' ||
  CASE WHEN forecast - target < 0 THEN 'behind' ELSE 'ahead of' END || ' target.' FROM fxs WHERE season_label = '{PLAN}' ORDER BY forecast - target, fixture_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 3, 'Biggest visible audience contributor is ' || c || ' with ' || {thousands("paid")} || ' paid tickets and ' || printf('%.1f', paid / all_paid * 100) || '% share.'
  FROM (SELECT coalesce(ticket_class, 'Unknown') AS c, sum(paid_tickets_sold) AS paid, sum(sum(paid_tickets_sold)) OVER () AS all_paid FROM now_tx GROUP BY 1) ORDER BY paid DESC, c LIMIT 1)""",
    "kpi", "fxs", "now_tx",
)

for _bucketed in ("customer_lifetime", "purchase_status"):
    ORACLE[f"{_bucketed}_bucketed"] = ORACLE[_bucketed]


def crc_hex(text: str) -> str:
    """CRC-32 of an ASCII text as eight hex digits, bit by bit."""
    bit = "if(b & 1 = 1, xor(b >> 1, 3988292384), b >> 1)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    crc = f"xor(4294967295, list_reduce({codes}, lambda a, x: list_reduce(range(8), lambda b, j: {bit}, xor(a, x)), 4294967295::BIGINT))"
    return f"printf('%08x', {crc})"


entry("row_ids", f"SELECT c_custkey, 'txn_' || {crc_hex("concat_ws('|', c_name, c_mktsegment)")} || '_' || c_custkey AS row_id FROM customer")
entry(
    "fixture_checksums",
    f"""
SELECT fixture_id, id_text, {crc_hex("id_text")} AS checksum
FROM (SELECT fixture_id, competition || '|' || season_label || '|' || strftime(match_date, '%Y-%m-%d') || '|' || opponent || '|' || venue AS id_text FROM fx)""",
    "fx",
)
entry(
    "uploaded_future_fixtures",
    """
SELECT season, season_label, competition, opponent, venue, match_date, 'assumed' AS fixture_status, false AS is_confirmed, true AS is_assumed,
  competition || ' v ' || opponent || ' | ' || strftime(match_date, '%d %b %Y') || ' | TBD / assumed' AS fixture_label, 'Uploaded next-season fixture assumption.' AS notes FROM fx""",
    "fx",
)
entry("csv_trial_rows", "SELECT row_number() OVER (ORDER BY c_custkey) AS source_row_number, CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS account_name FROM customer QUALIFY source_row_number <= 100")
