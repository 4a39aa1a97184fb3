"""Reference SQL for segments, the expected-by-now index and recommendations."""

from __future__ import annotations

from boxline.plans.oracle import AS_AT, BASE, PLAN, entry, part, r6, thousands

# Fixed values, written out here so that a wrong text in the package cannot pass.
DEFINITIONS = {
    "Returning purchasers": "Customers whose first purchase season was before the selected season.",
    "New purchasers": "Customers whose first purchase season is the selected season.",
    "Families": "Family flag or family ticket price/product naming.",
    "18-30s": "Customer age band indicates 18 to 30 where available.",
    "Premium buyers": "Ticket class contains Platinum or Premium.",
    "Gold ticket buyers": "Ticket class contains Gold.",
    "Boundary Zone buyers": "Ticket class contains Boundary Zone.",
    "General Admission buyers": "Ticket class contains General Admission, GA, or Hill.",
    "High basket-size purchasers": "Customer lifetime ticket volume indicates larger baskets.",
    "Low basket-size purchasers": "Customer lifetime ticket volume indicates smaller baskets.",
    "High-value purchasers": "Customer lifetime revenue is in the upper quartile.",
    "Marketable customers": "Marketing, email, or SMS opt-in is true.",
    "Non-marketable customers": "No marketing, email, or SMS opt-in flag is available.",
    "Usual early-window buyers": "Customer usually buys in early-sales, pre-sale, or on-sale windows.",
    "Usual late-window buyers": "Customer usually buys in campaign or match-week windows.",
    "NYE purchasers": "Historical purchase is attached to a 31 December fixture.",
    "WBBL comp recipients": "WBBL rows issued as complimentary tickets.",
    "Paid-ticket-only groups": "Rows representing paid demand, excluding comps and refunds.",
    "Comp-heavy groups": "Rows issued as complimentary tickets.",
}

_BAND = "'18|19|20|21|22|23|24|25|26|27|28|29|30'"
TICKET_SEGMENTS = {
    "Returning purchasers": "customer_purchase_status = 'Returning'",
    "New purchasers": "customer_purchase_status = 'New'",
    "Families": "purchaser_family_flag OR coalesce(family_flag, false) OR regexp_matches(coalesce(price_type, ''), '(?i)family|fam4|fam5') OR regexp_matches(cls, '(?i)family')",
    "18-30s": f"regexp_matches(coalesce(purchaser_age_band, age_band, ''), {_BAND})",
    "Premium buyers": "regexp_matches(cls, '(?i)platinum|premium')",
    "Gold ticket buyers": "regexp_matches(cls, '(?i)gold')",
    "Boundary Zone buyers": "regexp_matches(cls, '(?i)boundary')",
    "General Admission buyers": r"regexp_matches(cls, '(?i)general admission|\bga\b|hill')",
    "High basket-size purchasers": "life >= 12",
    "Low basket-size purchasers": "life > 0 AND life <= 3",
    "High-value purchasers": "value >= cut",
    "Marketable customers": "opted",
    "Non-marketable customers": "NOT opted",
    "Usual early-window buyers": "regexp_matches(usual, '(?i)early|pre-sale|on-sale')",
    "Usual late-window buyers": "regexp_matches(usual, '(?i)campaign|match-week|late')",
    "NYE purchasers": "strftime(match_date, '%m-%d') = '12-31'",
    "WBBL comp recipients": "competition = 'WBBL' AND is_comp",
    "Paid-ticket-only groups": "NOT is_comp AND NOT is_refund",
    "Comp-heavy groups": "is_comp",
}
CUSTOMER_SEGMENTS = {
    "Returning purchasers": "seasons >= 1",
    "Families": "family_flag",
    "18-30s": f"regexp_matches(coalesce(age_band, ''), {_BAND})",
    **{k: TICKET_SEGMENTS[k] for k in ("Premium buyers", "Gold ticket buyers", "Boundary Zone buyers", "General Admission buyers")},
    **{k: TICKET_SEGMENTS[k] for k in ("High basket-size purchasers", "Low basket-size purchasers", "High-value purchasers")},
    **{k: TICKET_SEGMENTS[k] for k in ("Marketable customers", "Non-marketable customers", "Usual early-window buyers", "Usual late-window buyers")},
}

# Ticket rows with customer behaviour.
part(
    "bx",
    """
  SELECT tx.*, coalesce(ticket_class, '') AS cls, c.family_flag, c.age_band, coalesce(c.lifetime_tickets, 0) AS life,
    coalesce(CAST(c.lifetime_revenue AS DOUBLE), 0) AS value, coalesce(c.usual_purchase_window, '') AS usual, c.usual_purchase_window AS usual_or_null,
    tx.marketing_opt_in OR coalesce(c.email_opt_in, false) OR coalesce(c.sms_opt_in, false) AS opted
  FROM tx LEFT JOIN cu c USING (customer_id)""",
    "tx", "cu",
)


def fan(src: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{label}' AS grp FROM {src} WHERE {test}" for label, test in TICKET_SEGMENTS.items())


part("bx_cut", "SELECT *, quantile_cont(value, 0.75) OVER () AS cut FROM bx", "bx")
entry(
    "segment_fanout",
    f"""
SELECT grp AS analysis_group, season_label, count(*) AS rows, {r6("sum(paid_tickets_sold)")} AS paid, count(DISTINCT customer_id) AS customers
FROM ({fan("bx_cut")}) GROUP BY 1, 2""",
    "bx_cut",
)
part(
    "cx",
    """
  SELECT *, quantile_cont(value, 0.75) OVER () AS cut FROM (
    SELECT customer_id, coalesce(family_flag, false) AS family_flag, age_band, coalesce(seasons_purchased_count, 0) AS seasons, coalesce(lifetime_tickets, 0) AS life,
      coalesce(CAST(lifetime_revenue AS DOUBLE), 0) AS value, coalesce(preferred_ticket_class, '') AS cls, coalesce(usual_purchase_window, '') AS usual,
      coalesce(marketing_opt_in, false) OR coalesce(email_opt_in, false) OR coalesce(sms_opt_in, false) AS opted FROM cu)""",
    "cu",
)
part(
    "sizes",
    "SELECT grp, CAST(count(DISTINCT customer_id) AS DOUBLE) AS eligible, CAST(count(DISTINCT CASE WHEN opted THEN customer_id END) AS DOUBLE) AS marketable FROM ("
    + " UNION ALL ".join(f"SELECT customer_id, opted, '{label}' AS grp FROM cx WHERE {test}" for label, test in CUSTOMER_SEGMENTS.items())
    + ") GROUP BY 1",
    "cx",
)
entry("segment_audience_sizes", f"SELECT grp AS analysis_group, {r6('eligible')} AS eligible_audience_size, {r6('marketable')} AS marketable_audience_size FROM sizes", "sizes")

_RANK = {"early-sales": 1, "general-sale": 2, "campaign-window": 3, "match-week": 4}


def rank(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in _RANK.items()) + " ELSE 2 END"


def has(c: str, *words: str) -> str:
    return f"regexp_matches(lower({c}), '{'|'.join(words)}')"


def index_parts(key: str, kind: str, competition: str, seasons: str, min_size: int = 100) -> None:
    """Parts idx_<key>: the whole index of one kind."""
    comp = "true" if competition == "All" else f"competition = '{competition}'"
    # Where the snapshot stands before the next fixture of the plan.
    part(
        f"pt_{key}",
        f"""
  SELECT greatest(coalesce(to_next, to_last, 0), 0) AS threshold,
    CASE WHEN to_next IS NULL OR to_next <= 7 THEN 'match-week' WHEN to_next <= 35 THEN 'campaign-window' WHEN to_next <= 80 THEN 'general-sale' ELSE 'early-sales' END AS cw
  FROM (SELECT min(CASE WHEN event_date >= DATE '{AS_AT}' THEN date_diff('day', DATE '{AS_AT}', event_date) END) AS to_next,
          max(date_diff('day', DATE '{AS_AT}', event_date)) AS to_last FROM plan WHERE {comp})""",
        "plan",
    )
    part(
        f"rows_{key}",
        f"""
  SELECT bx.*, season_label = '{PLAN}' AS is_now, quantile_cont(value, 0.75) OVER (PARTITION BY season_label = '{PLAN}') AS cut
  FROM bx WHERE {comp} AND ((season_label = '{PLAN}' AND transaction_date <= TIMESTAMP '{AS_AT}') OR season_label IN ({seasons}))""",
        "bx",
    )
    if kind == "ticket_type":
        fanned = f"SELECT *, coalesce(price_type, 'Unknown') AS g FROM rows_{key}"
    elif kind == "ticket_class":
        fanned = f"SELECT *, coalesce(ticket_class, 'Unknown') AS g FROM rows_{key}"
    elif kind == "segment":
        fanned = f"SELECT *, grp AS g FROM ({fan(f'rows_{key}')})"
    else:
        fanned = f"SELECT *, grp || ' x ' || coalesce(ticket_class, 'Unknown') AS g FROM ({fan(f'rows_{key}')})"
    part(f"fan_{key}", fanned, f"rows_{key}")
    part(
        f"mode_{key}",
        f"""
  SELECT g, coalesce(max(CASE WHEN k = 'u' AND rn = 1 THEN v END), max(CASE WHEN k = 'w' AND rn = 1 THEN v END)) AS uw FROM (
    SELECT g, k, v, row_number() OVER (PARTITION BY g, k ORDER BY n DESC, v) AS rn FROM (
      SELECT g, 'u' AS k, usual_or_null AS v, count(*) AS n FROM fan_{key} WHERE NOT is_now AND usual_or_null IS NOT NULL GROUP BY 1, 2, 3
      UNION ALL SELECT g, 'w', sales_window, count(*) FROM fan_{key} WHERE NOT is_now GROUP BY 1, 2, 3)) GROUP BY 1""",
        f"fan_{key}",
    )
    n = seasons.count("'") // 2
    m = lambda c, test="true": f"coalesce(sum({c}) FILTER ({test}), 0)"
    part(
        f"past_{key}",
        f"""
  SELECT g, sum(p) / {n} AS f_paid, sum(b) / {n} AS f_buyers, sum(pn) / {n} AS e_paid, sum(tn) / {n} AS e_tickets, CAST(sum(rn) AS DOUBLE) / {n} AS e_revenue, sum(bn) / {n} AS e_buyers
  FROM (
    SELECT season_label, g, sum(paid_tickets_sold) AS p, count(DISTINCT customer_id) AS b, {m("paid_tickets_sold", "due")} AS pn, {m("tickets_sold", "due")} AS tn,
      {m("gross_revenue", "due")} AS rn, count(DISTINCT CASE WHEN due THEN customer_id END) AS bn
    FROM (SELECT *, threshold <= 0 OR coalesce(days_out, -9999) >= threshold AS due FROM fan_{key}, pt_{key}) WHERE NOT is_now GROUP BY 1, 2) GROUP BY 1""",
        f"fan_{key}", f"pt_{key}",
    )
    part(
        f"cur_{key}",
        f"""
  SELECT g, sum(paid_tickets_sold) AS paid, sum(comp_tickets_sold) AS comps, sum(tickets_sold) AS tickets, CAST(sum(gross_revenue) AS DOUBLE) AS revenue,
    count(DISTINCT customer_id) AS buyers, count(DISTINCT order_id) AS orders FROM fan_{key} WHERE is_now GROUP BY 1""",
        f"fan_{key}",
    )
    z = lambda c: f"coalesce({c}, 0)"
    part(
        f"raw_{key}",
        f"""
  SELECT *, CASE WHEN e_paid > 0 THEN paid / e_paid WHEN paid > 0 THEN 1.25 ELSE 0 END AS ti, CASE WHEN e_revenue > 0 THEN revenue / e_revenue WHEN revenue > 0 THEN 1.25 ELSE 0 END AS ri,
    CASE WHEN e_buyers > 0 THEN buyers / e_buyers WHEN buyers > 0 THEN 1.25 ELSE 0 END AS pi, CASE WHEN eligible > 0 THEN buyers / eligible ELSE 0 END AS ar,
    CASE WHEN eligible > 0 THEN e_buyers / eligible ELSE 0 END AS er, CASE WHEN f_paid <> 0 THEN e_paid / f_paid ELSE 0 END AS due, {rank("uw")} > {rank("cw")} AS later
  FROM (
    SELECT coalesce(c.g, p.g) AS g, {z("paid")} AS paid, {z("comps")} AS comps, {z("tickets")} AS tickets, {z("revenue")} AS revenue, {z("buyers")} AS buyers, {z("orders")} AS orders,
      {z("f_paid")} AS f_paid, {z("e_paid")} AS e_paid, {z("e_tickets")} AS e_tickets, {z("e_revenue")} AS e_revenue, {z("e_buyers")} AS e_buyers,
      coalesce(eligible, greatest({z("f_buyers")}, {z("buyers")})) AS eligible, {z("marketable")} AS marketable, coalesce(uw, 'Unknown') AS uw, cw,
      CASE WHEN p.g IS NULL THEN 0 ELSE {n} END AS seasons
    FROM cur_{key} c FULL JOIN past_{key} p ON c.g = p.g LEFT JOIN mode_{key} m ON m.g = coalesce(c.g, p.g) LEFT JOIN sizes s ON s.grp = coalesce(c.g, p.g), pt_{key})""",
        f"cur_{key}", f"past_{key}", f"mode_{key}", "sizes", f"pt_{key}",
    )
    part(
        f"st_{key}",
        f"""
  SELECT *, CASE WHEN paid <= 0 AND (e_paid <= 0 OR (due < 0.08 AND later)) THEN 'Not due yet' WHEN later AND due < 0.12 AND ti < 0.85 THEN 'Not due yet'
      WHEN e_paid <= 0 THEN CASE WHEN paid > 0 THEN 'Ahead' ELSE 'Not due yet' END WHEN ti >= 1.10 THEN 'Ahead' WHEN ti >= 0.95 THEN 'On track' WHEN ti >= 0.85 THEN 'Watch'
      WHEN ti >= 0.70 THEN 'Behind' ELSE 'At risk' END AS status, paid - e_paid AS gap, CASE WHEN er > 0 THEN ar / er WHEN ar > 0 THEN 1.25 ELSE 0 END AS pri,
    greatest(paid, e_paid, f_paid, eligible) >= {min_size} AS big FROM raw_{key}""",
        f"raw_{key}",
    )
    g = "g"
    short = "status IN ('At risk', 'Behind', 'Watch')"
    if kind == "ticket_type":
        definition, product = "'Ticket type / price type equals ' || g || '.'", "g"
    else:
        if kind == "ticket_class":
            definition = "'Ticket class equals ' || g || '.'"
        else:
            other = "Combined audience segment and ticket product group." if kind == "segment_product" else "Aggregated audience segment generated from available ticket and customer fields."
            definition = "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFINITIONS.items()) + f" ELSE '{other}' END"
        product = (
            f"CASE WHEN {has(g, 'boundary')} THEN 'Boundary Zone' WHEN {has(g, 'gold')} THEN 'Gold' WHEN {has(g, 'premium', 'platinum')} THEN 'Premium / Platinum' "
            f"WHEN {has(g, 'general admission', 'ga')} THEN 'General Admission' WHEN {has(g, 'family')} THEN 'Family ticket products' ELSE 'Best available fixture inventory' END"
        )
    angle = (
        f"CASE WHEN {has(g, 'family', 'boundary')} THEN 'Family value, ease of attendance, and urgency before the window closes.' "
        f"WHEN {has(g, 'gold', 'premium', 'platinum')} THEN 'Premium availability and scarcity, not discounting.' "
        f"WHEN {has(g, 'general admission', 'ga')} THEN 'Simple group-ticket value and fixture urgency.' "
        "WHEN gap < -1000 THEN 'Direct response messaging with a clear fixture and product recommendation.' ELSE 'Fixture-specific reminder with availability and timing cues.' END"
    )
    ti = "printf('%.2f', ti)"
    following = f"CASE {rank('cw')} + 1 WHEN 1 THEN 'general-sale' WHEN 2 THEN 'campaign-window' ELSE 'match-week' END"
    part(
        f"idx_{key}",
        f"""
  SELECT g AS analysis_group, {definition} AS definition, {r6("paid")} AS current_paid_tickets, {r6("comps")} AS current_comps, {r6("tickets")} AS current_total_tickets,
    {r6("revenue")} AS current_revenue, {r6("buyers")} AS current_unique_purchasers, {r6("CASE WHEN orders > 0 THEN paid / orders ELSE 0 END")} AS current_average_basket_size,
    {r6("CASE WHEN paid > 0 THEN revenue / paid ELSE 0 END")} AS current_average_ticket_price, {r6("e_paid")} AS expected_paid_tickets_by_now, {r6("e_tickets")} AS expected_total_tickets_by_now,
    {r6("e_revenue")} AS expected_revenue_by_now, {r6("e_buyers")} AS expected_purchasers_by_now, {r6("f_paid")} AS expected_final_paid_tickets, {r6("eligible")} AS eligible_audience_size,
    {r6("marketable")} AS marketable_audience_size, {r6("ar")} AS actual_purchase_rate, {r6("er")} AS expected_purchase_rate, {r6("ti")} AS ticket_index, {r6("ri")} AS revenue_index,
    {r6("pi")} AS purchaser_index, {r6("pri")} AS purchase_rate_index, {r6("gap")} AS paid_ticket_gap, {r6("revenue - e_revenue")} AS revenue_gap, uw AS usual_purchase_window,
    cw AS current_sales_window, status,
    CASE WHEN seasons >= 3 AND greatest(f_paid, eligible) >= 5000 THEN 'High' WHEN seasons >= 2 AND greatest(f_paid, eligible) >= 1000 THEN 'Medium' ELSE 'Directional' END AS confidence,
    CASE WHEN status = 'Not due yet' THEN 'Monitor now and prepare a later-window reminder rather than treating this group as churned.' WHEN {short} THEN 'Prioritise this group in the current marketing plan.'
      WHEN status = 'Ahead' THEN 'Protect yield and avoid discount-led messaging.' ELSE 'Keep planned activity running and watch for mix shifts.' END AS recommended_action,
    CASE WHEN status = 'Not due yet' THEN 'Timing-led reminder when the group reaches its usual purchase window.' WHEN {short} THEN {angle}
      WHEN status = 'Ahead' THEN 'Availability, scarcity, and premium positioning.' ELSE 'Availability and fixture-specific value.' END AS suggested_message_angle,
    CASE WHEN status = 'Not due yet' THEN 'Prepare for ' || CASE WHEN uw <> 'Unknown' THEN uw ELSE {following} END || '.' WHEN {short} THEN 'Act in the ' || cw || ' window.'
      WHEN status = 'Ahead' THEN 'Keep active while demand is ahead of expectation.' ELSE 'Continue through the ' || cw || ' window.' END AS suggested_timing,
    {product} AS suggested_ticket_product,
    CASE WHEN status = 'Not due yet' THEN g || ' is below full-season conversion, but historical behaviour points to later-window purchasing (' || uw || '). Current window is ' || cw || '.'
      WHEN {short} THEN g || ' is ' || {thousands("abs(gap)")} || ' paid tickets ' || CASE WHEN gap < 0 THEN 'behind' ELSE 'ahead of' END || ' expected by now with a ticket index of ' || {ti} || '.'
      WHEN status = 'Ahead' THEN g || ' is ahead of expected paid-ticket volume with a ticket index of ' || {ti} || '.'
      ELSE g || ' is broadly on track with a ticket index of ' || {ti} || '.' END AS rationale, coalesce(big, false) AS meets_min_size
  FROM st_{key}""",
        f"st_{key}",
    )


index_parts("seg", "segment", "All", BASE)
index_parts("typ", "ticket_type", "BBL", BASE)
# Without baseline seasons the latest three labels other than the plan's count.
index_parts("cls", "ticket_class", "BBL", "'2022/23', '2023/24', '2025/26'")
index_parts("pro", "segment_product", "All", BASE)
index_parts("cla", "ticket_class", "All", BASE)
for _name, _key in {
    "expected_index_segment": "seg", "expected_index_ticket_type": "typ", "expected_index_ticket_class": "cls", "expected_index_segment_product": "pro",
}.items():
    entry(_name, f"SELECT * FROM idx_{_key}", f"idx_{_key}")

entry(
    "marketing_recommendations",
    """
SELECT row_number() OVER (ORDER BY status, paid_ticket_gap, analysis_group) AS rank, analysis_group, definition, marketable_audience_size, current_unique_purchasers, expected_purchasers_by_now, actual_purchase_rate, expected_purchase_rate, purchase_rate_index,
  current_paid_tickets, expected_paid_tickets_by_now, paid_ticket_gap, revenue_gap, usual_purchase_window, current_sales_window, recommended_action, suggested_message_angle, suggested_timing,
  suggested_ticket_product, confidence, rationale,
  CASE WHEN ready THEN 'Campaign-ready marketable audience size meets the selected threshold.' ELSE 'Opt-in or marketable size is unavailable/low; use as diagnostic planning evidence.' END AS marketable_note
FROM (SELECT *, bool_or(marketable_audience_size >= 300) OVER () AS ready FROM idx_seg)
WHERE CASE WHEN ready THEN marketable_audience_size >= 300 ELSE eligible_audience_size >= 250 END""",
    "idx_seg",
)
entry(
    "comparison_bars",
    """
SELECT row_number() OVER (ORDER BY expected_paid_tickets_by_now DESC, analysis_group) AS rank, analysis_group, current_paid_tickets, expected_paid_tickets_by_now FROM idx_pro""",
    "idx_pro",
)
_FIELDS = "analysis_group, status, paid_ticket_gap, ticket_index, usual_purchase_window"
_SR = "CASE status WHEN 'At risk' THEN 0 WHEN 'Behind' THEN 1 WHEN 'Watch' THEN 2 WHEN 'Not due yet' THEN 3 WHEN 'On track' THEN 4 ELSE 5 END"
_RISKY = "status IN ('At risk', 'Behind', 'Watch')"
entry(
    "index_report_order",
    f"SELECT row_number() OVER (ORDER BY {_SR}, paid_ticket_gap, expected_final_paid_tickets DESC, analysis_group) AS rank, analysis_group, status, paid_ticket_gap FROM idx_seg",
    "idx_seg",
)
entry(
    "risk_highlights",
    f"""
SELECT * FROM (SELECT 1 AS position, 'audience watch item' AS highlight, {_FIELDS} FROM idx_seg WHERE meets_min_size AND {_RISKY} ORDER BY paid_ticket_gap, {_SR}, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 2, 'not due yet', {_FIELDS} FROM idx_seg WHERE meets_min_size AND status = 'Not due yet' ORDER BY paid_ticket_gap, expected_final_paid_tickets DESC, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 3, 'ticket class watch item', {_FIELDS} FROM idx_cla WHERE meets_min_size AND {_RISKY} ORDER BY paid_ticket_gap, {_SR}, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 4, 'positive trend', {_FIELDS} FROM idx_cla WHERE meets_min_size AND status = 'Ahead' ORDER BY ticket_index DESC, paid_ticket_gap, analysis_group LIMIT 1)""",
    "idx_seg", "idx_cla",
)
entry(
    "risk_highlights_small_scope",
    f"""
SELECT * FROM (SELECT 1 AS position, 'audience watch item' AS highlight, {_FIELDS} FROM idx_seg WHERE {_RISKY} ORDER BY paid_ticket_gap, {_SR}, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 2, 'not due yet', {_FIELDS} FROM idx_seg WHERE status = 'Not due yet' ORDER BY paid_ticket_gap, expected_final_paid_tickets DESC, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 3, 'ticket class watch item', {_FIELDS} FROM idx_cla WHERE {_RISKY} ORDER BY paid_ticket_gap, {_SR}, analysis_group LIMIT 1)
UNION ALL SELECT * FROM (SELECT 4, 'positive trend', {_FIELDS} FROM idx_cla WHERE status = 'Ahead' ORDER BY ticket_index DESC, paid_ticket_gap, analysis_group LIMIT 1)""",
    "idx_seg", "idx_cla",
)
entry(
    "recommended_audiences",
    f"""
SELECT pos AS rank, audience_size >= 20 AS meets_min_size, segment, audience_size, {r6("alt")} AS avg_lifetime_tickets, {r6("alr")} AS avg_lifetime_revenue, {r6("sp")} AS seasons_purchased, usual_purchase_window, {r6("score")} AS likelihood_score,
  {r6("round_even(audience_size * (score / 100) * 1.8, 0)")} AS estimated_ticket_upside,
  CASE WHEN audience_size >= 5000 THEN 'high' WHEN audience_size >= 1000 THEN 'medium' ELSE 'directional' END AS confidence,
  CASE WHEN usual_purchase_window = 'Unknown' THEN 'next available sales window' ELSE usual_purchase_window END AS suggested_timing,
  CASE WHEN regexp_matches(segment, '(?i)family') THEN 'Family value, school-holiday timing, and urgency before window close.' ELSE 'Availability, group purchase ease, and fixture-specific urgency.' END AS suggested_message,
  {thousands("audience_size")} || ' marketable customers have not purchased {PLAN}; historic average is ' || coalesce(printf('%.1f', alt), 'nan') || ' tickets across ' || coalesce(printf('%.1f', sp), 'nan') || ' seasons.' AS rationale
FROM (
  SELECT *, least(greatest(least(greatest(coalesce(sp, 0), 0), 5) * 12 + least(greatest(coalesce(alt, 0), 0), 20) * 1.7 + ln(1 + greatest(coalesce(alr, 0), 0)) * 4, 0), 100) AS score FROM (
    SELECT *, row_number() OVER (ORDER BY audience_size DESC, segment) AS pos FROM (
      SELECT segment, count(DISTINCT customer_id) AS audience_size, avg(lifetime_tickets) AS alt, avg(CAST(lifetime_revenue AS DOUBLE)) AS alr, avg(seasons_purchased_count) AS sp, min(uw) AS usual_purchase_window
      FROM (SELECT *, coalesce(usual_purchase_window, 'Unknown') AS uw, CASE WHEN coalesce(family_flag, false) THEN 'Family' ELSE 'General' END || ' | ' || coalesce(preferred_ticket_class, 'Unknown') || ' | ' || coalesce(usual_purchase_window, 'Unknown') AS segment
            FROM cu WHERE (coalesce(marketing_opt_in, false) OR coalesce(email_opt_in, false) OR coalesce(sms_opt_in, false))
              AND NOT EXISTS (SELECT 1 FROM tx WHERE tx.customer_id = cu.customer_id AND season_label = '{PLAN}' AND transaction_date <= TIMESTAMP '2024-08-15'))
      GROUP BY 1)))""",
    "cu", "tx",
)
entry(
    "early_onsale_segments",
    f"""
SELECT 'ticket_class' AS segment_lens, segment, {r6("paid")} AS early_paid_tickets, customers AS early_customers, {r6("gross")} AS early_revenue, {r6("CAST(gross AS DOUBLE) / paid")} AS early_atp,
  {r6("paid / orders")} AS early_basket_size, {r6("paid / greatest(sum(paid) OVER (), 1) * 100")} AS early_share_pct,
  CASE WHEN {has("segment", "family", "boundary")} THEN 'Use family-value, fixture-date clarity, and early-access urgency in the opening sales window.'
    WHEN {has("segment", "gold", "platinum", "premium")} THEN 'Use premium availability, seat quality, and scarcity messaging rather than discount framing.'
    WHEN {has("segment", "general", "ga", "hill")} THEN 'Use simple group attendance, social proof, and easy entry messaging for early on-sale.'
    ELSE 'Prioritise clear fixture choice, value reassurance, and early-window urgency.' END AS recommendation
FROM (
  SELECT coalesce(ticket_class, 'Unknown') AS segment, sum(paid_tickets_sold) AS paid, sum(gross_revenue) AS gross, count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders
  FROM tx WHERE season_label = '2023/24' AND transaction_date BETWEEN TIMESTAMP '2023-08-01' AND TIMESTAMP '2023-08-31' GROUP BY 1) WHERE paid >= 10""",
    "tx",
)
