"""DuckDB SQL for the catalog: the same results, written independently of the operators."""

from __future__ import annotations

import re

CAMPAIGN = "DATE '2024-01-05' AND DATE '2024-01-26'"

_PARTS: dict[str, str] = {}
_SQL: dict[str, str] = {}


def _part(name: str, sql: str) -> None:
    _PARTS[name] = sql


def _with(body: str) -> str:
    """``body`` under a WITH list of the parts it uses, directly or through others."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z_0-9]+\b", text)) & _PARTS.keys():
            if name not in used:
                used.add(name)
                visit(_PARTS[name])

    visit(body)
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in _PARTS.items() if n in used)
    return f"WITH {ctes}\n{body}" if ctes else body


def _sql(name: str, body: str) -> None:
    _SQL[name] = _with(body)


#: Analyses that give the same rows as another one by other tables.
_SAME_AS = {"customer360_bucketed": "customer360", "retention_overall_bucketed": "retention_overall"}


def oracle() -> dict[str, str]:
    return _SQL | {name: _SQL[other] for name, other in _SAME_AS.items()}


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def _d(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0))"


def _avg(col: str) -> str:
    return _d(f"sum({col})", f"count({col})")


def _avg6(col: str) -> str:
    """Mean of a double through six decimals, as the order-independent mean does."""
    return _avg(f"CAST({col} AS DECIMAL(28,6))")


# --- tables ---------------------------------------------------------------

_part(
    "ev",
    """SELECT user_id AS id, ts, event_id, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS val,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
_part(
    "raw_log",
    """SELECT id, ts, event_id, kind AS event,
    CASE WHEN kind = 'error' THEN 'opened' WHEN kind = 'purchase' AND k % 2 = 0 THEN 'claimed'
         WHEN kind = 'purchase' THEN 'selected' ELSE 'null' END AS action,
    CASE WHEN k % 13 = 12 THEN 'null' WHEN k % 11 = 10 THEN '-1'
         ELSE CAST(k % 23 AS VARCHAR) END AS streak_text,
    CASE WHEN kind IN ('click', 'purchase', 'error')
         THEN CASE k % 4 WHEN 0 THEN 'coupon' WHEN 1 THEN 'win' WHEN 2 THEN 'tip' ELSE 'streak' END
         ELSE 'null' END AS card,
    CASE WHEN kind = 'purchase' AND k % 2 = 1 THEN 'TIER' || (k % 5 + 1) ELSE 'null' END AS code
    FROM ev""",
)
_part(
    "log",
    """SELECT id, ts, event_id, event, nullif(action, 'null') AS action,
    CASE WHEN streak_text = 'null' OR streak_text LIKE '-%' THEN 0
         ELSE CAST(streak_text AS INTEGER) END AS streak,
    nullif(card, 'null') AS card, nullif(code, 'null') AS code, CAST(ts AS DATE) AS day
    FROM raw_log""",
)
_part("camp", f"SELECT * FROM log WHERE day BETWEEN {CAMPAIGN}")
_part(
    "coupons",
    """SELECT id, kind AS event_type, 'TIER' || (k % 5 + 1) AS code, ts, val,
    CASE WHEN k % 2 = 0 THEN 'Percentage' ELSE 'Fixed' END AS value_type
    FROM ev WHERE kind = 'purchase'""",
)
_part(
    "live",
    """SELECT id, event_id AS order_id, ts, CAST(ts AS DATE) AS day, val AS demand,
    CASE WHEN k % 3 = 0 THEN round(val * CAST(0.1 AS DECIMAL(2,1)), 2) ELSE 0 END AS discount,
    CASE WHEN k % 3 = 0 THEN 'TIER' || (k % 5 + 1) END AS code
    FROM ev WHERE kind = 'purchase'""",
)
_part(
    "hist",
    """SELECT o_custkey AS id, o_orderkey AS order_id, o_orderdate AS ts,
    CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS demand,
    CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'pre'
         WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'during' ELSE 'post' END AS period,
    o_orderpriority FROM orders""",
)
_part(
    "line_discount",
    """SELECT l_orderkey AS order_id,
    round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))), 2)
      AS discount
    FROM lineitem GROUP BY l_orderkey""",
)
_part(
    "hist_discount",
    """SELECT h.*, coalesce(d.discount, 0) AS discount,
    CASE WHEN d.discount > 0 THEN o_orderpriority END AS code
    FROM hist h LEFT JOIN line_discount d USING (order_id)""",
)
_part(
    "raw_cust",
    """SELECT c_custkey AS id, c_name AS name,
    CASE WHEN c_custkey % 37 = 0 THEN 'Vrouw' WHEN c_custkey % 41 = 0 THEN 'm'
         WHEN c_custkey % 3 = 0 THEN 'V' WHEN c_custkey % 3 = 1 THEN 'M' END AS gender,
    CASE WHEN c_custkey % 19 = 0 THEN 'null' WHEN c_custkey % 23 = 0 THEN '110-114'
         WHEN c_custkey % 43 = 0 THEN '18-20' WHEN c_custkey % 47 = 0 THEN '20-29'
         ELSE (15 + 5 * (c_custkey % 18)) || '-' || (19 + 5 * (c_custkey % 18)) END AS age,
    n_name AS province,
    CASE WHEN c_custkey % 17 = 0 THEN 'null' ELSE CAST(c_custkey % 12 AS VARCHAR) END AS orders,
    CASE c_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'mobile' ELSE 'desktop' END AS most_used_device,
    CASE WHEN c_custkey % 2 = 0 THEN 'android' ELSE 'ios' END AS most_used_platform,
    c_mktsegment AS most_popular_category,
    CASE WHEN c_custkey % 31 = 0 THEN 'null' ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS urbanisation,
    CASE WHEN c_custkey % 29 = 0 THEN 'null'
         ELSE CAST(2010 + c_custkey % 15 AS VARCHAR) END AS first_order_year
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
_part(
    "cust",
    """SELECT id, gender, age, province, TRY_CAST(orders AS INTEGER) AS orders, most_used_device,
    most_used_platform, most_popular_category, TRY_CAST(urbanisation AS INTEGER) AS urbanisation,
    TRY_CAST(first_order_year AS INTEGER) AS first_order_year FROM raw_cust""",
)
_part(
    "tiers",
    """SELECT * FROM (VALUES ('TIER1', 5, 5), ('TIER2', 10, 10), ('TIER3', 15, 15),
    ('TIER4', 20, 20), ('TIER5', 22, 25)) AS v(code, tier, value)""",
)
_part(
    "reward_days",
    """SELECT DATE '2024-01-05' + CAST(n AS INTEGER) AS date, type,
    upper(type) || day(DATE '2024-01-05' + CAST(n AS INTEGER)) AS code, flat, rate
    FROM (SELECT unnest(range(22)) AS n,
      unnest(['coupon','coupon','win','coupon','tip','coupon','coupon','win','coupon','tip','win',
              'coupon','win','coupon','tip','coupon','coupon','win','coupon','tip','coupon',
              'coupon']) AS type,
      unnest([0,0,0,0,0,5,0,0,0,0,0,0,0,0,0,5,0,0,0,0,0,0]) AS flat,
      unnest([10,10,0,15,0,0,10,0,10,0,0,10,0,15,0,0,20,0,10,0,10,15]) AS rate)""",
)
_part(
    "rewards",
    """SELECT date, type, CAST(NULL AS VARCHAR) AS description, code,
    CAST(flat > 0 AS INTEGER) AS flat_discount, flat AS flat_discount_amount,
    CAST(rate > 0 AS INTEGER) AS percentage_discount, rate AS percentage_rate,
    CAST(flat > 0 OR rate > 0 AS INTEGER) AS has_discount,
    CASE WHEN flat > 0 THEN '€ ' || flat || ' off' WHEN rate > 0 THEN rate || ' % extra'
         WHEN type = 'win' THEN 'Big Win!' WHEN type = 'tip' THEN 'Tip day' END AS reward_label
    FROM reward_days""",
)
_part(
    "ids",
    """SELECT id FROM log UNION SELECT id FROM coupons UNION SELECT id FROM hist
    UNION SELECT id FROM cust""",
)
_part(
    "last_event",
    """SELECT id, streak AS final_streak FROM camp
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1""",
)
_part(
    "eng",
    """SELECT id, count(*) FILTER (event = 'view') AS n_enter,
    count(*) FILTER (event = 'signup') AS n_onboarded,
    count(*) FILTER (event = 'click') AS n_participate,
    count(*) FILTER (event = 'click' OR action = 'opened') AS n_opens,
    count(*) FILTER (action = 'claimed') AS n_claims,
    count(*) AS n_interactions, max(streak) AS max_streak, any_value(final_streak) AS final_streak,
    min(ts) AS first_engagement, max(ts) AS last_engagement,
    min(ts) FILTER (event = 'click') AS first_participate,
    count(*) FILTER (event = 'click') > 0 AS is_participant,
    max(streak) = 22 AS reached_ultimate_streak
    FROM camp JOIN last_event USING (id) GROUP BY id""",
)
_part("part_eng", "SELECT * FROM eng WHERE is_participant")
_part(
    "csum",
    f"""SELECT id, count(*) AS n_coupons_issued, sum(val) AS total_coupon_value,
    {_avg('val')} AS avg_coupon_value, count(*) FILTER (value_type = 'Percentage') AS n_percentage,
    count(*) FILTER (value_type = 'Fixed') AS n_fixed, min(ts) AS first_coupon_date,
    max(ts) AS last_coupon_date FROM coupons GROUP BY id""",
)
_PERIODS = ("pre", "during", "post")


def _order_cols(with_coupons: bool) -> str:
    out = []
    for p in _PERIODS:
        f = f"FILTER (period = '{p}')"
        out += [
            f"count(*) {f} AS n_orders_{p}",
            f"coalesce(sum(demand) {f}, 0) AS total_demand_{p}",
            f"coalesce(CAST(sum(demand) {f} AS DOUBLE) / nullif(count(demand) {f}, 0), 0.0)"
            f" AS avg_order_value_{p}",
        ]
        if with_coupons:
            out += [
                f"count(*) FILTER (period = '{p}' AND (discount > 0 OR code IS NOT NULL))"
                f" AS n_coupon_orders_{p}",
                f"coalesce(sum(discount) {f}, 0) AS total_coupon_discount_{p}",
            ]
    return ",\n".join(out)


def _uplift(metric: str) -> str:
    pre, post = f"{metric}_pre", f"{metric}_post"
    return (
        f"CASE WHEN {pre} > 0 THEN CAST({post} - {pre} AS DOUBLE) / CAST({pre} AS DOUBLE) * 100 END"
    )


_TOTALS = f"""n_orders_pre + n_orders_during + n_orders_post AS total_orders_all_time,
total_demand_pre + total_demand_during + total_demand_post AS total_demand_all_time,
{_uplift('n_orders')} AS order_uplift_pct, {_uplift('total_demand')} AS demand_uplift_pct"""

_part("ord0", f"SELECT id, {_order_cols(False)} FROM hist GROUP BY id")
_part("ord", f"SELECT *, {_TOTALS} FROM ord0")
_part("ordd0", f"SELECT id, {_order_cols(True)} FROM hist_discount GROUP BY id")
_part("ordd", f"SELECT *, {_TOTALS} FROM ordd0")
_ORDER_ZERO = [
    f"{m}_{p}" for p in _PERIODS for m in ("n_orders", "total_demand", "avg_order_value")
] + ["total_orders_all_time", "total_demand_all_time"]
_part(
    "everyone",
    "SELECT id, coalesce(is_participant, FALSE) AS is_participant,"
    " coalesce(max_streak, 0) AS max_streak, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _ORDER_ZERO)
    + ", order_uplift_pct, demand_uplift_pct"
    " FROM ids LEFT JOIN eng USING (id) LEFT JOIN ord USING (id)",
)
_part(
    "profiles",
    """SELECT p.id, n_opens, n_claims, max_streak, c.* EXCLUDE (id)
    FROM part_eng p LEFT JOIN cust c USING (id)""",
)

# --- sources and cleaning -------------------------------------------------

_sql(
    "scan_sources",
    """SELECT 'log' AS "table", count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns FROM log
    UNION ALL SELECT 'coupons', count(*), 6 FROM coupons
    UNION ALL SELECT 'transactions', count(*), 6 FROM live
    UNION ALL SELECT 'customers', count(*), 10 FROM cust""",
)
_CUST_COLS = """gender, age, province, orders, most_used_device, most_used_platform,
most_popular_category, urbanisation, first_order_year"""
_sql("normalize_headers", f"SELECT name AS unique_customer_id, {_CUST_COLS} FROM raw_cust")
_sql(
    "null_scrub",
    """SELECT id AS unique_customer_id, ts AS timestamp, event_id, event,
    nullif(action, 'null') AS action, nullif(streak_text, 'null') AS current_streak_value,
    nullif(card, 'null') AS collectable_type, nullif(code, 'null') AS collectable_value
    FROM raw_log""",
)
_sql(
    "streak_sanitize",
    "SELECT id AS unique_customer_id, event_id, streak AS current_streak_value FROM log",
)
_sql(
    "id_prefix_strip",
    """SELECT CAST(regexp_replace(name, '^Customer#', '') AS BIGINT) AS unique_customer_id,
    gender, age FROM raw_cust""",
)
_sql("campaign_window", "SELECT event, action, count(*) AS n FROM camp GROUP BY event, action")
_sql(
    "tier_mapping",
    """SELECT t.code, t.tier, t.value, count(l.id) AS n_selections,
    count(DISTINCT l.id) AS n_customers
    FROM tiers t LEFT JOIN log l ON l.action = 'selected' AND l.code = t.code
    GROUP BY t.code, t.tier, t.value""",
)

# --- data quality ---------------------------------------------------------

_sql("hourly_orders", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM live GROUP BY 1")
_sql(
    "hourly_boundary",
    """SELECT day AS date, CAST(hour(ts) AS INTEGER) AS utc_hour, count(*) AS n FROM live
    WHERE day IN (DATE '2024-01-14', DATE '2024-01-15', DATE '2024-01-16') GROUP BY 1, 2""",
)
_sql(
    "day_completeness",
    """SELECT day AS date, count(DISTINCT hour(ts)) AS unique_hours, count(*) AS total_orders
    FROM live GROUP BY day HAVING count(DISTINCT hour(ts)) <> 24""",
)
_sql(
    "time_ranges",
    """SELECT 'log' AS "table", min(ts) AS min_time, max(ts) AS max_time FROM log
    UNION ALL SELECT 'coupons', min(ts), max(ts) FROM coupons
    UNION ALL SELECT 'transactions', min(ts), max(ts) FROM hist""",
)
_sql(
    "qualifying_range",
    """SELECT min(day) AS first_day, max(day) AS last_day FROM log
    WHERE event = 'click' OR action = 'opened'""",
)
_KINDS = ("click", "error", "purchase", "signup", "view")
_sql(
    "daily_events_pivot",
    "SELECT day AS date, "
    + ", ".join(f"count(DISTINCT id) FILTER (event = '{e}') AS {e}" for e in _KINDS)
    + " FROM log GROUP BY day",
)
_SOURCES = (("log", "log"), ("coupons", "coupons"), ("transactions", "live"), ("customers", "cust"))
_sql(
    "missing_ids",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(*) FILTER (id IS NULL) AS missing_ids FROM {s}"""
        for n, s in _SOURCES
    ),
)
_sql(
    "id_summary",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(DISTINCT id) AS unique_customers FROM {s}"""
        for n, s in _SOURCES
    ),
)
_sql(
    "id_prefix_share",
    """SELECT round(avg(CASE WHEN name LIKE 'Customer#%' THEN 1.0 ELSE 0.0 END), 6) AS prefix_share
    FROM raw_cust""",
)
_sql(
    "id_length_dist",
    """SELECT 'log' AS "table", CAST(length(CAST(id AS VARCHAR)) AS INTEGER) AS id_length,
    count(*) AS n FROM log GROUP BY 2
    UNION ALL SELECT 'customers', CAST(length(name) AS INTEGER), count(*) FROM raw_cust GROUP BY 2""",
)


def _shared(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {a} INTERSECT SELECT {b}))"


_TXT = "CAST(id AS VARCHAR) FROM"
_sql(
    "key_overlap",
    f"""SELECT 'log' AS left_table, 'customers_raw' AS right_table,
    {_shared(_TXT + ' log', 'name FROM raw_cust')} AS shared_ids
    UNION ALL SELECT 'log', 'transactions', {_shared('id FROM log', 'id FROM hist')}
    UNION ALL SELECT 'coupons', 'transactions', {_shared('id FROM coupons', 'id FROM hist')}
    UNION ALL SELECT 'log', 'customers', {_shared('id FROM log', 'id FROM cust')}""",
)
_part(
    "in_all",
    "SELECT id FROM log INTERSECT SELECT id FROM coupons INTERSECT SELECT id FROM hist",
)
_sql("common_customers", "SELECT CAST(id AS VARCHAR) AS unique_customer_id FROM in_all")
_sql(
    "customer_timeline",
    """SELECT CAST(id AS VARCHAR) AS unique_customer_id, source, what, detail, ts AS timestamp FROM (
    SELECT id, 'log' AS source, event AS what, action AS detail, ts FROM log
    UNION ALL SELECT id, 'coupons', event_type, code, ts FROM coupons
    UNION ALL SELECT id, 'transactions', CAST(order_id AS VARCHAR),
      CAST(CAST(demand AS DECIMAL(28,6)) AS VARCHAR), ts FROM hist) WHERE id IN (SELECT id FROM in_all)""",
)
_sql(
    "distinct_values",
    """SELECT DISTINCT 'event' AS "column", event AS value FROM camp
    UNION ALL SELECT DISTINCT 'action', action FROM camp""",
)
_sql(
    "freq_table",
    """SELECT 'current_streak_value' AS "column", streak_text AS value, count(*) AS n
    FROM raw_log GROUP BY 2
    UNION ALL SELECT 'collectable_value', code, count(*) FROM raw_log GROUP BY 2
    UNION ALL SELECT 'action', action, count(*) FROM raw_log GROUP BY 2""",
)
_SUMMARY = (
    "orders",
    "max_streak",
    "final_streak",
    "n_opens",
    "n_coupons_issued",
    "n_orders_pre",
    "n_orders_post",
    "total_demand_all_time",
    "order_uplift_pct",
)
_part(
    "summary_input",
    """SELECT cust.orders, coalesce(max_streak, 0) AS max_streak,
    coalesce(final_streak, 0) AS final_streak, coalesce(n_opens, 0) AS n_opens,
    coalesce(n_coupons_issued, 0) AS n_coupons_issued, coalesce(n_orders_pre, 0) AS n_orders_pre,
    coalesce(n_orders_post, 0) AS n_orders_post,
    coalesce(total_demand_all_time, 0) AS total_demand_all_time, order_uplift_pct
    FROM ids LEFT JOIN cust USING (id) LEFT JOIN eng USING (id) LEFT JOIN csum USING (id)
    LEFT JOIN ord USING (id)""",
)
_sql(
    "numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null,
        {_r(f'CAST(min({c}) AS DOUBLE)')} AS minimum,
        {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q1,
        {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median,
        {_r(_avg6(c))} AS mean, {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q3,
        {_r(f'CAST(max({c}) AS DOUBLE)')} AS maximum FROM summary_input"""
        for c in _SUMMARY
    ),
)
_sql(
    "non_null_share",
    """SELECT round(avg(CASE WHEN streak_text <> 'null' THEN 1.0 ELSE 0.0 END), 6) AS non_null_share
    FROM raw_log WHERE event = 'click' AND CAST(ts AS DATE) BETWEEN """
    + CAMPAIGN,
)
_part("engaged", "SELECT * FROM camp WHERE event IN ('click', 'purchase', 'error')")
_part("user_days", "SELECT DISTINCT id, day FROM engaged")
_part("click_days", "SELECT DISTINCT id, day FROM camp WHERE event = 'click'")
_sql(
    "duplicate_keys",
    """SELECT id AS unique_customer_id, day AS activity_date, count(*) AS n FROM user_days
    GROUP BY id, day HAVING count(*) > 1""",
)
_sql(
    "duplicate_order_days",
    """SELECT id AS unique_customer_id, day AS order_date, count(*) AS n FROM hist
    GROUP BY id, day HAVING count(*) > 1""",
)
_sql(
    "join_fanout_check",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS joined, (SELECT count(*) FROM ids) AS rows_before,
        (SELECT count(*) FROM ids LEFT JOIN {s} USING (id)) AS rows_after,
        (SELECT count(*) FROM (SELECT id FROM {s} GROUP BY id HAVING count(*) > 1)) AS repeated_keys"""
        for n, s in (("customers", "cust"), ("engagement", "eng"), ("coupons", "csum"), ("orders", "ord"))
    ),
)
_sql("events_per_user", "SELECT id AS unique_customer_id, count(*) AS n FROM engaged GROUP BY id")
_sql(
    "buyers_count",
    """SELECT count(*) AS n_customers, count(*) FILTER (total_orders_all_time > 0) AS n_buyers
    FROM everyone""",
)
_LOCAL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam'"
_sql("tz_compare", f"SELECT event_id, ts AS original, {_LOCAL} AS localised FROM log")
_part(
    "first_selection",
    """SELECT id, code, ts FROM log WHERE action = 'selected' AND code IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, event_id) = 1""",
)
_sql(
    "row_counts",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(*) AS n_rows, count(DISTINCT id) AS unique_customers FROM {s}"""
        for n, s in (
            ("engagement_summary", "eng"),
            ("coupon_summary", "csum"),
            ("order_periods", "ord"),
            ("reward_selection", "first_selection"),
            ("engagement_events", "engaged"),
            ("user_daily_activity", "user_days"),
            ("participation_days", "click_days"),
        )
    ),
)

# --- funnel ---------------------------------------------------------------


def _users(src: str, event: str) -> str:
    return f"SELECT id FROM {src} WHERE event = '{event}'"


def _funnel(src: str) -> str:
    onboarded = f"{_users(src, 'signup')} INTERSECT {_users(src, 'view')}"
    return f"""SELECT CAST(1 AS INTEGER) AS stage_no, 'Entered' AS stage,
    (SELECT count(DISTINCT id) FROM ({_users(src, 'view')})) AS unique_customers
    UNION ALL SELECT 2, 'Onboarded', (SELECT count(*) FROM ({onboarded}))
    UNION ALL SELECT 3, 'Participated',
    (SELECT count(*) FROM ({onboarded} INTERSECT {_users(src, 'click')}))"""


def _conversion(src: str) -> str:
    rate = _d("unique_customers", "lag(unique_customers) OVER (ORDER BY stage_no)")
    return f"SELECT *, {_r(rate)} AS conversion_rate FROM ({_funnel(src)})"


def _independent(src: str) -> str:
    return f"""SELECT count(DISTINCT id) AS total_active_users,
    count(DISTINCT id) FILTER (event = 'view') AS entered,
    count(DISTINCT id) FILTER (event = 'signup') AS onboarded,
    count(DISTINCT id) FILTER (event = 'click') AS participated FROM {src}"""


_sql("funnel_independent", _independent("camp"))
_sql("funnel_sequential", _funnel("camp"))
_sql("funnel_conversion", _conversion("camp"))
_sql(
    "customer_journey",
    f"""SELECT entered, onboarded, {_r(_d('onboarded', 'entered') + ' * 100', 1)} AS onboarded_pct,
    participated, {_r(_d('participated', 'onboarded') + ' * 100', 1)} AS participated_pct
    FROM ({_independent('camp')})""",
)

# --- customer 360 ---------------------------------------------------------

_sql("all_customer_ids", "SELECT id AS unique_customer_id FROM ids")
_sql("engagement_summary", "SELECT id AS unique_customer_id, eng.* EXCLUDE (id) FROM eng")
_COUPON_OUT = f"""n_coupons_issued, CAST(total_coupon_value AS DOUBLE) AS total_coupon_value,
{_r('avg_coupon_value')} AS avg_coupon_value, n_percentage, n_fixed, first_coupon_date,
last_coupon_date, TRUE AS has_coupon"""
_sql("coupon_summary", f"SELECT id AS unique_customer_id, {_COUPON_OUT} FROM csum")


def _order_out(zero: bool) -> str:
    out = []

    def col(c: str, kind: str) -> str:
        value = f"coalesce({c}, 0)" if zero else c
        if kind == "money":
            value = f"CAST({value} AS DOUBLE)"
        elif kind == "rate":
            value = _r(value)
        return f"{value} AS {c}"

    for p in _PERIODS:
        out += [
            col(f"n_orders_{p}", "count"),
            col(f"total_demand_{p}", "money"),
            col(f"avg_order_value_{p}", "rate"),
            col(f"n_coupon_orders_{p}", "count"),
            col(f"total_coupon_discount_{p}", "money"),
        ]
    out += [col("total_orders_all_time", "count"), col("total_demand_all_time", "money")]
    out += [f"{_r(c)} AS {c}" for c in ("order_uplift_pct", "demand_uplift_pct")]
    return ", ".join(out)


_sql("order_periods", f"SELECT id AS unique_customer_id, {_order_out(False)} FROM ordd")
_ENG_COUNTS = (
    "n_enter",
    "n_onboarded",
    "n_participate",
    "n_opens",
    "n_claims",
    "n_interactions",
    "max_streak",
    "final_streak",
)
_sql(
    "customer360",
    f"""SELECT id AS unique_customer_id, gender, age, province, cust.orders AS orders,
    most_used_device, most_used_platform, most_popular_category, urbanisation, first_order_year,
    gender IS NOT NULL AS has_customer_info,
    {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ENG_COUNTS)},
    first_engagement, last_engagement, first_participate,
    coalesce(is_participant, FALSE) AS is_participant,
    coalesce(reached_ultimate_streak, FALSE) AS reached_ultimate_streak,
    coalesce(n_coupons_issued, 0) AS n_coupons_issued,
    CAST(coalesce(total_coupon_value, 0) AS DOUBLE) AS total_coupon_value,
    {_r('coalesce(avg_coupon_value, 0)')} AS avg_coupon_value,
    coalesce(n_percentage, 0) AS n_percentage, coalesce(n_fixed, 0) AS n_fixed,
    first_coupon_date, last_coupon_date, n_coupons_issued IS NOT NULL AS has_coupon,
    {_order_out(True)}
    FROM ids LEFT JOIN cust USING (id) LEFT JOIN eng USING (id) LEFT JOIN csum USING (id)
    LEFT JOIN ordd USING (id)""",
)
_sql(
    "customer_info_match",
    """SELECT gender IS NOT NULL AS has_customer_info, count(*) AS n
    FROM ids LEFT JOIN cust USING (id) GROUP BY 1""",
)
_sql(
    "participant_behaviour",
    f"""SELECT is_participant, count(*) AS n_customers,
    {', '.join(f"{_r(_avg(f'n_orders_{p}'))} AS avg_orders_{p}" for p in _PERIODS)},
    {_r(_avg6('order_uplift_pct'))} AS avg_uplift_pct FROM everyone GROUP BY is_participant""",
)
_sql(
    "sample_profiles",
    """SELECT id AS unique_customer_id, is_participant, max_streak, n_orders_pre, n_orders_post
    FROM everyone ORDER BY md5('7:' || id), id LIMIT 10""",
)

# --- daily engagement and orders -----------------------------------------

_part(
    "opens_by_day",
    """SELECT CAST(c.d AS DATE) AS open_date, count(l.id) AS total_opens,
    count(DISTINCT l.id) AS unique_opens
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-26',
          INTERVAL 1 DAY)) AS d) c
    LEFT JOIN camp l ON l.day = CAST(c.d AS DATE) AND l.event = 'click' GROUP BY 1""",
)
_part(
    "daily_opens",
    f"""SELECT *, (SELECT count(DISTINCT id) FROM camp WHERE event = 'click') AS participants,
    {_r(_d('unique_opens', "(SELECT count(DISTINCT id) FROM camp WHERE event = 'click')") + ' * 100', 2)}
      AS open_rate_pct,
    CAST(date_diff('day', DATE '2024-01-05', open_date) + 1 AS INTEGER) AS campaign_day,
    strftime(open_date, '%a') AS day_of_week, dayofweek(open_date) IN (0, 6) AS is_weekend,
    CASE WHEN lag(unique_opens) OVER (ORDER BY open_date) > 0 THEN
      {_r(_d('unique_opens - lag(unique_opens) OVER (ORDER BY open_date)',
             'lag(unique_opens) OVER (ORDER BY open_date)') + ' * 100', 1)} END AS pct_change
    FROM opens_by_day""",
)
_sql("daily_open_rate", "SELECT * FROM daily_opens")
_RATE = "CAST(open_rate_pct AS DECIMAL(18,2))"


def _mean_rate(condition: str) -> str:
    f = f"FILTER ({condition})"
    return _r(f"CAST(sum({_RATE}) {f} AS DOUBLE) / nullif(count(*) {f}, 0)", 1)


_sql(
    "open_rate_summary",
    f"""SELECT max(participants) AS participants,
    {_r(_d('sum(unique_opens)', 'count(*)'), 1)} AS avg_unique_opens,
    {_mean_rate('TRUE')} AS avg_open_rate, {_mean_rate('NOT is_weekend')} AS avg_open_rate_weekday,
    {_mean_rate('is_weekend')} AS avg_open_rate_weekend, min(pct_change) AS largest_drop_pct
    FROM daily_opens""",
)
_sql(
    "largest_drop",
    """SELECT * FROM (SELECT open_date, unique_opens,
    unique_opens - lag(unique_opens) OVER (ORDER BY open_date) AS change FROM opens_by_day)
    WHERE change IS NOT NULL ORDER BY change, open_date LIMIT 1""",
)
_part(
    "cards",
    f"""SELECT o.card AS collectable_type, opens, coalesce(claims, 0) AS claims,
    {_r(_d('coalesce(claims, 0)', 'opens') + ' * 100', 2)} AS claim_rate
    FROM (SELECT card, count(DISTINCT id) AS opens FROM camp
          WHERE event = 'click' AND card IS NOT NULL GROUP BY card) o
    LEFT JOIN (SELECT card, count(DISTINCT id) AS claims FROM camp
          WHERE action = 'claimed' GROUP BY card) c USING (card)""",
)
_sql("card_performance", "SELECT * FROM cards")
_sql(
    "best_card",
    """SELECT collectable_type, claim_rate FROM cards
    ORDER BY claim_rate DESC, collectable_type LIMIT 1""",
)
_part(
    "orders_by_day",
    """SELECT day AS order_date, count(DISTINCT id) AS unique_customers, count(*) AS total_orders,
    CAST(sum(demand) AS DOUBLE) AS total_demand, strftime(day, '%a') AS day_of_week,
    dayofweek(day) IN (0, 6) AS is_weekend,
    CASE WHEN day < DATE '2024-01-05' THEN 'Pre' WHEN day <= DATE '2024-01-26' THEN 'During'
         ELSE 'Post' END AS campaign_period
    FROM live WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY day""",
)
_part(
    "activity_by_day",
    """SELECT day, count(*) AS participate_count, count(DISTINCT id) AS unique_active_users
    FROM log WHERE event = 'click' AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
    GROUP BY day""",
)
_sql("daily_orders", "SELECT * FROM orders_by_day")
_sql("daily_activity", "SELECT * FROM activity_by_day")
_ACTIVITY = """coalesce(participate_count, 0) AS participate_count,
coalesce(unique_active_users, 0) AS unique_active_users"""
_sql(
    "reward_calendar",
    f"""SELECT r.*, {_ACTIVITY} FROM rewards r LEFT JOIN activity_by_day a ON a.day = r.date""",
)
_part(
    "full_days",
    f"""SELECT o.*, {_ACTIVITY}, r.* EXCLUDE (date, reward_label),
    coalesce(reward_label, 'No reward') AS reward_label,
    flat_discount_amount >= 5 OR percentage_rate >= 15 OR type = 'win' AS is_high_value
    FROM orders_by_day o LEFT JOIN activity_by_day a ON a.day = o.order_date
    LEFT JOIN rewards r ON r.date = o.order_date""",
)
_sql("daily_full", "SELECT * FROM full_days")
_sql(
    "top_days",
    """SELECT order_date, unique_customers, total_orders, total_demand, participate_count,
    unique_active_users, reward_label, is_high_value, day_of_week, is_weekend, campaign_period
    FROM full_days ORDER BY unique_customers DESC, order_date LIMIT 15""",
)
_sql(
    "scale_factor",
    f"SELECT {_r(_d('max(unique_customers)', 'max(unique_active_users)'))} AS scale_factor FROM full_days",
)

# --- streak levels and card opens ----------------------------------------

_sql("user_max_streak", "SELECT id AS unique_customer_id, max_streak FROM part_eng")
_sql(
    "ultimate_streak",
    f"""SELECT count(*) AS total_participants, count(*) FILTER (max_streak = 22) AS ultimate_users,
    {_r(_d('count(*) FILTER (max_streak = 22)', 'count(*)') + ' * 100', 2)} AS pct_ultimate
    FROM part_eng""",
)
_sql(
    "long_streak_share",
    f"""SELECT count(*) AS total_participants, count(*) FILTER (max_streak >= 7) AS long_streak_users,
    {_r(_d('count(*) FILTER (max_streak >= 7)', 'count(*)') + ' * 100', 2)} AS pct_long_streak
    FROM part_eng""",
)


def _distribution(col: str) -> str:
    return f"""SELECT {col}, count(*) AS n,
    {_r(_d('count(*)', 'sum(count(*)) OVER ()') + ' * 100')} AS percentage
    FROM part_eng GROUP BY {col}"""


_sql("streak_distribution", _distribution("max_streak"))
_sql("opens_distribution", _distribution("n_opens"))


def _streak_stats(src: str, total: str) -> str:
    return f"""SELECT count(*) AS {total},
    (SELECT max_streak FROM {src} GROUP BY max_streak ORDER BY count(*) DESC, max_streak LIMIT 1)
      AS most_common_streak,
    (SELECT count(*) FROM {src} GROUP BY max_streak ORDER BY count(*) DESC LIMIT 1) AS most_common_n,
    {_r(_avg('max_streak'))} AS avg_max_streak,
    {_r('quantile_cont(CAST(max_streak AS DOUBLE), 0.5)')} AS median_max_streak FROM {src}"""


_sql("streak_stats", _streak_stats("part_eng", "total_participants"))
_sql("streak_stats_all_customers", _streak_stats("everyone", "total_customers"))
_sql(
    "opens_stats",
    f"""SELECT min(n_opens) AS min_opens,
    {_r('quantile_cont(CAST(n_opens AS DOUBLE), 0.5)')} AS median_opens,
    {_r(_avg('n_opens'))} AS mean_opens, max(n_opens) AS max_opens FROM part_eng""",
)


def _histogram(col: str, width: int) -> str:
    return f"""SELECT CAST(ceil({col} / {width}.0 - 0.5) * {width} AS BIGINT) AS bin_centre,
    count(*) AS n FROM part_eng GROUP BY 1"""


_sql("histogram_opens", _histogram("n_opens", 5))
_sql("histogram_streak", _histogram("max_streak", 1))

# --- segmentation ---------------------------------------------------------

_GENDER = """CASE WHEN gender IN ('V', 'v', 'Vrouw') THEN 'Female'
WHEN gender IN ('M', 'm', 'Man') THEN 'Male' ELSE 'Unknown' END"""
_LOW = "TRY_CAST(nullif(regexp_extract(age, '^([0-9]+)', 1), '') AS INTEGER)"


def _age_group(unknown: str) -> str:
    return f"""CASE WHEN {_LOW} IS NULL OR {_LOW} < 15 OR {_LOW} > 99 THEN '{unknown}'
    WHEN {_LOW} <= 24 THEN '15-24' WHEN {_LOW} <= 34 THEN '25-34' WHEN {_LOW} <= 44 THEN '35-44'
    WHEN {_LOW} <= 54 THEN '45-54' WHEN {_LOW} <= 64 THEN '55-64' ELSE '65+' END"""


def _segment(keys: dict[str, str], src: str = "profiles", digits: int = 1, median: bool = False) -> str:
    names = list(keys)
    extra = (
        f", {_r('quantile_cont(CAST(max_streak AS DOUBLE), 0.5)', digits)} AS median_max_streak"
        if median
        else ""
    )
    return f"""SELECT {', '.join(f'{e} AS {n}' for n, e in keys.items())},
    count(*) AS n_participants, {_r(_avg('n_opens'), digits)} AS avg_opens,
    {_r(_d('count(*) FILTER (n_opens > 1)', 'count(*)') + ' * 100', digits)} AS repeat_open_rate,
    {_r(_d('count(*) FILTER (n_claims > 0)', 'count(*)') + ' * 100', digits)} AS claim_rate,
    {_r(_avg('max_streak'), digits)} AS avg_max_streak{extra}
    FROM {src} GROUP BY {', '.join(str(i + 1) for i in range(len(names)))}"""


_sql("segment_gender", _segment({"gender_clean": _GENDER}, digits=2))
_sql("segment_age", _segment({"age_group": _age_group("Unknown / Error")}, median=True))
_sql(
    "age_recode_audit",
    f"""SELECT CASE WHEN age IS NULL OR age IN ('null', 'NA') THEN 'Missing/null'
    WHEN {_LOW} >= 100 THEN 'Error (100+)' ELSE 'Valid' END AS age_valid, count(*) AS n
    FROM profiles GROUP BY 1""",
)
_sql(
    "segment_age_gender",
    _segment({"age_group": _age_group("Unknown"), "gender_clean": _GENDER}),
)
for _key, _column in (
    ("segment_device", "most_used_device"),
    ("segment_platform", "most_used_platform"),
    ("segment_category", "most_popular_category"),
    ("segment_province", "province"),
):
    _sql(_key, _segment({_column: _column}, median=True))
_sql(
    "segment_urban",
    _segment(
        {
            "urban_level": """CASE WHEN urbanisation <= 2 THEN 'Low (rural/suburban)'
            WHEN urbanisation = 3 THEN 'Medium' WHEN urbanisation >= 4 THEN 'High (urban)'
            ELSE 'Unknown' END"""
        },
        median=True,
    ),
)
_sql(
    "segment_tenure",
    _segment(
        {
            "tenure": """CASE WHEN first_order_year IS NULL THEN 'Unknown'
            WHEN first_order_year >= 2023 THEN 'New (2023-2024)'
            WHEN first_order_year >= 2016 THEN 'Established (2016-2022)'
            ELSE 'Legacy Loyalists (≤2015)' END"""
        }
    ),
)
_part(
    "part_orders",
    """SELECT p.*, coalesce(n_orders_pre, 0) AS orders_before
    FROM part_eng p LEFT JOIN ord USING (id)""",
)
_sql(
    "segment_orders",
    _segment(
        {
            "order_segment": """CASE WHEN orders_before <= 1 THEN 'Low (0-1)'
            WHEN orders_before <= 5 THEN 'Medium (2-5)' ELSE 'High (6+)' END"""
        },
        src="part_orders",
    ),
)
_sql(
    "segment_streak",
    _segment(
        {
            "streak_segment": """CASE WHEN max_streak <= 1 THEN 'Low (1 day)'
            WHEN max_streak <= 5 THEN 'Medium (2-5 days)' ELSE 'High (6+ days)' END"""
        },
        src="part_eng",
    ),
)

# --- reward selection -----------------------------------------------------

_sql(
    "reward_selection",
    """SELECT id AS unique_customer_id, code AS collectable_value, ts AS timestamp,
    tier AS selected_tier FROM first_selection LEFT JOIN tiers USING (code)""",
)
_part(
    "chosen",
    """SELECT id, tier, coalesce(max_streak, 0) AS max_streak, coalesce(final_streak, 0) AS final_streak
    FROM first_selection JOIN tiers USING (code) LEFT JOIN eng USING (id)""",
)


def _pct_where(condition: str) -> str:
    return _r(_d(f"count(*) FILTER ({condition})", "count(*)") + " * 100")


_sql(
    "selection_vs_streak",
    f"""SELECT count(*) AS total_selectors,
    {_pct_where('tier > final_streak')} AS pct_selected_above_final_streak,
    {_pct_where('tier > max_streak')} AS pct_selected_above_max_streak FROM chosen""",
)
_sql(
    "corr_tier_streak",
    f"""SELECT {_r('corr(tier, max_streak)')} AS cor_max,
    {_r('corr(tier, final_streak)')} AS cor_final FROM chosen""",
)
_sql(
    "edge_cases",
    """SELECT id AS unique_customer_id, max_streak, final_streak, tier AS selected_tier
    FROM chosen WHERE final_streak <= 2 AND tier >= 10""",
)
_TIERS = (5, 10, 15, 20, 22)


def _crosstab(streak: str) -> str:
    cells = ", ".join(f"count(*) FILTER (tier = {t}) AS tier_{t}" for t in _TIERS)
    return f"SELECT {streak}, {cells} FROM chosen GROUP BY {streak}"


_sql("crosstab_max_tier", _crosstab("max_streak"))
_sql("crosstab_final_tier", _crosstab("final_streak"))
_sql(
    "selection_totals",
    "SELECT " + ", ".join(f"count(*) FILTER (tier = {t}) AS tier_{t}" for t in _TIERS) + " FROM chosen",
)
_sql(
    "tier_logged_streak",
    f"""SELECT code AS collectable_value, {_r(_avg('streak'))} AS avg_logged_streak,
    {_r('quantile_cont(CAST(streak AS DOUBLE), 0.5)')} AS median_logged_streak,
    min(streak) AS min_logged_streak, max(streak) AS max_logged_streak, count(*) AS n
    FROM log WHERE action = 'selected' AND code IS NOT NULL GROUP BY code""",
)
_sql(
    "down_selection",
    f"""SELECT count(*) AS total_selectors, {_pct_where('tier < max_streak')} AS pct_down_selected,
    {_pct_where('tier = max_streak')} AS pct_equal_selected,
    {_pct_where('tier > max_streak')} AS pct_over_selected FROM chosen""",
)
_part(
    "basket",
    f"""SELECT id, count(*) AS n_pre, sum(demand) AS demand_pre, {_d('sum(demand)', 'count(*)')} AS abv
    FROM hist WHERE period = 'pre' GROUP BY id""",
)
_sql(
    "historic_basket",
    f"""SELECT id AS unique_customer_id, n_pre AS n_orders_pre,
    CAST(demand_pre AS DOUBLE) AS total_demand_pre, {_r('abv')} AS historic_abv FROM basket""",
)
_sql(
    "corr_abv_tier",
    f"SELECT {_r('corr(abv, tier)')} AS cor_abv_tier FROM chosen LEFT JOIN basket USING (id)",
)
_sql(
    "basket_by_tier",
    f"""SELECT tier AS selected_tier, count(*) AS n_users, count(abv) AS n_with_history,
    {_r(_avg6('abv'))} AS avg_historic_abv, {_r(_avg('n_pre'))} AS avg_orders_pre,
    {_r('quantile_cont(abv, 0.5)')} AS median_historic_abv
    FROM chosen LEFT JOIN basket USING (id) GROUP BY tier""",
)
_sql(
    "basket_by_downselect",
    f"""SELECT down_selected, count(*) AS n_users, {_r(_avg6('v'))} AS avg_historic_abv,
    {_r('quantile_cont(v, 0.5)')} AS median_historic_abv
    FROM (SELECT tier < max_streak AS down_selected, coalesce(avg_order_value_pre, 0) AS v
          FROM chosen LEFT JOIN ord USING (id)) GROUP BY down_selected""",
)

# --- impact ---------------------------------------------------------------

_sql(
    "impact_participants",
    f"""SELECT is_participant, {_r(_avg('n_orders_during'))} AS avg_orders_during,
    {_r(_avg('total_demand_during'))} AS avg_demand_during, count(*) AS n_customers
    FROM everyone GROUP BY is_participant""",
)
_sql(
    "corr_streak_orders",
    f"""SELECT {_r('corr(max_streak, n_orders_during)')} AS cor_orders,
    {_r('corr(max_streak, CAST(total_demand_during AS DOUBLE))')} AS cor_demand FROM everyone""",
)
_GROUP = """CASE WHEN max_streak = 1 THEN 'One-day users' WHEN max_streak <= 5 THEN 'Low engagement'
WHEN max_streak <= 15 THEN 'Medium engagement' ELSE 'High engagement' END"""
_sql(
    "streak_impact",
    f"""SELECT {_GROUP} AS streak_group, {_r(_avg('n_orders_during'))} AS avg_orders_during,
    {_r(_avg('total_demand_during'))} AS avg_demand_during, count(*) AS customers
    FROM everyone GROUP BY 1""",
)
_sql(
    "lift_analysis",
    f"""SELECT is_participant, {_r(_avg('(n_orders_during - n_orders_pre)'))} AS avg_order_lift,
    {_r(_avg('(total_demand_during - total_demand_pre)'))} AS avg_demand_lift,
    count(*) AS customers FROM everyone GROUP BY is_participant""",
)


def _log1p(x: str) -> str:
    return f"""CASE WHEN abs({x}) < 1e-5 THEN {x} - ({x}) * ({x}) / 2 + ({x}) * ({x}) * ({x}) / 3
      ELSE ln(1 + ({x})) END"""


def _tail(select: str, source: str, start: str, low: str, high: str, height: str) -> str:
    """Rows of ``source`` with ``p_value``: the share above ``start`` of the integral of
    ``height`` of ``y`` from ``low`` to ``high``, by Simpson's rule."""
    return f"""SELECT {select}, {_r("""CASE WHEN z0 >= z2 THEN 0 ELSE least(1,
      (z2 - z0) * (SELECT sum(w * h0) FROM nodes) / ((z2 - z1) * (SELECT sum(w * h1) FROM nodes))) END""")} AS p_value
    FROM (SELECT *, greatest(z1, {start}) AS z0 FROM (SELECT *, {low} AS z1, {high} AS z2 FROM ({source})))""".replace(
        "(SELECT sum(w * h0) FROM nodes)", _nodes("z0", height)
    ).replace("(SELECT sum(w * h1) FROM nodes)", _nodes("z1", height))


def _nodes(low: str, height: str) -> str:
    at = f"({low} + (z2 - {low}) * k / 1000.0)"
    return f"""(SELECT sum(CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
      * {height.replace('@', at)}) FROM range(0, 1001) r(k))"""


def _f_tail(select: str, source: str, f: str, between: str, within: str) -> str:
    """``_tail`` of the F distribution."""
    p, q = f"({between} - 1.0)", f"({within} - 1.0)"
    peaked = f"""SELECT *, CASE WHEN {p} + {q} > 0 THEN atan2(sqrt({p}), sqrt({q})) ELSE 0 END AS peak,
      CASE WHEN {p} + {q} > 0 THEN 1 / sqrt(2 * ({p} + {q})) ELSE pi() / 2 END AS width FROM ({source})"""
    moved = "sin(@ - peak) * sin(@ + peak)"

    def part(power: str, x: str) -> str:
        return f"CASE WHEN {power} = 0 THEN 0 WHEN {x} > -1 THEN {power} / 2 * ({_log1p(x)}) ELSE -700 END"

    sines = part(p, f"({moved} / pow(sin(peak), 2))")
    cosines = part(q, f"(-{moved} / pow(cos(peak), 2))")
    return _tail(
        select, peaked, f"atan(sqrt({between} * {f} / {within}))", "greatest(0, peak - 12 * width)",
        "least(pi() / 2, peak + 12 * width)", f"exp(greatest(-700, {sines} + {cosines}))",
    )


def _chi_tail(select: str, source: str, x: str, dof: str) -> str:
    """``_tail`` of the chi-square distribution."""
    power = f"({dof} - 1.0)"
    away = "((@ - peak) / peak)"
    relative = f"{power} * ({_log1p(away)} - {away} - {away} * {away} / 2)"
    height = f"""exp(greatest(-700, CASE WHEN {power} = 0 THEN -@ * @ WHEN {away} > -1 THEN {relative}
      ELSE -700 END))"""
    peaked = f"SELECT *, sqrt({power} / 2) AS peak FROM ({source})"
    return _tail(select, peaked, f"sqrt({x} / 2)", "greatest(0, peak - 9.0)", "peak + 9.0", height)


def _fitted(y: str) -> str:
    cy = f"CAST({y} AS DOUBLE)"
    return f"""SELECT n, b0, b1, r2, sqrt(rss / (n - 2) / sxx) AS se1,
      sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se0
      FROM (SELECT regr_intercept({cy}, max_streak) AS b0, regr_slope({cy}, max_streak) AS b1,
        regr_r2({cy}, max_streak) AS r2, count(*) AS n, regr_sxx({cy}, max_streak) AS sxx,
        regr_avgx({cy}, max_streak) AS mx,
        regr_syy({cy}, max_streak) * (1 - regr_r2({cy}, max_streak)) AS rss FROM everyone)"""


def _ols(y: str) -> str:
    return f"""SELECT n, {_r('b0')} AS intercept, {_r('se0')} AS intercept_se,
    {_r('b0 / se0')} AS intercept_t, {_r('b1')} AS slope, {_r('se1')} AS slope_se,
    {_r('b1 / se1')} AS slope_t, {_r('r2')} AS r2,
    {_r('1 - (1 - r2) * (n - 1) / (n - 2)')} AS adj_r2, {_r('(b1 / se1) * (b1 / se1)')} AS f_statistic
    FROM ({_fitted(y)})"""


def _p_values(y: str) -> str:
    terms = f"""SELECT 'max_streak' AS term, b1 AS b, se1 AS se, n FROM ({_fitted(y)})
      UNION ALL SELECT '(Intercept)', b0, se0, n FROM ({_fitted(y)})"""
    select = f"term, {_r('b')} AS estimate, {_r('se')} AS std_error, {_r('b / se')} AS t_value"
    return _f_tail(select, terms, "((b / se) * (b / se))", "1", "(n - 2)")


_sql("ols_streak_orders_p_values", _p_values("n_orders_during"))
_sql("ols_streak_demand_p_values", _p_values("total_demand_during"))
_sql("ols_streak_orders", _ols("n_orders_during"))
_sql("ols_streak_demand", _ols("total_demand_during"))
_DAYS = {
    "pre": "date_diff('day', DATE '1995-01-01', DATE '1997-12-31') + 1",
    "during": "date_diff('day', DATE '1998-01-01', DATE '1998-12-31') + 1",
    "post": "date_diff('day', DATE '1999-01-01', DATE '2001-08-01') + 1",
}
_RATE_COLS = ", ".join(
    f"{_avg(f'{col}_{p}')} / ({n}) AS avg_{name}_per_day_{p}"
    for p, n in _DAYS.items()
    for name, col in (("orders", "n_orders"), ("demand", "total_demand"))
)
_RATE_NAMES = [f"avg_{m}_per_day_{p}" for p in _DAYS for m in ("orders", "demand")]
_RATE_OUT = ", ".join(f"{_r(c)} AS {c}" for c in _RATE_NAMES)
_part("all_rates", f"SELECT {_RATE_COLS} FROM everyone")
_part(
    "group_rates",
    f"SELECT is_participant, count(*) AS n_customers, {_RATE_COLS} FROM everyone GROUP BY is_participant",
)
_sql("period_rates", f"SELECT {_RATE_OUT} FROM all_rates")
_sql("period_rates_by_group", f"SELECT is_participant, n_customers, {_RATE_OUT} FROM group_rates")


def _change(metric: str) -> str:
    pre, during = f"avg_{metric}_per_day_pre", f"avg_{metric}_per_day_during"
    return _r(f"({during} - {pre}) / {pre} * 100")


_sql(
    "campaign_lift",
    f"SELECT {_change('orders')} AS orders_lift_pct, {_change('demand')} AS demand_lift_pct FROM all_rates",
)
_part("treated", "SELECT * FROM group_rates WHERE is_participant")
_part("control", "SELECT * FROM group_rates WHERE NOT is_participant")
_sql(
    "participant_ratio",
    f"""SELECT {_r('t.avg_orders_per_day_during / c.avg_orders_per_day_during')} AS orders_ratio,
    {_r('t.avg_demand_per_day_during / c.avg_demand_per_day_during')} AS demand_ratio
    FROM treated t LEFT JOIN control c ON TRUE""",
)
_sql(
    "incremental_impact",
    f"""SELECT {_r('did')} AS incremental_daily_demand, {_r('did * 22')} AS incremental_per_participant,
    {_r('did * 22 * n')} AS total_incremental
    FROM (SELECT (t.avg_demand_per_day_during - t.avg_demand_per_day_pre)
      - (c.avg_demand_per_day_during - c.avg_demand_per_day_pre) AS did, t.n_customers AS n
      FROM treated t LEFT JOIN control c ON TRUE)""",
)
_SEGMENT = """CASE WHEN NOT is_participant THEN 'Non-participants'
WHEN max_streak = 1 THEN 'One-day users' WHEN max_streak BETWEEN 2 AND 5 THEN 'Low engagement'
WHEN max_streak BETWEEN 6 AND 14 THEN 'Medium engagement'
WHEN max_streak >= 15 THEN 'High engagement (loyal core)' END"""
_sql(
    "pre_post_engagement",
    f"""SELECT {_SEGMENT} AS engagement_segment, count(*) AS n_users,
    {', '.join(f'''{_r(_avg(f'n_orders_{p}'))} AS avg_orders_{p},
    {_r(_avg(f'total_demand_{p}'))} AS avg_demand_{p},
    {_r(_avg6(f'avg_order_value_{p}'))} AS avg_aov_{p}''' for p in ('pre', 'post'))},
    {_r(_avg6('order_uplift_pct'))} AS avg_order_uplift_pct,
    {_r(_avg6('demand_uplift_pct'))} AS avg_demand_uplift_pct FROM everyone GROUP BY 1""",
)
_sql(
    "pre_post_change",
    f"""SELECT {_SEGMENT} AS engagement_segment, count(*) AS n_users,
    {_r(_avg('(n_orders_post - n_orders_pre)'))} AS orders_change,
    {_r(_avg('(total_demand_post - total_demand_pre)'))} AS demand_change,
    {_r(_avg6('(avg_order_value_post - avg_order_value_pre)'))} AS aov_change
    FROM everyone GROUP BY 1""",
)
_part("grouped", f"SELECT {_GROUP} AS g, CAST(n_orders_during AS DOUBLE) AS y FROM everyone")
_part(
    "varied",
    """SELECT k - 1 AS d1, n - k AS d2, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) AS f
    FROM (SELECT count(DISTINCT g) AS k, count(*) AS n,
      sum((group_mean - grand_mean) * (group_mean - grand_mean)) AS ssb,
      sum((y - group_mean) * (y - group_mean)) AS ssw
      FROM (SELECT g, y, avg(y) OVER (PARTITION BY g) AS group_mean, avg(y) OVER () AS grand_mean
        FROM grouped))""",
)
_sql(
    "anova_streak_orders",
    _f_tail(
        f"""d1 AS df_between, d2 AS df_within, {_r('ssb')} AS ss_between, {_r('ssw')} AS ss_within,
        {_r('f')} AS f_statistic""",
        "SELECT * FROM varied", "f", "d1", "d2",
    ),
)
_part("flags", "SELECT is_participant AS a, n_orders_during > 0 AS b FROM everyone")
_part(
    "tested",
    """SELECT CAST(sum(o) AS BIGINT) AS n,
    (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
    sum((o - e) * (o - e) / e) AS chi_square
    FROM (SELECT ra.a, rb.b, coalesce(c.o, 0) AS o, ra.t * rb.t / t.t AS e
      FROM (SELECT a, CAST(count(*) AS DOUBLE) AS t FROM flags GROUP BY a) ra
      JOIN (SELECT b, CAST(count(*) AS DOUBLE) AS t FROM flags GROUP BY b) rb ON TRUE
      JOIN (SELECT CAST(count(*) AS DOUBLE) AS t FROM flags) t ON TRUE
      LEFT JOIN (SELECT a, b, CAST(count(*) AS DOUBLE) AS o FROM flags GROUP BY a, b) c
        ON c.a = ra.a AND c.b = rb.b)""",
)
_sql(
    "chi_square_participation_buying",
    _chi_tail(f"n, dof, {_r('chi_square')} AS chi_square", "SELECT * FROM tested", "chi_square", "dof"),
)

# --- ingest ---------------------------------------------------------------


def _rejects(table: str, source: str, column: str, given: str, bad: str) -> str:
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", count(*) FILTER ({given}) AS n_values,
    count(*) FILTER ({bad}) AS n_rejected FROM {source}"""


def _no_number(column: str) -> tuple[str, str]:
    given = f"{column} IS NOT NULL AND trim({column}) NOT IN ('', 'null')"
    return given, f"{given} AND TRY_CAST({column} AS INTEGER) IS NULL"


_part("sales", "SELECT * FROM ev WHERE kind = 'purchase'")
_sql(
    "source_rejects",
    " UNION ALL ".join(
        _rejects(*r)
        for r in (
            ("log", "ev", "unique_customer_id", "TRUE", "event_id % 89 = 0 OR id IS NULL"),
            ("log", "ev", "timestamp", "ts IS NOT NULL OR event_id % 101 = 0", "event_id % 101 = 0"),
            ("log", "ev", "event_id", "event_id IS NOT NULL", "event_id % 97 = 0"),
            ("log", "raw_log", "current_streak_value", *_no_number("streak_text")),
            ("log", "ev", "_corrupt_record", "TRUE", "FALSE"),
            ("coupons", "sales", "unique_customer_id", "TRUE", "id IS NULL"),
            ("coupons", "sales", "timestamp", "ts IS NOT NULL", "FALSE"),
            ("coupons", "sales", "value", "val IS NOT NULL OR event_id % 23 = 0", "event_id % 23 = 0"),
            ("coupons", "sales", "_corrupt_record", "TRUE", "FALSE"),
            ("transactions", "sales", "unique_customer_id", "TRUE", "id IS NULL"),
            ("transactions", "sales", "order_local_timestamp", "ts IS NOT NULL", "FALSE"),
            ("transactions", "sales", "demand", "val IS NOT NULL OR event_id % 19 = 0", "event_id % 19 = 0"),
            ("transactions", "sales", "coupon_discount", "k % 3 <> 0 OR k IS NULL OR val IS NOT NULL", "FALSE"),
            ("transactions", "sales", "_corrupt_record", "TRUE", "FALSE"),
            ("customers", "raw_cust", "unique_customer_id", "TRUE", "id % 53 = 0"),
            ("customers", "raw_cust", "orders", *_no_number("orders")),
            ("customers", "raw_cust", "urbanisation", *_no_number("urbanisation")),
            ("customers", "raw_cust", "first_order_year", *_no_number("first_order_year")),
            ("customers", "raw_cust", "_corrupt_record", "TRUE", "FALSE"),
        )
    ),
)
_part("logged", "SELECT *, CASE WHEN event_id % 89 = 0 THEN 'null' ELSE CAST(id AS VARCHAR) END AS who FROM ev")
_sql(
    "rejected_values",
    """SELECT 'log' AS "table", 'unique_customer_id' AS "column", 'null' AS value, who AS unique_customer_id
    FROM logged WHERE event_id % 89 = 0
    UNION ALL SELECT 'log', 'timestamp', 'soon', who FROM logged WHERE event_id % 101 = 0
    UNION ALL SELECT 'log', 'event_id', '#' || event_id, who FROM logged WHERE event_id % 97 = 0
    UNION ALL SELECT 'coupons', 'value', '5 euro', CAST(id AS VARCHAR) FROM sales WHERE event_id % 23 = 0
    UNION ALL SELECT 'transactions', 'demand', '1,5', CAST(id AS VARCHAR) FROM sales WHERE event_id % 19 = 0
    UNION ALL SELECT 'customers', 'unique_customer_id', ' ', ' ' FROM raw_cust WHERE id % 53 = 0""",
)
_sql(
    "export_times",
    """SELECT CASE WHEN event_id % 97 <> 0 THEN event_id END AS event_id,
    CASE WHEN event_id % 101 <> 0 THEN ts END AS timestamp FROM ev""",
)

# --- retention ------------------------------------------------------------

_sql(
    "engagement_events",
    """SELECT id AS unique_customer_id, event, action, day AS activity_date, ts AS timestamp
    FROM engaged""",
)
_part("cohorts", "SELECT id, min(day) AS cohort_date FROM camp WHERE event = 'click' GROUP BY id")
_sql("cohort_table", "SELECT id AS unique_customer_id, cohort_date FROM cohorts")
_sql("user_daily_activity", "SELECT id AS unique_customer_id, day AS activity_date FROM user_days")
_part(
    "lifecycle",
    """SELECT id, day, cohort_date,
    CAST(date_diff('day', cohort_date, day) AS INTEGER) AS days_since_cohort
    FROM user_days JOIN cohorts USING (id) WHERE day >= cohort_date""",
)
_sql(
    "retention_lifecycle",
    """SELECT id AS unique_customer_id, day AS activity_date, cohort_date, days_since_cohort
    FROM lifecycle""",
)
_sql("cohort_sizes", "SELECT cohort_date, count(*) AS cohort_size FROM cohorts GROUP BY cohort_date")


def _cohort_retention(horizon: int) -> str:
    return f"""SELECT cohort_date, days_since_cohort, active_users, cohort_size,
    {_r(_d('active_users', 'cohort_size') + ' * 100')} AS retention_rate
    FROM (SELECT cohort_date, days_since_cohort, count(DISTINCT id) AS active_users FROM lifecycle
      WHERE days_since_cohort <= {horizon} GROUP BY ALL)
    JOIN (SELECT cohort_date, count(*) AS cohort_size FROM cohorts GROUP BY cohort_date)
      USING (cohort_date)"""


_sql("cohort_retention", _cohort_retention(14))
_sql("cohort_retention_full", _cohort_retention(22))
_sql(
    "retention_overall",
    f"""SELECT days_since_cohort, active_users, total_users,
    {_r(_d('active_users', 'total_users') + ' * 100')} AS retention_rate
    FROM (SELECT days_since_cohort, count(DISTINCT id) AS active_users,
      (SELECT count(*) FROM cohorts) AS total_users FROM lifecycle
      GROUP BY days_since_cohort)""",
)
_part(
    "demo",
    """SELECT id, CASE gender WHEN 'V' THEN 'Female' ELSE 'Male' END AS gender_clean,
    CASE WHEN age IN ('15-19', '20-24') THEN '15-24' WHEN age IN ('25-29', '30-34') THEN '25-34'
      WHEN age IN ('35-39', '40-44') THEN '35-44' WHEN age IN ('45-49', '50-54') THEN '45-54'
      WHEN age IN ('55-59', '60-64') THEN '55-64'
      WHEN age IN ('65-69', '70-74', '75-79', '80-84', '85-89', '90-94', '95-99') THEN '65+'
      END AS age_group_clean
    FROM cust WHERE gender IN ('V', 'M')""",
)
_part(
    "lifecycle_demo",
    """SELECT gender_clean, age_group_clean, days_since_cohort, count(DISTINCT id) AS active_users
    FROM lifecycle JOIN demo USING (id) WHERE age_group_clean IS NOT NULL GROUP BY ALL""",
)
_sql(
    "retention_by_segment",
    f"""SELECT l.*, z.active_users AS cohort_size,
    {_r(_d('l.active_users', 'z.active_users') + ' * 100')} AS retention_rate
    FROM lifecycle_demo l JOIN lifecycle_demo z ON z.days_since_cohort = 0
      AND z.gender_clean = l.gender_clean AND z.age_group_clean = l.age_group_clean""",
)

# --- time of day ----------------------------------------------------------

_part(
    "local_clicks",
    f"""SELECT id, event_id, ts, {_LOCAL} AS local_ts,
    CAST(hour({_LOCAL}) AS INTEGER) AS h, CAST({_LOCAL} AS DATE) AS d
    FROM camp WHERE event = 'click'""",
)
_sql(
    "local_time_events",
    """SELECT id AS unique_customer_id, event_id, ts AS timestamp, local_ts AS timestamp_local,
    h AS hour_local, d AS date_local, strftime(d, '%a') AS weekday_local FROM local_clicks""",
)
_OPENS = "count(*) AS total_opens, count(DISTINCT id) AS unique_users"


def _share_of(over: str, digits: int) -> str:
    return _r(_d("count(*)", f"sum(count(*)) OVER ({over})") + " * 100", digits)


_part(
    "hourly",
    f"""SELECT h AS hour_local, {_OPENS}, {_share_of('', 2)} AS pct_opens
    FROM local_clicks GROUP BY h""",
)
_sql("hourly_distribution", "SELECT * FROM hourly")
_sql(
    "time_buckets",
    f"""SELECT CASE WHEN h < 6 THEN 'Night (00-05)' WHEN h < 12 THEN 'Morning (06-11)'
    WHEN h < 18 THEN 'Afternoon (12-17)' ELSE 'Evening (18-23)' END AS time_of_day_bucket, {_OPENS},
    {_share_of('', 1)} AS pct_opens FROM local_clicks GROUP BY 1""",
)
_sql("peak_hours", "SELECT * FROM hourly ORDER BY total_opens DESC, hour_local LIMIT 5")
_sql(
    "weekday_hour_share",
    f"""SELECT day_type, h AS hour_local, count(*) AS total_opens,
    {_share_of('PARTITION BY day_type', 6)} AS pct_opens
    FROM (SELECT *, CASE WHEN dayofweek(d) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type
      FROM local_clicks) GROUP BY day_type, h""",
)
_sql(
    "opens_day_hour",
    """SELECT d AS date_local, h AS hour_local, count(*) AS opens, count(DISTINCT id) AS unique_users
    FROM local_clicks GROUP BY d, h""",
)

_LEVEL = "count(*) AS opens, count(DISTINCT id) AS customers"
_sql(
    "participation_levels",
    f"""SELECT 'day' AS level, day, CAST(NULL AS INTEGER) AS hour, {_LEVEL} FROM camp
    WHERE event = 'click' GROUP BY day
    UNION ALL SELECT 'local day and hour', d, h, {_LEVEL} FROM local_clicks GROUP BY d, h
    UNION ALL SELECT 'local hour', NULL, h, {_LEVEL} FROM local_clicks GROUP BY h
    UNION ALL SELECT 'all', NULL, NULL, {_LEVEL} FROM local_clicks""",
)

# --- streak rebuilding ----------------------------------------------------



def _gaps(src: str) -> str:
    return f"""SELECT id, day, lag(day) OVER w AS prev_date,
    CAST(date_diff('day', lag(day) OVER w, day) AS INTEGER) AS gap_days,
    row_number() OVER w AS pos FROM {src} WINDOW w AS (PARTITION BY id ORDER BY day)"""


_sql(
    "streak_gaps",
    f"""SELECT id AS unique_customer_id, day AS activity_date, prev_date, gap_days
    FROM ({_gaps('click_days')})""",
)


def _rebuild(src: str) -> str:
    return f"""SELECT id, total_active_days, n_breaks, CAST(first_break_position AS INTEGER)
      AS first_break_position, n_breaks > 0 AS had_streak_break,
    coalesce(first_break_position < total_active_days, FALSE) AS tried_to_rebuild,
    CASE WHEN total_active_days = 1 THEN 'One-Day Users (No Streak)'
      WHEN n_breaks = 0 THEN 'Continuous Users (No Breaks)'
      WHEN first_break_position < total_active_days THEN 'Tried to Rebuild Streak'
      ELSE 'Broke & Dropped Off' END AS rebuild_segment
    FROM (SELECT id, count(*) AS total_active_days, count(*) FILTER (gap_days > 1) AS n_breaks,
      min(pos) FILTER (gap_days > 1) AS first_break_position FROM ({_gaps(src)}) GROUP BY id)"""


_part("rebuilt", _rebuild("click_days"))
_sql(
    "rebuild_flags",
    """SELECT id AS unique_customer_id, total_active_days, n_breaks, first_break_position,
    had_streak_break, tried_to_rebuild FROM rebuilt""",
)
_sql(
    "rebuild_segments",
    f"""SELECT rebuild_segment, count(*) AS n, {_share_of('', 1)} AS pct FROM rebuilt
    GROUP BY rebuild_segment""",
)
_sql(
    "rebuild_summary",
    f"""SELECT count(*) AS total_participants,
    count(*) FILTER (total_active_days = 1) AS one_day_users,
    count(*) FILTER (total_active_days > 1 AND n_breaks = 0) AS continuous_users,
    count(*) FILTER (n_breaks > 0) AS users_broke_streak,
    count(*) FILTER (tried_to_rebuild) AS users_tried_rebuild,
    {_r(_d('count(*) FILTER (tried_to_rebuild)', 'count(*)') + ' * 100', 2)} AS pct_tried_rebuild
    FROM rebuilt""",
)

_sql(
    "activity_runs",
    f"""SELECT id AS unique_customer_id, CAST(sum(n) AS BIGINT) AS active_days, count(*) AS n_runs,
    CAST(max(n) AS BIGINT) AS longest_run,
    CAST(coalesce(sum(n) FILTER (last_day = DATE '2024-01-26'), 0) AS BIGINT) AS final_run,
    min(first_day) AS first_day, max(last_day) AS last_day
    FROM (SELECT id, island, count(*) AS n, min(day) AS first_day, max(day) AS last_day
      FROM (SELECT id, day, day - CAST(pos AS INTEGER) AS island FROM ({_gaps('click_days')}))
      GROUP BY id, island) GROUP BY id""",
)

# --- streak audit and leakage --------------------------------------------

_part(
    "audited",
    """SELECT id, day, streak FROM camp WHERE event = 'click'
    QUALIFY row_number() OVER (PARTITION BY id, day ORDER BY ts DESC, event_id DESC) = 1""",
)
_part(
    "audit_gaps",
    """SELECT id, day, streak, prev_date, prev_streak, days_gap,
    coalesce(days_gap > 1, TRUE) AS missed_day,
    coalesce(days_gap > 1, TRUE) AND streak > 1 AS inconsistent
    FROM (SELECT *, lag(day) OVER w AS prev_date, lag(streak) OVER w AS prev_streak,
      CAST(date_diff('day', lag(day) OVER w, day) AS INTEGER) AS days_gap
      FROM audited WINDOW w AS (PARTITION BY id ORDER BY day))""",
)
_sql(
    "streak_audit",
    "SELECT id AS unique_customer_id, day AS activity_date, streak AS current_streak_value FROM audited",
)
_sql(
    "streak_gap_analysis",
    """SELECT id AS unique_customer_id, day AS activity_date, streak AS current_streak_value,
    prev_date, prev_streak, days_gap, missed_day, CASE WHEN missed_day THEN streak END
      AS streak_after_gap, inconsistent AS inconsistent_streak FROM audit_gaps""",
)
_sql(
    "streak_inconsistency",
    f"""SELECT count(*) AS total_gap_events, count(*) FILTER (inconsistent) AS inconsistent_events,
    {_r(_d('count(*) FILTER (inconsistent)', 'count(*)') + ' * 100', 1)} AS pct_inconsistent,
    count(DISTINCT id) FILTER (inconsistent) AS affected_customers
    FROM audit_gaps WHERE missed_day""",
)
_part(
    "user_audit",
    """SELECT id, bool_or(missed_day) AS had_gap, bool_or(inconsistent) AS had_inconsistent,
    count(*) FILTER (missed_day) AS gap_events, count(*) FILTER (inconsistent) AS inconsistent_events
    FROM audit_gaps GROUP BY id""",
)
_sql(
    "streak_inconsistent_users",
    """SELECT id AS unique_customer_id, had_gap, had_inconsistent AS had_inconsistent_streak,
    gap_events, inconsistent_events FROM user_audit""",
)
_sql(
    "streak_inconsistent_share",
    f"""SELECT count(*) FILTER (had_gap) AS customers_with_gap,
    count(*) FILTER (had_inconsistent) AS affected_customers,
    count(*) FILTER (NOT had_inconsistent) AS unaffected_customers,
    {_pct_where('had_inconsistent')} AS pct_affected FROM user_audit""",
)
_sql(
    "streak_extra_levels",
    f"""SELECT {_r(_avg('(streak - 1)'))} AS avg_extra_levels,
    {_r('quantile_cont(CAST(streak - 1 AS DOUBLE), 0.5)')} AS median_extra
    FROM audit_gaps WHERE inconsistent""",
)
_part(
    "bug_selections",
    """SELECT id, code FROM log WHERE action = 'selected' AND contains(code, 'TIER')
    AND id IN (SELECT id FROM audit_gaps WHERE inconsistent)""",
)
_part("bug_codes", "SELECT DISTINCT id, code FROM bug_selections")
_part("redeemed", "SELECT id, code, discount FROM live WHERE discount > 0")
_part(
    "leakage",
    """SELECT (SELECT count(DISTINCT id) FROM bug_codes) AS customers_selected,
    (SELECT count(DISTINCT id) FROM bug_codes JOIN redeemed USING (id, code)) AS customers_used,
    (SELECT CAST(coalesce(sum(discount), 0) AS DOUBLE) FROM bug_codes JOIN redeemed USING (id, code))
      AS leakage,
    (SELECT CAST(coalesce(sum(discount), 0) AS DOUBLE) FROM bug_selections
      JOIN redeemed USING (id, code)) AS leakage_raw""",
)
_sql("reward_leakage", "SELECT * FROM leakage")
_sql(
    "potential_loss",
    """SELECT (SELECT CAST(coalesce(sum(value), 0) AS BIGINT) FROM bug_codes JOIN tiers USING (code))
      AS potential_loss,
    (SELECT CAST(coalesce(sum(value), 0) AS BIGINT) FROM bug_selections JOIN tiers USING (code))
      AS potential_loss_raw""",
)
_sql(
    "bug_discount_share",
    f"""SELECT leakage, total_discount, {_r('leakage / total_discount * 100')} AS pct_of_discounts
    FROM leakage, (SELECT CAST(sum(discount) AS DOUBLE) AS total_discount FROM live
      WHERE day BETWEEN {CAMPAIGN})""",
)
