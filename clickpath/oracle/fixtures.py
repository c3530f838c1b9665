"""DuckDB SQL for the three fixtures and the four views (the oracle side).

Written independently of the DataFrame code: ranking windows and plain joins
where the Spark side uses aggregates. Every table is a CTE named ``f_*`` so it
never clashes with the driver's pre-registered ``orders`` view.
"""

from __future__ import annotations

# Fixed values (same as clickpath.sources.adapters / clickpath.spec).
_PRODUCTS_VALUES = """
    (1, TIMESTAMP '2023-03-01 00:00:00', 'The Original Mr. Fuzzy'),
    (2, TIMESTAMP '2023-06-01 00:00:00', 'The Forever Love Bear'),
    (3, TIMESTAMP '2023-09-01 00:00:00', 'The Birthday Sugar Panda'),
    (4, TIMESTAMP '2023-12-01 00:00:00', 'The Hudson River Mini bear')
"""

_CLEAN_SESSIONS = """
f_sessions AS (
    SELECT website_session_id, created_at, user_id, is_repeat_session,
           coalesce(utm_source, 'none') AS utm_source,
           coalesce(utm_campaign, 'none') AS utm_campaign,
           coalesce(utm_content, 'none') AS utm_content,
           device_type,
           coalesce(http_referer, 'none') AS http_referer,
           CASE WHEN utm_source IS NOT NULL THEN utm_source
                WHEN http_referer IS NOT NULL THEN 'organic'
                ELSE 'direct' END AS traffic_channel
    FROM raw_sessions
)"""

_PAGE_NAME = "coalesce(nullif(split_part(trim(pageview_url, '/'), '/', 1), ''), 'home')"

_CLICKSTREAM = f"""
ev AS (
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(user_id AS BIGINT) * 4194304 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1048576 AS sid
    FROM events
),
ev_ranked AS (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS rn FROM ev
),
raw_sessions AS (
    SELECT sid AS website_session_id, ts AS created_at, user_id,
           CASE WHEN sid = min(sid) OVER (PARTITION BY user_id) THEN 0 ELSE 1 END AS is_repeat_session,
           CASE WHEN k < 50 THEN 's_a' WHEN k < 70 THEN 's_b' WHEN k < 80 THEN 's_c' END AS utm_source,
           CASE WHEN k < 80 THEN CASE WHEN k % 2 = 1 THEN 'brand' ELSE 'nonbrand' END END AS utm_campaign,
           CASE WHEN k < 80 THEN 'ad_' || CAST(k % 3 AS VARCHAR) END AS utm_content,
           CASE WHEN (user_id + (sid - CAST(user_id AS BIGINT) * 4194304 - 1048576)) % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
           CASE WHEN k < 90 THEN 'https://ref' END AS http_referer
    FROM ev_ranked WHERE rn = 1
),
{_CLEAN_SESSIONS.strip()},
f_pageviews AS (
    SELECT event_id AS website_pageview_id, ts AS created_at, sid AS website_session_id, pageview_url,
           {_PAGE_NAME} AS page_name
    FROM (
        SELECT *, CASE
            WHEN event_type = 'purchase' AND value >= 150 THEN '/thank-you-for-your-order'
            WHEN rn = 1 AND k % 8 < 6 THEN
                CASE k % 8 WHEN 0 THEN '/home' ELSE '/lander-' || CAST(k % 8 AS VARCHAR) END
            WHEN event_type = 'view' THEN '/products'
            WHEN event_type = 'click' THEN
                CASE k % 4 WHEN 0 THEN '/the-original-mr-fuzzy' WHEN 1 THEN '/the-forever-love-bear'
                           WHEN 2 THEN '/the-birthday-sugar-panda' ELSE '/the-hudson-river-mini-bear' END
            WHEN event_type = 'signup' THEN '/cart'
            WHEN event_type = 'error' THEN '/shipping'
            WHEN k % 2 = 0 THEN '/billing'
            ELSE '/billing-2' END AS pageview_url
        FROM ev_ranked
    ) AS x
),
purchases AS (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY value DESC, event_id) AS item_rank
    FROM ev WHERE event_type = 'purchase'
),
kept AS (
    SELECT p.*, CAST(p.value AS DECIMAL(18,2)) AS price_usd,
           CAST(round(CAST(p.value AS DECIMAL(18,2)) * (0.30 + 0.02 * (p.k % 4)), 2) AS DECIMAL(18,2)) AS cogs_usd,
           CAST(p.k % 4 + 1 AS INTEGER) AS product_id
    FROM purchases AS p
    WHERE p.sid IN (SELECT sid FROM purchases WHERE item_rank = 1 AND value >= 150)
),
f_order_items AS (
    SELECT event_id AS order_item_id, ts AS created_at, sid AS order_id, product_id,
           CASE WHEN item_rank = 1 THEN 1 ELSE 0 END AS is_primary_item,
           price_usd, cogs_usd, CAST(price_usd - cogs_usd AS DECIMAL(18,2)) AS gross_profit
    FROM kept
),
f_orders AS (
    SELECT order_id, created_at, website_session_id, user_id, primary_product_id, items_purchased,
           price_usd, cogs_usd, CAST(price_usd - cogs_usd AS DECIMAL(18,2)) AS gross_profit
    FROM (
        SELECT sid AS order_id, min(CASE WHEN value >= 150 THEN ts END) AS created_at,
               sid AS website_session_id, max(user_id) AS user_id,
               max(CASE WHEN item_rank = 1 THEN product_id END) AS primary_product_id,
               CAST(count(*) AS INTEGER) AS items_purchased,
               CAST(sum(price_usd) AS DECIMAL(18,2)) AS price_usd,
               CAST(sum(cogs_usd) AS DECIMAL(18,2)) AS cogs_usd
        FROM kept GROUP BY sid
    ) AS y
),
f_order_item_refunds AS (
    SELECT event_id AS order_item_refund_id, ts + INTERVAL 5 DAY AS created_at,
           event_id AS order_item_id, sid AS order_id, price_usd AS refund_amount_usd
    FROM kept WHERE k % 7 = 0
),
f_products AS (
    SELECT * FROM (VALUES {_PRODUCTS_VALUES}) AS t(product_id, created_at, product_name)
)"""

_JOURNEY_SESSIONS_PAGEVIEWS = f"""
raw_sessions AS (
    SELECT o_orderkey AS website_session_id, o_orderdate AS created_at, o_custkey AS user_id,
           CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
                THEN 0 ELSE 1 END AS is_repeat_session,
           o_orderstatus AS utm_source, o_orderpriority AS utm_campaign,
           'ad_' || CAST(o_orderkey % 3 AS VARCHAR) AS utm_content,
           CASE WHEN o_orderkey % 5 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
           'https://ref' AS http_referer
    FROM orders
),
{_CLEAN_SESSIONS.strip()},
f_pageviews AS (
    SELECT website_pageview_id, created_at, website_session_id, pageview_url, {_PAGE_NAME} AS page_name
    FROM (
        SELECT o_orderkey AS website_pageview_id, o_orderdate AS created_at, o_orderkey AS website_session_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '/thank-you-for-your-order'
                    WHEN o_orderstatus = 'F' THEN '/cart'
                    WHEN o_orderstatus = 'O' THEN '/products'
                    ELSE '/the-original-mr-fuzzy' END AS pageview_url
        FROM orders
    ) AS x
)"""

_JOURNEY = f"""
{_JOURNEY_SESSIONS_PAGEVIEWS.strip()},
conv AS (
    SELECT o_orderkey, o_custkey, o_orderdate,
           CAST(o_totalprice AS DECIMAL(18,2)) AS price_usd,
           CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.4, 2) AS DECIMAL(18,2)) AS cogs_usd,
           CAST(o_orderkey % 4 + 1 AS INTEGER) AS product_id
    FROM orders WHERE o_orderpriority = '1-URGENT'
),
f_orders AS (
    SELECT o_orderkey AS order_id, o_orderdate AS created_at, o_orderkey AS website_session_id,
           o_custkey AS user_id, product_id AS primary_product_id, 1 AS items_purchased,
           price_usd, cogs_usd, CAST(price_usd - cogs_usd AS DECIMAL(18,2)) AS gross_profit
    FROM conv
),
f_order_items AS (
    SELECT o_orderkey AS order_item_id, o_orderdate AS created_at, o_orderkey AS order_id, product_id,
           1 AS is_primary_item, price_usd, cogs_usd, CAST(price_usd - cogs_usd AS DECIMAL(18,2)) AS gross_profit
    FROM conv
),
f_order_item_refunds AS (
    SELECT o_orderkey AS order_item_refund_id, o_orderdate + INTERVAL 5 DAY AS created_at,
           o_orderkey AS order_item_id, o_orderkey AS order_id, price_usd AS refund_amount_usd
    FROM conv WHERE o_orderkey % 7 = 0
),
f_products AS (
    SELECT * FROM (VALUES {_PRODUCTS_VALUES}) AS t(product_id, created_at, product_name)
)"""

_BASKET = f"""
{_JOURNEY_SESSIONS_PAGEVIEWS.strip()},
lines AS (
    SELECT l.*, p.p_type,
           row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
                              l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
                              l.l_shipdate) AS order_item_id
    FROM lineitem AS l JOIN part AS p ON l.l_partkey = p.p_partkey
),
lines_ranked AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                 l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                                 l_linestatus, l_shipdate, order_item_id) AS line_rank,
           count(*) OVER (PARTITION BY l_orderkey) AS n_lines,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS price_usd,
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.4, 2) AS DECIMAL(18,2)) AS cogs_usd
    FROM lines
),
f_order_items AS (
    SELECT order_item_id, l_shipdate AS created_at, l_orderkey AS order_id, p_type AS product_id,
           CASE WHEN line_rank = 1 THEN 1 ELSE 0 END AS is_primary_item,
           price_usd, cogs_usd, CAST(price_usd - cogs_usd AS DECIMAL(18,2)) AS gross_profit
    FROM lines_ranked
),
f_order_item_refunds AS (
    SELECT order_item_id AS order_item_refund_id, l_shipdate + INTERVAL 5 DAY AS created_at,
           order_item_id, l_orderkey AS order_id, price_usd AS refund_amount_usd
    FROM lines_ranked WHERE l_returnflag = 'R'
),
f_orders AS (
    SELECT o.o_orderkey AS order_id, o.o_orderdate AS created_at, o.o_orderkey AS website_session_id,
           o.o_custkey AS user_id, f.p_type AS primary_product_id,
           CAST(coalesce(f.n_lines, 0) AS INTEGER) AS items_purchased,
           CAST(o.o_totalprice AS DECIMAL(18,2)) AS price_usd,
           CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) * 0.4, 2) AS DECIMAL(18,2)) AS cogs_usd,
           CAST(CAST(o.o_totalprice AS DECIMAL(18,2))
                - CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) * 0.4, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2))
               AS gross_profit
    FROM orders AS o
    LEFT JOIN (SELECT l_orderkey, p_type, n_lines FROM lines_ranked WHERE line_rank = 1) AS f
           ON o.o_orderkey = f.l_orderkey
),
f_products AS (
    SELECT DISTINCT p_type AS product_id, CAST(NULL AS TIMESTAMP) AS created_at, p_type AS product_name
    FROM part
)"""

# Fixture D: other times, an unexpected page, order totals a cent off; all else is fixture A.
_YEARS = """
moved AS (
    SELECT * REPLACE (ts + to_days(CAST(coalesce(user_id % 15, 0) * 30 - 3650 AS INTEGER)) AS ts) FROM events
),
""" + (_CLICKSTREAM.strip()
       .replace("FROM events", "FROM moved")
       .replace("SELECT *, CASE\n", "SELECT *, CASE\n            WHEN k = 61 THEN '/odd-page/x'\n")
       .replace("CAST(sum(price_usd) AS DECIMAL(18,2)) AS price_usd", "CAST(sum(price_usd) + CASE WHEN sid % 5 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS price_usd"))

FIXTURE_SQL = {"A": _CLICKSTREAM.strip(), "B": _JOURNEY.strip(), "C": _BASKET.strip(), "D": _YEARS.strip()}

# ---------------------------------------------------------------------------
# The four views, over the f_* tables.
# ---------------------------------------------------------------------------
VIEWS_SQL = """
product_label(url, label) AS (
    VALUES ('/the-original-mr-fuzzy', 'The Original Mr Fuzzy'), ('/the-forever-love-bear', 'The Forever Love Bear'),
           ('/the-birthday-sugar-panda', 'The Birthday Sugar Panda'),
           ('/the-hudson-river-mini-bear', 'The Hudson River Mini bear')
),
landing_label(url, label) AS (
    VALUES ('/home', 'Home'), ('/lander-1', 'Lander-1'), ('/lander-2', 'Lander-2'),
           ('/lander-3', 'Lander-3'), ('/lander-4', 'Lander-4'), ('/lander-5', 'Lander-5')
),
seen_pages AS (
    SELECT v.website_session_id, max(b.label) AS product_name,
           CAST(least(1, count(b.label)) AS INTEGER) AS any_product,
           CAST(least(1, count(*) FILTER (v.pageview_url = '/products')) AS INTEGER) AS products_page,
           CAST(least(1, count(*) FILTER (v.pageview_url = '/cart')) AS INTEGER) AS cart_page,
           CAST(least(1, count(*) FILTER (v.pageview_url = '/shipping')) AS INTEGER) AS shipping_page,
           CAST(least(1, count(*) FILTER (v.pageview_url IN ('/billing', '/billing-2'))) AS INTEGER) AS billing_page,
           CAST(least(1, count(*) FILTER (v.pageview_url = '/thank-you-for-your-order')) AS INTEGER) AS order_page
    FROM f_pageviews AS v LEFT JOIN product_label AS b ON b.url = v.pageview_url
    GROUP BY v.website_session_id
),
entry_page AS (
    SELECT v.website_session_id, a.label
    FROM f_pageviews AS v LEFT JOIN landing_label AS a ON a.url = v.pageview_url
    QUALIFY row_number() OVER (PARTITION BY v.website_session_id ORDER BY v.created_at, v.website_pageview_id) = 1
),
product_page_visit_count AS (
    SELECT website_session_id, product_name AS Page_Name, cart_page AS saw_cart, shipping_page AS saw_shipping,
           billing_page AS saw_billing, order_page AS saw_thank_you
    FROM seen_pages WHERE any_product = 1
),
multivariant_test AS (
    SELECT website_session_id, label AS Landing_Page, products_page AS saw_product, any_product AS clicked_product,
           cart_page AS saw_cart, shipping_page AS saw_shipping, billing_page AS saw_billing,
           order_page AS saw_thank_you
    FROM seen_pages LEFT JOIN entry_page USING (website_session_id)
),
order_value AS (SELECT order_id, sum(price_usd) AS items_total FROM f_order_items GROUP BY ALL),
session_paid AS (
    SELECT website_session_id AS buyer_session, CAST(sum(items_total) AS DECIMAL(18,2)) AS paid
    FROM order_value NATURAL JOIN (SELECT order_id, website_session_id FROM f_orders) GROUP BY ALL
),
session_funnel AS (
    SELECT website_session_id, utm_source, utm_campaign, utm_content, device_type, traffic_channel,
           seen.saw_product, seen.saw_cart, seen.saw_shipping, seen.saw_billing, seen.saw_thank_you,
           (SELECT paid FROM session_paid WHERE buyer_session = f_sessions.website_session_id) AS session_revenue
    FROM f_sessions LEFT JOIN multivariant_test AS seen USING (website_session_id)
),
user_picks AS (
    SELECT user_id, arg_min(website_session_id, ROW(created_at, website_session_id)) AS entered,
           (SELECT arg_min(o.website_session_id, ROW(o.created_at, o.website_session_id)) FROM f_orders AS o
            WHERE o.user_id IS NOT DISTINCT FROM f_sessions.user_id) AS bought
    FROM f_sessions GROUP BY user_id
),
touch AS (
    SELECT website_session_id AS id, user_id AS owner,
           {'source': utm_source, 'campaign': utm_campaign, 'content': utm_content, 'device': device_type, 'channel': traffic_channel} AS by
    FROM f_sessions
),
user_attribution AS (
    SELECT p.entered AS first_touch_website_session_id, closing.id AS last_touch_website_session_id, p.user_id,
           opening.by.source AS first_touch_utm_source, opening.by.campaign AS first_touch_utm_campaign,
           opening.by.content AS first_touch_utm_content, opening.by.device AS first_touch_device_type,
           opening.by.channel AS first_touch_traffic_channel,
           closing.by.source AS last_touch_utm_source, closing.by.campaign AS last_touch_utm_campaign,
           closing.by.content AS last_touch_utm_content, closing.by.device AS last_touch_device_type,
           closing.by.channel AS last_touch_traffic_channel
    FROM user_picks AS p
    JOIN touch AS opening ON opening.id = p.entered
    LEFT JOIN touch AS closing ON closing.id = p.bought AND closing.owner = p.user_id
)""".strip()


def with_fixture(fixture: str, body: str, views: bool = True) -> str:
    """Full oracle statement: fixture CTEs, view CTEs, then ``body``.

    ``body`` is either a ``SELECT`` or further CTE definitions followed by a
    ``SELECT``; in the second case it must start with ``,``.
    """
    parts = [FIXTURE_SQL[fixture]]
    if views:
        parts.append(VIEWS_SQL)
    head = "WITH " + ",\n".join(parts)
    body = body.strip()
    if body.startswith(","):
        return head + body + "\n"
    return head + "\n" + body + "\n"
