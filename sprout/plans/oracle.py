"""DuckDB SQL that derives the same logical tables as ``sprout.sources.testdata``.

Each oracle query in ``__spark_entry__.oracle_sql`` is ``WITH <ctes> <select>``.
Dialect notes: DuckDB ``weekday`` is Sunday = 0 (use ``isodow - 1``), a plain
cast to an integer rounds (use ``trunc``), decimal literals stay decimal (every
arithmetic here has a DOUBLE operand), and ``round_even(x * 10^n, 0) / 10^n`` is
the twin of Spark's ``rint(x * 10^n) / 10^n``.
"""

from __future__ import annotations

from ..sources.testdata import ENTITIES, HIDDEN_RE


def rnd(expr: str, n: int) -> str:
    s = 10 ** n
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def h16(salt: str, *parts: str) -> str:
    items = [f"'{salt}'"]
    for i, p in enumerate(parts):
        if i:
            items.append("':'")
        items.append(f"CAST({p} AS VARCHAR)")
    return f"CAST(('0x' || substr(md5({' || '.join(items)}), 1, 4)) AS INTEGER)"


def md5_key(salt: str, *parts: str) -> str:
    items = [f"'{salt}'"]
    for i, p in enumerate(parts):
        if i:
            items.append("':'")
        items.append(f"CAST({p} AS VARCHAR)")
    return f"md5({' || '.join(items)})"


DEC = "DECIMAL(18,2)"


def daily_ctes(by_site: bool = False) -> str:
    if by_site:
        src = ("(SELECT l.*, r.r_name AS site_id FROM lineitem l "
               "JOIN supplier s ON l.l_suppkey = s.s_suppkey "
               "JOIN nation n ON s.s_nationkey = n.n_nationkey "
               "JOIN region r ON n.n_regionkey = r.r_regionkey)")
    else:
        src = "(SELECT *, 'all' AS site_id FROM lineitem)"
    return f"""
li_day AS (
  SELECT site_id, CAST(l_shipdate AS DATE) AS date,
    SUM(CAST(l_quantity AS {DEC})) AS qty,
    SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS {DEC}) ELSE CAST(0 AS {DEC}) END) AS organic,
    SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS {DEC}) ELSE CAST(0 AS {DEC}) END) AS paid,
    COUNT(*) AS n_lines,
    COUNT_IF(l_returnflag = 'R') AS n_r,
    COUNT_IF(l_linestatus = 'F') AS n_f,
    SUM(CAST(l_discount AS {DEC})) AS disc,
    SUM(CAST(l_tax AS {DEC})) AS tax,
    COUNT(DISTINCT l_orderkey) AS n_orders,
    SUM(CAST(l_extendedprice AS {DEC}) * (1 - CAST(l_discount AS {DEC}))) AS rev
  FROM {src} t GROUP BY 1, 2
),
day0 AS (
  SELECT site_id, date,
    CAST(trunc(qty) AS BIGINT) AS visitors,
    CAST(trunc(qty) AS BIGINT) + n_lines AS sessions,
    CAST(trunc(organic) AS BIGINT) AS organic_traffic,
    CAST(trunc(paid) AS BIGINT) AS paid_traffic,
    {rnd("CAST(0.5 AS DOUBLE) + 0.3 * (n_r / CAST(n_lines AS DOUBLE))", 4)} AS bounce_rate,
    {rnd("CAST(60.0 AS DOUBLE) + 4.0 * (CAST(qty AS DOUBLE) / CAST(n_lines AS DOUBLE))", 1)} AS avg_time_on_site,
    {rnd("CAST(disc AS DOUBLE) / CAST(n_lines AS DOUBLE)", 4)} AS ctr,
    {rnd("CAST(1.0 AS DOUBLE) + 200.0 * (CAST(tax AS DOUBLE) / CAST(n_lines AS DOUBLE))", 2)} AS avg_position,
    n_lines,
    {rnd("CAST(40.0 AS DOUBLE) + 60.0 * (n_f / CAST(n_lines AS DOUBLE))", 1)} AS page_speed,
    {rnd("CAST(100.0 AS DOUBLE) * (CAST(qty AS DOUBLE) / CAST(n_lines AS DOUBLE)) / 50.0", 1)} AS content_score,
    {rnd("n_orders / CAST(CAST(trunc(qty) AS BIGINT) + n_lines AS DOUBLE)", 4)} AS conversion_rate,
    n_orders AS sales,
    {rnd("CAST(rev AS DOUBLE)", 2)} AS revenue
  FROM li_day
),
day_bounds AS (SELECT site_id, MIN(date) AS d0, MAX(date) AS d1 FROM day0 GROUP BY 1),
day_cal AS (
  SELECT site_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM day_bounds
),
day_full AS (
  SELECT c.site_id, c.date, d.visitors, d.sessions, d.organic_traffic, d.paid_traffic, d.bounce_rate,
    d.avg_time_on_site, d.ctr, d.avg_position, d.n_lines, d.page_speed, d.content_score,
    d.conversion_rate, d.sales, d.revenue
  FROM day_cal c LEFT JOIN day0 d ON c.site_id = d.site_id AND c.date = d.date
),
daily_metrics AS (
  SELECT site_id, date,
    CAST(COALESCE(visitors, 0) AS BIGINT) AS visitors,
    CAST(COALESCE(sessions, 0) AS BIGINT) AS sessions,
    CAST(COALESCE(organic_traffic, 0) AS BIGINT) AS organic_traffic,
    CAST(COALESCE(paid_traffic, 0) AS BIGINT) AS paid_traffic,
    last_value(bounce_rate IGNORE NULLS) OVER wr AS bounce_rate,
    last_value(avg_time_on_site IGNORE NULLS) OVER wr AS avg_time_on_site,
    last_value(ctr IGNORE NULLS) OVER wr AS ctr,
    last_value(avg_position IGNORE NULLS) OVER wr AS avg_position,
    CAST(SUM(COALESCE(n_lines, 0)) OVER wr + 500 AS BIGINT) AS backlinks,
    last_value(page_speed IGNORE NULLS) OVER wr AS page_speed,
    last_value(content_score IGNORE NULLS) OVER wr AS content_score,
    last_value(conversion_rate IGNORE NULLS) OVER wr AS conversion_rate,
    CAST(COALESCE(sales, 0) AS BIGINT) AS sales,
    COALESCE(revenue, CAST(0 AS DOUBLE)) AS revenue
  FROM day_full
  WINDOW wr AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def _decoded(expr: str) -> str:
    for entity, char in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


PAGE_POINTS = """(50.0 * least(CAST(word_count AS DOUBLE) / 1200.0, CAST(1.0 AS DOUBLE))
      + 25.0 * least(CAST(internal_links AS DOUBLE) / 8.0, CAST(1.0 AS DOUBLE))
      + 10.0 * CAST((title_length BETWEEN 30 AND 60)::INT + (meta_length BETWEEN 70 AND 160)::INT + (h1_count = 1)::INT
                    + (alt_ratio >= 0.9)::INT + (has_schema = 1)::INT + (mobile_friendly = 1)::INT AS DOUBLE)
      + page_speed / 5.0)"""


def pages_ctes() -> str:
    text = _decoded(f"regexp_replace(regexp_replace(html, '{HIDDEN_RE}', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    title = _decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")
    meta = _decoded("""regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)""")
    return f"""
pg0 AS (
  SELECT url,
    CAST(len(regexp_extract_all({text}, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS word_count,
    CAST(len(regexp_extract_all(html, '<img[ >]')) AS BIGINT) AS images,
    CASE WHEN len(regexp_extract_all(html, '<img[ >]')) = 0 THEN CAST(1.0 AS DOUBLE)
      ELSE {rnd("""CAST(len(regexp_extract_all(html, '<img[^>]* alt="[^"]')) AS DOUBLE) / CAST(len(regexp_extract_all(html, '<img[ >]')) AS DOUBLE)""", 3)} END AS alt_ratio,
    CAST(len(regexp_extract_all(html, '<a href="/')) AS BIGINT) AS internal_links,
    CAST(len(regexp_extract_all(html, '<a href="http')) AS BIGINT) AS external_links,
    CAST(length({title}) AS BIGINT) AS title_length,
    CAST(length({meta}) AS BIGINT) AS meta_length,
    CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1_count,
    {rnd("CAST(20.0 AS DOUBLE) + CAST(1600000.0 AS DOUBLE) / (CAST(20000.0 AS DOUBLE) + length(html))", 1)} AS page_speed,
    CASE WHEN contains(html, 'application/ld+json') THEN 1 ELSE 0 END AS has_schema,
    CASE WHEN contains(html, 'name="viewport"') THEN 1 ELSE 0 END AS mobile_friendly
  FROM pages
),
pg1 AS (SELECT *, {PAGE_POINTS} AS s FROM pg0),
pg_bounds AS (SELECT MIN(s) AS lo, MAX(s) AS hi FROM pg1),
seo_pages AS (
  SELECT url, word_count, images, alt_ratio, internal_links, external_links, title_length,
    meta_length, h1_count, page_speed, has_schema, mobile_friendly,
    {rnd("100.0 * (s - lo) / (hi - lo)", 1)} AS seo_score,
    word_count * internal_links AS organic_traffic
  FROM pg1 CROSS JOIN pg_bounds
)"""


def users_ctes() -> str:
    pre = "od <= cutoff"
    urgent = f"({pre} AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"
    return f"""
u_od AS (SELECT *, CAST(o_orderdate AS DATE) AS od FROM orders),
u_cut AS (SELECT CAST(MAX(od) - 180 AS DATE) AS cutoff FROM u_od),
u_lines AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, SUM(CAST(l_quantity AS {DEC})) AS qty FROM lineitem GROUP BY 1
),
u_o AS (
  SELECT u_od.*, u_cut.cutoff, u_lines.n_lines, u_lines.qty
  FROM u_od CROSS JOIN u_cut LEFT JOIN u_lines ON u_od.o_orderkey = u_lines.l_orderkey
),
u_per AS (
  SELECT o_custkey,
    COUNT_IF({pre}) AS sessions,
    SUM(CASE WHEN {pre} THEN COALESCE(n_lines, 0) END) AS pageviews,
    SUM(CASE WHEN {pre} THEN COALESCE(qty, CAST(0 AS {DEC})) END) AS qty,
    MAX(CASE WHEN {pre} THEN od END) AS last_od,
    MIN(cutoff) AS cutoff,
    COUNT_IF({urgent}) AS num_orders,
    SUM(CASE WHEN {urgent} THEN CAST(o_totalprice AS {DEC}) END) AS spent,
    COUNT_IF(od > cutoff) AS n_after
  FROM u_o GROUP BY 1
  HAVING COUNT_IF({pre}) > 0
),
users AS (
  SELECT 'u' || CASE WHEN o_custkey < 100000 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
    CAST(sessions AS BIGINT) AS sessions,
    CAST(pageviews AS BIGINT) AS pageviews,
    CASE WHEN pageviews > 0
      THEN {rnd("6.0 * CAST(qty AS DOUBLE) / CAST(pageviews AS DOUBLE)", 1)}
      ELSE CAST(0 AS DOUBLE) END AS avg_time_on_site,
    CAST(date_diff('day', last_od, cutoff) AS BIGINT) AS recency_days,
    CAST(num_orders AS BIGINT) AS num_orders,
    COALESCE(CAST(spent AS DOUBLE), CAST(0 AS DOUBLE)) AS total_spent,
    CASE WHEN n_after = 0 THEN 1 ELSE 0 END AS churned
  FROM u_per
)"""


def keywords_ctes() -> str:
    rel = rnd("CAST(c.disc AS DOUBLE) / CAST(c.n AS DOUBLE) * 10.0", 3)
    return f"""
k_cand AS (
  SELECT l_partkey, l_suppkey, COUNT(*) AS n, SUM(CAST(l_quantity AS {DEC})) AS qty,
    SUM(CAST(l_discount AS {DEC})) AS disc, {md5_key('ours', 'l_partkey', 'l_suppkey')} AS ours_key
  FROM lineitem GROUP BY 1, 2
),
k_part AS (SELECT l_partkey, SUM(qty) AS sv, MIN(ours_key) AS min_ours, COUNT(*) AS gsize FROM k_cand GROUP BY 1),
k0 AS (
  SELECT CAST(c.l_partkey AS BIGINT) AS keyword_id, p.p_name AS keyword,
    CAST(trunc(kp.sv) AS BIGINT) AS search_volume,
    CAST(p.p_size * 2 AS DOUBLE) AS keyword_difficulty,
    CASE WHEN c.ours_key = kp.min_ours THEN 1 ELSE 0 END AS is_ours,
    {rel} AS relevance,
    CAST(trunc(c.qty * 20) AS BIGINT) AS word_count,
    CAST(c.n * 10 AS BIGINT) AS backlinks,
    CAST(1.0 AS DOUBLE) + CAST({h16('da', 'c.l_suppkey')} % 100 AS DOUBLE) AS domain_authority,
    CAST(20.0 AS DOUBLE) + CAST({h16('ps', 'c.l_suppkey')} % 801 AS DOUBLE) / 10.0 AS page_speed,
    CASE WHEN {rel} > 0.4 THEN 1 ELSE 0 END AS keyword_in_title,
    CASE WHEN {rel} > 0.5 THEN 1 ELSE 0 END AS keyword_in_h1,
    CAST({h16('il', 'c.l_partkey', 'c.l_suppkey')} % 20 AS BIGINT) AS internal_links,
    c.l_suppkey AS candidate_id, c.qty AS units, kp.gsize
  FROM k_cand c JOIN k_part kp ON c.l_partkey = kp.l_partkey
  JOIN part p ON c.l_partkey = p.p_partkey
),
k1 AS (
  SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY units DESC, candidate_id) AS pos
  FROM k0
),
keywords AS (
  SELECT keyword_id, keyword, search_volume, keyword_difficulty, is_ours, relevance, word_count,
    backlinks, domain_authority, page_speed, keyword_in_title, keyword_in_h1, internal_links,
    candidate_id, CAST(pos AS INTEGER) AS position,
    CAST(4 - floor(5 * (pos - 1) / gsize) AS INTEGER) AS relevance_label
  FROM k1
)"""


def with_ctes(*parts: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n" + body
