"""Query bodies of the DuckDB oracles (CTEs and SELECTs after the shared table CTEs)."""

from __future__ import annotations

from ..operators import texts as T
from .oracle import rnd


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if hi is not None:
        out = f"least(CAST({float(hi)} AS DOUBLE), {out})"
    if lo is not None:
        out = f"greatest(CAST({float(lo)} AS DOUBLE), {out})"
    return out


def dmean(c: str, scale: int) -> str:
    return f"(CAST(SUM(CAST({c} AS DECIMAL(28,{scale}))) AS DOUBLE) / CAST(COUNT({c}) AS DOUBLE))"


def grade(s: str) -> str:
    return (f"CASE WHEN {s} >= 90 THEN 'A' WHEN {s} >= 80 THEN 'B' WHEN {s} >= 70 THEN 'C' "
            f"WHEN {s} >= 60 THEN 'D' ELSE 'F' END")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, *exprs: str) -> str:
    pieces = template.split("{}")
    assert len(pieces) == len(exprs) + 1, template
    out = [q(pieces[0])]
    for e, tail in zip(exprs, pieces[1:]):
        out += [f"({e})", q(tail)]
    return "(" + " || ".join(out) + ")"


def pct_text(x: str) -> str:
    return f"(CAST(CAST(round_even(({x}) * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


def int_text(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def thousands_text(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def last_rows_cte(name: str, src: str, n: int, offset: int = 0, keys: str = "site_id") -> str:
    cond = f"_rn <= {offset + n}" + (f" AND _rn > {offset}" if offset else "")
    return (f"{name} AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY date DESC) AS _rn FROM {src}) WHERE {cond})")


# ---------------------------------------------------------------- health
def health_ctes(prefix: str = "h", src: str = "daily_metrics", keys: str = "site_id",
                last_n: int | None = 30) -> str:
    """Defines ``{prefix}_health`` with keys, five dims, health_score, health_grade."""
    seo = f"0.5 * {clip('100.0 - (m_position - 1.0) * 4.0', 0, 100)} + 0.5 * m_seo"
    ux = clip(f"(1.0 - m_bounce) * 100.0 * 0.6 + {clip('m_time / 3.0', 0, 100)} * 0.4", 0, 100)
    content = clip(f"m_content * 0.8 + {clip('(m_words - 300.0) / 30.0', 0, 20)}", 0, 100)
    security = clip("70.0 + 15.0 * m_schema + 15.0 * m_mobile", 0, 100)
    recent = last_rows_cte(f"{prefix}_recent", src, last_n, keys=keys) if last_n else \
        f"{prefix}_recent AS (SELECT * FROM {src})"
    return f"""
{recent},
{prefix}_daily AS (
  SELECT {keys}, {dmean('avg_position', 2)} AS m_position, {dmean('page_speed', 1)} AS m_speed,
    {dmean('bounce_rate', 4)} AS m_bounce, {dmean('avg_time_on_site', 1)} AS m_time,
    {dmean('content_score', 1)} AS m_content
  FROM {prefix}_recent GROUP BY {keys}
),
{prefix}_pages AS (
  SELECT {dmean('seo_score', 1)} AS m_seo, {dmean('word_count', 0)} AS m_words,
    {dmean('has_schema', 0)} AS m_schema, {dmean('mobile_friendly', 0)} AS m_mobile
  FROM seo_pages
),
{prefix}_dims AS (
  SELECT {keys}, {rnd(seo, 1)} AS seo, {rnd('m_speed', 1)} AS performance, {rnd(ux, 1)} AS ux,
    {rnd(security, 1)} AS security, {rnd(content, 1)} AS content
  FROM {prefix}_daily CROSS JOIN {prefix}_pages
),
{prefix}_health0 AS (
  SELECT *, {rnd('seo * 0.3 + performance * 0.2 + ux * 0.2 + security * 0.15 + content * 0.15', 1)}
    AS health_score
  FROM {prefix}_dims
),
{prefix}_health AS (SELECT *, {grade('health_score')} AS health_grade FROM {prefix}_health0)"""


def health_body() -> str:
    return ", " + health_ctes().strip() + "\nSELECT * FROM h_health"


# ---------------------------------------------------------------- page rules
def _struct(fields: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def issues_list() -> str:
    """The ordered list of triggered issues of one page (stable by priority)."""
    args = {
        "thin": ("word_count < 400", "CAST(word_count AS VARCHAR)"),
        "alt": ("alt_ratio < 0.6", pct_text("alt_ratio")),
        "slow": ("page_speed < 60", int_text("page_speed")),
        "schema": ("has_schema = 0", None),
        "links": ("internal_links < 5", "CAST(internal_links AS VARCHAR)"),
        "title": ("abs(title_length - 55) > 20", "CAST(title_length AS VARCHAR)"),
    }
    built = []
    for pos, (key, problem, reason, action, gain, prio) in enumerate(T.PAGE_ISSUES):
        cond, arg = args[key]
        reason_sql = fill(reason, arg) if arg else q(reason)
        st = _struct({"problem": q(problem), "reason": reason_sql, "action": q(action),
                      "expected_gain": q(gain), "priority": f"CAST({prio} AS INTEGER)"})
        built.append((prio, pos, f"CASE WHEN {cond} THEN {st} END"))
    items = [s for _, _, s in sorted(built)]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def page_issues_body() -> str:
    return f""", pi AS (SELECT url, {issues_list()} AS issues FROM seo_pages),
pi2 AS (SELECT url, issues, unnest(range(1, len(issues) + 1)) AS issue_rank FROM pi)
SELECT url, CAST(issue_rank AS INTEGER) AS issue_rank, issues[issue_rank].problem AS problem,
  issues[issue_rank].reason AS reason, issues[issue_rank].priority AS priority
FROM pi2"""


def page_recs_ctes(limit: int, name: str = "page_recs") -> str:
    opp = rnd("greatest(CAST(0.0 AS DOUBLE), 80.0 - seo_score) * ln(1 + CAST(organic_traffic AS DOUBLE))", 6)
    return f"""
pr_focus AS (SELECT *, {opp} AS opportunity FROM seo_pages ORDER BY opportunity DESC, url LIMIT {limit}),
pr_i AS (SELECT * FROM (SELECT pr_focus.*, {issues_list()} AS issues FROM pr_focus) WHERE len(issues) > 0),
{name} AS (
  SELECT 0 AS source, CAST(row_number() OVER (ORDER BY opportunity DESC, url) AS INTEGER) AS seq, 'SEO' AS area,
    url || ': ' || issues[1].problem AS problem, issues[1].reason AS reason, issues[1].action AS action,
    issues[1].expected_gain AS expected_gain, issues[1].priority AS priority
  FROM pr_i
)"""


# ---------------------------------------------------------------- site rules
def _rule_struct(spec, problem_args=(), reason_args=(), action_args=()) -> str:
    _, area, problem, reason, action, gain, prio = spec
    return _struct({
        "area": q(area),
        "problem": fill(problem, *problem_args) if problem_args else q(problem),
        "reason": fill(reason, *reason_args) if reason_args else q(reason),
        "action": fill(action, *action_args) if action_args else q(action),
        "expected_gain": q(gain), "priority": f"CAST({prio} AS INTEGER)"})


def site_recs_ctes(name: str = "site_recs") -> str:
    r = {s[0]: s for s in T.SITE_RULES}
    rules = [
        f"CASE WHEN v_prior IS NOT NULL AND v_recent < v_prior * 0.95 THEN "
        f"{_rule_struct(r['traffic_down'], reason_args=[pct_text('1.0 - v_recent / v_prior')])} END",
        f"CASE WHEN bounce > 0.6 THEN {_rule_struct(r['high_bounce'], reason_args=[pct_text('bounce')])} END",
        f"CASE WHEN speed < 70 THEN {_rule_struct(r['slow_site'], reason_args=[int_text('speed')])} END",
    ]
    return f"""
{last_rows_cte('sr_recent', 'daily_metrics', 30)},
{last_rows_cte('sr_prior', 'daily_metrics', 30, offset=30)},
sr_r AS (SELECT site_id, {dmean('visitors', 0)} AS v_recent, {dmean('bounce_rate', 4)} AS bounce,
  {dmean('page_speed', 1)} AS speed FROM sr_recent GROUP BY site_id),
sr_p AS (SELECT site_id, {dmean('visitors', 0)} AS v_prior FROM sr_prior GROUP BY site_id),
sr_l AS (
  SELECT r.site_id, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS recs
  FROM sr_r r LEFT JOIN sr_p p ON r.site_id = p.site_id
),
sr_u AS (SELECT site_id, recs, unnest(range(1, len(recs) + 1)) AS seq FROM sr_l),
{name} AS (
  SELECT site_id, 1 AS source, CAST(seq AS INTEGER) AS seq, recs[seq].area AS area, recs[seq].problem AS problem,
    recs[seq].reason AS reason, recs[seq].action AS action, recs[seq].expected_gain AS expected_gain,
    recs[seq].priority AS priority
  FROM sr_u
)"""


def recs_ctes(limit: int = 8) -> str:
    return f""", {page_recs_ctes(limit).strip()},
{site_recs_ctes().strip()},
all_recs AS (
  SELECT site_id, source, seq, area, problem, reason, action, expected_gain, priority FROM site_recs
  UNION ALL
  SELECT s.site_id, p.source, p.seq, p.area, p.problem, p.reason, p.action, p.expected_gain, p.priority
  FROM page_recs p CROSS JOIN (SELECT DISTINCT site_id FROM daily_metrics) s
),
ranked_recs AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY priority, source, seq) AS INTEGER) AS rank
  FROM all_recs
)"""


def strategy_body(limit: int = 8) -> str:
    return recs_ctes(limit) + """
SELECT *, CASE WHEN priority <= 1 THEN 'today' WHEN priority <= 2 THEN 'this_week' ELSE 'this_month' END AS bucket
FROM ranked_recs"""


def action_plan_body(autonomy: str, limit: int = 8) -> str:
    areas = ", ".join(q(a) for a in T.LOW_RISK_AREAS)
    auto = "TRUE" if autonomy == "auto" else "FALSE"
    return recs_ctes(limit) + f"""
SELECT site_id, rank, area, action, expected_gain, priority,
  CASE WHEN {auto} AND area IN ({areas}) AND priority <= 2 THEN 'simulated' ELSE 'proposed' END AS status
FROM ranked_recs WHERE rank <= {T.PLAN_SIZE}"""


# ---------------------------------------------------------------- cycles
def cycle_kpis_ctes(period: int = 30, season: int = 7, contamination: float = 0.06) -> str:
    last = dmean(f"CASE WHEN _back % {period} < {season} THEN visitors END", 0)
    return zscore_anomalies_ctes(contamination) + f""", cb0 AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) - 1 AS _back,
    COUNT(*) OVER (PARTITION BY site_id) AS _days
  FROM daily_metrics
),
cb AS (
  SELECT *, CAST(ceil(_days / {period}) - floor(_back / {period}) AS INTEGER) AS cycle,
    _days - floor(_back / {period}) * {period} >= {period} AS complete
  FROM cb0
),
{health_ctes('ch', 'cb', 'site_id, cycle', None).strip()},
cb_anom AS (SELECT cb.site_id, cycle, COUNT(*) AS n FROM cb JOIN az ON cb.site_id = az.site_id AND cb.date = az.date GROUP BY 1, 2),
kpis AS (
  SELECT b.*, ch_health.health_score, ch_health.health_grade, CAST(COALESCE(cb_anom.n, 0) AS BIGINT) AS n_anomalies
  FROM (
    SELECT site_id, cycle, bool_and(complete) AS complete, CAST(trunc({dmean('visitors', 0)}) AS BIGINT) AS avg_daily_visitors,
      CAST(SUM(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE) AS monthly_revenue,
      {rnd(dmean('conversion_rate', 4), 4)} AS avg_conversion_rate,
      {rnd(f"COALESCE(100.0 * ({last} / NULLIF({dmean('visitors', 0)}, 0) - 1.0), 0)", 1)} AS predicted_traffic_change_pct
    FROM cb GROUP BY site_id, cycle
  ) b JOIN ch_health ON b.site_id = ch_health.site_id AND b.cycle = ch_health.cycle
  LEFT JOIN cb_anom ON b.site_id = cb_anom.site_id AND b.cycle = cb_anom.cycle
)"""


def one_decimal_text(x: str) -> str:
    t = f"CAST(round_even(({x}) * 10, 0) AS BIGINT)"
    return (f"((CASE WHEN {t} < 0 THEN '-' ELSE '' END) || CAST(CAST(trunc(abs({t}) / 10) AS BIGINT) AS VARCHAR)"
            f" || '.' || CAST(abs({t}) % 10 AS VARCHAR))")


def alerts_body(period: int = 30) -> str:
    change = "(CAST(c_v - p_v AS DOUBLE) / CAST(p_v AS DOUBLE))"

    def alert(level, metric, msg, cond):
        return (f"CASE WHEN {cond} THEN "
                f"{_struct({'level': q(level), 'metric': q(metric), 'message': msg})} END")
    rules = [
        alert("critical", "traffic",
              fill(T.ALERT_TRAFFIC_DOWN, pct_text(f"abs({change})"), thousands_text("p_v"), thousands_text("c_v")),
              f"p_v <> 0 AND {change} <= -0.05"),
        alert("info", "traffic",
              fill(T.ALERT_TRAFFIC_UP, pct_text(change), thousands_text("p_v"), thousands_text("c_v")),
              f"p_v <> 0 AND {change} >= 0.10"),
        alert("warning", "health", fill(T.ALERT_HEALTH_DOWN, int_text("p_h"), int_text("c_h")), "c_h - p_h <= -3"),
        alert("info", "health", fill(T.ALERT_HEALTH_UP, int_text("p_h"), int_text("c_h")), "c_h - p_h >= 3"),
        alert("warning", "anomaly",
              fill(T.ALERT_ANOMALY, "CAST(c_a - p_a AS VARCHAR)", "CAST(p_a AS VARCHAR)", "CAST(c_a AS VARCHAR)"),
              "c_a > p_a"),
        alert("warning", "forecast", fill(T.ALERT_FORECAST, one_decimal_text("fc")), "fc <= -5"),
    ]
    base = _struct({"level": "'info'", "metric": "'baseline'", "message": q(T.ALERT_BASELINE)})
    stable = _struct({"level": "'info'", "metric": "'stable'", "message": q(T.ALERT_STABLE)})
    return cycle_kpis_ctes(period) + f""",
ax AS (
  SELECT site_id, cycle, lag(cycle) OVER w IS NOT NULL AS has_prev,
    COALESCE(avg_daily_visitors, 0) AS c_v, COALESCE(lag(avg_daily_visitors) OVER w, 0) AS p_v,
    CAST(COALESCE(health_score, 0) AS DOUBLE) AS c_h, CAST(COALESCE(lag(health_score) OVER w, 0) AS DOUBLE) AS p_h,
    n_anomalies AS c_a, COALESCE(lag(n_anomalies) OVER w, 0) AS p_a, predicted_traffic_change_pct AS fc
  FROM kpis WINDOW w AS (PARTITION BY site_id ORDER BY cycle)
),
af AS (SELECT *, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS fired FROM ax),
al AS (
  SELECT site_id, cycle,
    CASE WHEN NOT has_prev THEN [{base}] WHEN len(fired) = 0 THEN [{stable}] ELSE fired END AS alerts
  FROM af
),
au AS (SELECT site_id, cycle, alerts, unnest(range(1, len(alerts) + 1)) AS alert_seq FROM al)
SELECT site_id, cycle, CAST(alert_seq AS INTEGER) AS alert_seq, alerts[alert_seq].level AS level,
  alerts[alert_seq].metric AS metric, alerts[alert_seq].message AS message
FROM au"""


def sync_summary_body() -> str:
    return """, s_d AS (SELECT COUNT(*) AS daily_rows, strftime(MIN(date), '%Y-%m-%d') AS date_min,
  strftime(MAX(date), '%Y-%m-%d') AS date_max FROM daily_metrics),
s_p AS (SELECT COUNT(*) AS pages_rows FROM seo_pages),
s_u AS (SELECT COUNT(*) AS users_rows FROM users),
s_k AS (SELECT COUNT(*) AS keywords_rows FROM keywords)
SELECT 'testdata' AS source, daily_rows, pages_rows, users_rows, keywords_rows, date_min, date_max
FROM s_d CROSS JOIN s_p CROSS JOIN s_u CROSS JOIN s_k"""


# ---------------------------------------------------------------- features and splits
from ..sources.schemas import TRAFFIC_LAGS  # noqa: E402
from .oracle import h16, md5_key  # noqa: E402


def traffic_features_ctes(name: str = "tf") -> str:
    lags = ",\n    ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in TRAFFIC_LAGS)
    feats = [f"lag_{k}" for k in TRAFFIC_LAGS] + ["roll_mean_7", "roll_std_7", "momentum_7", "delta"]
    return f""", {name}_0 AS (
  SELECT site_id, date, visitors, CAST(visitors AS DOUBLE) AS y FROM daily_metrics
),
{name}_1 AS (
  SELECT site_id, date, visitors,
    {lags},
    CASE WHEN count(y) OVER w7 = 7 THEN avg(y) OVER w7 END AS roll_mean_7,
    CASE WHEN count(y) OVER w7 = 7 THEN stddev_samp(y) OVER w7 END AS roll_std_7,
    lag(y, 1) OVER w - lag(y, 8) OVER w AS momentum_7,
    isodow(date) - 1 AS dow, month(date) AS month,
    y - lag(y, 1) OVER w AS delta
  FROM {name}_0
  WINDOW w AS (PARTITION BY site_id ORDER BY date),
         w7 AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
),
{name} AS (SELECT * FROM {name}_1 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in feats)})"""


def traffic_features_body() -> str:
    lags = ", ".join(f"lag_{k}" for k in TRAFFIC_LAGS)
    return traffic_features_ctes() + f"""
SELECT site_id, date, visitors, {lags}, {rnd('roll_mean_7', 6)} AS roll_mean_7,
  {rnd('roll_std_7', 6)} AS roll_std_7, momentum_7, CAST(dow AS INTEGER) AS dow, CAST(month AS INTEGER) AS month,
  delta
FROM tf"""


def traffic_split_body(eval_fraction: float = 0.15) -> str:
    keep = repr(1.0 - eval_fraction)
    return traffic_features_ctes() + f"""
SELECT site_id, date,
  CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY date)
       <= CAST(trunc(count(*) OVER (PARTITION BY site_id) * CAST({keep} AS DOUBLE)) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split
FROM tf"""


def seasonal_naive_backtest_body(horizon: int = 14, folds: int = 3, min_train: int = 180) -> str:
    return seasonal_naive_backtest_ctes(horizon, folds, min_train) + "\nSELECT * FROM bt_sn"


def _backtest_summary(fold_cte: str, model: str) -> str:
    """Per site: mean fold MAE (1 dp), mean MAPE over folds that have one (4 dp), mean
    RMSE (1 dp) and the folds used; sites without a usable fold get NULLs and 0."""
    return f"""SELECT s.site_id, '{model}' AS model, MAE, MAPE, RMSE, CAST(COALESCE(folds, 0) AS BIGINT) AS folds
FROM (SELECT DISTINCT site_id FROM daily_metrics) s LEFT JOIN (
  SELECT site_id, {rnd('avg(mae)', 1)} AS MAE, {rnd('avg(mape)', 4)} AS MAPE,
    {rnd('avg(rmse)', 1)} AS RMSE, COUNT(*) AS folds
  FROM {fold_cte} GROUP BY site_id
) b ON s.site_id = b.site_id"""


def seasonal_naive_backtest_ctes(horizon: int = 14, folds: int = 3, min_train: int = 180,
                                 name: str = "bt_sn") -> str:
    return f""", bt_idx AS (
  SELECT site_id, date, visitors, row_number() OVER (PARTITION BY site_id ORDER BY date) - 1 AS idx
  FROM daily_metrics
),
bt_n AS (SELECT site_id, COUNT(*) AS n FROM daily_metrics GROUP BY 1),
bt_folds AS (
  SELECT * FROM (
    SELECT site_id, n, fold, n - {horizon} * ({folds} - fold) AS cut
    FROM bt_n CROSS JOIN range(0, {folds}) t(fold)
  ) WHERE cut >= {min_train} AND cut < n
),
bt_test AS (
  SELECT i.site_id, f.fold, i.idx, f.cut, CAST(i.visitors AS DOUBLE) AS actual,
    f.cut - 7 + (i.idx - f.cut) % 7 AS src_idx
  FROM bt_idx i JOIN bt_folds f ON i.site_id = f.site_id
  WHERE i.idx >= f.cut AND i.idx < f.cut + {horizon}
),
bt_pred AS (
  SELECT t.*, CAST(s.visitors AS DOUBLE) AS pred FROM bt_test t
  JOIN bt_idx s ON t.site_id = s.site_id AND t.src_idx = s.idx
),
bt_fold AS (
  SELECT site_id, fold, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
    avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) AS mape
  FROM bt_pred GROUP BY 1, 2
),
{name} AS (
{_backtest_summary('bt_fold', 'seasonal_naive')}
)"""


def hash_split_body(test_size: float = 0.2) -> str:
    thr = int(round(test_size * 65536))
    return f"""
SELECT site_id, date, CASE WHEN {h16('split', 'site_id', 'date')} < {thr} THEN 'test' ELSE 'train' END AS split
FROM daily_metrics"""


def stratified_split_body(test_size: float = 0.25) -> str:
    return f""", ss AS (
  SELECT user_id, CAST(num_orders > 0 AS INTEGER) AS stratum, {md5_key('strat', 'user_id')} AS hk FROM users
)
SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY hk, user_id)
  <= CAST(trunc(count(*) OVER (PARTITION BY stratum) * CAST({float(test_size)} AS DOUBLE)) AS BIGINT)
  THEN 'test' ELSE 'train' END AS split
FROM ss"""


def group_split_ctes(test_fraction: float = 0.2, name: str = "gs") -> str:
    return f""", {name}_ids AS (SELECT DISTINCT keyword_id FROM keywords),
{name} AS (
  SELECT keyword_id, CASE WHEN row_number() OVER (ORDER BY {md5_key('group', 'keyword_id')}, keyword_id)
    <= greatest(1, CAST(trunc(count(*) OVER () * CAST({float(test_fraction)} AS DOUBLE)) AS BIGINT))
    THEN 'test' ELSE 'train' END AS split
  FROM {name}_ids
)"""


def auc_body() -> str:
    def one(target: str, label: str, score: str) -> str:
        return f"""(
  SELECT '{target}' AS target, '{score}' AS score,
    CASE WHEN SUM(pos) > 0 AND SUM(cnt) - SUM(pos) > 0 THEN
      (SUM(pos * (lo + hi) / 2.0) - CAST(SUM(pos) AS DOUBLE) * (CAST(SUM(pos) AS DOUBLE) + 1.0) / 2.0)
      / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(cnt) - SUM(pos) AS DOUBLE)) END AS auc,
    SUM(pos) AS n_pos, SUM(cnt) - SUM(pos) AS n_neg
  FROM (
    SELECT s, MIN(r) AS lo, MAX(r) AS hi, COUNT_IF(y = 1) AS pos, COUNT(*) AS cnt FROM (
      SELECT {label} AS y, {score} AS s, row_number() OVER (ORDER BY {score}, user_id) AS r FROM users
    ) GROUP BY s
  )
)"""
    return "\n" + one("churned", "churned", "recency_days") + "\nUNION ALL\n" + \
        one("purchase", "CAST(num_orders > 0 AS INTEGER)", "pageviews")


HEURISTIC = rnd("2.5 * relevance + CAST(backlinks AS DOUBLE) / (50.0 + CAST(backlinks AS DOUBLE)) + domain_authority / 25.0", 6)


def ndcg_ctes(src: str, k: int, name: str) -> str:
    return f"""{name}_g AS (SELECT keyword_id FROM {src} GROUP BY 1 HAVING COUNT(*) >= 2),
{name}_x AS (SELECT * FROM {src} WHERE keyword_id IN (SELECT keyword_id FROM {name}_g)),
{name}_b0 AS (
  SELECT keyword_id, rank_score, COUNT(*) AS nb, SUM(CAST(relevance_label AS DOUBLE)) AS gsum
  FROM {name}_x GROUP BY 1, 2
),
{name}_b AS (
  SELECT * FROM (
    SELECT *, CAST(SUM(nb) OVER (PARTITION BY keyword_id ORDER BY rank_score DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nb AS BIGINT) AS start
    FROM {name}_b0
  ) WHERE start < {k}
),
{name}_dcg AS (
  SELECT keyword_id, SUM(gsum / nb * list_reduce(list_transform(range(start, least(start + nb, {k})),
    lambda p: 1.0 / log2(p + 2.0)), lambda a, b: a + b, CAST(0.0 AS DOUBLE))) AS dcg
  FROM {name}_b GROUP BY 1
),
{name}_idcg AS (
  SELECT keyword_id, SUM(CAST(relevance_label AS DOUBLE) / log2(ri + 1.0)) AS idcg FROM (
    SELECT keyword_id, relevance_label,
      row_number() OVER (PARTITION BY keyword_id ORDER BY relevance_label DESC) AS ri
    FROM {name}_x
  ) WHERE ri <= {k} GROUP BY 1
),
{name} AS (
  SELECT AVG(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END) AS ndcg, COUNT(*) AS n_groups
  FROM {name}_dcg JOIN {name}_idcg USING (keyword_id)
)"""


def ndcg_body() -> str:
    return group_split_ctes() + f""",
nd_src AS (
  SELECT k.*, {HEURISTIC} AS rank_score FROM keywords k JOIN gs ON k.keyword_id = gs.keyword_id
  WHERE gs.split = 'test'
),
{ndcg_ctes('nd_src', 10, 'n10')},
{ndcg_ctes('nd_src', 5, 'n5')}
SELECT {rnd('n10.ndcg', 6)} AS ndcg_at_10, n10.n_groups AS n_groups, {rnd('n5.ndcg', 6)} AS ndcg_at_5
FROM n10 CROSS JOIN n5"""


def positions_ctes() -> str:
    return f""", kp AS (
  SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY rank_score DESC, candidate_id) AS predicted_position
  FROM (SELECT *, {HEURISTIC} AS rank_score FROM keywords)
)"""


def positions_body() -> str:
    return positions_ctes() + """
SELECT keyword_id, candidate_id, rank_score, CAST(predicted_position AS INTEGER) AS predicted_position FROM kp"""


def opportunities_body(top: int = 15) -> str:
    return positions_ctes() + f"""
SELECT keyword, search_volume, keyword_difficulty, CAST(predicted_position AS INTEGER) AS predicted_position,
  relevance, backlinks, domain_authority
FROM kp WHERE is_ours = 1 AND predicted_position BETWEEN 4 AND 15
ORDER BY search_volume DESC, keyword, keyword_id LIMIT {top}"""


def standardized_body(features) -> str:
    stats = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS mu_{f}, "
                      f"COALESCE(NULLIF(stddev_pop(CAST({f} AS DOUBLE)), 0.0), 1.0) AS sd_{f}" for f in features)
    zs = ", ".join(rnd(f"(CAST({f} AS DOUBLE) - mu_{f}) / sd_{f}", 6) + f" AS z_{f}" for f in features)
    return f""", st AS (SELECT {stats} FROM users)
SELECT user_id, {zs} FROM users CROSS JOIN st"""


# ---------------------------------------------------------------- customers and segments (stand-in inputs)
def heuristic_scores_cte(name: str = "hs") -> str:
    return f""", {name} AS (
  SELECT *, {rnd('least(CAST(1.0 AS DOUBLE), CAST(pageviews AS DOUBLE) / 100.0)', 4)} AS purchase_prob,
    {rnd('least(CAST(1.0 AS DOUBLE), CAST(recency_days AS DOUBLE) / 365.0)', 4)} AS churn_risk,
    {rnd('CAST(total_spent AS DOUBLE) * 1.5', 2)} AS predicted_clv
  FROM users
)"""


def customer_summary_cte(name: str = "cs") -> str:
    return heuristic_scores_cte() + f""",
{name} AS (
  SELECT COUNT(*) AS customers, {rnd(dmean('purchase_prob', 4), 4)} AS avg_purchase_prob,
    {rnd(dmean('churn_risk', 4), 4)} AS avg_churn_risk,
    COUNT_IF(churn_risk >= 0.5) AS high_churn_customers,
    {rnd('CAST(SUM(CAST(churn_risk AS DECIMAL(8,4)) * CAST(predicted_clv AS DECIMAL(18,2))) AS DOUBLE)', 2)}
      AS revenue_at_risk,
    {rnd(dmean('predicted_clv', 2), 2)} AS avg_predicted_clv,
    COUNT_IF(num_orders = 0 AND purchase_prob >= 0.5) AS conversion_opportunities
  FROM hs
)"""


def customer_summary_body() -> str:
    return customer_summary_cte() + "\nSELECT * FROM cs"


def customer_recs_ctes(name: str = "cr_all") -> str:
    r = {s[0]: s for s in T.CUSTOMER_RULES}
    rules = [
        f"CASE WHEN high_churn_customers > 0 THEN {_rule_struct(r['churn'], problem_args=['CAST(high_churn_customers AS VARCHAR)'], reason_args=[thousands_text('COALESCE(revenue_at_risk, 0.0)')])} END",
        f"CASE WHEN conversion_opportunities > 0 THEN {_rule_struct(r['intent'], problem_args=['CAST(conversion_opportunities AS VARCHAR)'])} END",
    ]
    return customer_summary_cte() + f""",
cr AS (SELECT list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS recs FROM cs),
cru AS (SELECT recs, unnest(range(1, len(recs) + 1)) AS seq FROM cr),
{name} AS (
  SELECT 2 AS source, CAST(seq AS INTEGER) AS seq, recs[seq].area AS area, recs[seq].problem AS problem,
    recs[seq].reason AS reason, recs[seq].action AS action, recs[seq].expected_gain AS expected_gain,
    recs[seq].priority AS priority
  FROM cru
)"""


def customer_recs_body() -> str:
    return customer_recs_ctes() + "\nSELECT * FROM cr_all"


def top_at_risk_body(n: int = 10) -> str:
    return heuristic_scores_cte() + f"""
SELECT user_id, purchase_prob, churn_risk, predicted_clv FROM hs
ORDER BY churn_risk DESC, predicted_clv DESC, user_id LIMIT {n}"""


def fixed_segments_body(features, k: int = 4) -> str:
    stats = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS mu_{f}, "
                      f"COALESCE(NULLIF(stddev_pop(CAST({f} AS DOUBLE)), 0.0), 1.0) AS sd_{f}" for f in features)
    zs = ", ".join(rnd(f"(CAST({f} AS DOUBLE) - mu_{f}) / sd_{f}", 6) + f" AS z_{f}" for f in features)
    dist = " + ".join(f"(u.z_{f} - c.z_{f}) * (u.z_{f} - c.z_{f})" for f in features)
    prof = ", ".join(f"{dmean(f, 2)} AS {f}" for f in features)
    rest = T.PERSONA_REST
    rest_case = " ".join(f"WHEN r3 = {i + 1} THEN {q(n)}" for i, n in enumerate(rest))
    return f""", fs_st AS (SELECT {stats} FROM users),
fs_z AS (SELECT users.*, {zs} FROM users CROSS JOIN fs_st),
fs_c AS (
  SELECT CAST(row_number() OVER (ORDER BY hk, user_id) - 1 AS INTEGER) AS cluster, * FROM (
    SELECT *, {md5_key('centroid', 'user_id')} AS hk FROM fs_z ORDER BY hk, user_id LIMIT {k})
),
fs_a AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT u.*, c.cluster, row_number() OVER (PARTITION BY u.user_id ORDER BY {dist}, c.cluster) AS rk
    FROM fs_z u CROSS JOIN fs_c c
  ) WHERE rk = 1
),
fs_p AS (SELECT cluster, {prof} FROM fs_a GROUP BY cluster),
fs_r1 AS (SELECT *, row_number() OVER (ORDER BY total_spent DESC, cluster) AS r1 FROM fs_p),
fs_r2 AS (SELECT *, row_number() OVER (ORDER BY r1 = 1, pageviews DESC, cluster) AS r2 FROM fs_r1),
fs_r3 AS (SELECT *, row_number() OVER (ORDER BY (r1 = 1 OR r2 = 1), sessions DESC, cluster) AS r3 FROM fs_r2),
fs_l AS (
  SELECT cluster, CASE WHEN r1 = 1 THEN {q(T.PERSONA_BUYER)} WHEN r2 = 1 THEN {q(T.PERSONA_POTENTIAL)}
    {rest_case} ELSE 'Segment ' || CAST(cluster AS VARCHAR) END AS segment_label
  FROM fs_r3
),
fs_s AS (
  SELECT segment_label, COUNT(user_id) AS users, {dmean('num_orders', 0)} AS avg_orders,
    {dmean('total_spent', 2)} AS avg_spent, {dmean('pageviews', 0)} AS avg_pageviews
  FROM fs_a JOIN fs_l ON fs_a.cluster = fs_l.cluster GROUP BY segment_label
)
SELECT *, {rnd('avg_spent * (1.0 + avg_orders)', 2)} AS est_clv FROM fs_s"""


def zscore_anomalies_body(contamination: float = 0.06) -> str:
    return zscore_anomalies_ctes(contamination) + """
SELECT site_id, date, anomaly_score FROM az"""


def zscore_anomalies_ctes(contamination: float = 0.06) -> str:
    p = repr(1.0 - contamination)
    return f""", az_st AS (
  SELECT site_id, avg(CAST(visitors AS DOUBLE)) AS mu,
    COALESCE(NULLIF(stddev_pop(CAST(visitors AS DOUBLE)), 0.0), 1.0) AS sd
  FROM daily_metrics GROUP BY site_id
),
az_s AS (
  SELECT d.site_id, d.date, {rnd('abs((CAST(d.visitors AS DOUBLE) - st.mu) / st.sd)', 6)} AS s
  FROM daily_metrics d JOIN az_st st ON d.site_id = st.site_id
),
az_t AS (SELECT site_id, {rnd(f'quantile_cont(s, {p})', 6)} AS threshold FROM az_s GROUP BY site_id),
az AS (
  SELECT s.site_id, s.date, s.s - t.threshold AS anomaly_score
  FROM az_s s JOIN az_t t ON s.site_id = t.site_id
  WHERE s.s - t.threshold > 0
)"""


def site_recs_with_anomalies_body() -> str:
    return site_recs_with_anomalies_ctes() + "\nSELECT * FROM sa_all"


def site_recs_with_anomalies_ctes(name: str = "sa_all") -> str:
    r = {s[0]: s for s in T.SITE_RULES}
    anomaly = _rule_struct(r["anomalies"], problem_args=["CAST(n_anom AS VARCHAR)"],
                           reason_args=["strftime(top_day, '%Y-%m-%d')"])
    base = site_recs_ctes("site_recs0").strip()
    return zscore_anomalies_ctes() + f""",
{base},
sa_top AS (
  SELECT site_id, date AS top_day FROM (
    SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY anomaly_score DESC, date) AS rk
    FROM az) WHERE rk = 1
),
sa_n AS (SELECT site_id, COUNT(*) AS n_anom FROM az GROUP BY site_id),
sa_x AS (
  SELECT l.site_id, n.n_anom, t.top_day FROM (SELECT DISTINCT site_id FROM daily_metrics) l
  LEFT JOIN sa_n n ON l.site_id = n.site_id LEFT JOIN sa_top t ON l.site_id = t.site_id
),
sa_extra AS (
  SELECT site_id, 1 AS source, CAST(seq AS INTEGER) AS seq, r.area AS area, r.problem AS problem,
    r.reason AS reason, r.action AS action, r.expected_gain AS expected_gain, r.priority AS priority
  FROM (
    SELECT x.site_id, COALESCE(c.cnt, 0) + 1 AS seq, {anomaly} AS r FROM sa_x x
    LEFT JOIN (SELECT site_id, COUNT(*) AS cnt FROM site_recs0 GROUP BY site_id) c ON x.site_id = c.site_id
    WHERE COALESCE(x.n_anom, 0) > 0
  )
),
{name} AS (SELECT * FROM site_recs0 UNION ALL SELECT * FROM sa_extra)"""


# ---------------------------------------------------------------- insight tables on stand-in models
def naive_forecast_ctes(horizon: int = 30, season: int = 7, name: str = "fc") -> str:
    """Seasonal-naive forecast: day ``j`` after the last repeats index ``n - season + j % season``."""
    return f""", fc_idx AS (
  SELECT site_id, visitors, row_number() OVER (PARTITION BY site_id ORDER BY date) - 1 AS idx FROM daily_metrics
),
fc_n AS (SELECT site_id, COUNT(*) AS n, max(date) AS last_day FROM daily_metrics GROUP BY site_id),
{name} AS (
  SELECT n.site_id, CAST(n.last_day + CAST(t.step + 1 AS INTEGER) AS DATE) AS date,
    CAST(i.visitors AS BIGINT) AS predicted_visitors
  FROM fc_n n CROSS JOIN range(0, {horizon}) t(step)
  JOIN fc_idx i ON i.site_id = n.site_id AND i.idx = n.n - {season} + t.step % {season}
)"""


def history_forecast_body(days: int = 60, horizon: int = 30) -> str:
    return naive_forecast_ctes(horizon) + f""",
{last_rows_cte('hf_hist', 'daily_metrics', days)}
SELECT site_id, date, CAST(visitors AS BIGINT) AS visitors, 'actual' AS kind FROM hf_hist
UNION ALL
SELECT site_id, date, predicted_visitors AS visitors, 'forecast' AS kind FROM fc"""


def forecast_records_body(horizon: int = 30) -> str:
    return naive_forecast_ctes(horizon) + """
SELECT CAST(to_json({'site_id': site_id, 'date': strftime(date, '%Y-%m-%d'),
  'predicted_visitors': predicted_visitors}) AS VARCHAR) AS record
FROM fc"""


def kpi_row_body(horizon: int = 30, page_limit: int = 8) -> str:
    """The 13 KPIs per site from a seasonal-naive forecast, z-score anomaly flags,
    heuristic customer scores and every recommendation source."""
    return (customer_recs_ctes() + site_recs_with_anomalies_ctes() + naive_forecast_ctes(horizon)
            + ", " + page_recs_ctes(page_limit).strip() + ", " + health_ctes("kh").strip() + f""",
{last_rows_cte('kp_recent', 'daily_metrics', 30)},
kp_r AS (
  SELECT site_id, CAST(trunc({dmean('visitors', 0)}) AS BIGINT) AS avg_daily_visitors, {dmean('visitors', 0)} AS v_recent,
    CAST(SUM(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE) AS monthly_revenue,
    {rnd(dmean('conversion_rate', 4), 4)} AS avg_conversion_rate
  FROM kp_recent GROUP BY site_id
),
kp_f AS (
  SELECT site_id, {dmean('predicted_visitors', 0)} AS v_fc, CAST(COUNT(*) AS INTEGER) AS forecast_horizon_days
  FROM fc GROUP BY site_id
),
kp_a AS (SELECT site_id, COUNT(*) AS n FROM az GROUP BY site_id),
kp_s AS (SELECT site_id, COUNT(*) AS n FROM sa_all GROUP BY site_id),
kp_free AS (SELECT (SELECT COUNT(*) FROM page_recs) + (SELECT COUNT(*) FROM cr_all) AS n)
SELECT r.site_id, r.avg_daily_visitors, CAST(trunc(f.v_fc) AS BIGINT) AS forecast_avg_visitors,
  f.forecast_horizon_days, {rnd('100.0 * (f.v_fc / r.v_recent - 1.0)', 1)} AS predicted_traffic_change_pct,
  r.monthly_revenue, r.avg_conversion_rate, h.health_score, h.health_grade,
  COALESCE(a.n, 0) AS n_anomalies, COALESCE(s.n, 0) + kp_free.n AS n_recommendations,
  cs.revenue_at_risk, cs.high_churn_customers, cs.conversion_opportunities
FROM kp_r r LEFT JOIN kp_f f ON r.site_id = f.site_id LEFT JOIN kh_health h ON r.site_id = h.site_id
  LEFT JOIN kp_a a ON r.site_id = a.site_id LEFT JOIN kp_s s ON r.site_id = s.site_id
  CROSS JOIN kp_free CROSS JOIN cs""")


def top_anomalies_body(n: int = 3) -> str:
    """The report's most anomalous days per site: score desc, then date."""
    return zscore_anomalies_ctes() + f"""
SELECT site_id, date, anomaly_score FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY anomaly_score DESC, date) AS rk FROM az
) WHERE rk <= {n}"""


def holt_winters_fixed_body(alpha: float, beta: float, gamma: float, horizon: int = 30, m: int = 7) -> str:
    """Holt-Winters (additive trend and season) at fixed smoothing, as a recursive CTE:
    one row per (site, t) carrying level, trend and the season list."""
    a, b, g = (f"CAST({v!r} AS DOUBLE)" for v in (alpha, beta, gamma))
    one, mm = "CAST(1 AS DOUBLE)", f"CAST({m} AS DOUBLE)"
    return f""", hw_y AS (
  SELECT site_id, CAST(visitors AS DOUBLE) AS y, row_number() OVER (PARTITION BY site_id ORDER BY date) - 1 AS t
  FROM daily_metrics
),
hw_n AS (SELECT site_id, COUNT(*) AS n, max(date) AS last_day FROM daily_metrics GROUP BY site_id),
hw_init AS (
  SELECT site_id, SUM(y) FILTER (WHERE t < {m}) / {mm} AS m1,
    SUM(y) FILTER (WHERE t >= {m} AND t < {2 * m}) / {mm} AS m2,
    list(y ORDER BY t) FILTER (WHERE t < {m}) AS first
  FROM hw_y GROUP BY site_id
),
hw_rec AS (
  SELECT site_id, 0 AS t, m1 AS level, (m2 - m1) / {mm} AS trend, list_transform(first, lambda x: x - m1) AS season
  FROM hw_init
  UNION ALL
  SELECT site_id, t + 1, nl, {b} * (nl - level) + ({one} - {b}) * trend,
    list_concat(list_slice(season, 1, k), [{g} * (y - nl) + ({one} - {g}) * s], list_slice(season, k + 2, {m}))
  FROM (
    SELECT r.site_id, r.t, r.level, r.trend, r.season, y.y, CAST(r.t % {m} AS BIGINT) AS k,
      r.season[CAST(r.t % {m} AS BIGINT) + 1] AS s,
      {a} * (y.y - r.season[CAST(r.t % {m} AS BIGINT) + 1]) + ({one} - {a}) * (r.level + r.trend) AS nl
    FROM hw_rec r JOIN hw_y y ON y.site_id = r.site_id AND y.t = r.t
  )
),
hw_last AS (
  SELECT r.* FROM hw_rec r JOIN hw_n n ON r.site_id = n.site_id AND r.t = n.n
),
hw_tail AS (SELECT site_id, y AS last_y FROM hw_y y JOIN hw_n n USING (site_id) WHERE y.t = n.n - 1),
hw_fc AS (
  SELECT n.site_id, CAST(h.h AS INTEGER) AS h, n.last_day,
    CASE WHEN n.n < {2 * m} THEN tl.last_y
      ELSE l.level + CAST(h.h AS DOUBLE) * l.trend + l.season[CAST((n.n + h.h - 1) % {m} AS BIGINT) + 1] END AS v
  FROM hw_n n CROSS JOIN range(1, {horizon + 1}) h(h)
  LEFT JOIN hw_last l ON l.site_id = n.site_id LEFT JOIN hw_tail tl ON tl.site_id = n.site_id
)
SELECT site_id, CAST(last_day + h AS DATE) AS date,
  CAST(round_even(greatest(v, CAST(0 AS DOUBLE)), 0) AS BIGINT) AS predicted_visitors
FROM hw_fc"""


def holt_winters_grid_body(alphas, betas, gammas, horizon: int = 30, m: int = 7) -> str:
    """Holt-Winters with the smoothing chosen by in-sample squared error: one recursion
    per site and grid point, the first of the least errors wins."""
    values = ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({g!r} AS DOUBLE))" for i, (a, b, g) in enumerate(
        (a, b, g) for a in alphas for b in betas for g in gammas))
    one, mm, k = "CAST(1 AS DOUBLE)", f"CAST({m} AS DOUBLE)", f"CAST(r.t % {m} AS BIGINT)"
    return f""", hg_p(gid, a, b, g) AS (VALUES {values}),
hg_y AS (
  SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY date) - 1 AS t, CAST(visitors AS DOUBLE) AS y FROM daily_metrics
),
hg_n AS (SELECT site_id, COUNT(*) AS n, max(date) AS last_day FROM daily_metrics GROUP BY site_id),
hg_i AS (
  SELECT site_id, SUM(y) FILTER (WHERE t < {m}) / {mm} AS m1, SUM(y) FILTER (WHERE t >= {m} AND t < {2 * m}) / {mm} AS m2,
    list(y ORDER BY t) FILTER (WHERE t < {m}) AS first
  FROM hg_y GROUP BY site_id
),
hg AS (
  SELECT site_id, gid, a, b, g, 0 AS t, m1 AS level, (m2 - m1) / {mm} AS trend,
    list_transform(first, lambda x: x - m1) AS season, CAST(0 AS DOUBLE) AS sse
  FROM hg_i CROSS JOIN hg_p
  UNION ALL
  SELECT site_id, gid, a, b, g, t + 1, nl, b * (nl - level) + ({one} - b) * trend,
    list_concat(list_slice(season, 1, k), [g * (y - nl) + ({one} - g) * s], list_slice(season, k + 2, {m})),
    sse + (y - (level + trend + s)) * (y - (level + trend + s))
  FROM (
    SELECT r.*, y.y, {k} AS k, r.season[{k} + 1] AS s,
      r.a * (y.y - r.season[{k} + 1]) + ({one} - r.a) * (r.level + r.trend) AS nl
    FROM hg r JOIN hg_y y ON y.site_id = r.site_id AND y.t = r.t
  )
),
hg_best AS (
  SELECT * FROM (
    SELECT r.*, n.n, n.last_day, row_number() OVER (PARTITION BY r.site_id ORDER BY sse, gid) AS place
    FROM hg r JOIN hg_n n ON r.site_id = n.site_id AND r.t = n.n
  ) WHERE place = 1
)
SELECT site_id, CAST(last_day + CAST(h.h AS INTEGER) AS DATE) AS date,
  CASE WHEN n >= {2 * m} THEN CAST(round_even(greatest(level + CAST(h.h AS DOUBLE) * trend
    + season[CAST((n + h.h - 1) % {m} AS BIGINT) + 1], CAST(0 AS DOUBLE)), 0) AS BIGINT) END AS predicted_visitors
FROM hg_best CROSS JOIN range(1, {horizon + 1}) h(h)"""


def kmeans_step_body(scale: dict, centers: list) -> str:
    """One step of K-Means over z-scores in whole multiples of 2^-20, for every restart."""
    grid = "CAST(1 AS DOUBLE) / 1048576"
    z = ", ".join(f"round_even(((CAST({f} AS DOUBLE) - CAST({m!r} AS DOUBLE)) / CAST({s!r} AS DOUBLE)) * 1048576, 0) AS {f}" for f, (m, s) in scale.items())
    values = ", ".join(f"({i}, {c}, " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in row) + ")"
                       for i, rows in enumerate(centers) for c, row in enumerate(rows))
    far = " + ".join(f"(z.{f} / 1048576 - c.{f}) * (z.{f} / 1048576 - c.{f})" for f in scale)
    sums = ", ".join(f"SUM({f}) AS {f}" for f in scale)
    means = ", ".join(rnd(f"p.{f} / 1048576 / p.n", 9) + f" AS {f}" for f in scale)
    return f""", z AS (SELECT user_id, {z} FROM users),
c(restart, cluster, {", ".join(scale)}) AS (VALUES {values}),
far AS (SELECT z.*, c.restart, c.cluster, {far} AS d FROM z CROSS JOIN c),
own AS (SELECT *, row_number() OVER (PARTITION BY user_id, restart ORDER BY d, cluster) AS k FROM far),
p AS (SELECT restart, cluster, COUNT(*) AS n, {sums} FROM own WHERE k = 1 GROUP BY 1, 2),
cost AS (SELECT restart, SUM(round_even(d * 1048576, 0)) * ({grid}) AS cost FROM own WHERE k = 1 GROUP BY 1)
SELECT CAST(c.restart AS INTEGER) AS restart, CAST(c.cluster AS INTEGER) AS cluster, COALESCE(p.n, 0) AS n, {means},
  {rnd("cost.cost", 4)} AS cost
FROM c LEFT JOIN p ON c.restart = p.restart AND c.cluster = p.cluster JOIN cost ON cost.restart = c.restart"""


def trees_sql(model) -> str:
    """The summed trees of a boosted model as one expression over its feature columns."""
    def node(tree: int, i: int) -> str:
        if i < 0:
            return f"CAST({float(model.value[tree][~i])!r} AS DOUBLE)"
        column, cut = model.features[int(model.feature[tree][i])], float(model.threshold[tree][i])
        below, above = node(tree, int(model.left[tree][i])), node(tree, int(model.right[tree][i]))
        return f"CASE WHEN CAST({column} AS DOUBLE) > {cut!r} THEN {above} ELSE {below} END"
    out = f"CAST({model.base!r} AS DOUBLE)"
    for t in range(len(model.feature)):
        out = f"({out} + {node(t, 0)})"
    return out


def latest_snapshot_body(period: int = 30) -> str:
    """Latest stored cycle per site, with the cycle the next run will write."""
    return cycle_kpis_ctes(period) + """
SELECT k.*, CAST(k.cycle + 1 AS INTEGER) AS next_cycle FROM kpis k
JOIN (SELECT site_id, max(cycle) AS mc FROM kpis GROUP BY site_id) m ON k.site_id = m.site_id AND k.cycle = m.mc"""


def holt_winters_backtest_ctes(alpha: float, beta: float, gamma: float, horizon: int = 14, folds: int = 3,
                               m: int = 7, name: str = "bt_hw") -> str:
    """Walk-forward Holt-Winters at fixed smoothing: the recursion runs per (site, fold)
    over the training prefix ``[0, cut)``; needs ``bt_idx`` / ``bt_folds`` above."""
    a, b, g = (f"CAST({v!r} AS DOUBLE)" for v in (alpha, beta, gamma))
    one, mm = "CAST(1 AS DOUBLE)", f"CAST({m} AS DOUBLE)"
    return f""",
hwb_y AS (SELECT site_id, idx AS t, CAST(visitors AS DOUBLE) AS y FROM bt_idx),
hwb_init AS (
  SELECT site_id, SUM(y) FILTER (WHERE t < {m}) / {mm} AS m1,
    SUM(y) FILTER (WHERE t >= {m} AND t < {2 * m}) / {mm} AS m2,
    list(y ORDER BY t) FILTER (WHERE t < {m}) AS first
  FROM hwb_y GROUP BY site_id
),
hwb_rec AS (
  SELECT i.site_id, f.fold, f.cut, 0 AS t, i.m1 AS level, (i.m2 - i.m1) / {mm} AS trend,
    list_transform(i.first, lambda x: x - i.m1) AS season
  FROM hwb_init i JOIN bt_folds f ON i.site_id = f.site_id
  UNION ALL
  SELECT site_id, fold, cut, t + 1, nl, {b} * (nl - level) + ({one} - {b}) * trend,
    list_concat(list_slice(season, 1, k), [{g} * (y - nl) + ({one} - {g}) * s], list_slice(season, k + 2, {m}))
  FROM (
    SELECT r.site_id, r.fold, r.cut, r.t, r.level, r.trend, r.season, y.y, CAST(r.t % {m} AS BIGINT) AS k,
      r.season[CAST(r.t % {m} AS BIGINT) + 1] AS s,
      {a} * (y.y - r.season[CAST(r.t % {m} AS BIGINT) + 1]) + ({one} - {a}) * (r.level + r.trend) AS nl
    FROM hwb_rec r JOIN hwb_y y ON y.site_id = r.site_id AND y.t = r.t
    WHERE r.t < r.cut
  )
),
hwb_pred AS (
  SELECT r.site_id, r.fold, y.y AS actual,
    round_even(greatest(r.level + CAST(h.h AS DOUBLE) * r.trend
      + r.season[CAST((r.cut + h.h - 1) % {m} AS BIGINT) + 1], CAST(0 AS DOUBLE)), 0) AS pred
  FROM hwb_rec r CROSS JOIN range(1, {horizon + 1}) h(h)
  JOIN hwb_y y ON y.site_id = r.site_id AND y.t = r.cut + h.h - 1
  WHERE r.t = r.cut
),
hwb_fold AS (
  SELECT site_id, fold, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
    avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) AS mape
  FROM hwb_pred GROUP BY 1, 2
),
{name} AS (
{_backtest_summary('hwb_fold', 'holt_winters_fixed')}
)"""


def deterministic_comparison_body(alpha: float, beta: float, gamma: float, horizon: int = 14,
                                  folds: int = 3, min_train: int = 180) -> str:
    """Both backtests in one table; ``rank`` 1 = lowest rounded MAE per site (NULLs last)."""
    return (seasonal_naive_backtest_ctes(horizon, folds, min_train)
            + holt_winters_backtest_ctes(alpha, beta, gamma, horizon, folds) + """
SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY MAE ASC NULLS LAST, model) AS INTEGER) AS rank
FROM (SELECT * FROM bt_sn UNION ALL SELECT * FROM bt_hw)""")


def corr_importance_cte(features, target: str = "revenue", name: str = "li_imp") -> str:
    """Stand-in for the sales model's importance: |corr(feature, target)|, 6 dp (0 if undefined)."""
    parts = [f"SELECT '{f}' AS feature, COALESCE({rnd(f'abs(corr(CAST({f} AS DOUBLE), CAST({target} AS DOUBLE)))', 6)}, "
             f"CAST(0 AS DOUBLE)) AS importance FROM daily_metrics" for f in features]
    return f""", {name} AS (
  {chr(10).join(p + (' UNION ALL' if i < len(parts) - 1 else '') for i, p in enumerate(parts))}
)"""


def site_recs_with_lever_body(features) -> str:
    """Trend rules, then the top revenue lever (largest importance, ties to the larger name)."""
    r = {s[0]: s for s in T.SITE_RULES}
    lever = _rule_struct(r["revenue_lever"], reason_args=["top_lever"], action_args=["top_lever"])
    base = site_recs_ctes("site_recs0").strip()
    return corr_importance_cte(features) + f""",
{base},
li_top AS (SELECT feature AS top_lever FROM li_imp ORDER BY importance DESC, feature DESC LIMIT 1),
li_extra AS (
  SELECT site_id, 1 AS source, CAST(seq AS INTEGER) AS seq, r.area AS area, r.problem AS problem,
    r.reason AS reason, r.action AS action, r.expected_gain AS expected_gain, r.priority AS priority
  FROM (
    SELECT x.site_id, COALESCE(c.cnt, 0) + 1 AS seq, {lever} AS r
    FROM (SELECT DISTINCT site_id FROM sr_r) x CROSS JOIN li_top
    LEFT JOIN (SELECT site_id, COUNT(*) AS cnt FROM site_recs0 GROUP BY site_id) c ON x.site_id = c.site_id
  )
)
SELECT * FROM site_recs0 UNION ALL SELECT * FROM li_extra"""


def persistence_metrics_body(eval_fraction: float = 0.15) -> str:
    """The traffic model's evaluation on the chronological test tail, for a zero-delta
    predictor (level = max(0, lag_1)): MAE, RMSE, both MAPE forms and R² per site (6 dp)."""
    keep = repr(1.0 - eval_fraction)
    eps = "CAST(2.220446049250313e-16 AS DOUBLE)"
    return traffic_features_ctes() + f""",
pm AS (
  SELECT site_id, CAST(visitors AS DOUBLE) AS a, greatest(CAST(0 AS DOUBLE), CAST(lag_1 AS DOUBLE)) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY site_id) AS cnt
    FROM tf
  ) WHERE rn > CAST(trunc(cnt * CAST({keep} AS DOUBLE)) AS BIGINT)
)
SELECT site_id, {rnd('avg(abs(a - p))', 6)} AS mae, {rnd('sqrt(avg((a - p) * (a - p)))', 6)} AS rmse,
  {rnd('avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END)', 6)} AS mape,
  {rnd(f'avg(abs(a - p) / greatest(abs(a), {eps}))', 6)} AS mape_eps,
  {rnd('CAST(1 AS DOUBLE) - sum((a - p) * (a - p)) / (var_pop(a) * count(a))', 6)} AS r2, COUNT(*) AS n
FROM pm GROUP BY site_id"""
