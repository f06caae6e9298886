"""Registered queries (Spark) and their DuckDB oracles, keyed by the same name.

Every query reads the driver's tables through the adapter, over whole tables.
Oracle SQL is assembled from the CTE builders in ``oracle.py`` and reuses the
fixed texts of ``operators.texts`` so both sides print identical strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import testdata as td
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- sources
DAILY_COLS = ("site_id, date, visitors, sessions, organic_traffic, paid_traffic, bounce_rate, "
              "avg_time_on_site, ctr, avg_position, backlinks, page_speed, content_score, "
              "conversion_rate, sales, revenue")


@register("daily_metrics", O.with_ctes(O.daily_ctes(), body=f"SELECT {DAILY_COLS} FROM daily_metrics"))
def q_daily_metrics(spark, sf):
    return td.daily_metrics(spark, sf)


@register("daily_metrics_by_site",
          O.with_ctes(O.daily_ctes(by_site=True), body=f"SELECT {DAILY_COLS} FROM daily_metrics"))
def q_daily_metrics_by_site(spark, sf):
    return td.daily_metrics(spark, sf, by_site=True)


@register("seo_pages", O.with_ctes(O.pages_ctes(), body="SELECT * FROM seo_pages"))
def q_seo_pages(spark, sf):
    return td.seo_pages(spark, sf)


@register("users", O.with_ctes(O.users_ctes(), body="SELECT * FROM users"))
def q_users(spark, sf):
    return td.users(spark, sf)


@register("keywords", O.with_ctes(O.keywords_ctes(), body="SELECT * FROM keywords"))
def q_keywords(spark, sf):
    return td.keywords(spark, sf)


# ---------------------------------------------------------------- health
def _health_sql(by_site: bool) -> str:
    from .oracle_queries import health_body
    return O.with_ctes(O.daily_ctes(by_site), O.pages_ctes(), body=health_body())


@register("health_score", _health_sql(False))
def q_health(spark, sf):
    from ..operators.health import compute_health
    return compute_health(td.daily_metrics(spark, sf), td.seo_pages(spark, sf))


@register("health_score_by_site", _health_sql(True))
def q_health_by_site(spark, sf):
    from ..operators.health import compute_health
    return compute_health(td.daily_metrics(spark, sf, by_site=True), td.seo_pages(spark, sf))


# ---------------------------------------------------------------- rules
from . import oracle_queries as OQ  # noqa: E402


def _tables(spark, sf, by_site=False, once=False):
    daily = td.daily_metrics(spark, sf, by_site=by_site)
    return (_materialized(daily) if once else daily), td.seo_pages(spark, sf)


@register("page_issues", O.with_ctes(O.pages_ctes(), body=OQ.page_issues_body()))
def q_page_issues(spark, sf):
    from ..operators.rules import page_issues_long
    return page_issues_long(td.seo_pages(spark, sf))


@register("page_recommendations",
          O.with_ctes(O.pages_ctes(), body=", " + OQ.page_recs_ctes(10).strip() + "\nSELECT * FROM page_recs"))
def q_page_recs(spark, sf):
    from ..operators.rules import page_recommendations
    return page_recommendations(td.seo_pages(spark, sf), limit=10)


@register("site_recommendations",
          O.with_ctes(O.daily_ctes(), body=", " + OQ.site_recs_ctes().strip() + "\nSELECT * FROM site_recs"))
def q_site_recs(spark, sf):
    from ..operators.rules import site_recommendations
    return site_recommendations(td.daily_metrics(spark, sf))


def _recs(spark, sf, by_site=False):
    from ..operators.rules import combine_recommendations, page_recommendations, site_recommendations
    daily, pages = _tables(spark, sf, by_site, once=True)
    return combine_recommendations(site_recommendations(daily), page_recommendations(pages, limit=8),
                                   sites=daily.select("site_id"))


@register("strategy", O.with_ctes(O.daily_ctes(), O.pages_ctes(), body=OQ.strategy_body(8)))
def q_strategy(spark, sf):
    from ..operators.rules import build_strategy
    return build_strategy(_recs(spark, sf))


@register("strategy_by_site", O.with_ctes(O.daily_ctes(True), O.pages_ctes(), body=OQ.strategy_body(8)))
def q_strategy_by_site(spark, sf):
    from ..operators.rules import build_strategy
    return build_strategy(_recs(spark, sf, by_site=True))


@register("action_plan", O.with_ctes(O.daily_ctes(), O.pages_ctes(), body=OQ.action_plan_body("auto", 8)))
def q_action_plan(spark, sf):
    from ..operators.rules import plan_actions
    return plan_actions(_recs(spark, sf), autonomy="auto")


# ---------------------------------------------------------------- cycles
@register("kpi_cycles", O.with_ctes(O.daily_ctes(True), O.pages_ctes(),
                                    body=OQ.cycle_kpis_ctes(30) + "\nSELECT * FROM kpis"))
def q_kpi_cycles(spark, sf):
    from ..operators.cycle import cycle_kpis
    daily, pages = _tables(spark, sf, by_site=True, once=True)
    return cycle_kpis(daily, pages, 30, anomalies=_zscore_flags(daily))


@register("kpi_alerts", O.with_ctes(O.daily_ctes(True), O.pages_ctes(), body=OQ.alerts_body(30)))
def q_kpi_alerts(spark, sf):
    from ..operators.cycle import cycle_kpis, diff_snapshots
    daily, pages = _tables(spark, sf, by_site=True, once=True)
    return diff_snapshots(cycle_kpis(daily, pages, 30, anomalies=_zscore_flags(daily)))


@register("latest_snapshot", O.with_ctes(O.daily_ctes(True), O.pages_ctes(), body=OQ.latest_snapshot_body(30)))
def q_latest_snapshot(spark, sf):
    """The cycle store read back: per site the latest committed cycle's KPIs (``max_by``, no
    sort) and the counter the next cycle gets, over a history of 30-day cycles that went in by two commits."""
    from ..operators.cycle import CycleStore, cycle_kpis, latest_snapshot, next_cycle
    from ..session import ensure_checkpoint_dir
    daily, pages = _tables(spark, sf, by_site=True, once=True)
    history = _materialized(cycle_kpis(daily, pages, 30, anomalies=_zscore_flags(daily)))
    state = CycleStore(spark, f"{ensure_checkpoint_dir(spark)}/cycles-{uuid.uuid4().hex}")
    state.commit("early", 1, {"snapshots": history.where("cycle <= 40")})
    state.commit("late", 2, {"snapshots": history.where("cycle > 40")})
    snaps = state.read("snapshots").select(*history.columns)
    nxt = next_cycle(snaps).withColumnRenamed("cycle", "next_cycle")
    latest = latest_snapshot(snaps)
    return latest.join(nxt, "site_id").select(*latest.columns, F.col("next_cycle").cast("int").alias("next_cycle"))


@register("sync_summary", O.with_ctes(O.daily_ctes(), O.pages_ctes(), O.users_ctes(), O.keywords_ctes(),
                                      body=OQ.sync_summary_body()))
def q_sync_summary(spark, sf):
    from ..sources import read_testdata_tables, sync_summary
    return sync_summary(read_testdata_tables(spark, sf), "testdata")


# ---------------------------------------------------------------- features, splits, metrics
from pyspark.sql import functions as F  # noqa: E402

from ..functions import rnd  # noqa: E402
from ..operators.forecast import HW_ALPHA, HW_BETA, HW_GAMMA  # noqa: E402
from ..sources.schemas import SALES_FEATURES, TRAFFIC_LAGS, USER_FEATURES  # noqa: E402


@register("traffic_features", O.with_ctes(O.daily_ctes(), body=OQ.traffic_features_body()))
def q_traffic_features(spark, sf):
    from ..operators.features import traffic_features
    tf = traffic_features(td.daily_metrics(spark, sf))
    return tf.select("site_id", "date", "visitors", *[f"lag_{k}" for k in TRAFFIC_LAGS],
                     rnd("roll_mean_7", 6).alias("roll_mean_7"), rnd("roll_std_7", 6).alias("roll_std_7"),
                     "momentum_7", "dow", "month", F.col("_delta").alias("delta"))


@register("traffic_split", O.with_ctes(O.daily_ctes(), body=OQ.traffic_split_body(0.15)))
def q_traffic_split(spark, sf):
    from ..operators.features import chronological_split, traffic_features
    return chronological_split(traffic_features(td.daily_metrics(spark, sf)), 0.15).select("site_id", "date", "split")


@register("traffic_metrics_persistence", O.with_ctes(O.daily_ctes(True), body=OQ.persistence_metrics_body(0.15)))
def q_persistence_metrics(spark, sf):
    """The traffic model's evaluation path (chronological tail, level rebuilt as
    max(0, lag_1 + delta)) for a zero-delta predictor: MAE, RMSE, masked and
    epsilon MAPE and R² per site."""
    from ..operators.features import chronological_split, traffic_features
    from ..operators.metrics import regression_metrics
    sup = chronological_split(traffic_features(td.daily_metrics(spark, sf, by_site=True)), 0.15)
    test = (sup.where(F.col("split") == "test")
            .withColumn("pred_level", F.greatest(F.lit(0.0), F.col("lag_1").cast("double") + F.lit(0.0))))
    m = regression_metrics(test, "visitors", "pred_level", ["site_id"])
    return m.select("site_id", *[rnd(c, 6).alias(c) for c in ("mae", "rmse", "mape", "mape_eps", "r2")], "n")


@register("backtest_seasonal_naive", O.with_ctes(O.daily_ctes(True), body=OQ.seasonal_naive_backtest_body()))
def q_backtest_naive(spark, sf):
    from ..operators.forecast import backtest, seasonal_naive_forecaster
    return backtest(_materialized(td.daily_metrics(spark, sf, by_site=True)), seasonal_naive_forecaster(7), "seasonal_naive",
                    horizon=14, folds=3, min_train=180)


@register("sales_split", O.with_ctes(O.daily_ctes(True), body=OQ.hash_split_body(0.2)))
def q_sales_split(spark, sf):
    from ..operators.features import hash_split
    return hash_split(td.daily_metrics(spark, sf, by_site=True), ["site_id", "date"], 0.2).select(
        "site_id", "date", "split")


@register("customer_split", O.with_ctes(O.users_ctes(), body=OQ.stratified_split_body(0.25)))
def q_customer_split(spark, sf):
    from ..operators.features import stratified_split
    u = td.users(spark, sf)
    return stratified_split(u, (F.col("num_orders") > 0).cast("int"), "user_id", 0.25).select("user_id", "split")


@register("keyword_split", O.with_ctes(O.keywords_ctes(), body=OQ.group_split_ctes(0.2) + "\nSELECT * FROM gs"))
def q_keyword_split(spark, sf):
    from ..operators.features import group_split
    # split the distinct ids: joining them back to all candidates would only be undone by a distinct
    return group_split(td.keywords(spark, sf).select("keyword_id").distinct(), "keyword_id", 0.2)


@register("auc_baseline", O.with_ctes(O.users_ctes(), body=OQ.auc_body()))
def q_auc(spark, sf):
    from ..operators.metrics import auc
    u = _materialized(td.users(spark, sf)).withColumn("purchase", (F.col("num_orders") > 0).cast("int"))
    a = auc(u, "churned", "recency_days", "user_id").select(
        F.lit("churned").alias("target"), F.lit("recency_days").alias("score"), "*")
    b = auc(u, "purchase", "pageviews", "user_id").select(
        F.lit("purchase").alias("target"), F.lit("pageviews").alias("score"), "*")
    return a.unionByName(b)


@register("ndcg_heuristic", O.with_ctes(O.keywords_ctes(), body=OQ.ndcg_body()))
def q_ndcg(spark, sf):
    from ..operators.metrics import mean_ndcg
    from ..operators.ranking import heuristic_rank_score
    from ..operators.ranking import train_and_test
    kw = heuristic_rank_score(_materialized(td.keywords(spark, sf).select("keyword_id", "candidate_id", "relevance", "backlinks",
                                                                          "domain_authority", "relevance_label")))
    _, test = train_and_test(kw, 0.2)
    m = mean_ndcg(_materialized(test), "keyword_id", "relevance_label", "rank_score")
    return m.select(rnd("ndcg_at_10", 6).alias("ndcg_at_10"), "n_groups", rnd("ndcg_at_5", 6).alias("ndcg_at_5"))


@register("keyword_train_test", O.with_ctes(O.keywords_ctes(), body=OQ.group_split_ctes(0.2) + """
SELECT gs.split, COUNT(*) AS n_rows, COUNT(DISTINCT k.keyword_id) AS n_keywords, CAST(SUM(k.candidate_id) AS BIGINT) AS id_sum
FROM keywords k JOIN gs ON k.keyword_id = gs.keyword_id GROUP BY 1"""))
def q_train_test(spark, sf):
    """The ranker's train (anti join) and test (semi join) candidates, counted."""
    from ..operators.ranking import train_and_test
    train, test = train_and_test(_materialized(td.keywords(spark, sf).select("keyword_id", "candidate_id")), 0.2)
    part = lambda df, name: df.agg(
        F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("keyword_id").alias("n_keywords"),
        F.sum("candidate_id").alias("id_sum"))
    return part(train, "train").unionByName(part(test, "test"))


@register("keyword_positions", O.with_ctes(O.keywords_ctes(), body=OQ.positions_body()))
def q_positions(spark, sf):
    from ..operators.ranking import heuristic_rank_score, predicted_positions
    return predicted_positions(heuristic_rank_score(td.keywords(spark, sf))).select(
        "keyword_id", "candidate_id", "rank_score", "predicted_position")


@register("keyword_opportunities", O.with_ctes(O.keywords_ctes(), body=OQ.opportunities_body(15)))
def q_opportunities(spark, sf):
    from ..operators.ranking import heuristic_rank_score, opportunities
    return opportunities(heuristic_rank_score(td.keywords(spark, sf)), 15)


@register("users_standardized", O.with_ctes(O.users_ctes(), body=OQ.standardized_body(USER_FEATURES)))
def q_users_std(spark, sf):
    from ..operators.segment import standardize
    z = standardize(_materialized(td.users(spark, sf)), USER_FEATURES)
    return z.select("user_id", *[rnd(f"z_{f}", 6).alias(f"z_{f}") for f in USER_FEATURES])


# ---------------------------------------------------------------- model-backed (rows-only checks)
def _materialized(df):
    """Queries that read a derived table more than once (model fits: features, fit,
    scoring; rule queries: signals, anomalies, forecast, health) derive it from the
    raw tables once and keep it as Parquet in the shared folder. Column pruning makes
    each read a different plan, so Spark would not reuse the exchange and every read
    would rescan lineitem / orders."""
    from ..session import store
    return store(df, "derived")


@register("traffic_forecast")
def q_traffic_forecast(spark, sf):
    """Boosted deltas rolled forward 30 days for every site."""
    from ..operators.traffic import TrafficForecaster
    daily = _materialized(td.daily_metrics(spark, sf, by_site=True))
    tf = TrafficForecaster()
    tf.fit(daily)
    return tf.forecast(daily, 30)


@register("traffic_model_metrics")
def q_traffic_metrics(spark, sf):
    from ..operators.traffic import TrafficForecaster
    return TrafficForecaster().fit(_materialized(td.daily_metrics(spark, sf, by_site=True)))


@register("holt_winters_forecast", O.with_ctes(
    O.daily_ctes(True), body=OQ.holt_winters_grid_body(HW_ALPHA, HW_BETA, HW_GAMMA, horizon=30), recursive=True))
def q_hw_forecast(spark, sf):
    from ..operators.forecast import forecast, holt_winters_forecaster
    return forecast(_materialized(td.daily_metrics(spark, sf, by_site=True)), 30, holt_winters_forecaster()).drop("reason")


# One point of the smoothing grid, used where the recursion is checked exactly.
HW_FIXED = (0.3, 0.05, 0.1)


@register("holt_winters_fixed_forecast",
          O.with_ctes(O.daily_ctes(True), body=OQ.holt_winters_fixed_body(*HW_FIXED, horizon=30),
                      recursive=True))
def q_hw_fixed(spark, sf):
    """Holt-Winters at fixed smoothing: the per-series recursion, checked exactly."""
    from ..operators.forecast import forecast, holt_winters_forecaster
    return forecast(_materialized(td.daily_metrics(spark, sf, by_site=True)), 30,
                    holt_winters_forecaster(params=HW_FIXED)).drop("reason")


@register("forecaster_comparison_deterministic",
          O.with_ctes(O.daily_ctes(True), body=OQ.deterministic_comparison_body(*HW_FIXED, horizon=14), recursive=True))
def q_compare_deterministic(spark, sf):
    """Walk-forward comparison (horizon 14, 3 folds) of the two deterministic forecasters:
    seasonal naive and Holt-Winters at fixed smoothing, ranked by rounded MAE."""
    from ..operators.forecast import compare_forecasters, holt_winters_forecaster, seasonal_naive_forecaster
    return compare_forecasters(_materialized(td.daily_metrics(spark, sf, by_site=True)), horizon=14, folds=3,
                               forecasters={"seasonal_naive": seasonal_naive_forecaster(7),
                                            "holt_winters_fixed": holt_winters_forecaster(params=HW_FIXED)})


@register("seasonal_regression_forecast")
def q_sr_forecast(spark, sf):
    from ..operators.forecast import forecast, seasonal_regression_forecaster
    return forecast(_materialized(td.daily_metrics(spark, sf, by_site=True)), 30, seasonal_regression_forecaster())


@register("forecaster_comparison")
def q_compare(spark, sf):
    from ..operators.forecast import compare_forecasters
    return compare_forecasters(_materialized(td.daily_metrics(spark, sf, by_site=True)), horizon=14, folds=3)


@register("sales_model")
def q_sales(spark, sf):
    from ..operators.models import SalesPredictor
    m = SalesPredictor()
    met = m.fit(_materialized(td.daily_metrics(spark, sf, by_site=True)))
    imp = m.feature_importance().orderBy(F.desc("importance"), "feature").limit(5)
    return imp.crossJoin(met)


@register("seo_model")
def q_seo(spark, sf):
    from ..operators.models import SEOScorer
    m = SEOScorer()
    met = m.fit(td.seo_pages(spark, sf))
    imp = m.feature_importance().orderBy(F.desc("importance"), "feature").limit(5)
    return imp.crossJoin(met)


@register("customer_scores")
def q_customer_scores(spark, sf):
    from ..operators.models import CustomerIntelligence
    users = _materialized(td.users(spark, sf))
    ci = CustomerIntelligence()
    ci.fit(users)
    return ci.score(users).select("user_id", "purchase_prob", "churn_risk", "predicted_clv")


@register("customer_report")
def q_customer_report(spark, sf):
    """Fit metrics, the one-row summary and the top-10 at-risk customers."""
    from ..operators.models import CustomerIntelligence, customer_summary, top_at_risk
    users = _materialized(td.users(spark, sf))
    ci = CustomerIntelligence()
    met = ci.fit(users)
    scored = _materialized(ci.score(users))
    summ = customer_summary(scored).crossJoin(met)
    return top_at_risk(scored).select("user_id", "purchase_prob", "churn_risk", "predicted_clv").crossJoin(summ)


@register("user_segments")
def q_segments(spark, sf):
    from ..operators.segment import UserSegmenter
    users = _materialized(td.users(spark, sf))
    seg = UserSegmenter()
    met = seg.fit(users)
    return seg.segment_summary(users).crossJoin(met)


@register("anomalous_days")
def q_anomalies(spark, sf):
    from ..operators.anomaly import TrafficAnomalyDetector
    daily = _materialized(td.daily_metrics(spark, sf, by_site=True))
    return TrafficAnomalyDetector().fit(daily).anomalous_days(daily)


@register("keyword_ranker")
def q_ranker(spark, sf):
    """Listwise boosted ranker: NDCG on held-out keywords and striking-distance wins."""
    from ..operators.ranking import LambdaRanker, fit_and_evaluate
    kw = _materialized(td.keywords(spark, sf))
    ranker, nd = fit_and_evaluate(kw, LambdaRanker())
    return ranker.opportunities(kw, 15).crossJoin(nd)


# ---------------------------------------------------------------- customers and segments on stand-in inputs
@register("customer_summary_heuristic", O.with_ctes(O.users_ctes(), body=OQ.customer_summary_body()))
def q_customer_summary_h(spark, sf):
    from ..operators.models import customer_summary, heuristic_customer_scores
    return customer_summary(heuristic_customer_scores(td.users(spark, sf)))


@register("customer_recommendations_heuristic", O.with_ctes(O.users_ctes(), body=OQ.customer_recs_body()))
def q_customer_recs_h(spark, sf):
    from ..operators.models import customer_summary, heuristic_customer_scores
    from ..operators.rules import customer_recommendations
    return customer_recommendations(customer_summary(heuristic_customer_scores(td.users(spark, sf))))


@register("top_at_risk_heuristic", O.with_ctes(O.users_ctes(), body=OQ.top_at_risk_body(10)))
def q_top_at_risk_h(spark, sf):
    from ..operators.models import heuristic_customer_scores, top_at_risk
    return top_at_risk(heuristic_customer_scores(td.users(spark, sf))).select("user_id", "purchase_prob", "churn_risk", "predicted_clv")


@register("segments_fixed_centroids", O.with_ctes(O.users_ctes(), body=OQ.fixed_segments_body(USER_FEATURES)))
def q_segments_fixed(spark, sf):
    from ..operators.segment import fixed_centroid_segments
    return fixed_centroid_segments(_materialized(td.users(spark, sf)))


@register("anomaly_flags_zscore", O.with_ctes(O.daily_ctes(True), body=OQ.zscore_anomalies_body(0.06)))
def q_anomaly_flags(spark, sf):
    """Contamination threshold, flags and ordering on a fixed stand-in score (|z| of visitors)."""
    return _zscore_flags(_materialized(td.daily_metrics(spark, sf, by_site=True)))


def _zscore_flags(daily):
    from pyspark.sql import Window
    from ..operators.anomaly import anomalous_only, flag_days
    w = Window.partitionBy("site_id")  # day-grain series, one site per partition
    v = F.col("visitors").cast("double")
    sd = F.coalesce(F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)), F.lit(1.0))
    scored = daily.select("site_id", "date", rnd(F.abs((v - F.avg(v).over(w)) / sd), 6).alias("s"))
    thr = scored.groupBy("site_id").agg(rnd(F.percentile("s", 0.94), 6).alias("threshold"))
    return anomalous_only(flag_days(scored, thr))


@register("site_recommendations_with_anomalies",
          O.with_ctes(O.daily_ctes(True), body=OQ.site_recs_with_anomalies_body()))
def q_site_recs_anom(spark, sf):
    """Site rules including the anomaly rule, fed with the z-score flags."""
    from ..operators.rules import site_recommendations
    daily = _materialized(td.daily_metrics(spark, sf, by_site=True))
    return site_recommendations(daily, anomalies=_zscore_flags(daily))


# ---------------------------------------------------------------- insight tables on stand-in models
def _naive_forecast(daily, horizon=30):
    from ..operators.forecast import forecast, seasonal_naive_forecaster
    return forecast(daily, horizon, seasonal_naive_forecaster()).drop("reason")


@register("history_and_forecast_naive",
          O.with_ctes(O.daily_ctes(True), body=OQ.history_forecast_body(60, 30)))
def q_history_forecast(spark, sf):
    """Last 60 actual days ++ a 30-day seasonal-naive forecast per site (the report's series)."""
    from ..operators.common import history_and_forecast
    daily = _materialized(td.daily_metrics(spark, sf, by_site=True))
    return history_and_forecast(daily, _naive_forecast(daily), 60)


@register("forecast_records_naive", O.with_ctes(O.daily_ctes(True), body=OQ.forecast_records_body(30)))
def q_forecast_records(spark, sf):
    """Record export of the forecast table: one JSON object per row, dates as text."""
    from ..operators.common import records_json
    return records_json(_naive_forecast(_materialized(td.daily_metrics(spark, sf, by_site=True))))


@register("kpi_row_heuristic",
          O.with_ctes(O.daily_ctes(True), O.pages_ctes(), O.users_ctes(), body=OQ.kpi_row_body(30, 8)))
def q_kpi_row(spark, sf):
    """The 13-field KPI row per site, fed by deterministic stand-ins for the models:
    seasonal-naive forecast, z-score anomaly flags, heuristic customer scores."""
    from ..operators import rules as R
    from ..operators.health import compute_health
    from ..operators.models import customer_summary, heuristic_customer_scores
    from .bundles import kpi_row
    daily, pages = _tables(spark, sf, by_site=True, once=True)
    anomalies = _zscore_flags(daily)
    customers = customer_summary(heuristic_customer_scores(_materialized(td.users(spark, sf))))
    recs = R.combine_recommendations(R.site_recommendations(daily, anomalies=anomalies),
                                     R.page_recommendations(pages, 8), R.customer_recommendations(customers),
                                     sites=daily.select("site_id"))
    return kpi_row(daily, _naive_forecast(daily), compute_health(daily, pages), anomalies, recs, customers)


@register("report_top_anomalies_zscore", O.with_ctes(O.daily_ctes(True), body=OQ.top_anomalies_body(3)))
def q_top_anomalies(spark, sf):
    """The report's 3 most anomalous days per site (per-key top-k, a WindowGroupLimit)."""
    from pyspark.sql import Window
    from .bundles import REPORT_TOP_ANOMALIES
    flags = _zscore_flags(_materialized(td.daily_metrics(spark, sf, by_site=True)))
    w = Window.partitionBy("site_id").orderBy(F.desc("anomaly_score"), "date")
    return (flags.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= REPORT_TOP_ANOMALIES)
            .select("site_id", "date", "anomaly_score"))


@register("customer_feature_importance")
def q_customer_importance(spark, sf):
    """Importance matrix: feature x (purchase, churn, clv) of the three customer models."""
    from ..operators.models import CustomerIntelligence
    ci = CustomerIntelligence()
    ci.fit(_materialized(td.users(spark, sf)))
    return ci.feature_importance()


@register("keyword_report")
def q_keyword_report(spark, sf):
    """Top-5 ranking factors of the fitted ranker, beside the striking-distance keywords."""
    from ..operators.ranking import LambdaRanker, fit_and_evaluate
    kw = _materialized(td.keywords(spark, sf))
    ranker, _ = fit_and_evaluate(kw, LambdaRanker())
    top = ranker.feature_importance().orderBy(F.desc("importance"), "feature").limit(5)
    opp = ranker.opportunities(kw, 15)
    return (opp.select(F.lit("opportunity").alias("part"), "keyword", "predicted_position",
                       F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("importance"))
            .unionByName(top.select(F.lit("factor").alias("part"), F.lit(None).cast("string").alias("keyword"),
                                    F.lit(None).cast("int").alias("predicted_position"), "feature", "importance")))


@register("insight_kpis")
def q_insight_kpis(spark, sf):
    """The whole bundle: every model fitted on tables derived once,
    then the analysis; the result is its 13-field KPI row per site."""
    from ..sources import materialize_tables, read_testdata_tables
    from .bundles import analyze, train_all
    tables = materialize_tables(read_testdata_tables(spark, sf, by_site=True))
    models, _ = train_all(tables)
    return analyze(tables, models, horizon=30).kpis


def _corr_importance(daily):
    """Deterministic stand-in for the sales model's importance table: |corr(feature,
    revenue)| (6 dp, 0 if undefined), one global aggregate stacked to (feature, importance)."""
    one = daily.agg(*[F.coalesce(rnd(F.abs(F.corr(F.col(f).cast("double"), F.col("revenue").cast("double"))), 6),
                                 F.lit(0.0)).alias(f) for f in SALES_FEATURES])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in SALES_FEATURES])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


@register("site_recommendations_with_lever",
          O.with_ctes(O.daily_ctes(True), body=OQ.site_recs_with_lever_body(SALES_FEATURES)))
def q_site_recs_lever(spark, sf):
    """Site rules including the top-revenue-lever rule, fed with a correlation importance."""
    from ..operators.rules import site_recommendations
    daily = _materialized(td.daily_metrics(spark, sf, by_site=True))
    return site_recommendations(daily, sales_importance=_corr_importance(daily))


# ---------------------------------------------------------------- scoring with given trees
def _given_trees(features, base, *trees):
    """A small model given by hand, so that scoring can be compared with SQL: each tree is
    three (feature, threshold) splits, root first, and four leaf values."""
    import numpy as np
    from ..operators.boosting import Boosted
    at = [[features.index(f) for f, _ in splits] for splits, _ in trees]
    return Boosted(list(features), base, np.array(at), np.array([[t for _, t in splits] for splits, _ in trees], float),
                   np.array([values for _, values in trees], float), np.zeros(len(features)))


from ..sources.schemas import BEHAVIOUR_FEATURES, PAGE_SEO_FEATURES, RANKING_FEATURES  # noqa: E402

SALES_TREES = _given_trees(list(SALES_FEATURES), 5000.0,
                           ((("sessions", 130.0), ("page_speed", 70.0), ("content_score", 50.0)), (-5400.0, -900.0, 850.5, 2100.25)),
                           ((("bounce_rate", 0.6), ("sessions", 90.0), ("page_speed", 68.0)), (-125.5, 75.0, 10.0, -33.0)))
PAGE_TREES = _given_trees(list(PAGE_SEO_FEATURES), 45.0,
                          ((("word_count", 300.0), ("title_length", 30.0), ("internal_links", 5.0)), (-60.0, -20.0, 15.0, 70.0)),
                          ((("page_speed", 90.0), ("word_count", 150.0), ("title_length", 55.0)), (1.5, -2.25, 3.0, 0.5)))
VISITOR_TREES = {
    k: _given_trees(list(BEHAVIOUR_FEATURES), base,
                    ((("pageviews", 30.0), ("recency_days", 200.0), ("sessions", 12.0)), values),
                    ((("recency_days", 90.0), ("sessions", 5.0), ("avg_time_on_site", 150.0)), (0.25, 0.5, -0.125, -0.75)))
    for k, base, values in (("purchase", -0.25, (-1.5, -2.0, 0.5, 1.25)), ("churn", 0.1, (0.5, 1.5, -1.0, -0.25)),
                            ("clv", 900.0, (-1200.0, -950.0, 1500.5, 20000.25)))}
RANK_TREES = _given_trees(list(RANKING_FEATURES), 0.0,
                          ((("relevance", 0.5), ("backlinks", 15.0), ("domain_authority", 50.0)), (-1.0, -0.25, 0.5, 1.5)),
                          ((("word_count", 500.0), ("page_speed", 60.0), ("backlinks", 25.0)), (0.0, 0.125, -0.0625, 0.25)))


#: Centres and scale given by hand for a step of K-Means: restarts x clusters x visitor features.
STEP_SCALE = {"sessions": (12.0, 6.0), "pageviews": (40.0, 21.0), "avg_time_on_site": (150.0, 75.5), "recency_days": (120.0, 64.0),
              "num_orders": (9.0, 4.0), "total_spent": (900000.0, 512000.25)}
STEP_CENTERS = [[[-1.0, -0.75, 0.0, 1.5, -1.0, -1.25], [0.5, 0.25, 0.125, -0.5, 0.5, 0.25], [1.5, 1.75, -0.25, -0.5, 1.25, 2.0]],
                [[0.0, 0.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, -1.0, 0.5, 0.25, 0.0], [40.0, 40.0, 40.0, 40.0, 40.0, 40.0]]]


@register("kmeans_step_given_centers", O.with_ctes(O.users_ctes(), body=OQ.kmeans_step_body(STEP_SCALE, STEP_CENTERS)))
def q_kmeans_step(spark, sf):
    """One step of K-Means for two restarts at once: rows, new centres and cost (its one job's exact sums)."""
    import numpy as np
    from ..operators import kmeans
    users, names = td.users(spark, sf), list(STEP_SCALE)
    z = users.select("user_id", *[((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).alias(f) for f, (m, s) in STEP_SCALE.items()])
    n, total, cost = kmeans.lloyd_step(kmeans.on_grid(z, names, ["user_id"]), np.array(STEP_CENTERS))
    rows = [(i, c, int(n[i, c]), *[float(x) * kmeans.GRID / int(n[i, c]) if n[i, c] else None for x in total[i, c]], float(cost[i]))
            for i in range(len(n)) for c in range(n.shape[1])]
    out = spark.createDataFrame(rows, "restart int, cluster int, n long, " + ", ".join(f"{f} double" for f in names) + ", cost double")
    return out.select("restart", "cluster", "n", *[rnd(f, 9).alias(f) for f in names], rnd("cost", 4).alias("cost"))


@register("sales_predict_given_trees", O.with_ctes(O.daily_ctes(True), body=f"""
SELECT site_id, date, greatest({OQ.trees_sql(SALES_TREES)}, CAST(0 AS DOUBLE)) AS prediction FROM daily_metrics"""))
def q_sales_given(spark, sf):
    """The revenue model's scoring path (sum of trees, clipped at 0) for given trees."""
    from ..operators.models import SalesPredictor
    m = SalesPredictor()
    m.model = SALES_TREES
    return m.predict(td.daily_metrics(spark, sf, by_site=True)).select("site_id", "date", "prediction")


@register("seo_predict_given_trees", O.with_ctes(O.pages_ctes(), body=f"""
SELECT url, least(greatest({OQ.trees_sql(PAGE_TREES)}, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) AS prediction FROM seo_pages"""))
def q_seo_given(spark, sf):
    """The page model's scoring path (clipped to 0..100) for given trees."""
    from ..operators.models import SEOScorer
    m = SEOScorer()
    m.model = PAGE_TREES
    return m.predict(td.seo_pages(spark, sf)).select("url", "prediction")


@register("customer_scores_given_trees", O.with_ctes(O.users_ctes(), body=f"""
SELECT user_id, {O.rnd(f"1 / (1 + exp(-{OQ.trees_sql(VISITOR_TREES['purchase'])}))", 4)} AS purchase_prob,
  {O.rnd(f"1 / (1 + exp(-{OQ.trees_sql(VISITOR_TREES['churn'])}))", 4)} AS churn_risk,
  {O.rnd(f"greatest(CAST(0 AS DOUBLE), {OQ.trees_sql(VISITOR_TREES['clv'])})", 2)} AS predicted_clv
FROM users"""))
def q_customer_given(spark, sf):
    """The three customer models' scoring path (logistic link, rounding) for given trees."""
    from ..operators.models import CustomerIntelligence
    ci = CustomerIntelligence()
    ci.models = VISITOR_TREES
    return ci.score(td.users(spark, sf)).select("user_id", "purchase_prob", "churn_risk", "predicted_clv")


@register("rank_predict_given_trees", O.with_ctes(O.keywords_ctes(), body=f"""
SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY rank_score DESC, candidate_id) AS predicted_position
FROM (SELECT keyword_id, candidate_id, {OQ.trees_sql(RANK_TREES)} AS rank_score FROM keywords)"""))
def q_rank_given(spark, sf):
    """The ranker's scoring path and positions for given trees."""
    from ..operators.ranking import LambdaRanker
    r = LambdaRanker()
    r.model = RANK_TREES
    return r.predict_ranking(td.keywords(spark, sf)).select("keyword_id", "candidate_id", "rank_score", "predicted_position")
