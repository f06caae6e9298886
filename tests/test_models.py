"""Model quality on planted-signal frames (thresholds from the reference's tests),
persistence round trips and error paths."""

import math
import os

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from fixtures import daily_frame, keywords_frame, pages_frame, users_frame


@pytest.fixture(scope="module")
def daily500(spark):
    return spark.createDataFrame(daily_frame(500)).cache()


def test_traffic_forecaster_quality_and_forecast(spark, daily500, scratch):
    from sprout.operators.traffic import TrafficForecaster
    tf = TrafficForecaster()
    m = tf.fit(daily500).first()
    assert m["mape"] < 0.10
    fc = tf.forecast(daily500, 14).orderBy("date").collect()
    assert len(fc) == 14 and all(r["predicted_visitors"] >= 0 for r in fc)
    tf.save(scratch + "/traffic")
    again = TrafficForecaster.load(scratch + "/traffic").forecast(daily500, 14).orderBy("date").collect()
    assert [r["predicted_visitors"] for r in again] == [r["predicted_visitors"] for r in fc]


def test_unfitted_models_raise(spark, daily500):
    from sprout.operators.models import CustomerIntelligence, SalesPredictor
    from sprout.operators.traffic import TrafficForecaster
    with pytest.raises(RuntimeError):
        TrafficForecaster().forecast(daily500, 5)
    with pytest.raises(RuntimeError):
        SalesPredictor().predict(daily500)
    with pytest.raises(RuntimeError):
        CustomerIntelligence().score(daily500)
    with pytest.raises(RuntimeError):
        TrafficForecaster.load("/nonexistent/path")


def test_sales_quality(spark, daily500, scratch):
    from sprout.operators.models import SalesPredictor
    s = SalesPredictor()
    assert s.fit(daily500).first()["r2"] > 0.5
    s.save(f"file://{scratch}/sales")
    total = lambda m: m.predict(daily500).agg(F.sum("prediction")).first()[0]
    assert math.isclose(total(s), total(SalesPredictor.load(f"file://{scratch}/sales")), rel_tol=1e-12)


def test_seo_quality_and_clip(spark, scratch):
    from sprout.operators.models import SEOScorer
    pages = spark.createDataFrame(pages_frame(500))
    s = SEOScorer()
    assert s.fit(pages).first()["r2"] > 0.6
    p = s.predict(pages).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= p[0] and p[1] <= 100
    s.save(f"file://{scratch}/seo")
    again = SEOScorer.load(f"file://{scratch}/seo").predict(pages).agg(F.min("prediction"), F.max("prediction")).first()
    assert (again[0], again[1]) == (p[0], p[1])


def test_segmentation(spark, scratch):
    from sprout.operators.segment import UserSegmenter
    users = spark.createDataFrame(users_frame(1500))
    seg = UserSegmenter()
    m = seg.fit(users).first()
    assert m["silhouette"] > 0.2 and m["n_clusters"] == 4
    summ = seg.segment_summary(users).collect()
    assert {r["segment_label"] for r in summ} == {"Buyer", "Potential Buyer", "Returning Visitor", "New Visitor"}
    assert sum(r["users"] for r in summ) == 1500
    seg.save(scratch + "/seg")
    again = UserSegmenter.load(scratch + "/seg").predict(users).select("user_id", "segment_label")
    assert again.join(seg.predict(users).select("user_id", F.col("segment_label").alias("b")), "user_id") \
        .where(F.col("segment_label") != F.col("b")).count() == 0


def test_customer_intelligence(spark, scratch):
    from sprout.operators.models import CustomerIntelligence
    users = spark.createDataFrame(users_frame(4000))
    ci = CustomerIntelligence()
    m = ci.fit(users).first()
    assert 0.7 < m["purchase_auc"] < 0.999
    assert m["churn_auc"] > 0.65
    assert m["clv_r2"] > 0.2
    sc = ci.score(users)
    b = sc.agg(F.min("purchase_prob"), F.max("purchase_prob"), F.min("predicted_clv")).first()
    assert 0 <= b[0] and b[1] <= 1 and b[2] >= 0
    s = ci.summary(users).first()
    assert s["customers"] == 4000
    ci.save(scratch + "/cust")
    again = CustomerIntelligence.load(scratch + "/cust").summary(users).first()
    assert again.asDict() == s.asDict()


def test_customer_missing_columns(spark):
    from sprout.operators.models import CustomerIntelligence
    users = spark.createDataFrame(users_frame(50)).drop("churned", "total_spent")
    with pytest.raises(ValueError, match=r"\['churned', 'total_spent'\]"):
        CustomerIntelligence().fit(users)


def test_ranker_quality_and_opportunities(spark, scratch):
    from sprout.operators.ranking import LambdaRanker, fit_and_evaluate
    kw = spark.createDataFrame(keywords_frame(200))
    ranker, nd = fit_and_evaluate(kw, LambdaRanker())
    r = nd.first()
    assert r["ndcg_at_10"] > 0.85 and r["n_groups"] == 40
    ops = ranker.opportunities(kw, 15).collect()
    vols = [o["search_volume"] for o in ops]
    assert vols == sorted(vols, reverse=True)
    assert all(4 <= o["predicted_position"] <= 15 for o in ops)
    ranked = ranker.predict_ranking(kw)
    perms = ranked.groupBy("keyword_id").agg(F.sort_array(F.collect_list("predicted_position")).alias("p")).collect()
    assert all(list(r["p"]) == list(range(1, 11)) for r in perms)
    ranker.save(scratch + "/rk")
    a = LambdaRanker.load(scratch + "/rk").predict(kw).agg(F.sum("rank_score")).first()[0]
    b = ranker.predict(kw).agg(F.sum("rank_score")).first()[0]
    assert math.isclose(a, b, rel_tol=1e-12)


def test_anomaly_finds_spike(spark, scratch):
    from sprout.operators.anomaly import TrafficAnomalyDetector
    pdf = daily_frame(600, spike=True)
    daily = spark.createDataFrame(pdf)
    det = TrafficAnomalyDetector().fit(daily)
    days = det.anomalous_days(daily).collect()
    flagged = {r["date"] for r in days}
    assert any(pdf["date"].iloc[i] in flagged for i in range(430, 436))
    assert abs(len(days) - 0.06 * 600) <= 3
    scores = [r["anomaly_score"] for r in days]
    assert scores == sorted(scores, reverse=True) and all(s > 0 for s in scores)
    det.save(scratch + "/an")
    again = TrafficAnomalyDetector.load(scratch + "/an").anomalous_days(daily).count()
    assert again == len(days)


def test_forecasters_and_backtest(spark, daily500):
    from sprout.operators.forecast import (backtest, compare_forecasters, forecast, holt_winters_forecaster,
                                           seasonal_regression_forecaster)
    for fac in (holt_winters_forecaster, seasonal_regression_forecaster):
        fc = forecast(daily500, 10, fac()).collect()
        assert len(fc) == 10 and all(r["predicted_visitors"] >= 0 for r in fc)
    t = compare_forecasters(daily500, horizon=7, folds=2, min_train=180,
                            methods=["Holt-Winters", "Seasonal regression"]).orderBy("rank").collect()
    assert [r["MAE"] for r in t] == sorted(r["MAE"] for r in t)
    assert all(r["folds"] == 2 and math.isfinite(r["MAPE"]) for r in t)
    short = spark.createDataFrame(daily_frame(120))
    e = backtest(short, holt_winters_forecaster(), "hw", horizon=10, folds=2, min_train=200).first()
    assert e["folds"] == 0 and e["MAE"] is None


def test_forecast_horizon_bounds(spark, daily500):
    from sprout.operators.forecast import forecast, holt_winters_forecaster
    with pytest.raises(ValueError):
        forecast(daily500, 0, holt_winters_forecaster())
    with pytest.raises(ValueError):
        forecast(daily500, 181, holt_winters_forecaster())


def test_short_series_have_null_forecasts_with_a_reason(spark, daily500):
    from sprout.operators.forecast import forecast, holt_winters_forecaster, seasonal_regression_forecaster
    from sprout.operators.traffic import TrafficForecaster
    both = daily500.unionByName(spark.createDataFrame(daily_frame(2, site="new")))
    model = TrafficForecaster(rounds=20)
    model.fit(daily500)
    frames = [model.forecast(both, 5), forecast(both, 5, holt_winters_forecaster()), forecast(both, 5, seasonal_regression_forecaster())]
    for rows in (f.collect() for f in frames):
        short = [r for r in rows if r["site_id"] == "new"]
        assert len(rows) == 10 and len(short) == 5
        assert all(r["predicted_visitors"] is None and r["reason"] for r in short)
        assert all(r["predicted_visitors"] is not None and r["reason"] is None for r in rows if r["site_id"] != "new")


def test_ranker_sample_bounds_a_hot_keyword(spark):
    from sprout.operators.ranking import LambdaRanker
    rows = keywords_frame(40, 10)
    hot = keywords_frame(1, 200).assign(keyword_id=999)
    kw = spark.createDataFrame(rows).unionByName(spark.createDataFrame(hot))
    ranker = LambdaRanker(rounds=30, group_rows=20)
    per = {r["keyword_id"]: r["n"] for r in ranker.sample(kw).groupBy("keyword_id").agg(F.count("*").alias("n")).collect()}
    assert per[999] == 20 and len(per) == 41
    ranked = ranker.fit(kw).predict_ranking(kw).where("keyword_id = 999")
    assert sorted(r["predicted_position"] for r in ranked.collect()) == list(range(1, 201))


def test_segments_are_equal_on_all_layouts(spark):
    from sprout.operators.segment import UserSegmenter
    users = spark.createDataFrame(users_frame(1500))
    fits = []
    for n in (1, 7):
        seg = UserSegmenter(n_init=3)
        metrics = tuple(seg.fit(users.repartition(n)).first())
        fits.append((seg.model.tolist(), metrics, sorted(map(tuple, seg.predict(users).select("user_id", "segment_label").collect()))))
    assert fits[0] == fits[1]


def test_kmeans_ends_where_no_step_helps_and_silhouette_is_near_all_pairs(spark):
    from sprout.operators import kmeans
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, (n, 2)) for c, n in (((0, 0), 2500), ((5, 1), 1500), ((1, 6), 999))] + [[[40.0, 40.0]]])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k long, a double, b double").repartition(5)
    points = kmeans.on_grid(frame, ["a", "b"], ["k"]).cache()
    centers, cost = kmeans.fit(points, 2, 4, restarts=5)
    grid = np.rint(x / kmeans.GRID) * kmeans.GRID
    far = ((grid[:, None] - centers) ** 2).sum(2)
    own = far.argmin(1)
    assert abs(cost - far.min(1).sum()) < 0.01 and len(set(own)) == 4
    assert all(np.abs(grid[own == c].mean(0) - centers[c]).max() < 0.02 for c in range(4))
    n, total, _ = kmeans.lloyd_step(points, centers[None])
    assert n[0].tolist() == np.bincount(own).tolist() and np.array_equal(total[0] * kmeans.GRID, [grid[own == c].sum(0) for c in range(4)])
    each = []
    for i in range(len(grid)):
        d = np.sqrt(((grid[i] - grid) ** 2).sum(1))
        if (own == own[i]).sum() == 1:
            each.append(0.0)
            continue
        a = d[own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[own == c].mean() for c in range(4) if c != own[i])
        each.append((b - a) / max(a, b))
    assert abs(kmeans.silhouette(points, centers) - np.mean(each)) < 0.02
    assert abs(kmeans.silhouette(points, centers, sample=6000) - np.mean(each)) < 1e-5


def whole_frame(n=700):
    import pandas as pd
    rng = np.random.default_rng(9)
    i = pd.Series(range(n))
    a, b = rng.normal(size=n), rng.integers(0, 30, n)
    return pd.DataFrame({"k": i, "g": (i % 40).where(i % 3 > 0, 999), "a": a, "b": b, "c": rng.choice([0.5, np.nan, 7.25], n),
                         "y": np.clip(np.round(a + b / 15 + rng.normal(size=n) / 2), 0, 4), "z": ((a > 0) ^ (b > 20)) * 1.0})


@pytest.mark.parametrize("objective, target, shape", [("squared", "y", {}), ("logistic", "z", {}), ("lambdarank", "y", {"leaves": 7, "depth": 6})])
def test_both_plans_of_a_fit_give_equal_trees(spark, monkeypatch, objective, target, shape):
    from sprout.operators import boosting
    frame = spark.createDataFrame(whole_frame())
    options = dict(rounds=20, depth=3, rate=0.3, min_rows=5, rows=0.8, columns=0.7, group="g") | shape
    fits = []
    # keyword 999 has a third of the rows, in several blocks of the spread plan
    for task_rows, block_rows, parts in ((10_000, 100, 3), (700, 100, 1), (699, 90, 3), (699, 300, 5)):
        monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(boosting, "LEAST_ROWS", block_rows)
        monkeypatch.setattr(boosting, "STORED_EVERY", 7)
        monkeypatch.setattr(boosting, "DIRECT_PARTS", 64 if parts == 3 else 2)
        fits.append(boosting.fit_whole(frame.repartition(parts), ["a", "b", "c"], target, objective, ["k"], **options).to_json())
    assert fits[0] == fits[1] == fits[2] == fits[3]
    model = boosting.Boosted.from_json(fits[0])
    assert len(model.value) == 20 and max(len(v) for v in model.value) == shape.get("leaves", 8)


def test_lambdas_equal_all_pairs_of_the_top_places():
    from sprout.operators import boosting as B
    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 31, 90, 3]
    code = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
    y, score = rng.integers(0, 4, len(code)) * 1.0, np.round(rng.normal(size=len(code)), 1)
    y[code == 5] = 0
    g, h = B.Block(np.zeros((1, len(code)), np.uint8), y, np.arange(len(code), dtype=np.uint64), code, score).lambdas(score, 2.0 ** -40, {})
    want = np.zeros((2, len(code)))
    for c in range(len(sizes)):
        rows = np.flatnonzero(code == c)
        rows = rows[np.argsort(-score[rows], kind="stable")]
        off = [1 / math.log2(k + 2) if k < B.TOP else 0.0 for k in range(len(rows))]
        best = sum(v * d for v, d in zip(sorted(2.0 ** y[rows] - 1, reverse=True), off))
        for i in range(min(B.TOP, len(rows))):
            for j in range(i + 1, len(rows)):
                high, low = (rows[i], rows[j]) if y[rows[i]] > y[rows[j]] else (rows[j], rows[i])
                if y[high] > y[low]:
                    weight = (2.0 ** y[high] - 2.0 ** y[low]) * abs(off[i] - off[j]) / best
                    rho = 1 / (1 + math.exp(score[high] - score[low]))
                    want[:, high] += -rho * weight, rho * (1 - rho) * weight
                    want[:, low] += rho * weight, rho * (1 - rho) * weight
    assert np.abs(np.stack([g, h]) - want).max() < 1e-6  # exponentials are single precision


def test_pairs_and_sums_are_taken_some_at_a_time(monkeypatch):
    """A fit of one task: pairs of a few groups at a time, sums of two features a pass; both are exact."""
    from sprout.operators import boosting as B
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 40, 900)
    code, n = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32), int(sizes.sum())
    y, score = rng.integers(0, 5, n) * 1.0, rng.normal(size=n)
    bins = rng.integers(0, B.BINS, (5, n)).astype(np.uint8)
    found = []
    for groups in (7, 10_000):
        monkeypatch.setattr(B, "SQUARE_GROUPS", groups)
        block = B.Block(bins, y, np.arange(n, dtype=np.uint64), code, score)
        g, h = block.lambdas(score, 2.0 ** -26, {})
        assert max(len(at) for at, _ in block.squares) <= groups
        found.append((g, h))
    assert np.array_equal(found[0], found[1])
    rows = B.TaskRows(block, "lambdarank", 2.0 ** -26, 1, 1.0)
    rows.g, rows.h, rows.use, rows.rows = g, h, np.ones(n, bool), {0: np.arange(n), 1: np.arange(0, n, 9)}
    want = np.array([[[np.bincount(b[r], w[r], B.BINS) for b in bins] for w in (g, h, np.ones(n))] for r in rows.rows.values()])
    passes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(len(a[0])) or count(*a, **k))
    assert np.array_equal(rows.sums([0, 1]), want)
    assert n > B.BINS ** 2 > len(rows.rows[1]) and passes.count(n) == 9 and passes.count(len(rows.rows[1])) == 15


def ranked_block(seed: int):
    from sprout.operators import boosting as B
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 75, 150)
    sizes[70] = 900
    n = int(sizes.sum())
    x = np.round(rng.normal(size=(4, n)), 2)
    y = np.clip(np.rint(x[0] + x[1] * (x[2] > 0) + rng.normal(size=n) / 3), 0, 4)
    edges = [np.unique(np.sort(v)[B.marks(n)]) for v in x]
    draw = rng.integers(0, 1 << 63, n).astype(np.uint64)
    code = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
    return B.Block(B.bin_rows(list(x), edges), y, draw, code, np.zeros(n)), edges


@pytest.mark.parametrize("objective", ["lambdarank", "squared"])
def test_processes_of_a_task_share_a_fit(objective):
    from sprout.operators import boosting as B
    found = []
    for cores in (0, 1, 2, 5):
        block, edges = ranked_block(8)
        options = objective, 2.0 ** -26, 3, 0.8
        rows = B.TeamRows(block, cores, *options) if cores else B.TaskRows(block, *options)
        assert cores == 0 or len(rows.helpers) == cores - 1
        found.append(B.boost(rows, list("abcd"), 0.0, edges, B.Shape(6, 9, 5, 0.05), 6, 0.2, 3, 0.9).to_json())
        if cores:
            helpers = [pid for pid, _ in rows.helpers]
            rows.close()
            for pid in helpers:  # none is left
                with pytest.raises(ProcessLookupError):
                    os.kill(pid, 0)
    assert len(set(found)) == 1


def test_a_ranked_fit_above_a_tasks_rows_takes_no_jobs_a_round(spark, monkeypatch):
    from sprout.operators import boosting as B
    options = dict(rounds=5, depth=6, rate=0.3, leaves=7, group="g")
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=900), 2) for c in "abc"})
    pdf["k"], pdf["g"], pdf["y"] = range(900), rng.integers(0, 25, 900), np.clip(np.rint(pdf.a + pdf.b + 1), 0, 4)
    pdf.loc[:200, "g"] = 7  # lies in several blocks
    frame = spark.createDataFrame(pdf)
    lone = B.fit_whole(frame, list("abc"), "y", "lambdarank", ["k"], **options).to_json()
    for name, value in (("TASK_ROWS", 100), ("BLOCK_ROWS", 60), ("LEAST_ROWS", 60)):
        monkeypatch.setattr(B, name, value)
    made, job = [], B.SpreadRows.job
    monkeypatch.setattr(B.SpreadRows, "job", lambda self, *a: made.append(1) or job(self, *a))
    assert B.fit_whole(frame, list("abc"), "y", "lambdarank", ["k"], **options).to_json() == lone and not made
    monkeypatch.setattr(B, "TEAM_ROWS", 100)
    assert B.fit_whole(frame, list("abc"), "y", "lambdarank", ["k"], **options).to_json() == lone and made


def test_a_spread_fit_sends_splits_and_no_sums_to_the_driver(spark, monkeypatch):
    from pyspark import RDD
    from sprout.operators import boosting as B
    for name, value in (("TASK_ROWS", 100), ("BLOCK_ROWS", 60), ("LEAST_ROWS", 60)):
        monkeypatch.setattr(B, name, value)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    options = dict(rounds=2, depth=3, rate=0.3)
    model = B.fit_whole(spark.createDataFrame(whole_frame()), ["a", "b", "c"], "z", "logistic", ["k"], **options)
    nodes = [n for found in sent for _, some in found for n in some]
    assert all(isinstance(n, B.Node) for n in nodes) and not any(np.ndim(v) for n in nodes for v in n)
    assert len(nodes) == sum(1 + 2 * len(t) for t in model.feature)


def test_a_tree_takes_the_best_splits_first():
    from sprout.operators import boosting as B
    rng = np.random.default_rng(5)
    x, n = rng.integers(0, 40, (3, 900)).astype(float), 900
    y = np.rint(64 * (np.sin(x[0] / 5) * x[1] + (x[2] > 30) * 20)) / 64
    edges = [np.unique(np.sort(v)[B.marks(n)]) for v in x]
    block = B.Block(B.bin_rows(list(x), edges), y, np.arange(n, dtype=np.uint64), np.zeros(n, np.int32), np.zeros(n))
    model = B.boost(B.TaskRows(block, "squared", 2.0 ** -10, 1, 1.0), ["a", "b", "c"], 0.0, edges, B.Shape(20, 9, 10, 1.0), 1, 1.0, 1, 1.0)
    parts = {0: np.arange(n)}  # naive: split the leaf of the largest gain, all rows summed anew

    def best(rows):
        found = (1e-9, None)
        for j in range(3):
            for cut in edges[j]:
                left = x[j][rows] <= cut
                nl = left.sum()
                if min(nl, len(rows) - nl) >= 10:
                    gl, gt = -y[rows][left].sum(), -y[rows].sum()
                    found = max(found, (gl ** 2 / (nl + 1) + (gt - gl) ** 2 / (len(rows) - nl + 1) - gt ** 2 / (len(rows) + 1), (j, cut)),
                                key=lambda f: f[0])
        return found
    while len(parts) < 9:
        gain, k = max((best(rows)[0], k) for k, rows in parts.items())
        j, cut = best(parts[k])[1]
        rows = parts.pop(k)
        parts[2 * k + 1], parts[2 * k + 2] = rows[x[j][rows] <= cut], rows[x[j][rows] > cut]
    want = np.empty(n)
    for rows in parts.values():
        want[rows] = y[rows].sum() / (len(rows) + 1)
    assert np.abs(model.raw(x.T) - want).max() < 1e-9


def test_exact_edges_are_those_of_the_sorted_values(spark):
    from sprout.operators import boosting as B
    pdf = whole_frame().fillna(-math.inf)
    frame = spark.createDataFrame(pdf[["a", "b", "c"]].astype(float).set_axis(["x0", "x1", "x2"], axis=1)).repartition(5)
    got = B.exact_edges(frame, 3, len(pdf))
    want = [np.unique(np.sort(pdf[c].to_numpy(float))[B.marks(len(pdf))]) for c in "abc"]
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_models_are_fitted_on_all_rows(spark):
    from sprout.operators.features import stratified_split
    from sprout.operators.models import CustomerIntelligence
    users = spark.createDataFrame(users_frame(1000))
    ci = CustomerIntelligence(rounds=3)
    ci.fit(users)
    lab = users.withColumn("_purchase", (F.col("num_orders") > 0).cast("double"))
    train = stratified_split(lab, "_purchase", "user_id", 0.25).where("split = 'train'")
    mean, bought = train.agg(F.avg("total_spent"), F.avg("_purchase")).first()
    assert math.isclose(ci.models["clv"].base, mean, rel_tol=1e-9)
    assert math.isclose(ci.models["purchase"].base, math.log(bought / (1 - bought)), rel_tol=1e-9)


# ---------------------------------------------------------------- folds, Holt-Winters
def test_shared_folds_equal_fits_of_each_prefix(spark, daily500):
    from sprout.operators.forecast import backtest, holt_winters_forecaster, seasonal_regression_forecaster
    from sprout.operators.traffic import boosted_tree_forecaster
    daily = daily500.unionByName(spark.createDataFrame(daily_frame(300, seed=3, site="other")))
    for made in (lambda: boosted_tree_forecaster(rounds=12), holt_winters_forecaster, seasonal_regression_forecaster,
                 lambda: holt_winters_forecaster(params=(0.2, 0.05, 0.1))):
        shared, alone = made(), made()
        if shared.__module__.endswith("traffic"):
            # a prefix alone, fold by fold: one model for the sites that have the fold
            whole = alone

            def alone(train, horizon, gk):
                parts = [whole(train.where(F.col("fold") == f).drop("fold"), horizon, [k for k in gk if k != "fold"])
                         .withColumn("fold", F.lit(f)) for f in range(3)]
                return parts[0].unionByName(parts[1]).unionByName(parts[2])
        else:
            del alone.at_cuts
        got, want = (sorted(map(tuple, backtest(daily, f, "m").collect())) for f in (shared, alone))
        assert got == want and len(got) == 2 and all(r[-1] == 3 for r in got)


def test_estimated_holt_winters_is_never_above_the_grid():
    from sprout.operators import forecast as H
    rng = np.random.default_rng(6)
    t = np.arange(400)
    series = [100 + 0.3 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 3, 400), rng.normal(50, 9, 90), np.full(40, 7.0),
              np.cumsum(rng.normal(0, 2, 250)) + 300, np.arange(10.0), 50 + np.tile([0, 1, 2, 3, 9, 9, 0], 30) * 1.0]
    grid = [H.holt_winters_at_cuts(y, [len(y)], 14)[0] for y in series]
    found = H.holt_winters_estimated(series, 14)
    assert np.isnan(found[4]["forecast"]).all()
    for a, b in zip(grid, found):
        assert a["params"] is None or (b["sse"] <= a["sse"] and np.isfinite(b["forecast"]).all())
    assert found[0]["sse"] < 0.99 * grid[0]["sse"] and found[5]["sse"] < 1e-6
    # the batch doesn't change a series' result, and solved initial states are least squares
    alone = H.holt_winters_estimated(series[:1], 14)[0]
    assert np.allclose(alone["forecast"], found[0]["forecast"], rtol=1e-6)
    smooth = np.array([[found[0]["params"]]])
    sse, state = H.profiled(series[0][None], np.array([400]), smooth, 7)
    for j in range(8):
        for step in (-0.5, 0.5):
            x = state[0, 0].copy()
            x[j] += step
            level, trend, season, total = x[0], x[1], np.append(x[2:], -x[2:].sum()), 0.0
            for k, v in enumerate(series[0]):
                s = season[k % 7]
                total += (v - level - trend - s) ** 2
                new = smooth[0, 0, 0] * (v - s) + (1 - smooth[0, 0, 0]) * (level + trend)
                trend, level, season[k % 7] = smooth[0, 0, 1] * (new - level) + (1 - smooth[0, 0, 1]) * trend, new, \
                    smooth[0, 0, 2] * (v - new) + (1 - smooth[0, 0, 2]) * s
            assert total >= sse[0, 0] - 1e-6


def test_planted_trend_changes_are_found_and_forecasts_are_better_than_a_ridge():
    from sprout.operators import forecast as H
    rng, n = np.random.default_rng(2), 1500
    t, day, knots = np.arange(n), np.arange(n) + 18_000.0, np.linspace(0, 0.8, 27)[1:-1]
    week = 10 * np.sin(2 * np.pi * t / 7)
    bent = 100 + 0.3 * np.minimum(t, knots[12] * n)
    y = bent + week + rng.normal(0, 2, n)
    beta, _ = H.seasonal_regression_fit(y / y.max(), day)
    changes = beta[2:27]
    assert abs(int(np.abs(changes).argmax()) - 12) <= 1 and changes[11:14].sum() < -0.5
    straight = 100 + 0.1 * t + week + rng.normal(0, 4, n)
    none = H.seasonal_regression_fit(straight / straight.max(), day)[0][2:27]
    assert np.count_nonzero(none) <= 5 and np.abs(none).max() < 0.1

    def ridged(y, day, horizon):  # every change free, held by a ridge
        k = len(y)
        x = H._design(np.arange(k) / k, day, knots)
        pen = np.full(x.shape[1], 1e-2)
        pen[:2], pen[2:27] = 0, 1
        b = np.linalg.solve(x.T @ x + np.diag(pen) * k / 100, x.T @ (y / y.max()))
        return H._design((k + np.arange(horizon)) / k, day[-1] + 1 + np.arange(horizon), knots) @ b * y.max()
    wrong = np.zeros(2)
    for truth in (bent + week, 100 + 0.1 * t + week, 300 + np.cumsum(rng.normal(0, 1.5, n)) + week):
        y = truth + rng.normal(0, 4, n)
        for cut in (900, 1200, 1472):
            for i, f in enumerate((H.seasonal_regression_fit_forecast, ridged)):
                wrong[i] += np.abs(f(y[:cut], day[:cut], 28) - truth[cut:cut + 28]).mean()
    assert wrong[0] < wrong[1]


def test_sparse_changes_are_the_least_of_their_sum():
    from sprout.operators import forecast as H
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).cumsum(1)
    gram, rhs, weight = x.T @ x, x.T @ (x[:, 2] * 2 - x[:, 6] + rng.normal(size=60)), 40.0
    d = H.sparse_changes(gram, rhs, weight)
    cost = lambda v: v @ gram @ v / 2 - rhs @ v + weight * np.abs(v).sum()
    assert 0 < np.count_nonzero(d) < 8
    assert all(cost(d) <= cost(d + step) + 1e-9 for step in np.concatenate([rng.normal(size=(300, 8)) * s for s in (1e-3, 0.1, 1)]))
