"""Purged training, metrics, importances, Granger tests and transforms, by definition."""

import math
import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import granger, learning, transforms

# ---- metrics -----------------------------------------------------------------------------------------------------------------


def metrics_by_definition(rows):
    n = len(rows)
    f1 = 0.0
    for y in learning.LABELS:
        hit, true, called = (sum(c(r) for r in rows) for c in (lambda r: r[1] == y == r[2], lambda r: r[1] == y, lambda r: r[2] == y))
        f1 += true * (2 * hit / (true + called) if hit else 0.0)
    loss = -sum(math.log(max(r[3 + r[1] + 1], 1e-15)) for r in rows) / n
    auc = None
    pos, neg = [r[5] for r in rows if r[1] == 1], [r[5] for r in rows if r[1] != 1]
    if len({r[1] for r in rows}) == 2 and pos:
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    return n, sum(r[1] == r[2] for r in rows) / n, f1 / n, loss, auc


def test_fold_metrics(spark):
    rng, rows = random.Random(1), []
    for fold, labels in ((1, (-1, 1)), (2, (-1, 0, 1)), (3, (0, 1)), (4, (1,)), (5, (-1, 0))):
        for _ in range(150):
            p = [rng.choice([0.0, 0.25, 0.333, rng.random()]) for _ in range(3)]
            t = sum(p) or 1.0
            rows.append((fold, rng.choice(labels), rng.choice((-1, 0, 1)), *(x / t for x in p)))
    got = {r["fold"]: r for r in learning.fold_metrics(spark.createDataFrame(rows, "fold int, y_true int, y_pred int, prob_m1 double, prob_0 double, prob_p1 double").repartition(3)).collect()}
    for fold in range(1, 6):
        n, acc, f1, loss, auc = metrics_by_definition([r for r in rows if r[0] == fold])
        r = got[fold]
        assert r["n"] == n and abs(r["accuracy"] - acc) < 1e-12 and abs(r["f1_weighted"] - f1) < 1e-12 and abs(r["log_loss"] - loss) < 1e-9
        assert (r["auc"] is None) == (auc is None) and (auc is None or abs(r["auc"] - auc) < 1e-12)
    assert got[1]["auc"] is not None and got[2]["auc"] is None and got[5]["auc"] is None


# ---- training ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trades(spark):
    """The label follows ``a``; ``b`` is noise; some ``a`` are unknown."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a = rng.gauss(0, 1)
        rows.append((i, float(i), a if rng.random() > 0.05 else None, rng.gauss(0, 1), 1 if a + rng.gauss(0, 0.3) > 0.6 else -1 if a < -0.6 else 0, 1.0 + (i % 3)))
    return spark.createDataFrame(rows, "id long, at double, a double, b double, label int, weight double").repartition(4).persist()


def small():
    return learning.forest(["a", "b"], trees=8, depth=4)


@pytest.fixture(scope="module")
def model(trades):
    return learning.Calibrated.fit(small, learning.balanced(trades, "label", "weight"), "at")


def test_labels_are_balanced(trades):
    got = {r["y_"]: r["s"] for r in learning.balanced(trades, "label", "weight").groupBy("y_").agg(F.sum("w_").alias("s")).collect()}
    total = trades.agg(F.sum("weight")).first()[0]
    assert set(got) == {0.0, 1.0, 2.0} and all(abs(s - total / 3) < 1e-6 for s in got.values())


def test_calibrated_forest(trades, model):
    rows = learning.predictions(model.probabilities(trades), "label").collect()
    assert all(abs(r["prob_m1"] + r["prob_0"] + r["prob_p1"] - 1) < 1e-9 and min(r["p_"]) >= 0 for r in rows)
    assert sum(r["y_true"] == r["y_pred"] for r in rows) > 0.75 * len(rows)
    top = [r for r in rows if r["prob_p1"] > 0.7]
    assert sum(r["y_true"] == 1 for r in top) / len(top) > 0.7  # what is called likely is so
    importances = model.importances(["a", "b"])
    assert abs(sum(importances.values()) - 1) < 1e-9 and importances["a"] > 2 * importances["b"]


def test_permutation_importance(trades, model):
    got = {r["feature"]: r["importance"] for r in learning.permutation_importance(model, trades, ["a", "b"], "label", repeats=2).collect()}
    assert got["a"] > 0.2 and abs(got["b"]) < 0.1


def test_vectors_that_no_tree_tells_apart(trades, model):
    """Far fewer vectors than rows, the same probabilities; unknown values stay unknown."""
    odd = trades.filter("id < 3").withColumn("id", F.col("id") + 1000).withColumn("a", F.expr("CASE id WHEN 1000 THEN double('NaN') WHEN 1001 THEN 1e300 ELSE double('-Infinity') END"))
    rows = trades.unionByName(odd)
    few = learning.alike(rows, model.models).persist()
    assert few.select("a", "b").distinct().count() < 0.7 * trades.count()
    assert few.filter("a IS NULL").count() == rows.filter("a IS NULL").count() and few.filter("isnan(a)").count() == 1
    want, got = ({r["id"]: r["p_"] for r in model.probabilities(df).select("id", "p_").collect()} for df in (rows, few))
    assert got == want and len(got) == 603


def test_trials_are_dealt_together_and_scored_once(trades, model):
    """As by definition, each trial scored row by row; features don't add shuffles."""
    rows = trades.withColumn("label", F.when(F.col("id") % 50 > 0, F.col("label"))).withColumn("a", F.when(F.col("id") == 7, math.nan).otherwise(F.col("a")))
    right = lambda df: learning.predictions(model.probabilities(df), "label").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
    found, base = learning.permutation_importance(model, rows, ["a", "b"], "label", repeats=2, seed=3), right(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 2 * 2
    got = {r["feature"]: r for r in found.collect()}
    assert set(got) == {"a", "b"}
    for f in got:
        falls = [base - right(learning.shuffled(rows, f, 3000 + k)) for k in range(2)]
        assert abs(got[f]["importance"] - np.mean(falls)) < 1e-12 and abs(got[f]["deviation"] - np.std(falls)) < 1e-12
    one = learning.permutation_importance(model, rows, ["a"], "label", repeats=2, seed=3).collect()
    assert [tuple(r) for r in one] == [tuple(got["a"])]


def test_values_are_dealt_out_anew(trades):
    a = {r["id"]: r["b"] for r in learning.shuffled(trades.select("id", "b"), "b", 1).collect()}
    b = {r["id"]: r["b"] for r in learning.shuffled(trades.select("id", "b").repartition(2), "b", 1).collect()}
    c = {r["id"]: r["b"] for r in learning.shuffled(trades.select("id", "b"), "b", 2).collect()}
    own = {r["id"]: r["b"] for r in trades.collect()}
    assert a == b != c and sorted(a.values()) == sorted(own.values()) and sum(a[i] == own[i] for i in own) < 20


def test_training_on_folds(spark, trades):
    """A fold's model never sees its test rows; folds with too few rows are left out; reruns agree."""
    folds = trades.selectExpr("id", "1 AS fold", "CASE WHEN id < 300 THEN 'train' WHEN id >= 320 AND id < 420 THEN 'test' END AS role").filter("role IS NOT NULL")
    few = trades.selectExpr("id", "2 AS fold", "CASE WHEN id < 20 THEN 'train' ELSE 'test' END AS role")
    run = lambda: learning.train_on_folds(trades, folds.unionByName(few), "fold", ["a", "b"], "label", "at", "weight", make=small)
    predicted, models = run()
    rows = predicted.collect()
    assert {r["fold"] for r in rows} == {1} == set(models) and sorted(r["id"] for r in rows) == list(range(320, 420))
    assert learning.fold_metrics(predicted).first()["accuracy"] > 0.6
    again, _ = run()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    # Labels of the test rows turned round change no prediction.
    turned = trades.withColumn("label", F.when((F.col("id") >= 320) & (F.col("id") < 420), -F.col("label")).otherwise(F.col("label")))
    other, _ = learning.train_on_folds(turned, folds, "fold", ["a", "b"], "label", "at", "weight", make=small)
    assert {r["id"]: r["y_pred"] for r in other.collect()} == {r["id"]: r["y_pred"] for r in rows}


# ---- Granger -------------------------------------------------------------------------------------------------------------------


def test_tail_of_f():
    """Critical values of tables."""
    for f, d1, d2, p in ((4.9646, 1, 10, 0.05), (2.3053, 5, 100, 0.05), (5.8489, 2, 20, 0.01), (161.4476, 1, 1, 0.05), (1.0, 7, 7, 0.5)):
        assert abs(granger.f_tail(f, d1, d2) - p) < 1e-5
    assert granger.f_tail(0.0, 3, 9) == 1.0 and math.isnan(granger.f_tail(math.nan, 1, 5)) and granger.f_tail(1e9, 2, 50) < 1e-100


@pytest.mark.parametrize("block", [1 << 14, 50])
def test_granger_by_definition(spark, block):
    rng = np.random.default_rng(3)
    f, y = rng.standard_normal(260), np.zeros(260)
    for i in range(2, 260):
        y[i] = 0.4 * y[i - 1] + 0.5 * f[i - 2] + 0.7 * rng.standard_normal()
    begin = datetime(2024, 1, 1)
    rows = [("x", begin + timedelta(hours=5 * i), float(y[i]), float(f[i])) for i in range(260)] + [("few", begin + timedelta(hours=i), float(i), float(i * i % 5)) for i in range(5)]
    rows += [("x", datetime(2023, 5, 5), None, 1.0), ("x", datetime(2023, 5, 6), 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, y double, f double").repartition(3)
    got = {(r["symbol"], r["lag"]): r for r in granger.granger_tests(df, ["symbol"], "ts", "y", "f", 4, block=block).collect()}
    for lag in range(1, 5):
        t = np.arange(lag, 260)
        own = np.column_stack([np.ones(len(t)), *(y[t - j] for j in range(1, lag + 1))])
        both = np.column_stack([own, *(f[t - j] for j in range(1, lag + 1))])
        rss = [((y[t] - x @ np.linalg.lstsq(x, y[t], rcond=None)[0]) ** 2).sum() for x in (own, both)]
        free = len(t) - 2 * lag - 1
        stat = (rss[0] - rss[1]) / lag / (rss[1] / free)
        r = got["x", lag]
        assert r["n_obs"] == len(t) and abs(r["f_stat"] - stat) < 1e-6 * stat and abs(r["p_value"] - granger.f_tail(stat, lag, free)) < 1e-9
    assert got["x", 2]["p_value"] < 1e-10 and got["few", 4]["p_value"] is None and got["few", 4]["f_stat"] is None
    scores = {r["symbol"]: r["score"] for r in granger.granger_scores(spark.createDataFrame(list(got.values())), ["symbol"]).collect()}
    assert abs(scores["x"] + math.log10(min(got["x", k]["p_value"] for k in range(1, 5)))) < 1e-9


# ---- transforms ------------------------------------------------------------------------------------------------------------------


def share_by_definition(window, x):
    """Mean of interpolating from below and from above between the sorted window's places."""
    s, places = np.sort(window), np.linspace(0, 1, len(window))
    if x - 1e-7 < s[0]:
        return 0.0
    if x + 1e-7 > s[-1]:
        return 1.0
    return (np.interp(x, s, places) - np.interp(-x, -s[::-1], -places[::-1])) / 2


def test_trailing_normal(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal(300), 1)
    v = [None if i in (100, 101) else float(z) for i, z in enumerate(x)]
    rows = [("s", i, v[i], float(i % 7)) for i in range(300)] + [("short", i, float(i), 1.0) for i in range(20)]
    got = {(r["symbol"], r["k"]): r for r in transforms.trailing_normal(spark.createDataFrame(rows, "symbol string, k long, a double, b double").repartition(3), ["symbol"], ["k"], ["a", "b"], 40).collect()}
    for i in range(300):
        for c, z in (("a", v), ("b", [float(j % 7) for j in range(300)])):
            r = got["s", i]
            window = z[max(0, i - 40) : i]
            if len(window) < 40 or None in window or z[i] is None:
                assert r[f"{c}_share"] is None and r[f"{c}_normal"] is None
                continue
            p = share_by_definition(np.array(window), z[i])
            assert abs(r[f"{c}_share"] - p) < 1e-12
            want = -transforms.LIMIT if p == 0 else transforms.LIMIT if p == 1 else NormalDist().inv_cdf(p)
            assert abs(r[f"{c}_normal"] - want) < 1e-9
    assert all(got["short", i]["a_share"] is None for i in range(20)) and abs(transforms.LIMIT - 5.199337582) < 1e-8


def test_neutralised(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.standard_normal((400, 5)), columns=["f", "g", "m1", "m2", "other"])
    pdf["f"] += 2 * pdf["m1"] - pdf["m2"] + 3
    pdf.loc[5, "m1"], pdf.loc[6, "f"], pdf.loc[7, "g"] = None, None, None
    pdf["symbol"] = np.where(np.arange(400) < 30, "few", np.where(np.arange(400) % 2, "x", "y"))
    pdf["id"] = np.arange(400)
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "f double, g double, m1 double, m2 double, other double, symbol string, id long")
    out = transforms.neutralised(df.repartition(3), ["symbol"], ["f", "g"], ["m1", "m2"])
    assert out.columns == df.columns
    got = out.toPandas().set_index("id").sort_index()
    for s, part in pdf.groupby("symbol"):
        for c in ("f", "g"):
            good = part[[c, "m1", "m2"]].notna().all(axis=1)
            want = part[c].copy()
            if good.sum() >= 50:
                x, y = part.loc[good, ["m1", "m2"]].to_numpy(), part.loc[good, c].to_numpy()
                want[good] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            assert np.allclose(got.loc[part["id"], c].to_numpy(dtype=float), want.to_numpy(dtype=float), atol=1e-9, equal_nan=True)
        assert np.allclose(got.loc[part["id"], "other"], part["other"])


def test_scalers_stay_as_fitted(spark):
    rows = [("x", float(i), float(i % 5), None if i == 3 else float(i * i), 2.0) for i in range(20)] + [("y", 1.0, float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double")
    kinds = {"a": "standard", "b": "minmax", "c": "robust_log", "d": "signed_log"}
    table = transforms.fit_scalers(df.filter("a < 10"), ["symbol"], kinds)
    got = {r["a"]: r for r in transforms.apply_scalers(df.filter("symbol = 'x'").withColumn("k", F.col("a")), ["symbol"], table, kinds).collect()}
    a, c = np.arange(10.0), np.log1p(np.array([i * i for i in range(10) if i != 3], float))
    q1, q2, q3 = np.percentile(c, [25, 50, 75])
    for r in got.values():
        i = r["k"]
        assert abs(r["a"] - (i - a.mean()) / a.std()) < 1e-12 and abs(r["b"] - (i % 5) / 4) < 1e-12 and abs(r["d"] - math.log(3)) < 1e-12
        assert r["c"] is None if i == 3 else abs(r["c"] - (math.log1p(i * i) - q2) / (q3 - q1)) < 1e-12
    lone = transforms.apply_scalers(df.filter("symbol = 'y'"), ["symbol"], table, kinds).first()
    assert lone["a"] == 0.0 and abs(lone["d"] - math.log(3)) < 1e-12
    with pytest.raises(ValueError):
        transforms.fit_scalers(df, ["symbol"], {"a": "other"})


# ---- mutual information by neighbours --------------------------------------------------------------------------------------------


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


@pytest.mark.parametrize("parts", [1, 5])
def test_mutual_information_by_definition(spark, parts):
    """All pairs of points; groups of any kind, one with a hot value."""
    from tidewright.operators import neighbours

    rng = np.random.default_rng(6)
    groups = {}
    x = rng.standard_normal(160)
    groups["line"] = (x, 2 * x + 0.3 * rng.standard_normal(160))
    groups["none"] = (rng.standard_normal(150), rng.standard_normal(150))
    groups["heavy"] = (np.where(rng.random(120) < 0.3, 1.0, rng.standard_normal(120) ** 3), rng.standard_normal(120))
    groups["flat"], groups["few"] = (np.ones(30), rng.standard_normal(30)), (np.arange(3.0), np.arange(3.0))
    rows = [(g, i, float(a), float(b)) for g, (p, q) in groups.items() for i, (a, b) in enumerate(zip(p, q, strict=True))] + [("line", 999, None, 1.0), ("line", 998, float("nan"), 1.0)]
    got = {r["g"]: r for r in neighbours.mutual_information(spark.createDataFrame(rows, "g string, id long, x double, y double").repartition(4), ["g"], "id", "x", "y", parts=parts).collect()}
    for g in ("line", "none", "heavy"):
        p, q = (v / v.std() for v in groups[g])
        dx, dy = (np.abs(v[:, None] - v[None]) for v in (p, q))
        d = np.maximum(dx, dy)
        np.fill_diagonal(d, np.inf)
        r = np.sort(d, axis=1)[:, 2]
        for z in (dx, dy):
            np.fill_diagonal(z, np.inf)
        n = len(p)
        want = psi(n) + psi(3) - np.mean([psi(int((dx[i] < r[i]).sum()) + 1) + psi(int((dy[i] < r[i]).sum()) + 1) for i in range(n)])
        assert got[g]["n"] == n and abs(got[g]["mutual_information"] - max(0, want)) < 1e-9
    assert got["line"]["mutual_information"] > 1 > 0.3 > got["none"]["mutual_information"]
    assert got["flat"]["mutual_information"] == 0.0 and got["few"]["mutual_information"] is None
