from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectlens.operators import boosting as B
from effectlens.plans import modelling, training
from effectlens.plans.catalogue import QUERIES
from effectlens.plans.report import report
from tests.against import SF


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"a": rng.normal(size=500), "b": rng.normal(size=500), "c": rng.choice(list("wxyz"), 500)})
    df.loc[:20, "a"] = np.nan
    return df, (df.a.fillna(0) * 2 + (df.b > 0) * df.a.fillna(0) + (df.c == "x") * 1.5).to_numpy()


def test_effects_and_expectation_add_up_to_the_prediction(frame):
    df, y = frame
    m = B.fit(df, y, ["a", "b", "c"], ["c"], B.Params(iterations=30, depth=4))
    x = m.matrix(df)
    raw = m.raw(x)[:, 0]
    assert 1 - ((y - raw) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    assert np.allclose(sum(e[:, 0] for e in B.effects(m, x).values()) + B.expectation(m)[0], raw)
    assert np.allclose(B.Model.from_json(m.to_json()).raw(x), m.raw(x))


def test_pair_effects_equal_enumeration():
    t = B.Tree([0, 1, 2], [0.0, 0.0, 0.0], [False] * 3, [[float(v)] for v in (1, 5, 2, 8, 0, 3, 7, 4)], [3.0, 1, 2, 5, 4, 6, 1, 2])
    got = B.tree_effects(t)
    own = [0, 1, 2]
    v = {s: B.expectations(t, set(s))[:, 0] for n in range(4) for s in combinations(own, n)}
    for i, j in combinations(own, 2):
        k = 3 - i - j
        up = lambda *s: v[tuple(sorted(s))]
        expected = sum(factorial(len(s)) * factorial(1 - len(s)) / 2 * (up(i, j, *s) - up(i, *s) - up(j, *s) + up(*s)) for s in ((), (k,)))
        assert np.allclose(got[i, j][:, 0], expected)
    for i in own:
        phi = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (v[tuple(sorted((*s, i)))] - v[s]) for n in range(3) for s in combinations([f for f in own if f != i], n))
        pairs = sum(got[tuple(sorted((i, j)))][:, 0] for j in own if j != i)
        assert np.allclose(got[i,][:, 0], phi - pairs / 2)


@pytest.mark.parametrize("loss", B.LOSSES)
def test_losses_fall(frame, loss):
    df, y = frame
    if loss in ("MultiClass", "MultiClassOneVsAll"):
        y = np.eye(3)[np.digitize(y, [0, 1])]
    elif loss in ("Logloss", "CrossEntropy"):
        y = (y > 0).astype(float)
    elif loss == "MultiRMSE":
        y = np.column_stack([y, -y])
    p = B.Params(iterations=15, depth=3, loss=loss, delta=0.5, random_strength=0.1, bagging_temperature=0.5, colsample_bylevel=0.8, one_hot_max_size=2)
    m = B.fit(df, y, ["a", "b", "c"], ["c"], p)
    y = y.reshape(len(df), -1)
    flat = np.tile(np.array(m.base), (len(df), 1))
    assert B.loss_value(loss, y, m.raw(m.matrix(df)), 0.5) < B.loss_value(loss, y, flat, 0.5)
    if loss.startswith("MultiClass"):
        assert np.allclose(m.predict(m.matrix(df)).sum(1), 1)


def test_early_stopping_keeps_the_best(frame):
    df, y = frame
    m = B.fit(df[:300], y[:300], ["a"], [], B.Params(iterations=200, early_stopping_rounds=5, learning_rate=0.5), (df[300:], y[300:]))
    assert len(m.trees) == max(1, m.best_iteration) < 200
    with pytest.raises(ValueError):
        B.fit(df, y, ["a"], [], B.Params(loss="x"))


def test_scores_by_hand():
    y, p = np.array([[0.0], [0], [1], [1]]), np.array([[0.1], [0.6], [0.6], [0.9]])
    found = {k: B.score_of(k, y, p) for k in ("roc_auc", "accuracy", "f1", "balanced_accuracy", "f1_weighted", "log_loss")}
    assert found == pytest.approx({"roc_auc": 0.875, "accuracy": 0.75, "f1": 0.8, "balanced_accuracy": 0.75, "f1_weighted": (0.8 + 2 / 3) / 2, "log_loss": np.log([0.9, 0.4, 0.6, 0.9]).mean()})
    many, said = np.eye(3)[[0, 1, 2, 0]], np.array([[0.8, 0.1, 0.1], [0.2, 0.5, 0.3], [0.5, 0.2, 0.3], [0.6, 0.3, 0.1]])
    assert B.score_of("accuracy", many, said) == 0.75 and B.score_of("balanced_accuracy", many, said) == pytest.approx(2 / 3)
    assert B.score_of("roc_auc_ovr", many, said) == pytest.approx(1.0 * 0.5 + 0.25 * (2 / 3) + 0.25 * (2.5 / 3), abs=0.2) and B.score_of("f1_weighted", many, said) == pytest.approx(0.5 * 0.8 + 0.25 * 1)
    assert (B.score_of("neg_rmse", y, p), B.score_of("neg_mae", y, p), B.score_of("r2", y, p)) == pytest.approx((-np.sqrt(0.54 / 4), -0.3, 1 - 0.54))
    with pytest.raises(ValueError, match="nothing"):
        B.score_of("nothing", y, p)


def test_trials_are_chosen_by_the_score_named(spark, frame):
    """A model of two steps ranks like one of many, but its probabilities are far from the labels."""
    df, y = frame
    rows = spark.createDataFrame(df.assign(y=(y > y.mean()).astype(float), fold=np.arange(len(df)) % 2, a=df.a.fillna(0.0)))
    trials = [{"iterations": 2, "learning_rate": 0.001, "depth": 6}, {"iterations": 30, "learning_rate": 0.3, "depth": 1}]
    best = {}
    for scoring in (None, "roc_auc"):
        fits = B.fit_folds(rows, "fold", ["a", "b", "c"], ["c"], ["y"], B.Params(loss="Logloss"), trials, scoring=scoring)
        best[scoring] = {r.trial for r in fits.groupBy("trial").agg(F.avg("score").alias("s")).orderBy(F.desc("s")).limit(1).collect()}
        large = B.fit_folds(rows, "fold", ["a", "b", "c"], ["c"], ["y"], B.Params(loss="Logloss"), trials[:1], scoring=scoring, most_sent=0)
        assert {r.fold: r.score for r in large.collect()} == pytest.approx({r.fold: r.score for r in fits.filter("trial = 0").collect()})
    own = [(r.fold, r.trial) for r in B.fit_folds(rows, "fold", ["a", "b", "c"], ["c"], ["y"], B.Params(loss="Logloss"), trials, own_trial=True).collect()]
    assert sorted(own) == [(0, 0), (1, 1)]
    assert best[None] == {1} and best["roc_auc"] <= {0, 1}


def test_rows_meet_models_alike_sent_or_dealt(spark, frame):
    df, y = frame
    rows = spark.createDataFrame(df.assign(y=y, key=[f"r{i}" for i in range(len(df))], fold=np.arange(len(df)) % 3, a=df.a.fillna(0.0))).repartition(5)
    fits = B.fit_folds(rows, "fold", ["a", "b", "c"], ["c"], ["y"], B.Params(iterations=8))
    sizes = (1 << 30, 8000)
    assert len(B.tree_blocks(B.split_models(fits, lambda m: m, 8000, B.leaf_bytes), 8000)) > 2
    for every in (False, True):
        both = [{(r.key, r.fold): r.pred[0] for r in B.predict_folds(rows, fits, "fold", "key", ["c"], every, most_sent=m).collect()} for m in sizes]
        assert both[0] == pytest.approx(both[1]) and len(both[0]) == len(df) * (3 if every else 1)
    found = [B.effects_by_fold(rows, fits, "fold", "key", ["c"], most_sent=m) for m in sizes]
    parts = [{(r.row, r.fold, r.slice, r.eff, r.i, r.j): r.phi for r in f.collect()} for f in found]
    assert parts[0] == pytest.approx(parts[1])
    # Of every row all effects and the expectation add up to the prediction.
    base = {r.fold: float(B.expectation(B.Model.from_json(r.model))[0]) for r in fits.collect()}
    summed = {r.row: base[r.fold] + r.s for r in found[0].groupBy("row", "fold").agg(F.sum("phi").alias("s")).collect()}
    assert all(summed[r.key] == pytest.approx(r.pred[0]) for r in B.predict_folds(rows, fits, "fold", "key", ["c"]).collect())


def test_fits_run_once(spark, frame):
    df, y = frame
    rows = spark.createDataFrame(df.assign(y=y, key=range(len(df)), fold=np.arange(len(df)) % 3, a=df.a.fillna(0.0)))
    fits = B.fit_folds(rows, "fold", ["a", "b", "c"], ["c"], ["y"], B.Params(iterations=3))
    assert B.predict_folds(rows, fits, "fold", "key", ["c"]).count() == len(df) and B.effects_by_fold(rows, fits, "fold", "key", ["c"]).count() > 0
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan or "Scan parquet" in plan
    assert "MapInPandas" not in plan and "Python" not in plan


def test_effects_of_deep_trees_equal_enumeration():
    rng = np.random.default_rng(5)
    for features in ([0, 1, 2, 3, 4, 5], [0, 1, 0, 2, 1, 0], [3, 3, 3, 3], [2], [4, 4, 1, 0, 4, 2, 1]):
        d = len(features)
        covers = rng.integers(0, 5, 1 << d).astype(float)
        t = B.Tree(features, [0.0] * d, [False] * d, rng.normal(size=(1 << d, 2)).tolist(), covers.tolist())
        got, own = B.tree_effects(t), sorted(set(features))
        v = {s: B.expectations(t, set(s)) for n in range(len(own) + 1) for s in combinations(own, n)}
        up = lambda *s: v[tuple(sorted(set(s)))]
        u = len(own)
        for i, j in combinations(own, 2):
            rest = [f for f in own if f not in (i, j)]
            expected = sum(factorial(n) * factorial(u - n - 2) / factorial(u - 1) * (up(i, j, *s) - up(i, *s) - up(j, *s) + up(*s)) for n in range(u - 1) for s in combinations(rest, n))
            assert np.allclose(got[i, j], expected)
        for i in own:
            rest = [f for f in own if f != i]
            phi = sum(factorial(n) * factorial(u - n - 1) / factorial(u) * (up(i, *s) - up(*s)) for n in range(u) for s in combinations(rest, n))
            assert np.allclose(got[i,], phi - sum((got[tuple(sorted((i, j)))] for j in rest), np.zeros_like(phi)) / 2)


def test_model_queries(spark):
    oof = QUERIES["booster_oof"](spark, SF).toPandas()
    assert len(oof) == modelling.FOLDS and (oof.rmse >= oof.mae).all()
    found = QUERIES["tree_shap_values"](spark, SF)
    assert found.groupBy("row", "eff", "slice").count().filter("count > 1").count() == 0


def test_importance_invariants(spark):
    out = QUERIES["gii_full_pipeline"](spark, SF).toPandas()
    n = modelling.N_BOOT
    for s in ("m", "v", "gii"):
        assert out[f"{s}_p"].between(round(1 / (n + 1), 2) - 0.01, 1).all() and (out[f"{s}_q"] >= out[f"{s}_p"] - 0.011).all() and (out[f"{s}_value"].dropna() >= 0).all()
    assert not out.eff.str.startswith("shadow_").any()


@pytest.mark.parametrize("outcome,task", [("y", None), ("k", "binary_classification"), ("c", "multiclass_classification"), (["y", "z"], "multi_regression")])
def test_train_predict_infer(spark, tmp_path, outcome, task):
    rng = np.random.default_rng(1)
    n = 120
    df = pd.DataFrame({"rid": range(n), "age": rng.normal(40, 10, n).round(1), "level": rng.choice(["low", "mid", "high"], n), "group": rng.choice(list("ab"), n)})
    df["y"] = df.age * 0.5 + (df.level == "high") * 10 + rng.normal(0, 3, n)
    df["z"], df["k"], df["c"] = -df.y, (df.y > df.y.median()).astype(int), pd.cut(df.y, 3, labels=["p", "q", "r"]).astype(str)
    df.to_csv(tmp_path / "train.csv", index=False)
    df.assign(extra=1).to_csv(tmp_path / "new.csv", index=False)
    config = {
        "data": {"id": "rid"},
        "features": {"continuous": [{"pattern": "age"}], "ordinal": [{"pattern": "level", "levels": ["low", "mid", "high"]}], "nominal": [{"pattern": "group"}]},
        "modeling": {"outcome": outcome, "cv_folds": 2, "tuning": {"n_iter": 2, "inner_cv_folds": 2, "early_stopping_rounds": 500, "search_space": {"iterations": {"low": 30, "high": 40}, "depth": {"low": 3, "high": 4}}}},
        "shap": {"bootstrapping": {"n_boot": 4, "alpha": 0.05, "fdr_correct": True, "stab_thresh": 2, "output_boots_n": 2}},
    }
    if task:
        config["modeling"]["task_type"] = task
    run = str(tmp_path / "run")
    c = training.train(spark, str(tmp_path / "train.csv"), config, run)
    assert c.features == ["age", "group", "level"]
    oof = spark.read.csv(f"{run}/full_oof_predictions", header=True)
    assert oof.count() == n and oof.select("id").distinct().count() == n
    if outcome in ("y", "c"):
        training.predict(spark, run)
        stats = spark.read.csv(f"{run}/shap_stats_global", header=True)
        assert stats.filter(F.col("eff") == "age").count() == (3 if outcome == "c" else 1)
        assert spark.read.csv(f"{run}/performance", header=True).count() >= 3
        report(spark, run)
        assert spark.read.csv(f"{run}/report/performance", header=True).count() >= 3
        assert spark.read.csv(f"{run}/report{'/p' if outcome == 'c' else ''}/trends", header=True).count() > 0
        metrics = spark.read.csv(f"{run}/metrics_oof", header=True)
        assert {r.fold for r in metrics.select("fold").distinct().collect()} == {"0", "1", "mean", "std"}
        assert {r.metric for r in metrics.select("metric").distinct().collect()} == ({"RMSE", "MAE", "R2"} if outcome == "y" else {"BALANCED_ACCURACY", "F1_WEIGHTED", "ROC_AUC_OVR"})
        nulls = spark.read.parquet(f"{run}/permutation_null_distributions")
        assert nulls.groupBy("metric").count().filter("count <> 1000").count() == 0 and nulls.select("metric").distinct().count() == 3
        for statistic in ("m", "v", "gii"):
            saved = spark.read.parquet(f"{run}/bootstraps_{statistic}")
            assert saved.groupBy("slice", "eff").count().filter("count <> 4").count() == 0 and saved.select("slice").distinct().count() == (3 if outcome == "c" else 1)
        micro = spark.read.parquet(f"{run}/microdata")
        named = {(r.main_feature, r.main_feature_type, r.main_feature_raw) for r in micro.filter("main_feature <> 'age'").select("main_feature", "main_feature_type", "main_feature_raw").distinct().collect()}
        assert named >= {("level", "ordinal", "high")} or named >= {("group", "nominal", "a")} or not named
        assert {r.feature_value for r in micro.filter("main_feature = 'group'").select("feature_value").distinct().collect()} <= {"a", "b"}
        levels = spark.read.csv(f"{run}/report{'/p' if outcome == 'c' else ''}/level_means", header=True).filter("eff = 'level'").collect()
        assert [(r.level, r.place) for r in levels] in ([], [("low", "1"), ("mid", "2"), ("high", "3")])
        assert {r.slice_name for r in micro.select("slice_name").distinct().collect()} == ({"p", "q", "r"} if outcome == "c" else {None})
        if outcome == "c":
            assert spark.read.csv(f"{run}/report/q/trends", header=True).count() > 0
    if isinstance(outcome, list):
        metrics = spark.read.csv(f"{run}/metrics_oof", header=True).toPandas()
        first = metrics[metrics.fold == "0"].set_index("metric").score.astype(float)
        assert first["RMSE_mean"] == pytest.approx((first["RMSE_y"] + first["RMSE_z"]) / 2) and set(metrics[metrics.metric == "RMSE_mean"].fold) == {"0", "1", "mean", "std"}
    if outcome in ("y", "c"):
        training.infer(spark, run, str(tmp_path / "new.csv"), f"{run}/new")
        assert spark.read.csv(f"{run}/new/predictions", header=True).count() == n
        effects = spark.read.parquet(f"{run}/new/effects")
        assert effects.groupBy("slice", "eff").count().filter(F.col("count") > n).count() == 0
        assert {r.slice_name for r in effects.select("slice_name").distinct().collect()} == ({"p", "q", "r"} if outcome == "c" else {None})
        assert spark.read.csv(f"{run}/new/performance_per_model", header=True).count() == 3 * 4
        assert spark.read.csv(f"{run}/new/shap_stats_global", header=True).count() >= 3


def test_rare_class_is_an_error(spark, tmp_path):
    pd.DataFrame({"a": range(20), "k": [1] + [0] * 19}).to_csv(tmp_path / "x.csv", index=False)
    config = {"features": {"continuous": [{"pattern": "a"}]}, "modeling": {"outcome": "k", "task_type": "binary_classification", "cv_folds": 3}}
    with pytest.raises(ValueError, match="class 1"):
        training.prepare(spark, str(tmp_path / "x.csv"), config)
