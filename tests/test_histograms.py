import numpy as np
import pandas as pd
import pytest

from effectlens.operators import boosting as B
from effectlens.operators import histograms as H


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 600
    df = pd.DataFrame({"a": rng.integers(0, 12, n).astype(float), "b": rng.normal(size=n).round(1), "c": rng.choice(list("wxyz"), n), "d": rng.choice([f"l{i}" for i in range(14)], n), "fold": np.arange(n) % 3})
    df.loc[:40, "a"] = np.nan
    df["y0"] = df.a.fillna(3) * 2 + (df.b > 0) * df.a.fillna(0) + (df.c == "x") * 1.5 + df.d.str[1:].astype(int) / 5 + rng.normal(size=n) / 10
    return df


NAMES, CATEGORICAL = ["a", "b", "c", "d"], ["c", "d"]


def as_spark(spark, df):
    kinds = ", ".join(f"{c} {'string' if c in CATEGORICAL else 'int' if c == 'fold' else 'double'}" for c in df)
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, kinds).repartition(5)


def gathered(df, k, p, targets):
    inside, outside = df[df.fold != k], df[df.fold == k]
    valid = (outside, outside[targets].to_numpy(float)) if p.early_stopping_rounds else None
    return B.fit(inside, inside[targets].to_numpy(float), NAMES, CATEGORICAL, p, valid)


def assert_same_trees(m, n):
    assert len(m.trees) == len(n.trees) and m.best_iteration == n.best_iteration
    assert m.base == pytest.approx(n.base) and m.encodings.keys() == n.encodings.keys()
    for c in m.encodings:
        assert m.encodings[c] == pytest.approx(n.encodings[c])
    for s, t in zip(m.trees, n.trees, strict=True):
        assert s.features == t.features and s.equal == t.equal and s.covers == t.covers
        assert np.allclose(s.thresholds, t.thresholds) and np.allclose(s.values, t.values)


@pytest.mark.parametrize("kind", ["RMSE", "Logloss", "MultiClass", "MultiRMSE"])
def test_the_trees_are_those_of_gathered_rows(spark, frame, kind):
    df, targets = frame.copy(), ["y0"]
    if kind == "Logloss":
        df["y0"] = (df.y0 > df.y0.median()).astype(float)
    elif kind in ("MultiClass", "MultiRMSE"):
        targets = ["y0", "y1", "y2"]
        y = df.y0
        for j, t in enumerate(targets):
            df[t] = (pd.qcut(y, 3, labels=False) == j).astype(float) if kind == "MultiClass" else y * (j + 1) + (df.c == "w") * j
    p = B.Params(iterations=6, depth=3, learning_rate=0.3, loss=kind, border_count=8, one_hot_max_size=5, min_data_in_leaf=4, random_strength=0.02, colsample_bylevel=0.9)
    params = {k: B.Params(**vars(p) | {"seed": 5 + k}) for k in range(3)}
    found = H.fit_by_histograms(as_spark(spark, df), "fold", NAMES, CATEGORICAL, targets, params, rewrite=4)
    assert [k for k, _, _ in found] == [0, 1, 2]
    for k, score, m in found:
        n = gathered(df, k, params[k], targets)
        assert_same_trees(m, n)
        outside = df[df.fold == k]
        assert score == pytest.approx(-B.loss_value(kind, outside[targets].to_numpy(float), n.raw(n.matrix(outside)), p.delta))


def test_stopping_early_keeps_the_same_trees(spark, frame):
    p = B.Params(iterations=30, depth=2, learning_rate=0.9, border_count=8, one_hot_max_size=5, early_stopping_rounds=2, l2_leaf_reg=0.1)
    params = {0: p, 2: B.Params(**vars(p) | {"iterations": 3, "depth": 4, "learning_rate": 0.2})}
    found = H.fit_by_histograms(as_spark(spark, frame), "fold", NAMES, CATEGORICAL, ["y0"], params, scoring="r2", rewrite=3)
    assert [k for k, _, _ in found] == [0, 2] and len(found[0][2].trees) < 30
    for k, score, m in found:
        n = gathered(frame, k, params[k], ["y0"])
        assert_same_trees(m, n)
        outside = frame[frame.fold == k]
        assert score == pytest.approx(B.score_of("r2", outside[["y0"]].to_numpy(float), n.predict(n.matrix(outside))))


@pytest.mark.parametrize("loss", ["MAE", "Huber", "Quantile", "CrossEntropy", "MultiClassOneVsAll"])
def test_losses_fall_with_weights_and_sketched_cuts(spark, frame, loss, monkeypatch):
    monkeypatch.setattr(H, "FEW", 5)
    monkeypatch.setattr(H, "DENSE_CELLS", 10)
    df, targets = frame.copy(), ["y0"]
    if loss == "CrossEntropy":
        df["y0"] = (df.y0 - df.y0.min()) / (df.y0.max() - df.y0.min())
    elif loss == "MultiClassOneVsAll":
        targets = ["y0", "y1", "y2"]
        label = pd.qcut(df.y0, 3, labels=False)
        for j, t in enumerate(targets):
            df[t] = (label == j).astype(float)
    p = B.Params(iterations=3, depth=2, learning_rate=0.5, loss=loss, delta=0.5, border_count=16, bagging_temperature=0.7)
    ((_, score, m),) = H.fit_by_histograms(as_spark(spark, df), "fold", NAMES, CATEGORICAL, targets, {1: p})
    y, flat = df[df.fold == 1][targets].to_numpy(float), np.tile(np.array(m.base), (200, 1))
    assert score > -B.loss_value(loss, y, flat, 0.5)


def test_scores_of_tables_equal_those_of_arrays(spark):
    rng = np.random.default_rng(4)
    y, p = np.eye(3)[rng.integers(0, 3, 90)], rng.dirichlet([1, 1, 1], 90).round(2)
    rows = lambda y, p: spark.createDataFrame([(7, a.tolist(), b.tolist()) for a, b in zip(y, p, strict=True)], "fit int, y array<double>, p array<double>")
    for name in ("log_loss", "roc_auc_ovr", "accuracy", "balanced_accuracy", "f1_weighted"):
        assert H.scores(rows(y, p), name, 3).first().score == pytest.approx(B.score_of(name, y, p)), name
    for name in ("log_loss", "roc_auc", "accuracy", "balanced_accuracy", "f1", "f1_weighted"):
        assert H.scores(rows(y[:, :1], p[:, :1]), name, 1).first().score == pytest.approx(B.score_of(name, y[:, :1], p[:, :1])), name
    y, p = rng.normal(size=(50, 2)), rng.normal(size=(50, 2))
    for name in ("neg_rmse", "neg_mae", "r2"):
        assert H.scores(rows(y, p), name, 2).first().score == pytest.approx(B.score_of(name, y, p)), name


def test_large_tables_take_this_way(spark, frame):
    rows = as_spark(spark, frame)
    p = B.Params(iterations=3, depth=2, border_count=8, one_hot_max_size=5)
    small = {r.fold: B.Model.from_json(r.model) for r in B.fit_folds(rows, "fold", NAMES, CATEGORICAL, ["y0"], p).collect()}
    large = {(r.fold, r.trial): B.Model.from_json(r.model) for r in B.fit_folds(rows, "fold", NAMES, CATEGORICAL, ["y0"], p, [{}, {"depth": 1}], most_sent=0).collect()}
    assert sorted(large) == [(k, i) for k in range(3) for i in range(2)]
    for k in range(3):
        assert_same_trees(large[k, 0], small[k])
        assert all(len(t.features) == 1 for t in large[k, 1].trees)
    own = B.fit_folds(rows, "fold", NAMES, CATEGORICAL, ["y0"], p, [{"depth": k + 1} for k in range(3)], own_trial=True, most_sent=0)
    assert sorted((r.fold, r.trial) for r in own.collect()) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("targets", [["y0"], ["y0", "y1"]])
def test_rows_of_the_same_bins_count_as_one(spark, frame, targets, monkeypatch):
    df = frame.assign(y1=frame.y0 * 2 + (frame.c == "w"))[["a", "c", "fold", *targets]]
    seen, grown = [], H.grown
    monkeypatch.setattr(H, "grown", lambda state, *rest: (seen.append(state.count()), grown(state, *rest)))
    p = B.Params(iterations=6, depth=2, learning_rate=0.7, loss="RMSE" if len(targets) == 1 else "MultiRMSE", border_count=8, early_stopping_rounds=2, min_data_in_leaf=3)
    rows = spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False)], "a double, c string, fold int, " + ", ".join(f"{t} double" for t in targets))
    found = H.fit_by_histograms(rows, "fold", ["a", "c"], ["c"], targets, {k: p for k in range(3)}, rewrite=2)
    assert seen[0] < len(df)
    for k, score, m in found:
        inside, outside = df[df.fold != k], df[df.fold == k]
        y = outside[targets].to_numpy(float)
        n = B.fit(inside, inside[targets].to_numpy(float), ["a", "c"], ["c"], p, (outside, y))
        assert_same_trees(m, n)
        assert score == pytest.approx(-B.loss_value(p.loss, y, n.raw(n.matrix(outside)), p.delta))
