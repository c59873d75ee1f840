"""Rows that are alike count as one: in fits, and in attributions and their resamples."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectlens.operators import boosting as B
from effectlens.operators import histograms as H
from effectlens.operators import resampling as R
from effectlens.plans import training as T


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 900
    df = pd.DataFrame({T.ROW: [f"r{i}" for i in range(n)], "a": rng.integers(0, 12, n).astype(float), "c": rng.choice(list("wxyz"), n), "fold": np.arange(n) % 3})
    df["y"] = df.a * 2 + (df.c == "x") * df.a + rng.normal(size=n)
    df.loc[:30, "a"] = np.nan
    return df


def as_spark(spark, df):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, f"{T.ROW} string, a double, c string, fold int, y double").repartition(5)


@pytest.mark.parametrize("more", [{}, {"early_stopping_rounds": 3, "iterations": 40}, {"one_hot_max_size": 2, "border_count": 4, "min_data_in_leaf": 20}])
def test_fits_of_rows_alike_are_those_of_rows(spark, frame, monkeypatch, more):
    """More rows than are sent, but few different ones, are fitted at once and not level by level."""
    monkeypatch.setattr(H, "fit_by_histograms", lambda *a, **k: pytest.fail("rows alike weren't counted as one"))
    rows, p = as_spark(spark, frame), B.Params(**{"iterations": 8, "depth": 3, "learning_rate": 0.3} | more)
    found = [{r.fold: r for r in B.fit_folds(rows, "fold", ["a", "c"], ["c"], ["y"], p, most_sent=m).collect()} for m in (1 << 26, 20_000)]
    for k in range(3):
        one, other = (B.Model.from_json(f[k].model) for f in found)
        assert found[0][k].score == pytest.approx(found[1][k].score) and one.base == pytest.approx(other.base) and one.best_iteration == other.best_iteration
        assert [t.features for t in one.trees] == [t.features for t in other.trees] and one.trees
        for s, t in zip(one.trees, other.trees, strict=True):
            assert s.covers == t.covers and s.equal == t.equal and np.allclose(s.thresholds, t.thresholds) and np.allclose(s.values, t.values)


def test_losses_by_row_are_not_counted_as_one(spark, frame):
    with pytest.raises(ValueError, match="count as one"):
        B.fit(frame, frame.y.to_numpy(), ["a"], [], B.Params(loss="MAE"), n=np.ones(len(frame)))


def test_draws_are_counted_by_profile(spark, frame):
    rows = as_spark(spark, frame)
    of_rows, profiles = T.profiled(rows, ["a", "c"])
    assert profiles.count() == len(frame[["fold", "a", "c"]].drop_duplicates()) < len(frame) == of_rows.count()
    met = of_rows.join(profiles, T.PROFILE).join(rows.select(T.ROW, F.col("a").alias("_a"), F.col("c").alias("_c")), T.ROW)
    assert met.filter("a <=> _a AND c = _c").count() == len(frame)
    by = dict(of_rows.collect())
    order = sorted(by, key=lambda r: (hashlib.md5(r.encode()).hexdigest(), r))
    expected = {}
    for r in R.bootstrap_counts(spark, len(frame), 3, 7).collect():
        expected[r.b, by[order[r.k]]] = expected.get((r.b, by[order[r.k]]), 0) + r.times
    assert {(r.b, r[T.PROFILE]): r.times for r in T.drawn_profiles(of_rows, 3, 7).collect()} == expected
    # Rows of one unit come along together.
    both = of_rows.unionByName(of_rows).withColumn(T.ROW, F.concat(T.ROW, F.lit("|0")))
    assert {(r.b, r[T.PROFILE]): r.times for r in T.drawn_profiles(both, 3, 7, T.without_fold()).collect()} == {k: 2 * n for k, n in expected.items()}
