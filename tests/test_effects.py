import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from effectlens.operators import effects as X
from effectlens.operators import presentation as P
from effectlens.operators import splines as S


def test_bh_equals_numpy(spark):
    p = np.random.default_rng(1).random(40) ** 3
    got = {r.e: r.q for r in X.bh(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "e int, p double"), "p", "q").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    for i, x in zip(order, np.minimum(q, 1), strict=True):
        assert got[i] == pytest.approx(x) and got[i] >= p[i] - 1e-12


def test_effects_of_cells_add_up(spark):
    rng = np.random.default_rng(2)
    rows = [(str(a), str(b), float(y)) for a, b, y in zip(rng.integers(0, 3, 200), rng.integers(0, 2, 200), rng.random(200), strict=True)]
    df = spark.createDataFrame([*rows, (None, "0", 5.0)], "a string, b string, y double")
    mean = df.agg(F.avg("y")).first()[0]
    cells = {(r.a, r.b): r for r in X.cell_effects(df, "a", "b", "y").collect()}
    for r in df.groupBy("a", "b").agg(F.avg("y").alias("m")).collect():
        c = cells[r.a, r.b]
        assert mean + c.phi_a + c.phi_b + c.phi_ab == pytest.approx(r.m)


def test_constant_effect_has_no_variability(spark):
    df = spark.createDataFrame([("e", "x", 1.0), ("e", "y", 1.0)], "eff string, x string, phi double")
    r = X.variability(df, ["eff"], ["x"]).first()
    assert (r.m, r.v, r.gii) == (1.0, 0.0, 0.0)
    b = spark.createDataFrame([(i, "e", 2.0) for i in range(5)], "b int, eff string, gii double")
    assert X.summary(b, "gii", ["eff"]).first().gii_stab == 0.0


def test_missing_stratum_falls_back_to_all_noise_and_no_shadow_is_an_error(spark):
    kinds = "b int, eff string, stratum string, m double, v double, gii double"
    real = spark.createDataFrame([(0, "a", "s1", 1.0, 1.0, 1.0), (0, "b", "s2", 1.0, None, None)], kinds)
    fake = spark.createDataFrame([(0, "z", "s1", 0.5, 2.0, 0.7), (0, "y", "s3", 0.9, 0.1, 0.3)], kinds)
    got = {r.eff: (r.noise_m, r.noise_v, r.noise_gii) for r in X.with_noise(real, fake).collect()}
    assert got == {"a": (0.5, 2.0, 0.7), "b": (0.9, 2.0, 0.7)}
    stats = {r.eff: r for r in X.statistics(real, fake, 1).collect()}
    assert stats["b"].v_failure_rate == 1.0 and stats["b"].calc_failed and stats["b"].v_p == 0.5 and stats["a"].v_p == 1.0
    with pytest.raises(ValueError):
        X.statistics(real, fake.limit(0), 1)


def test_all_statistics_are_corrected_in_one_scan(spark, monkeypatch):
    kinds = "b int, eff string, stratum string, m double, v double, gii double"
    rng = np.random.default_rng(5)
    real = [(b, e, "s", *map(float, rng.random(3) * (k + 1))) for b in range(12) for k, e in enumerate("abcdef")]
    calls, scan = [], X.scan
    monkeypatch.setattr(X, "scan", lambda *a, **b: calls.append(a) or scan(*a, **b))
    fake = spark.createDataFrame([(b, "z", "s", 0.9, 0.8, 1.1) for b in range(12)], kinds)
    got = sorted(X.statistics(spark.createDataFrame(real, kinds), fake, 12).collect(), key=lambda r: r.eff)
    assert len(calls) == 1
    for s in X.STATISTICS:
        p = np.array([r[f"{s}_p"] for r in got])
        order = np.argsort(-p, kind="stable")
        q = np.empty(6)
        q[order] = np.minimum.accumulate(np.minimum(p[order] * 6 / np.arange(6, 0, -1), 1))
        assert [r[f"{s}_q"] for r in got] == pytest.approx(q)


def test_fold_averages(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "a", 6.0)], "row int, eff string, phi double")
    assert X.fold_average(df, 3, True).first().phi == 3.0 and X.fold_average(df, 3, False).first().phi == 4.5


def test_save_set_takes_significant_ones_and_some_more(spark):
    df = spark.createDataFrame([("a", True, 0.01), ("b", False, 0.2), ("c", False, 0.1), ("d", False, 0.9)], "eff string, s boolean, q double")
    assert [r.eff for r in X.save_set(df, 1, "s", "q").orderBy("save_rank").collect()] == ["a", "c"]


def test_crossings(spark):
    m = spark.createDataFrame([(1, -1.0), (2, 2.0), (3, 0.0), (4, -1.0), (5, 1.0)], "p int, m double")
    assert [r.crossing for r in P.mean_crossings(m, "p", "m").collect()] == [1.5, 4.5]
    assert P.first_zero(m, "p", "m").first().zero == pytest.approx(1 + 1 / 3)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(-5, 5)), min_size=1, max_size=60))
def test_group_mean_signal(rows):
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    expected = np.array([y[x == v].mean() for v in x])
    assert np.allclose(S.group_means(y, x), expected)


def test_splines_recover_their_own_degree():
    rng = np.random.default_rng(3)
    x = np.sort(rng.normal(size=400))
    y = x**3 - 2 * x
    knots = S.interior_knots(x, 6)
    assert np.allclose(S.fit_1d(x, y, knots, 3), y)
    assert S.v_1d(x, y, n_knots=6) == pytest.approx(np.std(y))
    x2 = rng.normal(size=400)
    assert S.v_2d(x, x2, x * x2) == pytest.approx(np.std(x * x2), rel=0.1)


def test_zero_inflated_feature_is_fitted_by_lines():
    x = np.r_[np.zeros(300), np.linspace(0.1, 1, 100)]
    knots = S.interior_knots(x, 4)
    assert len(knots) < 4 and S.degree_for(knots, 3) == 1
    assert S.v_1d(x, 2 * x + 1) == pytest.approx(np.std(2 * x), rel=1e-6)
    assert S.v_1d(np.ones(50), np.arange(50.0)) == 0.0


def test_routes_by_nature():
    rng = np.random.default_rng(4)
    y = rng.normal(size=200)
    few = rng.integers(0, 15, 200).astype(float)
    assert S.is_discrete(few, False, 15) and not S.is_discrete(np.arange(16.0), False, 15) and S.is_discrete(np.arange(99.0), True, 15)
    assert S.v_effect(few, None, y, False, False) == pytest.approx(np.std(S.group_means(y, few)))
    x = rng.normal(size=200)
    x[:20] = np.nan
    assert S.v_effect(x, None, y, False, False) == pytest.approx(S.v_stacked(np.where(np.isnan(x), 0, x), np.isnan(x), y))
    assert S.v_effect(x[:22], x[:22], y[:22], False, False) == 0.0


def test_unsupported_spline_is_none():
    x = np.r_[np.zeros(10), np.full(10, 1.0), [2.0]]
    assert S.fit_1d(x, x, np.array([0.2, 0.4, 0.6, 0.8]), 3) is None
