import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectlens.operators import scans
from effectlens.operators import splines as S


def effects(rng):
    """Groups of every route: (x1, x2, nominal1, nominal2, paired, phi)."""
    out = {}
    n = 300
    x, z, few = rng.normal(size=n), rng.uniform(size=n), rng.integers(0, 4, n).astype(float)
    noise = rng.normal(size=n) / 20
    out["discrete"] = (few, None, False, False, few**2 + noise)
    out["curve"] = (x, None, False, False, np.sin(x) + noise)
    out["tied curve"] = (x.round(1), None, False, False, np.sin(2 * x) + noise)
    out["steep data"] = (x, None, False, False, np.where(x > 0, 1.0, 0.0))
    out["missing"] = (np.where(rng.random(n) < 0.2, np.nan, x), None, False, False, np.sin(x) + noise)
    out["short"] = (x[:14], None, False, False, x[:14])
    out["just enough"] = (np.arange(17.0), None, False, False, np.arange(17.0) ** 2)
    out["one knot or none"] = (np.r_[np.zeros(200), np.arange(1.0, 18)], None, False, False, np.r_[noise[:200], np.arange(17.0)])
    out["nominal pair"] = (few, rng.integers(0, 3, n).astype(float), True, True, few + noise)
    out["in levels"] = (few, x, False, False, x * few + noise)
    out["in levels of the second"] = (z, few, False, True, z * few + noise)
    out["in rare levels"] = (np.r_[few[:290], 10 + np.arange(10.0)], x, True, False, x + noise)
    out["surface"] = (x, z, False, False, x * z + noise)
    out["gaps in a surface"] = (np.where(rng.random(n) < 0.1, np.nan, x), np.where(rng.random(n) < 0.1, np.nan, z), False, False, x * z + noise)
    out["noisy surface"] = (x, z, False, False, np.where(x * z > 0.3, 3.0, -1.0))
    out["coarse axis"] = (np.r_[np.zeros(280), np.arange(1.0, 21)], z, False, False, z + noise)
    out["coarse axes"] = (np.r_[np.zeros(280), np.arange(1.0, 21)], np.r_[np.arange(20.0), np.full(280, 7.0)], False, False, z)
    out["two rows"] = (np.array([1.0, np.nan, 2.0]), np.array([1.0, 2.0, 3.0]), False, False, np.array([1.0, 5.0, 2.0]))
    out["nothing"] = (np.full(5, np.nan), None, False, False, np.arange(5.0))
    return out


def table(spark, found, rng=None):
    parts = []
    for name, (x1, x2, nominal1, nominal2, y) in found.items():
        times = np.ones(len(y), int) if rng is None else rng.integers(1, 4, len(y))
        parts.append(pd.DataFrame({"eff": name, "x1": x1, "x2": np.nan if x2 is None else x2, "nominal1": nominal1, "nominal2": nominal2, "paired": x2 is not None, "phi": y, "times": times}))
    whole = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(whole, "eff string, x1 double, x2 double, nominal1 boolean, nominal2 boolean, paired boolean, phi double, times long").repartition(7)
    return df, whole


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("shape", [(4, 3), (6, 3)])
def test_tables_give_what_the_kernels_give(spark, weighted, shape):
    rng = np.random.default_rng(21)
    df, whole = table(spark, effects(rng), rng if weighted else None)
    got = {r.eff: r for r in S.variability_by(df, ["eff"], *shape, threshold=12, range_rows=40).collect()}
    for name, part in whole.groupby("eff"):
        rows = part.loc[part.index.repeat(part["times"])]
        x2 = rows["x2"].to_numpy() if rows["paired"].iloc[0] else None
        v = S.v_effect(rows["x1"].to_numpy(), x2, rows["phi"].to_numpy(), bool(rows["nominal1"].iloc[0]), bool(rows["nominal2"].iloc[0]), *shape, threshold=12)
        assert got[name].m == pytest.approx(np.abs(rows["phi"]).mean()), name
        assert got[name].v == (None if v is None else pytest.approx(v, rel=1e-6, abs=1e-9)), name


def test_groups_may_be_null_and_tables_empty(spark):
    df, _ = table(spark, {k: v for k, v in effects(np.random.default_rng(22)).items() if k in ("curve", "discrete")})
    got = S.variability_by(df.withColumn("eff", F.when(F.col("eff") == "curve", F.col("eff"))), ["eff"])
    assert {r.eff is None for r in got.collect()} == {True, False}
    assert S.variability_by(df.limit(0), ["eff"]).count() == 0


def test_support_of_counts_equals_support_of_rows():
    rng = np.random.default_rng(23)
    for _ in range(500):
        knots = np.sort(rng.choice(np.arange(1, 9), rng.integers(1, 5), replace=False)).astype(float)
        degree = int(rng.integers(1, 4))
        x = np.sort(rng.choice(np.arange(0, 9.5, 0.5), rng.integers(2, 14)))
        x = np.sort(np.r_[0.0, x[(x > 0) & (x < 9)], 9.0])
        t = np.r_[0.0, knots, 9.0]
        place = np.searchsorted(t, x, "left") + np.searchsorted(t, x, "right") - 1
        full = np.r_[[0.0] * (degree + 1), knots, [9.0] * (degree + 1)]
        assert S.support_of_counts(np.bincount(place, minlength=2 * len(t) - 1), len(knots), degree) == S.has_support(x, full, degree)


def test_scans_hand_on_over_pieces(spark):
    rng = np.random.default_rng(24)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "x": np.where(rng.random(4000) < 0.4, 5.0, rng.integers(0, 400, 4000)), "z": rng.random(4000), "w": rng.integers(1, 5, 4000)}).drop_duplicates(["g", "x", "z"])
    df = spark.createDataFrame(pdf).repartition(5)
    assert scans.with_pieces(df, ["g"], ["x", "z"], 100).groupBy("g", "_piece").count().agg(F.max("count")).first()[0] < 200
    got = scans.scan(df, ["g"], ["x", "z"], "w", ["w"], rows=100).toPandas()
    for g, part in pdf.groupby("g"):
        part = part.sort_values(["x", "z"])
        mine = got[got.g == g].sort_values(["x", "z"])
        assert mine["_before"].tolist() == (part["w"].cumsum() - part["w"]).tolist()
        before = [None, *part[["x", "z", "w"]].itertuples(index=False, name=None)][:-1]
        assert [None if p is None else tuple(p) for p in mine["_prev"]] == before


def test_cuts_are_sent_to_the_rows_and_looked_up_by_halving(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 613).cast("double").alias("z"))
    pieces = scans.with_pieces(df, ["g"], ["x", "z"], 100)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambda" not in plan
    cuts = np.sort(np.random.default_rng(1).integers(0, 90, scans.PIECES - 1)).astype(float)
    points = spark.createDataFrame([(float(x), cuts.tolist() if x < 95 else None) for x in range(-2, 100)], "x double, cuts array<double>")
    for r in scans.with_under(points, "cuts", "x", "n").collect():
        assert r.n == (np.searchsorted(cuts, r.x, "left") if r.cuts else 0)
