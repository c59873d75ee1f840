import itertools
import re

import pytest
from pyspark.sql import functions as F

from effectlens.operators import metrics as M
from effectlens.operators import resampling as R
from effectlens.plans import importance, modelling, scoring
from tests.against import SF


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("y"), (F.col("id") % 7).cast("double").alias("x"))


def test_dense_index_has_no_gap(rows):
    got = sorted((r.key, r.k) for r in R.dense_index(rows, [F.col("key")]).collect())
    assert got == [(i, i) for i in range(1000)]


def test_dense_index_of_ties_and_of_one_row(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("a"), "id")
    got = sorted((r.a, r.id, r.k) for r in R.dense_index(df, [F.col("a"), F.col("id")]).collect())
    assert [k for *_, k in got] == list(range(50))
    assert R.dense_index(spark.range(1), [F.col("id")]).first().k == 0
    assert R.dense_index(spark.range(0), [F.col("id")]).count() == 0


def test_folds_are_even_and_repeatable(rows):
    a = R.kfold(rows, "key", 7, 1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in a] == [143] * 6 + [142]
    b = {r.key: r.fold for r in R.kfold(rows.repartition(13), "key", 7, 1).collect()}
    assert b == {r.key: r.fold for r in R.kfold(rows, "key", 7, 1).collect()}


def test_strata_are_even(rows):
    n = {(r.y, r.fold): r["count"] for r in R.folds_for(rows, "key", "y", 5, 1, True).groupBy("y", "fold").count().collect()}
    assert set(n.values()) == {20, 180}


def test_shadow_keeps_values_and_breaks_rows(rows):
    got = R.shadow(rows, "key", ["x", "y"], 3).join(rows, "key").collect()
    assert sorted(r.shadow_x for r in got) == sorted(r.x for r in got)
    assert 100 < sum(r.shadow_x == r.x for r in got) < 250


def test_bootstrap_draws_all_slots(spark):
    got = R.bootstrap_counts(spark, 100, 20, 5).groupBy("b").agg(F.sum("times").alias("n"), F.count("*").alias("d")).collect()
    assert all(r.n == 100 for r in got) and 50 < sum(r.d for r in got) / len(got) < 75


def test_clusters_come_whole(spark):
    df = spark.range(30).select((F.col("id") / 3).cast("int").alias("c"), "id")
    assert R.require_equal_clusters(df, "c") == 3
    got = R.cluster_bootstrap(df, "c", 2, 1).groupBy("b", "slot").count().collect()
    assert len(got) == 20 and all(r["count"] == 3 for r in got)
    with pytest.raises(ValueError):
        R.require_equal_clusters(df.filter("id > 0"), "c")


def test_interval_leaves_out_resamples_of_one_value(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1), (2, 1.0, 0.8)], "key int, y double, p double")
    got = R.bootstrap_ci(df, "key", M.scorer("neg_mae"), 60, 2).first()
    assert got.n_used < 60 and got.ci_low <= got.score <= got.ci_high
    same = spark.createDataFrame([(1, 1.0, 0.1), (2, 1.0, 0.8)], "key int, y double, p double")
    got = R.bootstrap_ci(same, "key", M.scorer("neg_mae"), 10, 2).first()
    assert got.n_used == 0 and got.ci_low == got.ci_high == got.score


def test_permutation_p_is_within_bounds(spark):
    df = spark.range(60).select(F.col("id").alias("key"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    got = R.permutation_test(df, "key", M.scorer("neg_rmse"), "RMSE", 30, 1).first()
    assert got.p_value == pytest.approx(1 / 31) and got.observed == 0


def test_metrics_on_corner_cases(spark):
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    y, p, t = F.col("y"), F.col("p"), F.lit(1)
    assert flat.agg(M.r2(y, p, t)).first()[0] == 0.0
    assert flat.filter("p = 1").agg(M.r2(y, p, t)).first()[0] == 1.0
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert none.agg(M.f1(y, p, t)).first()[0] == 0.0
    sure = spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, p double")
    assert -25 < sure.agg(M.log_loss(y, p, t)).first()[0] < -17
    with pytest.raises(ValueError, match="unknown metric"):
        M.scorer("nope")
    assert M.auc(spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9)], "y int, p double")).first().auc == 0.75
    assert M.displayed("neg_rmse")[0] == "RMSE" and M.displayed("r2")[0] == "R2"


def test_table_metrics_weigh_repeats(spark):
    rows = [(0, 1, 0.9, 2), (0, 0, 0.4, 1), (0, 1, 0.4, 1), (1, 1, 0.1, 1), (1, 0, 0.3, 3)]
    df = spark.createDataFrame(rows, "b int, y int, p double, t int")
    flat = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "b int, y int, p double")
    assert sorted(map(tuple, M.auc(df, by=["b"], times="t").collect())) == sorted(map(tuple, M.auc(flat, by=["b"]).collect())) == [(0, 5 / 6), (1, 0.0)]
    hard = lambda d: d.withColumn("p", (F.col("p") > 0.35).cast("int"))
    for f in (M.balanced_accuracy, M.f1_weighted):
        a, b = f(hard(df), by=["b"], times="t").collect(), f(hard(flat), by=["b"]).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_interval_and_test_of_an_area(spark):
    df = spark.range(80).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.col("id") % 7 / 4).alias("p"))
    area = lambda t, by=(), times=None: M.auc(t, by=by, times=times)
    got = R.bootstrap_ci_of_table(df, "key", area, 30, 1).first()
    assert 0.5 < got.ci_low <= got.score <= got.ci_high <= 1 and got.n_used == 30
    assert R.permutation_test_of_table(df, "key", area, "AUC", 40, 1).first().p_value < 0.1


def test_draws_and_rows_are_dealt_out_by_place_not_sent_through_the_driver(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(2000).select(F.col("id").alias("key"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("p"))
    for df in (importance.boots(spark, SF), R.with_drawn(R.bootstrap_indices(spark, 2000, 64, 1), rows.withColumn("k", F.col("key")))):
        lines = plan(df).splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                under = list(itertools.takewhile(lambda x, line=line: depth(x) > depth(line), lines[at + 1 :]))
                assert not any("Range (" in x for x in under), "\n".join([line, *under])
    shadows = R.shadow(rows, "key", ["y", "p"], 1)
    assert "BroadcastExchange" not in plan(shadows.select("key", "shadow_y", "shadow_p"))


def test_folds_that_are_read_many_times_are_made_once(spark):
    for made in (scoring.nested_inner_folds(spark, SF), modelling.order_matrix(spark, SF)):
        files = made.inputFiles()
        assert files and not any("orders.parquet" in f for f in files)


def test_cells_are_sent_to_the_rows(spark):
    plan = importance.with_cells(importance.planted(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.splitlines()[1].strip(" :+-").startswith("BroadcastHashJoin") or "BroadcastHashJoin" in "\n".join(plan.splitlines()[:3])


def test_rows_are_numbered_once_for_shadows_and_draws(spark, rows, monkeypatch):
    calls, real = [], R.dense_index
    monkeypatch.setattr(R, "dense_index", lambda *a, **b: calls.append(a) or real(*a, **b))
    importance.both_boots(spark, SF)
    assert len(calls) == 1
    both = {r.key: r for r in R.with_shadow(rows, "key", ["x", "y"], 3).collect()}
    assert {k: (r.k, r.y) for k, r in both.items()} == {i: (i, "common" if i % 10 else "rare") for i in range(1000)}
    assert {k: (r.shadow_x, r.shadow_y) for k, r in both.items()} == {r.key: (r.shadow_x, r.shadow_y) for r in R.shadow(rows, "key", ["x", "y"], 3).collect()}


def test_draws_are_made_once_and_dealt_out_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(importance.gii_stability(spark, SF)).count("Range (") == 1
    pairs = spark.range(2000).select(F.col("id").alias("key"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("p"))
    one = plan(R.bootstrap_ci(pairs, "key", M.scorer("neg_mae"), 8, 1))
    assert one.count("Range (") == 1 and not re.search(r"keys=\[b#\d+L?, k#\d+L?\]", one)


def test_more_draws_are_made_by_more_tasks(spark):
    tasks = lambda n: R.bootstrap_indices(spark, n, 64, 1)._jdf.queryExecution().toRdd().getNumPartitions()
    assert tasks(10) == spark.sparkContext.defaultParallelism and tasks(9_000_000) == 144
