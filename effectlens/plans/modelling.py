"""Queries on models and splines.  Fits have no SQL form, and tests hold them against invariants; models given by hand have one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.functions.columns import ordinal_code
from effectlens.operators import boosting as B
from effectlens.operators import effects as X
from effectlens.operators import histograms as H
from effectlens.operators import metrics as M
from effectlens.operators import resampling as R
from effectlens.operators import splines as S
from effectlens.operators.scans import variation
from effectlens.plans import training as T
from effectlens.plans.cleaning import PRIORITIES
from effectlens.plans.registry import SEED, query, rounded, table
from effectlens.plans.scoring import KFOLD, ORDER_FOLDS
from effectlens.sources.scratch import stored

FOLDS, N_BOOT = 3, 8
FEATURES = ["month", "priority", "status"]
PARAMS = B.Params(iterations=20, learning_rate=0.2, depth=3, border_count=16, seed=SEED)


def order_matrix(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias(T.ROW), F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("_y0"),
        F.month("o_orderdate").cast("double").alias("month"), ordinal_code(F.col("o_orderpriority"), PRIORITIES).cast("double").alias("priority"), F.col("o_orderstatus").alias("status"),
    )
    return stored(R.kfold(rows, T.ROW, FOLDS, SEED), "folds")  # fits, predictions and scores each read it


def contract() -> T.Contract:
    config = {
        "execution": {"random_seed": SEED},
        "modeling": {"loss_function": "RMSE", "cv_folds": FOLDS},
        "shap": {"bootstrapping": {"n_boot": N_BOOT, "alpha": 0.05, "fdr_correct": True, "stab_thresh": 2}, "splines": {"n_knots": 4, "degree": 3, "discrete_threshold": 15}},
    }
    return T.Contract(config, "regression", ["price"], {"month": "continuous", "priority": "ordinal", "status": "nominal"})


@query()
def booster_oof(spark, sf_dir):
    rows = order_matrix(spark, sf_dir)
    models = B.fit_folds(rows, "fold", FEATURES, ["status"], ["_y0"], PARAMS)
    preds = B.predict_folds(rows, models, "fold", T.ROW, ["status"])
    both = rows.select(T.ROW, "fold", F.col("price").alias("y")).join(preds.select(T.ROW, F.get("pred", 0).alias("p")), T.ROW)
    y, p, t = F.col("y"), F.col("p"), F.lit(1)
    return rounded(both.groupBy("fold").agg(M.rmse(y, p, t).alias("rmse"), M.mae(y, p, t).alias("mae"), F.count("*").alias("n")), 2)


GAINS = """WITH f AS (SELECT o_orderkey, o_totalprice AS y, month(o_orderdate) AS month, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status, fold FROM {folds}),
k AS (SELECT unnest([0, 1, 2]) AS fit), i AS (SELECT k.fit, f.*, avg(y) OVER (PARTITION BY k.fit) AS base FROM k JOIN f ON f.fold <> k.fit),
g AS (SELECT *, base - y AS g FROM i), w AS (SELECT fit, count(*) AS n, sum(g) AS g FROM g GROUP BY fit),
c AS (SELECT fit, 'month' AS feature, m + 0.5 AS cut, count(*) FILTER (month > m) AS n, coalesce(sum(g) FILTER (month > m), 0) AS g FROM g, (SELECT unnest(range(1, 12)) AS m) GROUP BY fit, m
UNION ALL SELECT fit, 'status', s, count(*) FILTER (status = s), coalesce(sum(g) FILTER (status = s), 0) FROM g, (SELECT unnest([0, 1, 2]) AS s) GROUP BY fit, s)
SELECT c.fit::INTEGER AS fit, feature, cut::DOUBLE AS cut, round((c.g * c.g / (c.n + 3) + (w.g - c.g) * (w.g - c.g) / (w.n - c.n + 3))::DOUBLE / 1e9, 4) AS gain FROM c JOIN w USING (fit)"""


@query(GAINS.format(folds=KFOLD.format(seed=SEED, src="orders", f=3)))
def histogram_gains(spark, sf_dir):
    """The gains of all first splits of every fold's first tree, from histograms."""
    rows, names = stored(order_matrix(spark, sf_dir).select("fold", "month", "status", "_y0"), "rows"), ["month", "status"]
    fits = H.prepared(rows, "fold", names, ["status"], ["_y0"], {k: PARAMS for k in range(FOLDS)})
    state = H.state_of(rows, "fold", names, ["status"], ["_y0"], fits)
    found = H.gains(H.summed(state, fits, 1, 0, False, False), fits, 1)
    cuts = spark.createDataFrame([(f.number, c, i, names[c], v) for f in fits for c, i, v, _ in f.candidates()], "fit int, feature int, place int, name string, cut double")
    return rounded(found.join(cuts, ["fit", "feature", "place"]).select("fit", F.col("name").alias("feature"), "cut", (F.col("gain") / 1e9).alias("gain")))


@query()
def tree_shap_values(spark, sf_dir):
    rows = order_matrix(spark, sf_dir)
    models = B.fit_folds(rows, "fold", FEATURES, ["status"], ["_y0"], PARAMS)
    return rounded(B.effects_by_fold(rows, models, "fold", T.ROW, ["status"]).drop("i", "j"), 3)


@query()
def gii_full_pipeline(spark, sf_dir):
    rows, c = order_matrix(spark, sf_dir), contract()
    names = [*FEATURES, *[f"shadow_{f}" for f in FEATURES]]
    doubled = T.stored(T.with_shadows(rows.drop("price"), c).select("fold", *names, "_y0"), "shadowed")  # fits measure it before they read it
    models = B.fit_folds(doubled, "fold", names, ["status", "shadow_status"], ["_y0"], PARAMS).select("fold", "model")
    stats, _, _ = T.importance(rows, T.stored(models, "models"), c)
    return rounded(stats, 2)


#: Prices beyond these go right in the first and second tree of the models given by hand.
FIRST_CUT, SECOND_CUT = 150_000.0, 100_000.0


def given_models(spark, folds: int, slices: int = 1) -> DataFrame:
    """(fold, model): a tree on the price, whose leaves grow with the fold, and one on price and status; each further output is twice the one before."""
    out = []
    for k in range(folds):
        wide = lambda x: [float(x) * 2**s for s in range(slices)]
        trees = [
            B.Tree([0], [FIRST_CUT], [False], [wide(-1 - k), wide(2 + 2 * k)], [1.0, 3.0]),
            B.Tree([0, 1], [SECOND_CUT, 1.0], [False, True], [wide(x) for x in (0, 1, 2, 6)], [1.0] * 4),
        ]
        model = B.Model(["price", "status"], wide(10 * k), 0.5, "RMSE", trees, {"status": {"F": 0.0, "O": 1.0, "P": 2.0}})
        out.append((k, model.to_json()))
    return spark.createDataFrame(out, "fold int, model string")


def priced(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias(T.ROW), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


GIVEN = """10.0 * {k} + 0.5 * ({k} + 1) * CASE WHEN o_totalprice > 150000 THEN 2 ELSE -1 END
  + 0.5 * CASE WHEN o_totalprice > 100000 THEN CASE WHEN o_orderstatus = 'O' THEN 6 ELSE 2 END ELSE CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END END"""
EVERY = " + ".join(f"({GIVEN.format(k=k)})" for k in range(3))


@query(f"SELECT f.o_orderkey, f.fold, ({GIVEN.format(k='f.fold')})::DOUBLE AS pred FROM {ORDER_FOLDS} f")
def fold_model_join(spark, sf_dir):
    rows = R.kfold(priced(spark, sf_dir), "o_orderkey", 5, SEED)
    return B.predict_folds(rows, given_models(spark, 5), "fold", "o_orderkey", ["status"]).select("o_orderkey", "fold", F.get("pred", 0).alias("pred"))


@query(f"SELECT o_orderkey, round((({EVERY}) / 3)::DOUBLE, 3) AS pred, 3::BIGINT AS n_models FROM orders")
def ensemble_average(spark, sf_dir):
    each = B.predict_folds(priced(spark, sf_dir), given_models(spark, 3), "fold", "o_orderkey", ["status"], every=True)
    return rounded(each.groupBy("o_orderkey").agg(F.avg(F.get("pred", 0)).alias("pred"), F.count("*").alias("n_models")), 3)


@query(f"SELECT o_orderkey::VARCHAR AS id, o_totalprice AS y_true, round((({GIVEN.format(k=0)}) * 2000 + 500)::DOUBLE, 3) AS y_pred FROM orders")
def predictions_frame_single(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("fold", F.lit(0))
    shown = T.Contract({}, "regression", ["price"], {"status": "nominal"}, scales={"price": [500.0, 2000.0]})
    return rounded(T.prediction_frame(rows, B.predict_folds(rows, given_models(spark, 1), "fold", T.ROW, ["status"]), shown), 3)


@query(f"""SELECT o_orderkey::VARCHAR AS id, o_totalprice AS y_true_price, round((({GIVEN.format(k=0)}) * 2000 + 500)::DOUBLE, 3) AS y_pred_price,
o_custkey AS y_true_buyer, round((2 * ({GIVEN.format(k=0)}))::DOUBLE, 3) AS y_pred_buyer FROM orders""")
def predictions_frame_multireg(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("buyer"))
    rows = priced(spark, sf_dir).join(buyers, "o_orderkey").withColumn("fold", F.lit(0))
    shown = T.Contract({}, "multi_regression", ["price", "buyer"], {"status": "nominal"}, scales={"price": [500.0, 2000.0]})
    return rounded(T.prediction_frame(rows, B.predict_folds(rows, given_models(spark, 1, 2), "fold", T.ROW, ["status"]), shown), 3)


PHI = """(SELECT f.o_orderkey AS row, f.fold, unnest(['price', 'status', 'price x status']) AS eff, unnest([
  0.5 * ((f.fold + 1) * CASE WHEN o_totalprice > 150000 THEN 0.75 ELSE -2.25 END + CASE WHEN o_totalprice > 100000 THEN 1.75 ELSE -1.75 END),
  0.5 * CASE WHEN o_orderstatus = 'O' THEN 1.25 ELSE -1.25 END,
  0.5 * CASE WHEN (o_totalprice > 100000) = (o_orderstatus = 'O') THEN 0.75 ELSE -0.75 END]) AS phi FROM {folds} f)"""


@query(f"SELECT row, fold, eff, round(phi::DOUBLE, 4) AS phi FROM {PHI.format(folds=ORDER_FOLDS)}")
def tree_effects_given(spark, sf_dir):
    rows = R.kfold(priced(spark, sf_dir), "o_orderkey", 5, SEED)
    return rounded(B.effects_by_fold(rows, given_models(spark, 5), "fold", "o_orderkey", ["status"]).select("row", "fold", "eff", "phi"))


@query(f"""SELECT slice::INTEGER AS slice, eff, round((avg(abs(phi)) * (slice + 1))::DOUBLE, 6) AS m
FROM {PHI.format(folds='(SELECT *, 0 AS fold FROM orders)')}, (SELECT unnest([0, 1]) AS slice) GROUP BY slice, eff""")
def effects_by_slice(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("fold", F.lit(0))
    found = B.effects_by_fold(rows, given_models(spark, 1, 2), "fold", "o_orderkey", ["status"])
    return rounded(found.groupBy("slice", "eff").agg(X.magnitude(F.col("phi")).alias("m")), 6)


@query("""WITH k AS (SELECT l_suppkey, unnest(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS knot, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
SELECT DISTINCT l_suppkey::BIGINT AS l_suppkey, round(knot::DOUBLE, 6) AS knot FROM k WHERE knot > lo AND knot < hi""")
def quantile_knots(spark, sf_dir):
    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        knots = S.interior_knots(pdf["l_quantity"].to_numpy(float), 4)
        return pd.DataFrame({"l_suppkey": pdf["l_suppkey"].iloc[0], "knot": knots})

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "l_quantity")
    return rounded(rows.groupBy("l_suppkey").applyInPandas(of_group, "l_suppkey long, knot double"), 6)


@query("""WITH m AS (SELECT l_suppkey, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_suppkey, abs(y - lag(y) OVER (PARTITION BY l_suppkey ORDER BY x)) AS dy, 50000 * (x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x)) AS df FROM m),
s AS (SELECT l_suppkey, coalesce(sum(dy), 0) AS raw, coalesce(sum(df), 0) AS fitted FROM d GROUP BY 1)
SELECT l_suppkey::BIGINT AS l_suppkey, round(raw::DOUBLE, 1) AS raw, round(fitted::DOUBLE, 1) AS fitted, CASE WHEN raw = 0 THEN fitted < 1e-9 ELSE fitted <= 1.001 * raw END AS holds FROM s""")
def total_variation_gate(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("l_suppkey"), F.col("l_quantity").cast("double").alias("x")).agg(F.avg("l_extendedprice").cast("double").alias("raw"))
    found = variation(points.withColumn("fitted", F.col("x") * 50000), ["l_suppkey"], ["x"], ["raw", "fitted"])
    return rounded(found.select("*", S.smooth_enough(F.col("raw"), F.col("fitted")).alias("holds")), 1)


@query("""WITH p AS (SELECT l_linestatus, l_quantity::DOUBLE AS x1, l_partkey::DOUBLE AS x2, avg(l_extendedprice)::DOUBLE AS y FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT l_linestatus, abs(y - lag(y) OVER (PARTITION BY l_linestatus ORDER BY x1, x2)) AS d1, abs(y - lag(y) OVER (PARTITION BY l_linestatus ORDER BY x2, x1)) AS d2 FROM p)
SELECT l_linestatus, round(sum(d1)::DOUBLE, 1) AS along_quantity, round(sum(d2)::DOUBLE, 1) AS along_part, round((sum(d1) + sum(d2))::DOUBLE, 1) AS both FROM d GROUP BY 1""")
def total_variation_2d(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_quantity").cast("double").alias("x1"), F.col("l_partkey").cast("double").alias("x2"))
    points = rows.agg(F.avg("l_extendedprice").cast("double").alias("y"))
    one, two = (variation(points, ["l_linestatus"], order, ["y"]).withColumnRenamed("y", name) for order, name in ((["x1", "x2"], "along_quantity"), (["x2", "x1"], "along_part")))
    return rounded(one.join(two, "l_linestatus").withColumn("both", F.col("along_quantity") + F.col("along_part")), 1)


@query("""WITH h AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 7 THEN l_tax END AS a, CASE WHEN l_discount > 0.02 THEN l_linenumber END AS b, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT l_suppkey, a, b, count(*) AS n, sum(y) AS s FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT l_suppkey, sum(n) AS n, sqrt(greatest(sum(s * s / n) / sum(n) - (sum(s) / sum(n)) ** 2, 0)) AS v FROM c GROUP BY 1)
SELECT l_suppkey::BIGINT AS l_suppkey, round(m::DOUBLE, 4) AS m, round(CASE WHEN coalesce(n, 0) < 3 THEN 0 ELSE v END::DOUBLE, 4) AS v
FROM (SELECT l_suppkey, avg(abs(y)) AS m FROM h GROUP BY 1) LEFT JOIN v USING (l_suppkey)""")
def interaction_valid_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("l_suppkey"), F.when(F.col("l_linenumber") != 7, F.col("l_tax")).cast("double").alias("x1"), F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")).cast("double").alias("x2"),
        F.lit(False).alias("nominal1"), F.lit(False).alias("nominal2"), F.lit(True).alias("paired"), (F.col("l_extendedprice") / 1000).alias("phi"), F.lit(1).alias("times"),
    )
    return rounded(S.variability_by(rows, ["l_suppkey"]).select("l_suppkey", "m", "v"))
