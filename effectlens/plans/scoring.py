"""Queries on folds, resamples and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlens.operators import boosting as B
from effectlens.operators import metrics as M
from effectlens.operators import resampling as R
from effectlens.operators.effects import fold_average
from effectlens.operators.permuting import place_sql
from effectlens.plans.registry import SEED, query, rounded, table
from effectlens.sources.scratch import stored

N_BOOT = 20


def order_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def price_pairs(spark, sf_dir):
    """Outcome and a stand-in prediction for each order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + F.pmod("o_orderkey", F.lit(7)) * 5000).alias("p"))


PAIRS = "SELECT o_orderkey, o_totalprice AS y, o_totalprice * 0.9 + (o_orderkey % 7) * 5000 AS p, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders"
KFOLD = """(WITH h AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}|fold|' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM {src})
SELECT *, (CASE WHEN k < (n % {f}) * (n // {f} + 1) THEN k // (n // {f} + 1) ELSE n % {f} + (k - (n % {f}) * (n // {f} + 1)) // (n // {f}) END)::INTEGER AS fold FROM h)"""
ORDER_FOLDS = KFOLD.format(seed=SEED, src="orders", f=5)


@query(f"SELECT o_orderkey, fold FROM {ORDER_FOLDS}")
def kfold_assign(spark, sf_dir):
    return R.kfold(order_rows(spark, sf_dir).select("o_orderkey"), "o_orderkey", 5, SEED)


@query(f"SELECT fold, count(*) AS n FROM {ORDER_FOLDS} GROUP BY 1")
def fold_sizes(spark, sf_dir):
    return kfold_assign(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"))


STRATIFIED = f"SELECT *, ((row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}|fold|' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM labels"


@query(f"SELECT doc_id, quality, fold FROM ({STRATIFIED})")
def stratified_kfold_assign(spark, sf_dir):
    return R.folds_for(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, SEED, classification=True)


@query("SELECT fold, inner_fold, count(*) AS n, min(o_orderkey) AS first_key FROM (" + " UNION ALL ".join(
    f"SELECT {k} AS fold, o_orderkey, fold AS inner_fold FROM " + KFOLD.format(seed=SEED + k + 1, src=f"(SELECT o_orderkey FROM {ORDER_FOLDS} WHERE fold <> {k})", f=3) for k in range(5)) + ") GROUP BY ALL")
def nested_inner_folds(spark, sf_dir):
    outer = stored(kfold_assign(spark, sf_dir), "folds")  # read several times for each fold
    parts = [R.kfold(outer.filter(F.col("fold") != k).select("o_orderkey"), "o_orderkey", 3, SEED + k + 1).select(F.lit(k).alias("fold"), "o_orderkey", F.col("fold").alias("inner_fold")) for k in range(5)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("fold", "inner_fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


PLACED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"
SHADOW = f"""WITH RECURSIVE names AS (SELECT unnest(['o_orderpriority', 'o_orderstatus']) AS c), whole AS (SELECT count(*) AS n FROM orders),
which AS (SELECT c, n, '{SEED}|0|' || c AS name FROM names, whole), {place_sql("which", "c")}
SELECT o.o_orderkey, o.o_orderpriority, a.o_orderpriority AS shadow_o_orderpriority, b.o_orderstatus AS shadow_o_orderstatus, o.o_totalprice, o.k
FROM {PLACED} o JOIN moved p ON p.c = 'o_orderpriority' AND p.k = o.k JOIN {PLACED} a ON a.k = p.dest JOIN moved s ON s.c = 'o_orderstatus' AND s.k = o.k JOIN {PLACED} b ON b.k = s.dest"""


@query(f"SELECT o_orderkey, shadow_o_orderpriority, shadow_o_orderstatus FROM ({SHADOW})")
def shadow_permute(spark, sf_dir):
    return R.shadow(order_rows(spark, sf_dir), "o_orderkey", ["o_orderpriority", "o_orderstatus"], SEED)


@query("SELECT o_orderpriority AS level, count(*) AS n, count(*) AS n_shadow FROM orders GROUP BY 1")
def shadow_marginals_equal(spark, sf_dir):
    real = order_rows(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"))
    moved = shadow_permute(spark, sf_dir).groupBy(F.col("shadow_o_orderpriority").alias("level")).agg(F.count("*").alias("n_shadow"))
    return real.join(moved, "level")


DRAW = "('0x' || substr(md5('{seed}|' || b || '|' || slot), 1, 8))::BIGINT % {n}"
RUNS = "(SELECT unnest(range({b})) AS b)"
SLOTS = "(SELECT unnest(range((SELECT {n}))) AS slot)"


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), d AS (
SELECT b, slot, {DRAW.format(seed=SEED, n='(SELECT n FROM n)')} AS k FROM {RUNS.format(b=5)}, (SELECT unnest(range((SELECT n FROM n))) AS slot))
SELECT b::INTEGER AS b, count(*) AS n, count(DISTINCT k) AS n_distinct, sum(k * (slot % 10))::BIGINT AS mark, round(avg(o_totalprice), 4) AS mean_price FROM d JOIN {PLACED} o USING (k) GROUP BY b""")
def bootstrap_indices(spark, sf_dir):
    rows = R.dense_index(order_rows(spark, sf_dir), [F.col("o_orderkey")])
    drawn = R.with_drawn(R.bootstrap_indices(spark, rows.count(), 5, SEED), rows)
    return rounded(drawn.groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_distinct"), F.sum(F.col("k") * (F.col("slot") % 10)).alias("mark"), F.avg("o_totalprice").alias("mean_price")))


@query(f"""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer), n AS (SELECT count(*) AS n FROM c), d AS (
SELECT b, slot, {DRAW.format(seed=SEED, n='(SELECT n FROM n)')} AS k FROM {RUNS.format(b=5)}, (SELECT unnest(range((SELECT n FROM n))) AS slot))
SELECT b::INTEGER AS b, fold, count(*) AS n, round(sum(c_acctbal + fold), 2) AS total
FROM d JOIN c USING (k) JOIN customer USING (c_custkey), (SELECT unnest([0, 1, 2]) AS fold) GROUP BY ALL""")
def cluster_bootstrap_indices(spark, sf_dir):
    folds = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", folds)
    R.require_equal_clusters(rows, "c_custkey")
    drawn = R.cluster_bootstrap(rows, "c_custkey", 5, SEED)
    return rounded(drawn.groupBy("b", "fold").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal") + F.col("fold")).alias("total")), 2)


LINES = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p, l_linenumber % 4 AS fold FROM lineitem"


def line_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), (F.col("l_linenumber") % 4).alias("fold"))


R2_SQL = "1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))"


@query(f"""SELECT 'MAE' AS metric, round(avg(abs(y - p)), 3) AS score FROM ({LINES}) UNION ALL
SELECT 'RMSE', round(sqrt(avg((y - p) * (y - p))), 3) FROM ({LINES}) UNION ALL SELECT 'R2', round({R2_SQL}, 3) FROM ({LINES})""")
def metric_regression(spark, sf_dir):
    y, p, t = F.col("y"), F.col("p"), F.lit(1)
    one = line_pairs(spark, sf_dir).agg(*[M.scorer(n)(y, p, t).alias(n) for n in ("neg_mae", "neg_rmse", "r2")])
    long = one.unpivot([], ["neg_mae", "neg_rmse", "r2"], "name", "score")
    shown = F.when(F.col("name").startswith("neg_"), -F.col("score")).otherwise(F.col("score"))
    return rounded(long.select(F.upper(F.regexp_replace("name", "^neg_", "")).alias("metric"), shown.alias("score")), 3)


@query("""SELECT target, round(sqrt(mse), 3) AS rmse FROM (
SELECT 'l_extendedprice' AS target, avg((l_extendedprice - l_quantity * 1500) ** 2) AS mse FROM lineitem UNION ALL
SELECT 'l_tax', avg((l_tax - 0.04) ** 2) FROM lineitem UNION ALL
SELECT 'all', (avg((l_extendedprice - l_quantity * 1500) ** 2) + avg((l_tax - 0.04) ** 2)) / 2 FROM lineitem)""")
def metric_multioutput_rmse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_tax", (F.col("l_quantity") * 1500).alias("p1"), F.lit(0.04).alias("p2"))
    return rounded(M.multi_rmse(rows, [("l_extendedprice", "p1"), ("l_tax", "p2")]), 3)


JUDGED = "SELECT l.doc_id, l.quality AS y, n_chars::DOUBLE / (n_chars + 1500) AS p, lang FROM labels l JOIN documents d USING (doc_id)"


def judged(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return both.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("p"), "lang")


@query(f"""WITH j AS ({JUDGED}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM j)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def metric_auc(spark, sf_dir):
    return rounded(M.auc(judged(spark, sf_dir)).select("auc"), 6)


@query(f"SELECT round(avg(ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS log_loss FROM ({JUDGED})")
def metric_logloss(spark, sf_dir):
    return rounded(judged(spark, sf_dir).agg(M.scorer("log_loss")(F.col("y"), F.col("p"), F.lit(1)).alias("log_loss")), 6)


@query(f"""SELECT round(avg((y = c)::INT), 6) AS accuracy, round(2.0 * count(*) FILTER (y = 1 AND c = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (c = 1)), 6) AS f1
FROM (SELECT y, (p > 0.5)::INT AS c FROM ({JUDGED}))""")
def metric_accuracy_f1(spark, sf_dir):
    rows = judged(spark, sf_dir).select("y", (F.col("p") > 0.5).cast("int").alias("c"))
    y, c, t = F.col("y"), F.col("c"), F.lit(1)
    return rounded(rows.agg(M.scorer("accuracy")(y, c, t).alias("accuracy"), M.scorer("f1")(y, c, t).alias("f1")), 6)


def embedded(spark, sf_dir):
    """Labels of ten classes and the first ten coordinates as their scores."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("probs"))


EMBEDDED = "(SELECT vec_id, label AS y, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS probs FROM embeddings)"
PREDICTED = f"(SELECT y, list_position(probs, list_max(probs)) - 1 AS p FROM {EMBEDDED})"


@query(f"SELECT round(avg(recall), 6) AS balanced_accuracy FROM (SELECT y, avg((y = p)::INT) AS recall FROM {PREDICTED} GROUP BY y)")
def metric_balanced_acc(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("y", M.argmax("probs").alias("p"))
    return rounded(M.balanced_accuracy(rows), 6)


@query(f"""WITH e AS (SELECT * FROM {PREDICTED}), c AS (SELECT y AS c, count(*) AS s FROM e GROUP BY 1)
SELECT round(sum(s * f) / sum(s), 6) AS f1_weighted FROM (SELECT s, 2.0 * (SELECT count(*) FROM e WHERE y = c.c AND p = c.c) / (s + (SELECT count(*) FROM e WHERE p = c.c)) AS f FROM c)""")
def metric_f1_weighted(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("y", M.argmax("probs").alias("p"))
    return rounded(M.f1_weighted(rows), 6)


@query(f"""WITH l AS (SELECT c, (y = c)::INT AS y, probs[c + 1] AS p FROM {EMBEDDED}, (SELECT unnest(range(10)) AS c)),
r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0 AS r FROM l),
a AS (SELECT c, avg(y) AS w, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY c)
SELECT round(sum(w * auc) / sum(w), 6) AS auc_ovr FROM a""")
def metric_auc_ovr(spark, sf_dir):
    return rounded(M.auc_ovr(embedded(spark, sf_dir), classes=10), 6)


PER_FOLD = f"""SELECT fold::VARCHAR AS fold, metric, score FROM (
SELECT fold, 'MAE' AS metric, avg(abs(y - p)) AS score FROM ({LINES}) GROUP BY fold UNION ALL
SELECT fold, 'RMSE', sqrt(avg((y - p) * (y - p))) FROM ({LINES}) GROUP BY fold UNION ALL
SELECT fold, 'R2', {R2_SQL} FROM ({LINES}) GROUP BY fold)"""


def fold_scores(spark, sf_dir):
    y, p, t = F.col("y"), F.col("p"), F.lit(1)
    wide = line_pairs(spark, sf_dir).groupBy("fold").agg(M.mae(y, p, t).alias("MAE"), M.rmse(y, p, t).alias("RMSE"), M.r2(y, p, t).alias("R2"))
    return wide.unpivot(["fold"], ["MAE", "RMSE", "R2"], "metric", "score")


@query(f"SELECT fold, metric, round(score, 3) AS score FROM ({PER_FOLD})")
def metric_per_fold(spark, sf_dir):
    return rounded(fold_scores(spark, sf_dir).withColumn("fold", F.col("fold").cast("string")), 3)


@query(f"SELECT 'mean' AS fold, metric, round(avg(score), 3) AS score FROM ({PER_FOLD}) GROUP BY metric")
def metric_fold_summary(spark, sf_dir):
    return rounded(M.with_mean_and_std(fold_scores(spark, sf_dir), "fold", "metric", "score").filter("fold = 'mean'"), 3)


@query(f"""WITH f AS ({PER_FOLD}) SELECT fold, metric, round(score, 3) AS score FROM f UNION ALL
SELECT 'mean', metric, round(avg(score), 3) FROM f GROUP BY metric UNION ALL SELECT 'std', metric, round(stddev_samp(score), 3) FROM f GROUP BY metric""")
def per_model_metrics(spark, sf_dir):
    return rounded(M.with_mean_and_std(fold_scores(spark, sf_dir), "fold", "metric", "score"), 3)


CI_DRAWS = f"""n AS (SELECT count(*) AS n FROM p), d AS (
SELECT b, {DRAW.format(seed=SEED, n='(SELECT n FROM n)')} AS k FROM {RUNS.format(b=N_BOOT)}, (SELECT unnest(range((SELECT n FROM n))) AS slot)),
m AS (SELECT b, -sqrt(avg((y - p) * (y - p))) AS m FROM d JOIN p USING (k) GROUP BY b)"""


@query(f"""WITH p AS ({PAIRS}), {CI_DRAWS}
SELECT 'RMSE' AS metric, round(sqrt(avg((y - p) * (y - p))), 3) AS score, round(-(SELECT quantile_cont(m, 0.975) FROM m), 3) AS ci_low,
round(-(SELECT quantile_cont(m, 0.025) FROM m), 3) AS ci_high, (SELECT count(*) FROM m) AS n_used FROM p""")
def bootstrap_metric_ci(spark, sf_dir):
    one = R.bootstrap_ci(price_pairs(spark, sf_dir), "o_orderkey", M.scorer("neg_rmse"), N_BOOT, SEED)
    name, score, low, high = M.displayed("neg_rmse")
    return rounded(one.select(F.lit(name).alias("metric"), score.alias("score"), low.alias("ci_low"), high.alias("ci_high"), "n_used"), 3)


@query(f"""WITH RECURSIVE p AS ({PAIRS}), whole AS (SELECT count(*) AS n FROM p), which AS (SELECT b, n, '{SEED}|perm|' || b AS name FROM {RUNS.format(b=N_BOOT)}, whole),
{place_sql("which", "b")},
m AS (SELECT m.b, -avg(abs(y.y - x.p)) AS m FROM moved m JOIN p x ON x.k = m.k JOIN p y ON y.k = m.dest GROUP BY m.b), o AS (SELECT -avg(abs(y - p)) AS o FROM p)
SELECT 'neg_mae' AS metric, round(any_value(o), 3) AS observed, round(avg(m), 3) AS null_mean, round(stddev_pop(m), 3) AS null_std,
round((count(*) FILTER (m >= o) + 1) / (count(*) + 1), 6) AS p_value FROM m, o""")
def permutation_test(spark, sf_dir):
    one = R.permutation_test(price_pairs(spark, sf_dir), "o_orderkey", M.scorer("neg_mae"), "neg_mae", N_BOOT, SEED)
    return one.select("metric", *[F.round(c, 3).alias(c) for c in ("observed", "null_mean", "null_std")], F.round("p_value", 6).alias("p_value"))


@query(f"SELECT times, count(*) AS n_rows FROM (SELECT o_orderkey, count(*) AS times FROM {ORDER_FOLDS} GROUP BY 1) GROUP BY 1")
def oof_coverage(spark, sf_dir):
    seen = kfold_assign(spark, sf_dir).groupBy("o_orderkey").agg(F.count("fold").alias("times"))
    return order_rows(spark, sf_dir).select("o_orderkey").join(seen, "o_orderkey", "left").groupBy(F.coalesce("times", F.lit(0)).cast("long").alias("times")).agg(F.count("*").alias("n_rows"))


@query("""WITH m AS (SELECT (o_orderkey % 5)::INTEGER AS fold, (o_custkey % 40)::INTEGER AS trial, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2)
SELECT fold, trial, round(score::DOUBLE, 3) AS score FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, trial) = 1""")
def best_trial(spark, sf_dir):
    fits = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_custkey") % 40).cast("int").alias("trial"), F.col("o_totalprice").cast("double").alias("score"))
    return rounded(B.best_trials(fits), 3)


@query("""WITH p AS (SELECT doc_id, [n_chars % 7, n_chars % 5, n_chars % 11]::DOUBLE[] AS probs FROM documents)
SELECT doc_id, (list_position(probs, list_max(probs)) - 1)::INTEGER AS label FROM p""")
def class_argmax(spark, sf_dir):
    n = F.col("n_chars")
    probs = table(spark, sf_dir, "documents").select("doc_id", F.array(*[(n % k).cast("double") for k in (7, 5, 11)]).alias("probs"))
    return probs.select("doc_id", M.argmax("probs").alias("label"))


FOLD_PHI = "(SELECT o_orderkey AS row, fold, e AS eff, o_totalprice * (fold + 1) * (e = 'a')::INT + (e = 'b')::INT * fold AS phi FROM orders, (SELECT unnest([0, 1, 2]) AS fold), (SELECT unnest(['a', 'b']) AS e) WHERE NOT (e = 'b' AND fold = 0))"


def fold_phi(spark, sf_dir):
    """Effects by fold: the first fold lacks effect b."""
    folds, effs = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("eff")
    rows = order_rows(spark, sf_dir).select(F.col("o_orderkey").alias("row"), "o_totalprice", folds).select("*", effs).filter("NOT (eff = 'b' AND fold = 0)")
    return rows.select("row", "fold", "eff", F.when(F.col("eff") == "a", F.col("o_totalprice") * (F.col("fold") + 1)).otherwise(F.col("fold").cast("double")).alias("phi"))


@query(f"SELECT row, eff, round(avg(phi), 4) AS phi FROM {FOLD_PHI} GROUP BY ALL")
def fold_shap_average(spark, sf_dir):
    return rounded(fold_average(fold_phi(spark, sf_dir), 3, zero_filled=False))


@query(f"SELECT row, eff, round(sum(phi) / 3, 4) AS phi FROM {FOLD_PHI} GROUP BY ALL")
def fold_shap_zero_filled(spark, sf_dir):
    return rounded(fold_average(fold_phi(spark, sf_dir), 3, zero_filled=True))
