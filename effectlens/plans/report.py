"""Tables behind the plots of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.functions.columns import recode_missing, slug
from effectlens.operators import effects as X
from effectlens.operators import presentation as P
from effectlens.operators.splines import trend
from effectlens.plans.training import Contract, load, slice_names
from effectlens.sources.files import read_csv, write_csv, write_parquet
from effectlens.sources.scratch import stored


def report(spark: SparkSession, run: str, negate: bool = False) -> None:
    """Under run/report: the performance panel and its nulls, and for each class or target in a folder of its own the significant effects by rank, and for each of their
    features the level means in the order of the levels, as they are called in the data, their crossings and most frequent levels, and the trends and their first zeros, in percent of the outcome's range."""
    c, _, _ = load(spark, run)
    performance, tests = (read_csv(spark, f"{run}/{n}").withColumn("metric", F.concat_ws(" ", "target", "metric")).drop("target") for n in ("performance", "permutation_test"))
    write_csv(P.performance_panel(performance, tests), f"{run}/report/performance")
    nulls = spark.read.parquet(f"{run}/permutation_null_distributions").select(F.concat_ws(" ", "target", "metric").alias("metric"), "b", "null")
    write_parquet(nulls.join(performance.select("metric", F.col("score").alias("observed")), "metric"), f"{run}/report/performance_nulls")
    stats = read_csv(spark, f"{run}/shap_stats_global")
    for k, name in enumerate(slice_names(c)):
        one_slice(spark, run, f"{run}/report" if name is None else f"{run}/report/{plain(name)}", c, stats.filter(F.col("slice") == k), k, negate)


def plain(name: str) -> str:
    return "".join(ch for ch in name if ch.isalnum() or ch == "_")


def one_slice(spark: SparkSession, run: str, out: str, c: Contract, stats: DataFrame, k: int, negate: bool) -> None:
    """The tables of one class or target."""
    ranked = X.ranked_significant(stats).withColumn("file", slug(F.col("eff")))
    write_csv(ranked, f"{out}/ranked")
    rows = spark.read.parquet(f"{run}/train_matrix")
    span = 1.0
    if c.task in ("regression", "multi_regression"):
        span = rows.agg((F.max(f"_y{k}") - F.min(f"_y{k}")).alias("s")).first().s or 1.0
    micro = spark.read.parquet(f"{run}/microdata").filter(F.col("slice") == k).withColumn("percent", P.rescaled(F.col("phi"), F.lit(float(span)), negate))
    single = micro.filter("interaction_partner IS NULL").withColumn("level", recode_missing(F.col("main_feature_raw")))
    levels = single.filter("main_feature_type <> 'continuous'")
    # Missing levels have no code and come last.
    ordered = P.level_order(levels.withColumn("_code", F.coalesce("feature_code", F.lit(float("inf")))), "level", "_code", ["eff"])
    means = levels.groupBy("eff", "level").agg(F.avg("percent").alias("mean"), F.count("*").alias("n")).join(ordered, ["eff", "level"])
    write_csv(means.orderBy("eff", "place"), f"{out}/level_means")
    write_csv(P.mean_crossings(means, "place", "mean", ["eff"]), f"{out}/level_crossings")
    write_csv(P.top_levels(levels.filter("main_feature_type = 'nominal'"), "level", by=["eff"]), f"{out}/top_levels")
    smooth = stored(trend(single.filter("main_feature_type = 'continuous' AND feature_code IS NOT NULL").select("eff", F.col("feature_code").alias("value"), "percent"), ["eff"], "value", "percent"), "trends")
    write_csv(smooth, f"{out}/trends")
    write_csv(P.first_zero(smooth, "x", "fit", ["eff"]), f"{out}/trend_zeros")
