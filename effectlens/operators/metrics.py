"""Scores of predictions; higher is better for all of them.

A scorer is a Column of aggregates over (y, p, times), so it works in any groupBy: whole table, fold,
or resample.  Rank metrics and metrics over classes need the rows ranked or counted first and take a
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.operators.scans import scan

TINY = 2.220446049250313e-16  # spacing of doubles at 1
NAMES = ("neg_mae", "neg_rmse", "r2", "roc_auc", "accuracy", "f1", "log_loss", "balanced_accuracy", "f1_weighted", "roc_auc_ovr")


def mae(y: Column, p: Column, t: Column) -> Column:
    return F.sum(F.abs(y - p) * t) / F.sum(t)


def rmse(y: Column, p: Column, t: Column) -> Column:
    return F.sqrt(F.sum(F.pow(y - p, 2) * t) / F.sum(t))


def r2(y: Column, p: Column, t: Column) -> Column:
    """1 - SSE/SST; a constant y scores 1 if it is met and else 0."""
    sse = F.sum(F.pow(y - p, 2) * t)
    sst = F.sum(y * y * t) - F.pow(F.sum(y * t), 2) / F.sum(t)
    flat = F.min(y) == F.max(y)
    return F.when(flat, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / F.when(~flat, sst))


def accuracy(y: Column, p: Column, t: Column) -> Column:
    """p is a class, or the probability of class 1 compared by the caller."""
    return F.sum(F.when(y == p, t).otherwise(0)) / F.sum(t)


def f1(y: Column, p: Column, t: Column) -> Column:
    hit = F.sum(F.when((y == 1) & (p == 1), t).otherwise(0))
    return F.coalesce(F.try_divide(2 * hit, F.sum(F.when(y == 1, t).otherwise(0)) + F.sum(F.when(p == 1, t).otherwise(0))), F.lit(0.0))


def log_loss(y: Column, p: Column, t: Column) -> Column:
    """The mean log of the probability given to the true class."""
    q = F.greatest(F.least(F.when(y == 1, p).otherwise(1 - p), F.lit(1 - TINY)), F.lit(TINY))
    return F.sum(F.log(q) * t) / F.sum(t)


SCORERS = {
    "neg_mae": lambda y, p, t: -mae(y, p, t),
    "neg_rmse": lambda y, p, t: -rmse(y, p, t),
    "r2": r2,
    "accuracy": accuracy,
    "f1": f1,
    "log_loss": log_loss,
}


def scorer(name: str):
    if name not in SCORERS:
        known = sorted({*NAMES})
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(known)}" if name not in NAMES else f"{name} needs ranks or classes: use its own function")
    return SCORERS[name]


def weight(times: str | None) -> Column:
    return F.col(times) if times else F.lit(1)


def auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = (), times: str | None = None) -> DataFrame:
    """(by, auc) by average ranks.  Rows are first counted per distinct score; a scan of these counts gives the ranks, group by group, with no window over a whole group."""
    t = weight(times)
    counts = df.withColumn("_one", F.lit(0)).groupBy(*by, "_one", p).agg(F.sum(F.when(F.col(y) == 1, t).otherwise(0)).alias("pos"), F.sum(t).alias("n"))
    ranked = scan(counts, [*by, "_one"], [p], "n").withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2)
    return area_under(ranked, by)


def area_under(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) of counts (by, pos, n, rank)."""
    n1, n = F.sum("pos"), F.sum("n")
    value = F.try_divide(F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return ranked.groupBy(*by).agg(value.alias("auc"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = (), times: str | None = None) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.sum(weight(times)).alias("n"))


def per_class(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = (), times: str | None = None) -> DataFrame:
    """(by, class, support, predicted, hits) from the confusion counts."""
    c = confusion(df, y, p, by, times)
    sides = c.select(*by, F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.unionByName(c.select(*by, F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits")))
    return sides.groupBy(*by, "class").agg(*[F.sum(x).cast("long").alias(x) for x in ("support", "predicted", "hits")])


def balanced_accuracy(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = (), times: str | None = None) -> DataFrame:
    return per_class(df, y, p, by, times).filter("support > 0").groupBy(*by).agg(F.avg(F.col("hits") / F.col("support")).alias("balanced_accuracy"))


def f1_weighted(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = (), times: str | None = None) -> DataFrame:
    each = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class(df, y, p, by, times).groupBy(*by).agg((F.sum(F.col("support") * each) / F.sum("support")).alias("f1_weighted"))


def auc_ovr(df: DataFrame, y: str = "y", probs: str = "probs", classes: int = 2, by: list[str] = (), times: str | None = None) -> DataFrame:
    """(by, auc_ovr): the AUC of each class against the rest, weighted by how common it is; absent classes don't count."""
    long = df.select(*by, weight(times).alias("t"), F.col(y).alias("cls"), F.posexplode(probs).alias("c", "p")).filter(F.col("c") < classes)
    long = long.select(*by, "c", "t", (F.col("cls") == F.col("c")).cast("int").alias("y"), "p")
    share = long.groupBy(*by, "c").agg((F.sum(F.col("y") * F.col("t")) / F.sum("t")).alias("w"))
    each = auc(long, by=[*by, "c"], times="t").join(share, [*by, "c"]).filter("auc IS NOT NULL")
    return each.groupBy(*by).agg((F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("auc_ovr"))


def argmax(probs: str | Column):
    """The first place of the largest of an array."""
    c = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def multi_rmse(df: DataFrame, targets: list[tuple[str, str]]) -> DataFrame:
    """(target, rmse) rows, and one for all: the root of the mean squared error over the targets."""
    one = df.agg(*[F.avg(F.pow(F.col(y) - F.col(p), 2)).alias(y) for y, p in targets])
    rows = one.unpivot([], [y for y, _ in targets], "target", "mse").select("target", F.sqrt("mse").alias("rmse"))
    whole = one.select(F.lit("all").alias("target"), F.sqrt(sum((F.col(y) for y, _ in targets), F.lit(0.0)) / len(targets)).alias("rmse"))
    return rows.unionByName(whole)


def displayed(name: str, score: str = "score", low: str = "ci_low", high: str = "ci_high") -> tuple[str, Column, Column, Column]:
    """Name and values as shown: a negated metric loses its sign, and its bounds change places."""
    if name.startswith("neg_"):
        return name[4:].upper(), -F.col(score), -F.col(high), -F.col(low)
    return name.upper(), F.col(score), F.col(low), F.col(high)


def with_mean_and_std(scores: DataFrame, fold: str, metric: str, score: str) -> DataFrame:
    """Scores per fold and metric, then rows named mean and std (of a sample) for each metric."""
    rows = scores.select(F.col(fold).cast("string").alias(fold), metric, score)
    one = rows.groupBy(metric).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return rows.unionByName(one.unpivot([metric], ["mean", "std"], fold, score).select(fold, metric, score))
