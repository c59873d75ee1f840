"""Tables behind the plots: levels, crossings, rescaling.  All run on small aggregated inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def level_order(df: DataFrame, raw: str, code: str, by: list[str] = ()) -> DataFrame:
    """(by, raw, place): distinct labels in the order of their codes, from 1."""
    return df.select(*by, raw, code).distinct().select(*by, raw, F.dense_rank().over(W.partitionBy(*by).orderBy(code)).cast("int").alias("place"))


def top_levels(df: DataFrame, level: str, n: int = 5, by: list[str] = ()) -> DataFrame:
    """(by, level, n) of the most frequent levels."""
    counts = df.groupBy(*by, level).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), level).limit(n)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), level))
    return counts.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def level_means(df: DataFrame, level: str, value: str) -> DataFrame:
    return df.groupBy(level).agg(F.avg(value).alias("mean"))


def mean_crossings(means: DataFrame, place: str, mean: str, by: list[str] = ()) -> DataFrame:
    """(by, crossing): midpoints between adjacent levels whose means have other signs, neither being 0."""
    after = W.partitionBy(*by).orderBy(place)
    steps = means.select(*by, place, mean, F.lead(place).over(after).alias("_x"), F.lead(mean).over(after).alias("_y"))
    return steps.filter((F.col(mean) != 0) & (F.col("_y") != 0) & (F.signum(mean) != F.signum("_y"))).select(*by, ((F.col(place) + F.col("_x")) / 2).alias("crossing"))


def first_zero(trend: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(by, zero): where a trend first changes sign, between its points; its value before must not be 0."""
    after = W.partitionBy(*by).orderBy(x)
    steps = trend.select(*by, F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(after).alias("x2"), F.lead(y).over(after).alias("y2"))
    crossed = steps.filter((F.col("y1") != 0) & F.col("y2").isNotNull() & (F.signum("y1") != F.signum("y2")))
    at = F.col("x1") - F.col("y1") * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    first = crossed.groupBy(*by).agg(F.min_by(at, "x1").alias("zero"))
    return first.filter("zero IS NOT NULL")


def rescaled(phi: Column, outcome_range: float | Column, negate: bool = False) -> Column:
    """An attribution as percent of the outcome's range."""
    return (-phi if negate else phi) / outcome_range * 100


def axis_limit(stats: DataFrame, value: str, noise: str) -> DataFrame:
    return stats.agg((F.greatest(F.max(value), F.max(noise)) * 1.05).alias("axis_limit"))


def performance_panel(performance: DataFrame, permutation: DataFrame) -> DataFrame:
    """Scores with the p of their permutation test, where there is one."""
    return performance.join(permutation.select("metric", "p_value"), "metric", "left")
