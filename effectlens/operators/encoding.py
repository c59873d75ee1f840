"""Cleaning and encoding of a wide table, and the reports and guards that go with it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.functions.columns import blank_to_null, nominal, ordinal_code, to_number


class LevelError(ValueError):
    """Most distinct values of an ordinal are none of its levels."""


def clean_strings(df: DataFrame) -> DataFrame:
    """Blank cells of all string columns become null, in one projection."""
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df's columns of these names, in this order; extra columns go, missing ones are an error."""
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*[f"`{c}`" for c in names])


def supervised(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """df with whether all outcomes are there; no row goes."""
    known = F.lit(True)
    for c in outcomes:
        known = known & F.col(c).isNotNull()
    return df.withColumn("supervised", known)


def drop_missing_outcome(df: DataFrame, outcomes: list[str]) -> DataFrame:
    return df.na.drop(subset=outcomes)


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_rate, missing_count, total_count) from one pass with one row of counts."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["total"], columns, "feature", "present")
    return long.select("feature", ((F.col("total") - F.col("present")) / F.col("total")).alias("missing_rate"), (F.col("total") - F.col("present")).alias("missing_count"), F.col("total").alias("total_count"))


def all_missing(df: DataFrame, columns: list[str]) -> list[str]:
    """Names of the columns without any value."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first() if columns else {}
    return [c for c in columns if seen[c] == 0]


def unknown_levels(df: DataFrame, column: str, levels: list, numeric: bool = False) -> DataFrame:
    """One row: shares of distinct values and of observations that are none of the levels."""
    unknown = ordinal_code(F.col(column), levels, numeric).isNull()
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).withColumn("unknown", unknown)
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return counts.agg(
        share(F.sum(F.col("unknown").cast("int")), F.count("*")).alias("unique_frac"),
        share(F.sum(F.when(F.col("unknown"), F.col("n")).otherwise(0)), F.sum("n")).alias("obs_frac"),
    )


def check_levels(df: DataFrame, column: str, levels: list, numeric: bool = False, most_unique: float = 0.5, most_obs: float = 0.1) -> None:
    found = unknown_levels(df, column, levels, numeric).first()
    if found.unique_frac > most_unique:
        raise LevelError(f"{column}: {found.unique_frac:.0%} of the distinct values are none of its levels")
    if found.unique_frac > 0:
        warnings.warn(f"{column}: some values are none of its levels and become missing")
    if found.obs_frac > most_obs:
        warnings.warn(f"{column}: {found.obs_frac:.0%} of the observations are none of its levels")


def encode(df: DataFrame, roles: dict[str, str], levels: dict[str, list], keep: list[str] = ()) -> DataFrame:
    """Typed features in sorted order after the columns to keep: one projection, no shuffle."""
    kinds = dict(df.dtypes)
    out = []
    for c in sorted(roles):
        if roles[c] == "nominal":
            out.append(nominal(F.col(c), kinds[c]).alias(c))
        elif roles[c] == "continuous":
            out.append(to_number(F.col(c)).cast("float").alias(c))
        else:
            numeric = all(isinstance(x, int | float) for x in levels[c])
            out.append(ordinal_code(F.col(c), levels[c], numeric).alias(c))
    return df.select(*keep, *out)


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): codes of the distinct values in order; the ranking sees distinct values only."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return found.select(column, (F.dense_rank().over(W.orderBy(column)) - 1).cast("int").alias("code"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(target, mean, scale): population moments; a constant column has scale 1."""
    one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"`{c}|m`").alias("mean"), F.when(F.col(f"`{c}|s`") > 0, F.col(f"`{c}|s`")).otherwise(1.0).alias("scale")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column z-scored in place; the moments are one row."""
    one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(one))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).select(*df.columns)


def class_counts(df: DataFrame, label: str, folds: int) -> DataFrame:
    """(label, n, enough): whether each class has a row for every fold."""
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= folds)
