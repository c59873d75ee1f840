"""Ordered scans of groups of any size: pieces of each group's order, and what each hands on to the next.

A group of more than ``rows`` rows is cut at quantiles of its first order column; where many rows share a quantile's value, they are cut
at quantiles of the second.  Windows run within pieces, and a window over the pieces, few a group, gives what
lies before each.  No window holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.sources.scratch import stored

ROWS = 500_000
PIECES = 256


def with_under(df: DataFrame, cuts: str, x: str, name: str) -> DataFrame:
    """df with how many of an array of sorted cuts, under PIECES of them, are less than x: found by halving, a projection for each step; 0 without an array."""
    df, step = df.withColumn(name, F.lit(0)), PIECES // 2
    while step:
        df = df.withColumn(name, F.when(F.get(cuts, F.col(name) + (step - 1)) < F.col(x), F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return df


def with_pieces(df: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """df with _piece, a number that never falls along the order within a group.  Order columns are numbers without nulls."""
    steps = [i / PIECES for i in range(1, PIECES)]
    sketches = [F.percentile_approx(c, steps, 20 * PIECES).alias(f"_cuts{k}") for k, c in enumerate(order[:2])]
    large = df.groupBy(*by).agg(F.count("*").alias("_many"), *sketches).filter(F.col("_many") > rows).drop("_many")
    # A few kB for every `rows` rows at most; dealt out by group, a large group's rows would meet in one task.
    met = with_under(df.join(F.broadcast(large), by, "left"), "_cuts0", order[0], "_first")
    first = F.col("_first").cast("long")
    if len(order) > 1:
        # The cuts that are repeated are values of many rows; these are the last of their piece.
        met = with_under(met, "_cuts1", order[1], "_second")
        hot = (F.get("_cuts0", F.col("_first")) == F.col(order[0])) & (F.get("_cuts0", F.col("_first") + 1) == F.col(order[0]))
        first = first * (PIECES + 1) + F.when(hot, 1 + F.col("_second")).otherwise(0)
    return met.select(*df.columns, first.cast("long").alias("_piece"))


def variation(points: DataFrame, by: list[str], order: list[str], y: list[str], rows: int = ROWS) -> DataFrame:
    """(by, y...): the total variation of each of the columns y along the order, 0 for a single point."""
    steps = scan(points, by, order, keep=y, rows=rows)
    return steps.groupBy(*by).agg(*[F.coalesce(F.sum(F.abs(F.col(c) - F.col("_prev")[c])), F.lit(0.0)).alias(c) for c in y])


def scan(df: DataFrame, by: list[str], order: list[str], weight: str | None = None, keep: list[str] = (), rows: int = ROWS) -> DataFrame:
    """df with _before, the weight of the rows before each in its group, and _prev, the last row before it as a struct of order and ``keep``.

    Order columns must tell a group's rows apart.
    """
    cut = stored(with_pieces(df, by, order, rows), "pieces")  # read twice: rows, and what pieces hand on
    inside = W.partitionBy(*by, "_piece").orderBy(*order)
    own = F.struct(*order, *keep)
    w = F.col(weight) if weight else F.lit(1)
    put = cut.withColumn("_prev", F.lag(own).over(inside)).withColumn("_before", F.sum(w).over(inside.rowsBetween(W.unboundedPreceding, 0)) - w)
    ends = cut.groupBy(*by, "_piece").agg(F.sum(w).alias("_sum"), F.max(own).alias("_last"))
    pieces = W.partitionBy(*by).orderBy("_piece")
    starts = ends.select(*by, "_piece", (F.sum("_sum").over(pieces) - F.col("_sum")).alias("_start"), F.lag("_last").over(pieces).alias("_from"))
    met = put.join(starts, [*by, "_piece"])
    return met.select(*df.columns, (F.col("_before") + F.col("_start")).alias("_before"), F.coalesce("_prev", "_from").alias("_prev"))


def least_from(df: DataFrame, by: list[str], order: list[str], value: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with the least value of each row and all that come after it in its group."""
    cut = stored(with_pieces(df, by, order, rows), "pieces")  # read twice: rows, and what pieces hand on
    back = lambda keys, last: W.partitionBy(*by, *keys).orderBy(*[F.desc(c) for c in last])
    own = cut.withColumn("_own", F.min(value).over(back(["_piece"], order).rowsBetween(W.unboundedPreceding, 0)))
    ends = cut.groupBy(*by, "_piece").agg(F.min(value).alias("_least"))
    later = ends.select(*by, "_piece", F.min("_least").over(back([], ["_piece"]).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    return own.join(later, [*by, "_piece"]).select(*df.columns, F.least("_own", "_later").alias(name))


def quantiles(scanned: DataFrame, by: list[str], x: str, weight: str, whole: str, share: list[float], name: str) -> DataFrame:
    """(by, name): exact quantiles of x, interpolated linearly, of rows that ``scan`` has put in the order of x; whole is the group's weight."""
    place = [F.lit(p) * (F.col(whole) - 1) for p in share]
    covers = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col(weight))
    at = lambda r: F.max(F.when(covers(r), F.col(x)))
    low = scanned.groupBy(*by).agg(
        F.array(*[at(F.floor(h)) for h in place]).alias("_low"),
        F.array(*[at(F.ceil(h)) for h in place]).alias("_high"),
        F.array(*[F.max(h - F.floor(h)) for h in place]).alias("_t"),
    )
    between = F.zip_with(F.arrays_zip("_low", "_high"), "_t", lambda a, t: a["_low"] + (a["_high"] - a["_low"]) * t)
    return low.select(*by, between.alias(name))
