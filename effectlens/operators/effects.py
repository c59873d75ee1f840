"""Effects in long form and the statistics over their resamples.

An effect is a row of (eff, i, j, type_i, type_j); j is null for a single feature.  Attributions are
(row, eff, phi); bootstrap results are (b, eff, m, v, gii).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.operators.scans import least_from, scan
from effectlens.sources.scratch import stored


def pairs_of(features: DataFrame, name: str = "feature") -> DataFrame:
    """(i, j) of all feature pairs, i before j: features, not rows, so the product is small."""
    a, b = features.select(F.col(name).alias("i")), features.select(F.col(name).alias("j"))
    return a.join(b, F.col("i") < F.col("j"))


def cell_effects(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """(a, b, n, phi_a, phi_b, phi_ab): attributions of the cell means of y by two features.

    One aggregation with grouping sets gives the cell, both margins and the whole; everything after
    runs on one row per cell.
    """
    sets = df.groupingSets([[a, b], [a], [b], []], a, b).agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.grouping_id().alias("g"))
    mean = F.col("s") / F.col("n")
    pick = lambda g, *cols: sets.filter(F.col("g") == g).select(*cols)
    cells = pick(0, a, b, "n", mean.alias("v_ab"))
    by_a, by_b = pick(1, F.col(a).alias("_a"), mean.alias("v_a")), pick(2, F.col(b).alias("_b"), mean.alias("v_b"))
    out = cells.join(by_a, F.col(a).eqNullSafe(F.col("_a"))).join(by_b, F.col(b).eqNullSafe(F.col("_b")))
    out = out.crossJoin(F.broadcast(pick(3, mean.alias("v_0"))))
    return out.select(a, b, "n", (F.col("v_a") - F.col("v_0")).alias("phi_a"), (F.col("v_b") - F.col("v_0")).alias("phi_b"), (F.col("v_ab") - F.col("v_a") - F.col("v_b") + F.col("v_0")).alias("phi_ab"))


def level_effects(df: DataFrame, feature: str, y: str) -> DataFrame:
    """(level, n, phi): a feature's own attribution in an additive model, its level mean less the mean."""
    levels = df.groupBy(F.col(feature).alias("level")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    whole = levels.agg((F.sum("s") / F.sum("n")).alias("v_0"))
    return levels.crossJoin(F.broadcast(whole)).select("level", "n", (F.col("s") / F.col("n") - F.col("v_0")).alias("phi"))


def magnitude(phi: Column, times: Column | None = None) -> Column:
    """M: the mean absolute attribution."""
    return F.avg(F.abs(phi)) if times is None else F.sum(F.abs(phi) * times) / F.sum(times)


def variability(df: DataFrame, by: list[str], x: list[str], phi: str = "phi", times: str | None = None) -> DataFrame:
    """(by, m, v, gii): V is the spread of the level means, each row counting with its level's mean.

    Two aggregations, first by level and then by effect: no row is repeated, no window is needed.
    """
    t = F.col(times) if times else F.lit(1)
    cells = df.groupBy(*by, *x).agg(F.sum(t).alias("w"), F.sum(F.col(phi) * t).alias("s"), F.sum(F.abs(phi) * t).alias("a"))
    n, square, total = F.sum("w"), F.sum(F.col("s") * F.col("s") / F.col("w")), F.sum("s")
    v = F.sqrt(F.greatest(square / n - F.pow(total / n, 2), F.lit(0.0)))
    out = cells.groupBy(*by).agg((F.sum("a") / n).alias("m"), v.alias("v"))
    return out.withColumn("gii", F.sqrt(F.col("m") * F.col("v")))


def nature(distinct: Column, role: Column, threshold: int = 15) -> Column:
    return F.when((role == "nominal") | (distinct <= threshold), "discrete").otherwise("continuous")


def nonzero(effects: DataFrame, by: list[str], phi: str = "phi") -> DataFrame:
    """The effects of each group that are other than 0 in some row."""
    return effects.groupBy(*by).agg(F.max(F.abs(phi)).alias("most")).filter("most > 0").drop("most")


def fold_average(effects: DataFrame, folds: int, zero_filled: bool) -> DataFrame:
    """(row, eff, phi) over folds: an effect that a fold lacks counts as 0 there, or is passed over."""
    total = F.sum("phi")
    return effects.groupBy("row", "eff").agg((total / folds if zero_filled else total / F.count("phi")).alias("phi"))


def spread(value: str, alpha: float = 0.05) -> list[Column]:
    """Aggregates that a statistic's summary needs; nulls are passed over."""
    return [F.avg(value).alias(f"{value}_value"), F.percentile(value, F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2))).alias(f"{value}_q3")]


def described(value: str) -> list[Column]:
    """Mean, interval and stability (median by width, 0 where there is none) from these aggregates."""
    low, mid, high = (F.get(f"{value}_q3", i) for i in range(3))
    stable = F.when(high - low > 1e-12, mid / F.when(high - low > 1e-12, high - low)).otherwise(0.0)
    return [F.col(f"{value}_value"), low.alias(f"{value}_ci_low"), high.alias(f"{value}_ci_high"), stable.alias(f"{value}_stab")]


def summary(boots: DataFrame, values: str | tuple[str, ...], by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, value, ci_low, ci_high, stab) of one statistic, or of several in one pass."""
    values = (values,) if isinstance(values, str) else values
    return boots.groupBy(*by).agg(*[x for v in values for x in spread(v, alpha)]).select(*by, *[x for v in values for x in described(v)])


STATISTICS = ("m", "v", "gii")


def noise(shadows: DataFrame) -> DataFrame:
    """(b, stratum, m, v, gii): per resample the largest value of any shadow effect in the stratum."""
    return shadows.groupBy("b", "stratum").agg(*[F.max(s).alias(s) for s in STATISTICS])


def with_noise(boots: DataFrame, shadows: DataFrame) -> DataFrame:
    """boots with noise_m, noise_v, noise_gii of their stratum, or of all strata where it has no shadow."""
    own = noise(shadows).withColumnsRenamed({s: f"own_{s}" for s in STATISTICS})
    whole = noise(shadows).groupBy("b").agg(*[F.max(s).alias(f"any_{s}") for s in STATISTICS])
    out = boots.join(own, ["b", "stratum"], "left").join(whole, "b", "left")
    return out.select(*boots.columns, *[F.coalesce(f"own_{s}", f"any_{s}").alias(f"noise_{s}") for s in STATISTICS])


def exceedance(value: str, n_boot: int) -> Column:
    """p: how often a resample's value is within its noise; a failed value isn't, and counts."""
    return (F.sum(F.when(F.col(value) <= F.col(f"noise_{value}"), 1).otherwise(0)) + 1) / F.lit(n_boot + 1)


def bh(df: DataFrame, p: str, q: str) -> DataFrame:
    """df with the Benjamini-Hochberg q of p."""
    return df.join(bh_of(df, p).withColumnRenamed("q", q), F.col(p) == F.col("_p")).drop("_p")


def bh_of(df: DataFrame, p: str, by: list[str] = ()) -> DataFrame:
    """(by, _p, q) of each distinct p of a group: a scan over them, as equal p have equal q, and one back for the least of what follows."""
    counts = stored(df.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), "p-values")
    group = ["_all", *by]
    many = counts.groupBy(*group).agg(F.sum("_n").alias("_m"))  # one row for each group
    ranked = scan(counts, group, ["_p"], "_n").join(F.broadcast(many), group)
    least = least_from(ranked.select(*group, "_p", (F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_n"))).alias("_raw")), group, ["_p"], "_raw", "_q")
    return least.select(*by, "_p", F.least(F.lit(1.0), "_q").alias("q"))


def statistics(boots: DataFrame, shadows: DataFrame, n_boot: int, alpha: float = 0.05, stab_thresh: float = 2.0, fdr: bool = True) -> DataFrame:
    """The final table: value, interval, p, q, stability and significance of each statistic, and failures of V."""
    # A few rows for each resample: written down once, for all that follows.
    boots, shadows = stored(boots, "boots"), stored(shadows, "shadow-boots")
    if not shadows.take(1):
        raise ValueError("no shadow effects: nothing to calibrate against")
    held = with_noise(boots, shadows)
    out = held.groupBy("eff", "stratum").agg(
        *[exceedance(s, n_boot).alias(f"{s}_p") for s in STATISTICS],
        F.avg(F.col("v").isNull().cast("int")).alias("v_failure_rate"),
        F.every(F.col("v").isNull()).alias("calc_failed"),
        *[x for s in STATISTICS for x in spread(s, alpha)],
    )
    out = stored(out.select("eff", "stratum", *[f"{s}_p" for s in STATISTICS], "v_failure_rate", "calc_failed", *[x for s in STATISTICS for x in described(s)]), "statistics")
    if fdr:  # all statistics' p are corrected in one scan
        q = stored(bh_of(out.unpivot(["eff"], [f"{s}_p" for s in STATISTICS], "_s", "_each"), "_each", ["_s"]), "q")
    for s in STATISTICS:
        one = q.filter(F.col("_s") == f"{s}_p").select("_p", F.col("q").alias(f"{s}_q")) if fdr else None
        out = out.withColumn(f"{s}_q", F.col(f"{s}_p")) if one is None else out.join(one, F.col(f"{s}_p") == F.col("_p")).drop("_p")
        out = out.withColumn(f"{s}_sig", F.coalesce((F.col(f"{s}_q") < alpha) & (F.col(f"{s}_stab") >= stab_thresh), F.lit(False)))
    return out


def final_order(sig: str = "gii_sig", q: str = "gii_q", value: str = "gii_value") -> list[Column]:
    """Significant effects first by q, then the larger first."""
    return [F.col(q) + F.when(F.col(sig), 0).otherwise(1000), F.col(value).desc(), F.col("eff")]


def save_set(stats: DataFrame, extra: int, sig: str, q: str) -> DataFrame:
    """The significant effects and the next `extra` by q; stats has one row per effect."""
    order = W.orderBy(F.col(sig).desc(), q, "eff")
    n_sig = F.sum(F.col(sig).cast("int")).over(W.partitionBy())
    return stats.withColumn("_n", n_sig).withColumn("save_rank", F.row_number().over(order)).filter(F.col("save_rank") <= F.col("_n") + extra).drop("_n")


def ranked_significant(stats: DataFrame) -> DataFrame:
    return stats.filter("gii_sig").withColumn("rank", F.row_number().over(W.orderBy(F.col("gii_value").desc(), "eff")))


def microdata(effects: DataFrame, values: DataFrame) -> DataFrame:
    """Attributions (row, eff, i, j, phi), and their slice if they have one, with what is known of each feature's value.

    values is (row, feature, value, code, raw, type): the value as the model saw it, a number that orders it, as it stood in the data, and the feature's type.
    """
    side = lambda k, names: values.select("row", F.col("feature").alias(k), *[F.col(c).alias(n) for c, n in names.items()])
    main = side("i", {"value": "feature_value", "code": "feature_code", "raw": "main_feature_raw", "type": "main_feature_type"})
    partner = side("j", {"value": "partner_value", "code": "partner_code", "raw": "partner_feature_raw", "type": "partner_feature_type"})
    out = effects.join(main, ["row", "i"]).join(partner, ["row", "j"], "left")
    known = ["feature_value", "partner_value", "feature_code", "partner_code", "main_feature_raw", "main_feature_type", "partner_feature_raw", "partner_feature_type"]
    return out.select(*(["slice"] if "slice" in effects.columns else []), "row", "eff", "phi", F.col("i").alias("main_feature"), F.col("j").alias("interaction_partner"), *known)
