"""Least-squares splines and the variability V that they give.

``v_effect`` and the functions above it are numpy kernels of one effect's rows.  ``variability_by`` gives the same of tables, without gathering any
group's rows: rows are summed up by (group, x); a scan of these cells finds knots and total variations; Gram matrices
and moments are sums over cells, made task by task and added up by (group, coefficient, coefficient); and a fit is solved from
at most a few thousand numbers.  The spread of the fitted values follows from the Gram matrix.

Rows of one x are taken in the order of y where the variation of the data is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.operators.scans import ROWS, quantiles, scan
from effectlens.sources.scratch import stored

LINEAR_BELOW = 4  # interior knots under which a spline is made of lines
ENERGY = 1.001


def interior_knots(x: np.ndarray, n: int) -> np.ndarray:
    """Distinct inner percentiles that lie strictly within the data."""
    k = np.unique(np.percentile(x, np.linspace(0, 100, n + 2)[1:-1]))
    return k[(k > x.min()) & (k < x.max())]


def degree_for(knots: np.ndarray, degree: int) -> int:
    return 1 if len(knots) < LINEAR_BELOW else degree


def basis(x: np.ndarray, knots: np.ndarray, degree: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, full knots) of all B-splines at x, by the Cox-de Boor recursion."""
    t = np.r_[[low] * (degree + 1), knots, [high] * (degree + 1)]
    spans = np.clip(np.searchsorted(t, x, "right") - 1, degree, len(t) - degree - 2)
    b = np.zeros((len(x), len(t) - 1))
    b[np.arange(len(x)), spans] = 1
    for k in range(1, degree + 1):
        rise, fall = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        up = np.divide(x[:, None] - t[: -k - 1], rise, out=np.zeros((len(x), len(rise))), where=rise > 0)
        down = np.divide(t[k + 1 :] - x[:, None], fall, out=np.zeros((len(x), len(fall))), where=fall > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b, t


def has_support(x: np.ndarray, t: np.ndarray, degree: int) -> bool:
    """Whether some data points, in order, lie one inside each spline's support (x is sorted)."""
    i, m = 0, len(t) - degree - 1
    for j in range(m):
        low, high = t[j], t[j + degree + 1]
        edge = j in (0, m - 1)
        while i < len(x) and not (low < x[i] < high or (edge and low <= x[i] <= high)):
            i += 1
        if i == len(x):
            return False
        i += 1
    return True


def fit_1d(x: np.ndarray, y: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray | None:
    """Fitted values of the least-squares spline at sorted x; None if the data don't determine it."""
    b, t = basis(x, knots, degree, x[0], x[-1])
    if not has_support(x, t, degree):
        return None
    return b @ np.linalg.lstsq(b, y, rcond=None)[0]


def fit_2d(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, k1: np.ndarray, k2: np.ndarray, d1: int, d2: int) -> np.ndarray:
    """Fitted values of the tensor spline of least norm."""
    b1, _ = basis(x1, k1, d1, x1.min(), x1.max())
    b2, _ = basis(x2, k2, d2, x2.min(), x2.max())
    design = (b1[:, :, None] * b2[:, None, :]).reshape(len(y), -1)
    return design @ np.linalg.lstsq(design, y, rcond=None)[0]


def variation(y: np.ndarray) -> float:
    return float(np.abs(np.diff(y)).sum())


def within_energy(raw: float, fitted: float) -> bool:
    """A smooth signal may not vary more than the data it was fitted to."""
    return fitted < 1e-9 if raw == 0 else fitted <= ENERGY * raw


def group_means(y: np.ndarray, *x: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(y), np.int64)
    for c in x:
        _, inverse = np.unique(c, return_inverse=True)
        codes = codes * (inverse.max() + 1 if len(inverse) else 1) + inverse
    _, at = np.unique(codes, return_inverse=True)
    return (np.bincount(at, y) / np.bincount(at))[at]


def line(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    if x.min() == x.max():
        return None
    slope, base = np.polyfit(x, y, 1)
    return slope * x + base


def v_1d(x: np.ndarray, y: np.ndarray, n_knots: int = 4, degree: int = 3, threshold: int = 15) -> float | None:
    """V of a continuous feature; None where no spline can be fitted."""
    if len(x) <= threshold:
        return float(np.std(group_means(y, x)))
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    knots = interior_knots(xs, n_knots)
    if not len(knots):
        straight = line(xs, ys)
        return 0.0 if straight is None else float(np.std(straight))
    fitted = fit_1d(xs, ys, knots, degree_for(knots, degree))
    if fitted is None or not np.isfinite(fitted).all():
        return None
    if not within_energy(variation(ys), variation(fitted)):
        return float(np.std(group_means(y, x)))
    return float(np.std(fitted))


def v_stacked(x: np.ndarray, group: np.ndarray, y: np.ndarray, n_knots: int = 4, degree: int = 3, threshold: int = 15) -> float:
    """V of a continuous feature within each level of a discrete one; a level's mean where no spline fits."""
    signal = np.empty(len(y))
    _, at = np.unique(group, return_inverse=True)
    for g in range(at.max() + 1 if len(at) else 0):
        rows = np.flatnonzero(at == g)
        order = rows[np.lexsort((y[rows], x[rows]))]
        xs, ys = x[order], y[order]
        fitted = None
        if len(rows) > threshold:
            knots = interior_knots(xs, n_knots)
            fitted = fit_1d(xs, ys, knots, degree_for(knots, degree)) if len(knots) else line(xs, ys)
            if fitted is not None and len(knots) and not within_energy(variation(ys), variation(fitted)):
                fitted = None
        signal[order] = ys.mean() if fitted is None else fitted
    return float(np.std(signal))


def v_2d(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, n_knots: int = 4, degree: int = 3, threshold: int = 15) -> float | None:
    """V of two continuous features; an axis of under two inner knots serves as groups."""
    k1, k2 = interior_knots(x1, n_knots), interior_knots(x2, n_knots)
    fine1, fine2 = len(k1) >= 2, len(k2) >= 2
    if not fine1 and not fine2:
        return float(np.std(group_means(y, x1, x2)))
    if not (fine1 and fine2):
        return v_stacked(x2, x1, y, n_knots, degree, threshold) if fine2 else v_stacked(x1, x2, y, n_knots, degree, threshold)
    fitted = fit_2d(x1, x2, y, k1, k2, degree_for(k1, degree), degree_for(k2, degree))
    if not np.isfinite(fitted).all():
        return None
    along = [np.lexsort((y, x2, x1)), np.lexsort((y, x1, x2))]
    if not within_energy(sum(variation(y[o]) for o in along), sum(variation(fitted[o]) for o in along)):
        return float(np.std(group_means(y, x1, x2)))
    return float(np.std(fitted))


def is_discrete(x: np.ndarray, nominal: bool, threshold: int) -> bool:
    return nominal or len(np.unique(x[~np.isnan(x)])) <= threshold


def v_effect(x1: np.ndarray, x2: np.ndarray | None, y: np.ndarray, nominal1: bool, nominal2: bool, n_knots: int = 4, degree: int = 3, threshold: int = 15) -> float | None:
    """V of an effect by the natures of its features in this very sample; NaN marks a missing value."""
    shape = {"n_knots": n_knots, "degree": degree, "threshold": threshold}
    if x2 is None:
        gone = np.isnan(x1)
        if is_discrete(x1, nominal1, threshold):
            return float(np.std(group_means(y, np.where(gone, -1e308, x1))))
        if gone.any():
            return v_stacked(np.where(gone, 0.0, x1), gone, y, **shape)
        return v_1d(x1, y, **shape)
    both = ~np.isnan(x1) & ~np.isnan(x2)
    x1, x2, y = x1[both], x2[both], y[both]
    if len(y) < 3:
        return 0.0
    d1, d2 = is_discrete(x1, nominal1, threshold), is_discrete(x2, nominal2, threshold)
    if d1 and d2:
        return float(np.std(group_means(y, x1, x2)))
    if d1 or d2:
        return v_stacked(x2, x1, y, **shape) if d1 else v_stacked(x1, x2, y, **shape)
    return v_2d(x1, x2, y, **shape)


def support_of_counts(counts: np.ndarray, knots: int, degree: int) -> bool:
    """``has_support`` from row counts: at the lowest value, between it and the first knot, at that knot, and so on up to the highest value."""
    places = np.r_[[0] * (degree + 1), 2 * np.arange(1, knots + 1), [2 * knots + 2] * (degree + 1)]
    left, at, m = counts.copy(), 0, len(places) - degree - 1
    for j in range(m):
        low, high = places[j], places[j + degree + 1]
        edge = j in (0, m - 1)
        while at < len(left) and (left[at] <= 0 or not (low < at < high or (edge and low <= at <= high))):
            at += 1
        if at == len(left):
            return False
        left[at] -= 1
    return True


def parts_of(key: list[str], pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    yield from pdf.groupby(key, sort=False)


def curve(pdf: pd.DataFrame, x: np.ndarray, axis: str = "") -> np.ndarray:
    """Basis functions at x, of the knots that all rows of pdf have."""
    first = pdf.iloc[0]
    return basis(x, np.asarray(first[f"knots{axis}"], float), int(first[f"degree{axis}"]), float(first[f"low{axis}"]), float(first[f"high{axis}"]))[0]


def design(pdf: pd.DataFrame, axes: list[str], prefix: str = "") -> np.ndarray:
    """(rows, coefficients): the basis, or the products of both axes' bases."""
    out = None
    for axis in axes:
        b = curve(pdf, pdf[f"{prefix}x{axis}"].to_numpy(float), axis)
        out = b if out is None else (out[:, :, None] * b[:, None, :]).reshape(len(pdf), -1)
    return out


def grams(cells: DataFrame, key: list[str], axes: list[str]) -> DataFrame:
    """(key, i, j, value): sums over rows of the products of two basis functions (i <= j), with y (j = -1), and, along one axis, row counts by place (i = -2).

    Each batch adds up what it holds of a group; Spark adds up batches and tasks.
    """
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", i int, j int, value double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for of, part in parts_of(key, pdf):
                b, n = design(part, axes), part["n"].to_numpy(float)
                gram = (b * n[:, None]).T @ b
                i, j = np.nonzero(np.triu(gram))
                y = b.T @ part["s"].to_numpy(float)
                rows = [(i, j, gram[i, j]), (np.arange(len(y)), np.full(len(y), -1), y)]
                if len(axes) == 1:
                    first, x = part.iloc[0], part["x"].to_numpy(float)
                    t = np.r_[float(first["low"]), np.asarray(first["knots"], float), float(first["high"])]
                    place = np.clip(np.searchsorted(t, x, "left") + np.searchsorted(t, x, "right") - 1, 0, 2 * len(t) - 2)
                    count = np.bincount(place, n)
                    rows.append((np.full(len(count), -2), np.arange(len(count)), count))
                i, j, value = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pd.DataFrame(dict(zip(key, of, strict=True)) | {"i": i, "j": j, "value": value})

    return cells.mapInPandas(run, schema).groupBy(*key, "i", "j").agg(F.sum("value").alias("value"))


def solved(sums: DataFrame, key: list[str], heads: DataFrame, axes: list[str]) -> DataFrame:
    """(key, coefficients, ss): of each fit the coefficients for y less its mean, and the sum of squares of the fitted values; null where the data don't determine a curve.

    heads has a row per fit with its knots; a group here has as many rows as its Gram matrix has numbers.
    """
    kinds = dict(heads.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", coefficients array<double>, ss double"
    sized = heads.select(*key, "mean", *[f"degree{a}" for a in axes], *[F.size(f"knots{a}").alias(f"size{a}") for a in axes])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m = int(np.prod([int(first[f"size{a}"]) + int(first[f"degree{a}"]) + 1 for a in axes]))
        gram, y = np.zeros((m, m)), np.zeros(m)
        i, j, value = (pdf[c].to_numpy() for c in ("i", "j", "value"))
        pairs, moments = (i >= 0) & (j >= 0), j == -1
        gram[i[pairs], j[pairs]] = value[pairs]
        gram[j[pairs], i[pairs]] = value[pairs]
        y[i[moments]] = value[moments]
        out = {c: first[c] for c in key}
        if len(axes) == 1:
            knots, degree = int(first["size"]), int(first["degree"])
            counts = np.zeros(2 * knots + 3)
            counts[j[i == -2]] = value[i == -2]
            if knots and not support_of_counts(counts, knots, degree):
                return pd.DataFrame([out | {"coefficients": None, "ss": None}])
        y -= first["mean"] * gram.sum(1)  # basis functions add up to one
        scale = np.sqrt(np.maximum(np.diag(gram), 0))
        scale[scale == 0] = 1
        c = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (y / scale) / scale
        fine = bool(np.isfinite(c).all())
        return pd.DataFrame([out | {"coefficients": c.tolist() if fine else None, "ss": float(max(c @ gram @ c, 0)) if fine else None}])

    return sums.join(sized, key).groupBy(*key).applyInPandas(one, schema)


def variations(scanned: DataFrame, key: list[str], heads: DataFrame, axes: list[str]) -> DataFrame:
    """(key, raw, fitted): total variation of the data, and of the curve, from each cell to the next."""
    kinds = dict(scanned.dtypes)
    names = [f"x{a}" for a in axes]
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", raw double, fitted double"
    met = scanned.join(heads.filter("coefficients IS NOT NULL").select(*key, "coefficients", *[f"{c}{a}" for c in ("knots", "degree", "low", "high") for a in axes]), key)
    steps = met.select(*key, *names, *[F.coalesce(F.col("_prev")[c], F.col(c)).alias(f"_{c}") for c in names], (F.col("hi") - F.col("lo") + F.coalesce(F.abs(F.col("lo") - F.col("_prev")["hi"]), F.lit(0.0))).alias("raw"), "coefficients", *[f"{c}{a}" for c in ("knots", "degree", "low", "high") for a in axes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for of, part in parts_of(key, pdf):
                c = np.asarray(part["coefficients"].iloc[0], float)
                step = np.abs(design(part, axes) @ c - design(part, axes, "_") @ c).sum()
                yield pd.DataFrame([dict(zip(key, of, strict=True)) | {"raw": part["raw"].sum(), "fitted": float(step)}])

    return steps.mapInPandas(run, schema).groupBy(*key).agg(F.sum("raw").alias("raw"), F.sum("fitted").alias("fitted"))


def smooth_enough(raw: Column, fitted: Column) -> Column:
    return F.when(raw == 0, fitted < 1e-9).otherwise(fitted <= ENERGY * raw)


def knotted(cells: DataFrame, key: list[str], x: str, n_knots: int, degree: int, axis: str = "", rows: int = ROWS) -> DataFrame:
    """(key, n, mean, distinct, low, high, knots, degree) of cells (key, x, n, s), one for each x."""
    whole = cells.groupBy(*key).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.count("*").alias(f"distinct{axis}"), F.min(x).alias(f"low{axis}"), F.max(x).alias(f"high{axis}"))
    ordered = scan(cells.join(whole.select(*key, "_n"), key), key, [x], "n", rows=rows)
    found = quantiles(ordered, key, x, "n", "_n", [i / (n_knots + 1) for i in range(1, n_knots + 1)], "_q")
    inner = F.array_distinct(F.array_sort(F.filter("_q", lambda q: (q > F.col(f"low{axis}")) & (q < F.col(f"high{axis}")))))
    out = whole.join(found, key).withColumn(f"knots{axis}", inner)
    kept = [f"distinct{axis}", f"low{axis}", f"high{axis}", f"knots{axis}"]
    return out.select(*key, F.col("_n").alias("n"), (F.col("_s") / F.col("_n")).alias("mean"), *kept, F.when(F.size(f"knots{axis}") < LINEAR_BELOW, 1).otherwise(degree).alias(f"degree{axis}"))


def of_levels(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, v): the spread of the cells' means, each row counting with its cell's."""
    n, total = F.sum("n"), F.sum("s")
    return cells.groupBy(*key).agg(F.sqrt(F.greatest(F.sum(F.col("s") * F.col("s") / F.col("n")) / n - F.pow(total / n, 2), F.lit(0.0))).alias("v"))


def of_curves(cells: DataFrame, n_knots: int, degree: int, threshold: int, rows: int) -> DataFrame:
    """(_by, v) of cells (_by, g, alone, x, n, s, lo, hi): a curve along x in each level g, the level's mean where there is none; an effect that is alone falls back to the means by x."""
    key = ["_by", "g"]
    cells = stored(cells, "curve-cells")
    heads = stored(knotted(cells, key, "x", n_knots, degree, rows=rows), "curves")
    drawn = heads.filter((F.col("n") > threshold) & (F.col("low") < F.col("high")))
    ordered = stored(scan(cells.join(drawn.select(*key), key, "left_semi"), key, ["x"], "n", ["hi"], rows), "ordered-cells")
    fits = solved(grams(ordered.drop("_prev").join(drawn.select(*key, "knots", "degree", "low", "high"), key), key, [""]), key, drawn, [""])
    fits = stored(drawn.join(fits, key), "fits")
    steps = variations(ordered, key, fits, [""])
    met = heads.join(fits.select(*key, "coefficients", "ss"), key, "left").join(steps, key, "left")
    tried = (F.col("n") > threshold) & (F.col("low") < F.col("high"))
    calm = (F.size("knots") == 0) | smooth_enough(F.col("raw"), F.col("fitted"))
    ss = F.when(F.col("coefficients").isNotNull() & calm, F.col("ss"))
    each = met.select(*key, "n", "mean", ss.alias("ss"), (tried & F.col("coefficients").isNull()).alias("failed"), (~tried & (F.col("n") > threshold)).alias("flat"))
    by_level = each.groupBy("_by").agg(
        F.sum("n").alias("n"),
        F.sum(F.coalesce("ss", F.lit(0.0))).alias("ss"),
        F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"),
        F.max("failed").alias("failed"),
        F.max("flat").alias("flat"),
        F.max(F.col("ss").isNull()).alias("fell_back"),
    )
    between = F.greatest(F.col("square") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    alone = cells.groupBy("_by").agg(F.max("alone").alias("alone"))
    means = of_levels(cells.filter("alone"), ["_by"]).withColumnRenamed("v", "by_x")
    v = F.sqrt((F.col("ss") + between) / F.col("n"))
    own = F.when(F.col("failed"), None).when(F.col("flat"), F.lit(0.0)).when(F.col("fell_back"), F.col("by_x")).otherwise(F.sqrt(F.col("ss") / F.col("n")))
    return by_level.join(alone, "_by").join(means, "_by", "left").select("_by", F.when(F.col("alone"), own).otherwise(v).alias("v"))


def of_surfaces(cells: DataFrame, heads: DataFrame, rows: int) -> DataFrame:
    """(_by, v) of cells (_by, x1, x2, n, s, lo, hi) by tensor splines with the knots of heads."""
    key, axes = ["_by"], ["1", "2"]
    cells = stored(cells, "surface-cells")
    shape = [f"{c}{a}" for c in ("knots", "degree", "low", "high") for a in axes]
    fits = solved(grams(cells.join(heads.select(*key, *shape), key), key, axes), key, heads, axes)
    fits = stored(heads.join(fits, key), "surface-fits")
    along = [variations(scan(cells, key, order, "n", ["hi"], rows), key, fits, axes) for order in (["x1", "x2"], ["x2", "x1"])]
    steps = along[0].unionByName(along[1]).groupBy(*key).agg(F.sum("raw").alias("raw"), F.sum("fitted").alias("fitted"))
    met = fits.join(steps, key, "left").join(of_levels(cells, key).withColumnRenamed("v", "by_cell"), key)
    v = F.when(F.col("coefficients").isNull(), None).when(smooth_enough(F.col("raw"), F.col("fitted")), F.sqrt(F.col("ss") / F.col("n"))).otherwise(F.col("by_cell"))
    return met.select("_by", v.alias("v"))


def variability_by(df: DataFrame, by: list[str], n_knots: int = 4, degree: int = 3, threshold: int = 15, range_rows: int = ROWS) -> DataFrame:
    """(by, m, v, gii) of rows (by, x1, x2, nominal1, nominal2, paired, phi, times); a group may have any number of rows.

    For effects that the two-step aggregation in `effects.variability` can't express.  As ``v_effect`` does, each group goes by the natures of its
    features in its own rows; x that are null or NaN are missing.  v is null where no curve can be fitted.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    t, phi = F.col("times"), F.col("phi")
    rows = df.withColumns({"x1": known("x1"), "x2": known("x2")})
    sums = [F.sum(t).alias("n"), F.sum(phi * t).alias("s"), F.sum(F.abs(phi) * t).alias("a"), F.min("phi").alias("lo"), F.max("phi").alias("hi")]
    flags = [F.first(c).alias(c) for c in ("nominal1", "nominal2", "paired")]
    cells = stored(rows.groupBy(*by, "x1", "x2").agg(*sums, *flags), "cells")
    ids = stored(cells.groupBy(*by).agg(F.sum("n").alias("rows"), (F.sum("a") / F.sum("n")).alias("m"), *flags).withColumn("_by", F.monotonically_increasing_id()), "groups")
    named = ids.select(F.col("_by"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    cells = stored(cells.join(named, same).select("_by", "x1", "x2", "n", "s", "lo", "hi", "paired"), "numbered-cells")
    used = cells.filter("NOT paired OR (x1 IS NOT NULL AND x2 IS NOT NULL)")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("axis"), F.col("x1").alias("x")), F.struct(F.lit(2).alias("axis"), F.col("x2").alias("x")))).alias("e")
    axes = used.select("_by", "n", "s", sides).filter("e.x IS NOT NULL").groupBy("_by", "e.axis", "e.x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    counted = axes.groupBy("_by").agg(F.count_if(F.col("axis") == 1).alias("distinct1"), F.count_if(F.col("axis") == 2).alias("distinct2"), F.sum(F.when(F.col("axis") == 1, F.col("n"))).alias("there"))
    few = lambda k: F.col(f"nominal{k}") | (F.coalesce(f"distinct{k}", F.lit(0)) <= threshold)
    shape = stored(ids.join(counted, "_by", "left").select("_by", "paired", "rows", F.coalesce("there", F.lit(0)).alias("there"), few(1).alias("d1"), few(2).alias("d2")), "shapes")
    wide = shape.filter("paired AND there >= 3 AND NOT d1 AND NOT d2").select("_by")
    knots = axes.join(wide, "_by", "left_semi")
    one, two = (stored(knotted(knots.filter(F.col("axis") == k).withColumnRenamed("x", f"x{k}").drop("axis"), ["_by"], f"x{k}", n_knots, degree, str(k), range_rows), "axis-knots") for k in (1, 2))
    heads = one.join(two.drop("n", "mean"), "_by")
    fine = shape.join(heads.select("_by", (F.size("knots1") >= 2).alias("fine1"), (F.size("knots2") >= 2).alias("fine2")), "_by", "left")
    way = (
        F.when(F.col("paired") & (F.col("there") < 3), "none")
        .when(~F.col("paired"), F.when(F.col("d1"), "levels").when(F.col("there") < F.col("rows"), "gone").otherwise("alone"))
        .when(F.col("d1") & F.col("d2"), "levels")
        .when(F.col("d1"), "along2")
        .when(F.col("d2"), "along1")
        .when(F.col("fine1") & F.col("fine2"), "surface")
        .when(F.col("fine1"), "along1")
        .when(F.col("fine2"), "along2")
        .otherwise("levels")
    )
    ways = stored(fine.select("_by", way.alias("way")), "ways")
    routed = used.join(ways, "_by")
    go = F.col("way")
    curves = routed.filter(go.isin("alone", "gone", "along1", "along2")).select(
        "_by",
        F.when(go == "along1", F.col("x2")).when(go == "along2", F.col("x1")).otherwise(F.col("x1").isNull().cast("double")).alias("g"),
        (go == "alone").alias("alone"),
        F.when(go == "along2", F.col("x2")).otherwise(F.coalesce("x1", F.lit(0.0))).alias("x"),
        *["n", "s", "lo", "hi"],
    )
    there = {r.way for r in ways.select("way").distinct().collect()}  # at most seven
    found = of_levels(routed.filter(go == "levels"), ["_by"])
    if there & {"alone", "gone", "along1", "along2"}:
        found = found.unionByName(of_curves(curves, n_knots, degree, threshold, range_rows))
    if "surface" in there:
        found = found.unionByName(of_surfaces(routed.filter(go == "surface").drop("way", "paired"), heads.join(ways.filter(go == "surface"), "_by", "left_semi"), range_rows))
    met = ids.join(ways, "_by").join(found, "_by", "left")
    v = F.when(F.col("way") == "none", F.lit(0.0)).otherwise(F.col("v"))
    return met.select(*by, "m", v.alias("v"), F.sqrt(F.col("m") * v).alias("gii"))


def trend(df: DataFrame, by: list[str], x: str, y: str, points: int = 100, n_knots: int = 4, degree: int = 3) -> DataFrame:
    """(by, x, fit) of the spline through each group's points, on an even grid: for display."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", x double, fit double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=[x, y]).sort_values(x, kind="stable")
        xs, ys = known[x].to_numpy(float), known[y].to_numpy(float)
        if not len(xs):
            return pd.DataFrame({c: [] for c in [*by, "x", "fit"]})
        grid = np.linspace(xs[0], xs[-1], points)
        knots = interior_knots(xs, n_knots)
        k = degree_for(knots, degree)
        if xs[0] == xs[-1]:
            fitted = np.full(points, ys.mean())
        else:
            b, _ = basis(xs, knots, k, xs[0], xs[-1])
            fitted = basis(grid, knots, k, xs[0], xs[-1])[0] @ np.linalg.lstsq(b, ys, rcond=None)[0]
        return pd.DataFrame({c: [pdf[c].iloc[0]] * points for c in by} | {"x": grid, "fit": fitted})

    return df.groupBy(*by).applyInPandas(one, schema)
