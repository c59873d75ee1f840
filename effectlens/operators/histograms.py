"""Boosted trees of tables that no worker could hold: split search as an aggregation.

``fit_by_histograms`` grows the trees that ``boosting.fit`` grows, of all folds side by side, without ever gathering
a fold's rows.  The state is a table with a row per row and fit: the features' bins, the outcomes, and the raw
score so far.  For each level of a tree one pass sums gradients by (fit, feature, node, bin); each task sums its own
rows first, Spark adds up the tasks' sums, and the gains of all candidates follow from the sums of a feature, whose
number depends on depth and bins and not on rows.  The driver gets one number per candidate, chooses a split per fit, and
sends it out with the next pass; a row's node follows from the splits so far, and nothing is written for it.
Where bins leave few different rows, squared losses are summed over rows of the same bins first (``merged``).
After every ``rewrite`` trees raw scores are written anew, so that a pass adds up at most as many trees.

Cuts lie midway between the values of a feature, where the values of the fit's rows are few, else at quantiles:
exact ones up to ``FEW`` distinct values, beyond that of a sketch with a rank error of 1 / ``ACCURACY``.  Bagging
weights come from a hash of (seed, tree, row).  Medians that start a fit come from such a sketch too.  All else equals ``boosting.fit``,
up to the order in which sums are taken.

A model holds the encodings of its nominal features and passes through the driver, so its size is that of levels,
trees and leaves.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.operators import boosting as B
from effectlens.operators import metrics as M
from effectlens.sources.scratch import stored

FEW = 1_000
ACCURACY = 10_000
REWRITE = 16
DENSE_CELLS = 4_000_000  # sums that a task keeps at once; beyond, it hands them on batch by batch
#: n rows alike count as one: y is their mean, and q the sum of squares about it.
STATE = "fit int, outside boolean, at long, bins binary, y binary, f binary, n long, q double"


@dataclass
class Grown:
    """A tree by bins: splits as (feature, place among its cuts)."""

    splits: list[tuple[int, int]]
    values: np.ndarray


@dataclass
class Fit:
    number: int
    params: B.Params
    model: B.Model | None
    single: set[int]
    cuts: list[np.ndarray]  # of each feature: thresholds in order, or the codes that are split one by one
    rng: np.random.Generator
    trees: list[Grown] = field(default_factory=list)
    count: int = 0  # trees so far, where only the last are at hand
    now: list[tuple[int, int]] = field(default_factory=list)
    best: tuple[float, int] | None = None
    floor: float = 0.0
    growing: bool = True
    live: bool = True

    def candidates(self) -> list[tuple[int, int, float, bool]]:
        """(feature, place, threshold, whether by equality), in the order in which ``boosting`` looks at them."""
        out, lowest = [], -np.finfo(float).max
        for f, cuts in enumerate(self.cuts):
            if f in self.single:
                out += [(f, i, float(v), True) for i, v in enumerate(cuts) if i or len(cuts) > 2]
            else:
                out += sorted(((f, i, float(v), False) for i, v in enumerate(cuts)), key=lambda c: (c[2] == lowest, c[1]))
        return out

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint16)
        for f, cuts in enumerate(self.cuts):
            at = np.searchsorted(cuts, np.nan_to_num(x[:, f], nan=-np.inf), "left")
            if f in self.single:
                known = np.r_[cuts, np.inf][at] == x[:, f]
                at = np.where(known, at + 1, 0)
            out[:, f] = at
        return out

    def node(self, bins: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(len(bins), np.int64)
        for f, i in splits:
            out = out * 2 + (bins[:, f] == i + 1 if f in self.single else bins[:, f] > i)
        return out

    def added(self, bins: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Raw scores f with those of the trees at hand."""
        for t in self.trees:
            f = f + self.params.learning_rate * t.values[self.node(bins, t.splits)]
        return f


def sent(state: DataFrame, fits: list[Fit], first: int):
    """Fits broadcast by number, with only their trees from the first one on that the state doesn't have, and what has grown of the next."""
    return state.sparkSession.sparkContext.broadcast({f.number: replace(f, model=None, trees=f.trees[first:], count=len(f.trees)) for f in fits})


def uniform(at: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Numbers in (0, 1) that a row, a seed and a tree decide."""
    mask = (1 << 64) - 1
    z = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + tree * 0x8CB92BA72F3D8DD7) & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def weighted_quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantiles with linear interpolation of values that stand ``counts`` times."""
    ends = np.cumsum(counts)
    place = q * (ends[-1] - 1)
    low = np.floor(place).astype(np.int64)
    a, b = (values[np.searchsorted(ends, np.minimum(i, ends[-1] - 1), "right")] for i in (low, low + 1))
    return a + (b - a) * (place - low)


def cuts_of(values: np.ndarray, counts: np.ndarray, border_count: int) -> np.ndarray:
    middles = (values[1:] + values[:-1]) / 2
    return np.unique(weighted_quantiles(values, counts, np.linspace(0, 1, border_count + 2)[1:-1])) if len(middles) > border_count else middles


def with_missing(cuts: np.ndarray, missing: bool) -> np.ndarray:
    return np.r_[-np.finfo(float).max, cuts] if missing else cuts


def starts(rows: DataFrame, fold: str, folds: list[int], targets: list[str], params: dict[int, B.Params]) -> dict[int, np.ndarray]:
    """Of each fit the raw score that its trees are added to."""
    any_loss = next(iter(params.values())).loss
    if any_loss in ("MAE", "Huber", "Quantile"):
        at = {k: params[k].delta if any_loss == "Quantile" else 0.5 for k in folds}
        cells = [F.percentile_approx(F.when(F.col(fold) != k, F.col(t)), at[k], ACCURACY * 10).alias(f"{k}_{j}") for k in folds for j, t in enumerate(targets)]
        row = rows.agg(*cells).first()
        return {k: np.array([float(row[f"{k}_{j}"]) for j in range(len(targets))]) for k in folds}
    sums = {int(r[0]): np.array(r[1:], float) for r in rows.groupBy(fold).agg(F.count("*"), *[F.sum(t) for t in targets]).collect()}
    whole = sum(sums.values())
    mean = {k: (whole - sums.get(k, 0))[1:] / (whole - sums.get(k, 0))[0] for k in folds}
    if any_loss in ("RMSE", "MultiRMSE"):
        return mean
    p = {k: np.clip(m, 1e-6, 1 - 1e-6) for k, m in mean.items()}
    return {k: np.log(x) if any_loss == "MultiClass" else np.log(x / (1 - x)) for k, x in p.items()}


def prepared(rows: DataFrame, fold: str, names: list[str], categorical: list[str], targets: list[str], params: dict[int, B.Params]) -> list[Fit]:
    """A fit for each fold, with its encodings and cuts, from counts by fold: a fit's are all folds' less its own."""
    folds = sorted(params)
    base = starts(rows, fold, folds, targets, params)
    numeric = [c for c in names if c not in categorical]
    number = {c: F.col(c).cast("double") for c in numeric}
    missing = {c: F.isnan(x) | x.isNull() for c, x in number.items()}
    seen = [x for c in numeric for x in (F.approx_count_distinct(number[c]).alias(f"n_{c}"), *(F.coalesce(F.max((F.col(fold) != k) & missing[c]), F.lit(False)).alias(f"m_{c}_{k}") for k in folds))]
    about = rows.agg(*seen).first() if seen else None
    few = [c for c in numeric if about[f"n_{c}"] <= FEW]
    counted: dict[str, pd.DataFrame] = {}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), number[c].alias("v")) for c in few])).alias("x")
        got = rows.select(fold, pairs).filter("NOT isnan(x.v) AND x.v IS NOT NULL").groupBy(fold, "x.c", "x.v").count().toPandas()  # FEW values a feature
        counted = dict(iter(got.rename(columns={fold: "fold"}).groupby("c")))
    levels: dict[str, pd.DataFrame] = {}
    for c in categorical:  # a model holds its levels
        level = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        levels[c] = rows.groupBy(F.col(fold).alias("fold"), level.alias("v")).agg(F.count("*").alias("count"), F.sum(targets[0]).alias("sum")).toPandas()
    many = [c for c in numeric if c not in few]
    sketches = {}
    if many:
        spread = lambda k: np.linspace(0, 1, params[k].border_count + 2)[1:-1].tolist()
        cells = [F.percentile_approx(F.when((F.col(fold) != k) & ~missing[c], number[c]), spread(k), ACCURACY).alias(f"{c}|{k}") for c in many for k in folds]
        sketches = rows.agg(*cells).first().asDict()
    out = []
    for k in folds:
        p = params[k]
        encodings, single, cuts = {}, set(), []
        for f, c in enumerate(names):
            if c in categorical:
                mine = levels[c][levels[c]["fold"] != k].groupby("v")[["sum", "count"]].sum().sort_index()
                if len(mine) <= p.one_hot_max_size:
                    encodings[c] = {v: float(i) for i, v in enumerate(mine.index)}
                    single.add(f)
                    cuts.append(np.arange(len(mine), dtype=float))
                else:
                    mean = mine["sum"].sum() / mine["count"].sum()
                    code = (mine["sum"] + mean) / (mine["count"] + 1)
                    encodings[c] = code.to_dict()
                    values, at = np.unique(code.to_numpy(float), return_inverse=True)
                    cuts.append(cuts_of(values, np.bincount(at, mine["count"]), p.border_count))
                continue
            if c in few:
                mine = counted.get(c)
                mine = mine[mine["fold"] != k].groupby("v")["count"].sum().sort_index() if mine is not None else pd.Series(dtype=float)
                own = cuts_of(mine.index.to_numpy(float), mine.to_numpy(), p.border_count) if len(mine) else np.empty(0)
            else:
                own = np.unique(np.array(sketches[f"{c}|{k}"] or [], float))
            cuts.append(with_missing(own, bool(about[f"m_{c}_{k}"]) and (c in many or len(mine) > 0)))
        model = B.Model(names, base[k].tolist(), p.learning_rate, p.loss, encodings=encodings)
        out.append(Fit(k, p, model, single, cuts, np.random.default_rng(p.seed)))
    return out


def state_of(rows: DataFrame, fold: str, names: list[str], categorical: list[str], targets: list[str], fits: list[Fit]) -> DataFrame:
    """The state before the first tree: every row once for each fit, also for the one that leaves it out."""
    listed = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shown = pdf.assign(**{c: pdf[c].astype(str) for c in categorical})
            y = [r.tobytes() for r in pdf[targets].to_numpy(float)]
            for fit in listed.value:
                bins = fit.bins(fit.model.matrix(shown))
                base = np.array(fit.model.base).tobytes()
                yield pd.DataFrame({"fit": fit.number, "outside": (pdf[fold] == fit.number).to_numpy(), "at": pdf["_at"].to_numpy(), "bins": [r.tobytes() for r in bins], "y": y, "f": base, "n": 1, "q": 0.0})

    used = rows.select(fold, *names, *targets, F.monotonically_increasing_id().alias("_at"))
    return stored(used.mapInPandas(run, STATE), "boosting-state")


def merged(state: DataFrame, fits: list[Fit], n_targets: int) -> DataFrame:
    """The state with a fit's rows of the same bins as one, where bins leave few different rows; else as it is.

    Squared losses need only their number, mean and squares.  Weights by row and absolute gradients, which other settings ask for, need the rows.
    """
    plain = all(f.params.loss in ("RMSE", "MultiRMSE") and not f.params.bagging_temperature and not f.params.random_strength for f in fits)
    if not plain or 4 * sum(math.prod(len(c) + 1 for c in f.cuts) for f in fits) > state.count():
        return state
    ys = [f"y{j}" for j in range(n_targets)]
    names = ["fit", "outside", "bins", "f"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1, 3, 5)] + [pa.array(c) for c in matrix(batch.column(4), np.float64, n_targets).T], [*names, *ys])

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(at=0, y=[r.tobytes() for r in pdf[ys].to_numpy(float)])[["fit", "outside", "at", "bins", "y", "f", "n", "q"]]

    sums = state.mapInArrow(opened, "fit int, outside boolean, bins binary, f binary, " + ", ".join(f"{y} double" for y in ys)).groupBy(*names)
    squares = sum((F.var_pop(y) for y in ys), F.lit(0.0)) * F.count("*")
    alike = sums.agg(F.count("*").alias("n"), squares.alias("q"), *[F.avg(y).alias(y) for y in ys])
    return stored(alike.mapInPandas(closed, STATE), "boosting-state")


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def parts(batch: pa.RecordBatch, fits: dict[int, Fit], n_targets: int) -> Iterator[tuple[Fit, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fit, outside, at, bins, y, raw score, n, q) of a batch's rows, fit by fit."""
    number = batch.column(0).to_numpy()
    for k in np.unique(number).tolist():
        if k not in fits:
            continue
        own = batch.filter(pa.array(number == k))
        fit = fits[k]
        bins = matrix(own.column(3), np.uint16, len(fit.cuts))
        y, f = (matrix(own.column(c), np.float64, n_targets) for c in (4, 5))
        yield fit, own.column(1).to_numpy(zero_copy_only=False), own.column(2).to_numpy(), bins, y, fit.added(bins, f), own.column(6).to_numpy(), own.column(7).to_numpy()


def derivatives(fit: Fit, at: np.ndarray, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradients, weighted gradients, weighted second derivatives)."""
    p = fit.params
    g, h = B.gradients(p.loss, y, f, p.delta)
    if not p.bagging_temperature:
        return g, g, h
    w = ((-np.log(uniform(at, p.seed, fit.count))) ** p.bagging_temperature)[:, None]
    return g, g * w, h * w


#: Features under which sums of other kinds travel: absolute gradients, losses of rows outside, leaves.
ABSOLUTE, LOSS, LEAF = -1, -2, -3


def summed(state: DataFrame, fits: list[Fit], n_targets: int, first: int, leaves: bool, losses: bool) -> DataFrame:
    """(fit, feature, node, bin, n, s0, s1...): row counts, then sums of gradients and of second derivatives by output; with ``leaves`` by node alone."""
    known = sent(state, fits, first)
    keys = ["fit", "feature", "node", "bin"]
    sums = [f"s{j}" for j in range(2 * n_targets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = known.value
        kept: dict[tuple[int, int], np.ndarray] = {}

        def width(fit: Fit, feature: int) -> int:
            return 1 if feature < 0 else len(fit.cuts[feature]) + 1

        cells = sum((1 << len(f.now)) * (1 if leaves else sum(len(c) + 1 for c in f.cuts)) for f in fits.values()) * (1 + 2 * n_targets)

        def out(number: int, feature: int, places: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            wide = width(fits[number], feature)
            ints = [np.full(len(places), number, np.int32), np.full(len(places), feature, np.int32), (places // wide).astype(np.int32), (places % wide).astype(np.int32), values[:, 0].astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in [*ints, *values[:, 1:].T]], [*keys, "n", *sums])

        def add(fit: Fit, feature: int, place: np.ndarray, size: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if cells <= DENSE_CELLS:
                table = np.stack([np.bincount(place, c, size) for c in columns], 1)
                key = (fit.number, feature)
                kept[key] = kept[key] + table if key in kept else table
            else:
                there, at = np.unique(place, return_inverse=True)
                yield out(fit.number, feature, there, np.stack([np.bincount(at, c, len(there)) for c in columns], 1))

        for batch in batches:
            for fit, outside, at, bins, y, f, n, q in parts(batch, fits, n_targets):
                blank = np.zeros(len(y))
                if losses and outside.any():
                    yo, fo, no = y[outside], f[outside], n[outside]
                    squared = fit.params.loss in ("RMSE", "MultiRMSE")
                    total = (no * ((yo - fo) ** 2).sum(1) + q[outside]).sum() if squared else B.loss_value(fit.params.loss, yo, fo, fit.params.delta) * len(yo)
                    row = np.r_[no.sum(), total, np.zeros(2 * n_targets - 1)]
                    yield out(fit.number, LOSS, np.zeros(1, np.int64), row[None])
                if not fit.growing or outside.all():
                    continue
                mine = ~outside
                bins, g, gw, hw = bins[mine], *derivatives(fit, at[mine], y[mine], f[mine])
                node, many = fit.node(bins, fit.now), n[mine].astype(float)
                columns = [many, *(gw * many[:, None]).T, *(hw * many[:, None]).T]
                nodes = 1 << len(fit.now)
                if leaves:
                    yield from add(fit, LEAF, node, nodes, columns)
                    continue
                if fit.params.random_strength:
                    yield from add(fit, ABSOLUTE, np.zeros(len(bins), np.int64), 1, [many, *np.abs(g).T, *([blank[mine]] * n_targets)])
                for c in range(len(fit.cuts)):
                    wide = len(fit.cuts[c]) + 1
                    yield from add(fit, c, node * wide + bins[:, c], nodes * wide, columns)
        for (number, feature), table in kept.items():
            there = np.flatnonzero(table[:, 0])
            yield out(number, feature, there, table[there])

    schema = "fit int, feature int, node int, bin int, n long, " + ", ".join(f"{s} double" for s in sums)
    return state.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])


def gains(sums: DataFrame, fits: list[Fit], n_targets: int) -> DataFrame:
    """(fit, feature, place, gain) of all candidates, minus infinity where a leaf would be too small; place -1 has the score without a split.

    A group has at most nodes x bins rows.  Other sums pass through, with their mean.
    """
    shapes = {f.number: ([len(c) for c in f.cuts], f.single, 1 << len(f.now), f.params.l2_leaf_reg, f.params.min_data_in_leaf) for f in fits}
    columns = ["n", *[f"s{j}" for j in range(2 * n_targets)]]

    def of_feature(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, feature = map(int, key)
        if feature < 0:
            total = pdf[columns].to_numpy().sum(0)
            mean = total[1 : 1 + n_targets].sum() / total[0] / (n_targets if feature == ABSOLUTE else 1)
            return pd.DataFrame({"fit": [k], "feature": [feature], "place": [0], "gain": [mean]})
        lengths, single, nodes, l2, least = shapes[k]
        table = np.zeros((nodes, lengths[feature] + 1, len(columns)))
        table[pdf["node"], pdf["bin"]] = pdf[columns].to_numpy(float)
        whole = table.sum(1)
        # Above a cut lie the bins after its own; a code that is split off has a bin of its own.
        on = table[:, 1:] if feature in single else whole[:, None] - np.cumsum(table, 1)[:, :-1]
        off = whole[:, None] - on
        score = lambda t: (t[..., 1 : 1 + n_targets] ** 2 / (t[..., 1 + n_targets :] + l2)).sum(-1)
        gain = (score(on) + score(off)).sum(0)
        small = np.minimum(np.rint(on[..., 0]), np.rint(off[..., 0]))
        smallest = np.where(small > 0, small, np.inf).min(0)
        gain = np.where(np.isfinite(smallest) & (smallest >= least), gain, -np.inf)
        return pd.DataFrame({"fit": k, "feature": feature, "place": np.r_[-1, np.arange(len(gain))], "gain": np.r_[score(whole).sum(), gain]})

    return sums.groupBy("fit", "feature").applyInPandas(of_feature, "fit int, feature int, place int, gain double")


def chosen(fit: Fit, found: pd.DataFrame) -> tuple[int, int] | None:
    """The split of a level, as ``boosting.grow`` chooses it; None if none lowers the loss."""
    p, candidates = fit.params, fit.candidates()
    if not candidates:
        return None
    known = {(r.feature, r.place): r.gain for r in found.itertuples()}
    if not fit.now:
        fit.floor = next(v for (f, i), v in known.items() if f >= 0 and i == -1)
    value = np.array([known.get((f, i), -np.inf) for f, i, _, _ in candidates])
    if p.colsample_bylevel < 1:
        value[fit.rng.random(len(value)) >= p.colsample_bylevel] = -np.inf
    if p.random_strength:
        value = value + fit.rng.normal(0, 1, len(value)) * p.random_strength * known[ABSOLUTE, 0]
    c = int(np.argmax(value))
    if not np.isfinite(value[c]) or value[c] <= fit.floor + 1e-12:
        return None
    fit.floor = value[c]
    return candidates[c][:2]


def judge(fit: Fit, loss: float) -> None:
    """Keep the best number of trees; stop the fit if too many since then were no better."""
    loss = float(np.sqrt(loss)) if fit.params.loss in ("RMSE", "MultiRMSE") else loss
    if fit.best is None or loss < fit.best[0]:
        fit.best = (loss, len(fit.trees))
    elif fit.params.early_stopping_rounds and len(fit.trees) - fit.best[1] >= fit.params.early_stopping_rounds:
        fit.live = False


def grown(state: DataFrame, fits: list[Fit], n_targets: int, rewrite: int = REWRITE) -> None:
    """Add trees to all fits until each has its number or stops."""
    first = 0
    while live := [f for f in fits if f.live]:
        for f in live:
            f.now, f.growing = [], len(f.trees) < f.params.iterations
        first_level = True
        while live:
            losses = first_level and any(f.params.early_stopping_rounds for f in live)
            if not losses and not any(f.growing for f in live):
                break
            found = gains(summed(state, live, n_targets, first, False, losses), live, n_targets).toPandas()  # a row per candidate
            by_fit = dict(iter(found.groupby("fit")))
            for f in live:
                mine = by_fit.get(f.number, found[:0])
                if losses and f.params.early_stopping_rounds:
                    judge(f, float(mine.loc[mine["feature"] == LOSS, "gain"].iloc[0]))
                if f.growing and f.live and len(f.now) < f.params.depth:
                    split = chosen(f, mine[mine["feature"] != LOSS])
                    f.now += [split] if split else []
                    f.growing = split is not None and len(f.now) < f.params.depth
                else:
                    f.growing = False
            live = [f for f in live if f.live]
            first_level = False
        for f in (f for f in fits if f.live):
            f.growing = bool(f.now)
            f.live = f.growing
        live = [f for f in fits if f.live]
        if not live:
            break
        leaf = summed(state, live, n_targets, first, True, False).toPandas()  # a row per leaf
        for f in live:
            mine = leaf[leaf["fit"] == f.number]
            sums = np.zeros((1 << len(f.now), 1 + 2 * n_targets))
            sums[mine["node"]] = mine[["n", *[f"s{j}" for j in range(2 * n_targets)]]].to_numpy(float)
            f.trees.append(Grown(f.now, -sums[:, 1 : 1 + n_targets] / (sums[:, 1 + n_targets :] + f.params.l2_leaf_reg)))
            cuts = {(c, i): (v, same) for c, i, v, same in f.candidates()}
            f.model.trees.append(B.Tree([c for c, _ in f.now], [cuts[s][0] for s in f.now], [cuts[s][1] for s in f.now], f.trees[-1].values.tolist(), sums[:, 0].tolist()))
            if len(f.trees) == f.params.iterations and not f.params.early_stopping_rounds:
                f.live = False
        most = max(len(f.trees) for f in fits)
        if most - first >= rewrite and any(f.live for f in fits):
            state, first = moved(state, [f for f in fits if f.live], n_targets, first), most
    for f in fits:
        if f.params.early_stopping_rounds:
            f.model.best_iteration = f.best[1]
            f.model.trees, f.trees = f.model.trees[: max(1, f.best[1])], f.trees[: max(1, f.best[1])]
        else:
            f.model.best_iteration = len(f.trees)


def moved(state: DataFrame, fits: list[Fit], n_targets: int, first: int) -> DataFrame:
    """The state with raw scores that have all trees so far; fits that have ended are left out."""
    known = sent(state, fits, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fit, outside, at, bins, y, f, n, q in parts(batch, known.value, n_targets):
                listed = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fit.number, np.int32)), pa.array(outside), pa.array(at), listed(bins), listed(y), listed(f), pa.array(n), pa.array(q)], batch.schema.names)

    return stored(state.mapInArrow(run, STATE), "boosting-state")


def outside_predictions(state: DataFrame, fits: list[Fit], n_targets: int) -> DataFrame:
    """(fit, y, p, raw) of the rows that each fit left out, from the state before the first tree; y, p and raw are arrays."""
    known = sent(state, fits, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fit, _, at, _, y, raw, _, _ in parts(batch.filter(batch.column(1)), known.value, n_targets):
                rows = [pa.array(list(x), pa.list_(pa.float64())) for x in (y, B.shown(fit.params.loss, raw), raw)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fit.number, np.int32)), *rows], ["fit", "y", "p", "raw"])

    return state.mapInArrow(run, "fit int, y array<double>, p array<double>, raw array<double>")


def scores(predicted: DataFrame, name: str, n_targets: int) -> DataFrame:
    """(fit, score): what ``boosting.score_of`` says, of tables."""
    long = predicted.select("fit", F.explode(F.arrays_zip("y", "p")).alias("x")).select("fit", F.col("x.y").alias("y"), F.col("x.p").alias("p"))
    if name in ("neg_rmse", "neg_mae"):
        return long.groupBy("fit").agg(M.scorer(name)(F.col("y"), F.col("p"), F.lit(1)).alias("score"))
    if name == "r2":
        each = predicted.select("fit", F.posexplode(F.arrays_zip("y", "p")).alias("k", "x")).groupBy("fit", "k").agg(M.scorer("r2")(F.col("x.y"), F.col("x.p"), F.lit(1)).alias("r2"))
        return each.groupBy("fit").agg(F.avg("r2").alias("score"))
    many = n_targets > 1
    if name == "log_loss":
        y, p = F.get("y", 0), F.get("p", 0)
        true = F.aggregate(F.zip_with("y", "p", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) if many else F.when(y == 1, p).otherwise(1 - p)
        tiny = float(np.finfo(float).eps)
        return predicted.groupBy("fit").agg(F.avg(F.log(F.least(F.greatest(true, F.lit(tiny)), F.lit(1 - tiny)))).alias("score"))
    label = (F.array_position("y", F.lit(1.0)) - 1).cast("int") if many else F.get("y", 0).cast("int")
    if name == "roc_auc" and not many:
        return M.auc(predicted.select("fit", label.alias("y"), F.get("p", 0).alias("p")), by=["fit"]).toDF("fit", "score")
    if name in ("roc_auc", "roc_auc_ovr"):
        return M.auc_ovr(predicted.select("fit", label.alias("y"), F.col("p").alias("probs")), classes=n_targets, by=["fit"]).toDF("fit", "score")
    said = M.argmax("p") if many else (F.get("p", 0) > 0.5).cast("int")
    labels = predicted.select("fit", label.alias("y"), said.alias("p"))
    if name == "balanced_accuracy":
        return M.balanced_accuracy(labels, by=["fit"]).toDF("fit", "score")
    if name == "f1_weighted" or (name == "f1" and many):
        return M.f1_weighted(labels, by=["fit"]).toDF("fit", "score")
    return labels.groupBy("fit").agg(M.scorer(name)(F.col("y"), F.col("p"), F.lit(1)).alias("score"))


def fit_by_histograms(rows: DataFrame, fold: str, names: list[str], categorical: list[str], targets: list[str], params: dict[int, B.Params], scoring: str | None = None, rewrite: int = REWRITE) -> list[tuple[int, float, B.Model]]:
    """(fold, score, model) of each fold in ``params``, fitted on the rows of the other folds, all at once."""
    used = stored(rows.select(fold, *names, *targets), "boosting-rows")
    fits = prepared(used, fold, names, categorical, targets, params)
    state = state_of(used, fold, names, categorical, targets, fits)
    grown(merged(state, fits, len(targets)), fits, len(targets), rewrite)
    predicted = outside_predictions(state, fits, len(targets))
    found = scores(predicted, scoring, len(targets)) if scoring else losses_of(predicted, fits)
    score = {r.fit: r.score for r in found.collect()}
    return [(f.number, score.get(f.number), f.model) for f in fits]


def losses_of(predicted: DataFrame, fits: list[Fit]) -> DataFrame:
    """(fit, score): the negated loss, from each task's sums."""
    kinds = {f.number: (f.params.loss, f.params.delta) for f in fits}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby("fit"):
                loss, delta = kinds[int(k)]
                y, raw = (np.stack(part[c].to_list()) for c in ("y", "raw"))
                value = B.loss_value(loss, y, raw, delta)
                yield pd.DataFrame({"fit": [k], "n": [len(part)], "s": [len(part) * (value**2 if loss in ("RMSE", "MultiRMSE") else value)]})

    mean = F.sum("s") / F.sum("n")
    rooted = F.col("fit").isin([k for k, (loss, _) in kinds.items() if loss in ("RMSE", "MultiRMSE")])
    sums = predicted.mapInPandas(run, "fit int, n long, s double").groupBy("fit").agg(mean.alias("mean"))
    return sums.select("fit", (-F.when(rooted, F.sqrt("mean")).otherwise(F.col("mean"))).alias("score"))


def as_table(spark, found: list[tuple[int, int, float, B.Model]]) -> DataFrame:
    """(fold, trial, score, best_iteration, model) of (fold, trial, score, model)."""
    rows = [(k, t, None if s is None else float(s), m.best_iteration, json.dumps(asdict(m))) for k, t, s, m in found]
    return spark.createDataFrame(rows, "fold int, trial int, score double, best_iteration int, model string")
