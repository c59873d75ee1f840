"""Gradient boosting with symmetric trees, and exact path-dependent attributions of its trees.

Every level of a tree has one (feature, threshold) split, so a tree of depth d is d splits and 2^d
leaves.  Fits are small and many: they run in numpy, a (fold, trial, inner fold) to a task.  Rows meet
models where they lie: models are sent out, rows aren't grouped.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.sources.scratch import stored

LOSSES = ("RMSE", "MAE", "Huber", "Quantile", "MultiRMSE", "Logloss", "CrossEntropy", "MultiClass", "MultiClassOneVsAll")


@dataclass
class Params:
    iterations: int = 100
    learning_rate: float = 0.1
    depth: int = 4
    l2_leaf_reg: float = 3.0
    min_data_in_leaf: int = 1
    random_strength: float = 0.0
    bagging_temperature: float = 0.0
    border_count: int = 64
    colsample_bylevel: float = 1.0
    one_hot_max_size: int = 10
    loss: str = "RMSE"
    delta: float = 1.0  # of Huber; the level of Quantile
    early_stopping_rounds: int = 0
    seed: int = 42


@dataclass
class Tree:
    features: list[int]
    thresholds: list[float]
    equal: list[bool]  # x == threshold, for one-hot splits, else x > threshold
    values: list[list[float]]
    covers: list[float]


@dataclass
class Model:
    names: list[str]
    base: list[float]
    learning_rate: float
    loss: str
    trees: list[Tree] = field(default_factory=list)
    encodings: dict[str, dict[str, float]] = field(default_factory=dict)  # of categorical features: level to number
    best_iteration: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        raw = json.loads(text)
        return Model(**raw | {"trees": [Tree(**t) for t in raw["trees"]]})

    def matrix(self, df: pd.DataFrame) -> np.ndarray:
        out = np.full((len(df), len(self.names)), np.nan)
        for k, c in enumerate(self.names):
            known = self.encodings.get(c)
            out[:, k] = df[c].map(known).fillna(-1).astype(float) if known is not None else df[c].astype(float)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for t in self.trees:
            out += self.learning_rate * np.array(t.values)[leaves(t, x)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values, or probabilities of the classes; a column per output."""
        return shown(self.loss, self.raw(x))


def shown(loss: str, f: np.ndarray) -> np.ndarray:
    """Raw scores as values, or as probabilities of the classes."""
    if loss in ("Logloss", "CrossEntropy", "MultiClassOneVsAll"):
        p = 1 / (1 + np.exp(-f))
        return p / p.sum(1, keepdims=True) if loss == "MultiClassOneVsAll" else p
    if loss == "MultiClass":
        e = np.exp(f - f.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return f


def bits(t: Tree, x: np.ndarray) -> np.ndarray:
    """(rows, splits): which side of each split a row is on; a missing value is below every threshold."""
    out = np.zeros((len(x), len(t.features)), bool)
    for k, (f, at, same) in enumerate(zip(t.features, t.thresholds, t.equal, strict=True)):
        c = x[:, f]
        out[:, k] = c == at if same else np.nan_to_num(c, nan=-np.inf) > at
    return out


def leaves(t: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf numbers; the first split is the highest bit."""
    d = len(t.features)
    return bits(t, x) @ (1 << np.arange(d - 1, -1, -1)) if d else np.zeros(len(x), np.int64)


def gradients(loss: str, y: np.ndarray, f: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the raw score; y has a column per output."""
    if loss in ("RMSE", "MultiRMSE"):
        return f - y, np.ones_like(f)
    if loss == "MAE":
        return np.sign(f - y), np.ones_like(f)
    if loss == "Huber":
        return np.clip(f - y, -delta, delta), np.ones_like(f)
    if loss == "Quantile":
        return np.where(y > f, -delta, 1 - delta), np.ones_like(f)
    if loss == "MultiClass":
        e = np.exp(f - f.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
    else:
        p = 1 / (1 + np.exp(-f))
    return p - y, np.maximum(p * (1 - p), 1e-12)


def loss_value(loss: str, y: np.ndarray, f: np.ndarray, delta: float) -> float:
    r = y - f
    if loss in ("RMSE", "MultiRMSE"):
        return float(np.sqrt((r**2).sum(1).mean()))
    if loss == "MAE":
        return float(np.abs(r).mean())
    if loss == "Huber":
        return float(np.where(np.abs(r) <= delta, r**2 / 2, delta * (np.abs(r) - delta / 2)).mean())
    if loss == "Quantile":
        return float(np.where(r > 0, delta * r, (delta - 1) * r).mean())
    if loss == "MultiClass":
        top = f.max(1, keepdims=True)
        return float((np.log(np.exp(f - top).sum(1)) + top[:, 0] - (y * f).sum(1)).mean())
    return float((np.logaddexp(0, f) - y * f).sum(1).mean())


def start(loss: str, y: np.ndarray, delta: float) -> np.ndarray:
    if loss in ("RMSE", "MultiRMSE"):
        return y.mean(0)
    if loss in ("MAE", "Huber"):
        return np.median(y, axis=0)
    if loss == "Quantile":
        return np.quantile(y, delta, axis=0)
    p = np.clip(y.mean(0), 1e-6, 1 - 1e-6)
    return np.log(p) if loss == "MultiClass" else np.log(p / (1 - p))


def squared_loss(y: np.ndarray, f: np.ndarray, n: np.ndarray, q: np.ndarray) -> float:
    """The squared losses' value where n rows alike count as one: y is their mean, and q the sum of squares about it."""
    return float(np.sqrt((n * ((y - f) ** 2).sum(1) + q).sum() / n.sum()))


def encodings(df: pd.DataFrame, categorical: list[str], y: np.ndarray, one_hot: int, prior: float = 1.0, n: np.ndarray | None = None) -> tuple[dict, set[str]]:
    """Numbers for levels: codes where they are split one by one, else smoothed target means."""
    out, single = {}, set()
    for c in categorical:
        levels = sorted(df[c].astype(str).unique())
        if len(levels) <= one_hot:
            out[c] = {v: float(i) for i, v in enumerate(levels)}
            single.add(c)
        else:
            target, many = y[:, 0], np.ones(len(y)) if n is None else n
            g = pd.DataFrame({"v": df[c].astype(str), "sum": target * many, "count": many}).groupby("v").sum()
            out[c] = ((g["sum"] + prior * np.average(target, weights=n)) / (g["count"] + prior)).to_dict()
    return out, single


def split_candidates(x: np.ndarray, single: set[int], border_count: int, n: np.ndarray | None = None) -> list[tuple[int, float, bool]]:
    from effectlens.operators.histograms import cuts_of

    out = []
    for f in range(x.shape[1]):
        there = ~np.isnan(x[:, f])
        seen, at = np.unique(x[there, f], return_inverse=True)
        if f in single:
            out += [(f, float(v), True) for v in seen] if len(seen) > 2 else [(f, float(v), True) for v in seen[1:]]
        elif len(seen):
            middles = (seen[1:] + seen[:-1]) / 2
            if len(middles) > border_count:
                spread = np.linspace(0, 1, border_count + 2)[1:-1]
                middles = np.unique(np.quantile(x[there, f], spread)) if n is None else cuts_of(seen, np.bincount(at, n[there]), border_count)
            out += [(f, float(v), False) for v in middles]
            if np.isnan(x[:, f]).any():
                out.append((f, -np.finfo(float).max, False))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, side: np.ndarray, cand: list, p: Params, rng: np.random.Generator, weight: np.ndarray, n: np.ndarray | None = None) -> Tree:
    """One tree: at each level the split that lowers the loss most over all its nodes together.  n tells how many rows each row stands for."""
    counted = lambda at, width, on=slice(None): np.bincount(at[on], None if n is None else n[on], width)
    weight = weight if n is None else weight * n
    t = Tree([], [], [], [], [])
    node, k = np.zeros(len(x), np.int64), g.shape[1]
    gw, hw = g * weight[:, None], h * weight[:, None]
    best_so_far = (gw.sum(0) ** 2 / (hw.sum(0) + p.l2_leaf_reg)).sum()
    for _ in range(p.depth):
        use = np.flatnonzero(rng.random(len(cand)) < p.colsample_bylevel) if p.colsample_bylevel < 1 else np.arange(len(cand))
        width = 1 << len(t.features)
        total = [np.stack([np.bincount(node, a[:, j], width) for j in range(k)]) for a in (gw, hw)]
        count = counted(node, width)
        gains = np.full(len(cand), -np.inf)
        for c in use.tolist():
            on = side[c]
            n_on = counted(node, width, on)
            small = np.minimum(n_on, count - n_on)
            if small[small > 0].size == 0 or small[small > 0].min() < p.min_data_in_leaf:
                continue
            score = 0.0
            for j in range(k):
                g1, h1 = np.bincount(node[on], gw[on, j], width), np.bincount(node[on], hw[on, j], width)
                score += (g1**2 / (h1 + p.l2_leaf_reg) + (total[0][j] - g1) ** 2 / (total[1][j] - h1 + p.l2_leaf_reg)).sum()
            gains[c] = score
        if p.random_strength:
            gains = gains + rng.normal(0, 1, len(gains)) * p.random_strength * np.abs(g).mean()
        c = int(np.argmax(gains)) if len(gains) else 0
        if not len(gains) or not np.isfinite(gains[c]) or gains[c] <= best_so_far + 1e-12:
            break
        best_so_far = gains[c]
        f, at, same = cand[c]
        t.features.append(f)
        t.thresholds.append(at)
        t.equal.append(same)
        node = node * 2 + side[c]
    width = 1 << len(t.features)
    sums = [np.stack([np.bincount(node, a[:, j], width) for j in range(k)], 1) for a in (gw, hw)]
    t.values = (-sums[0] / (sums[1] + p.l2_leaf_reg)).tolist()
    t.covers = counted(node, width).astype(float).tolist()
    return t


def alike(loss: str, p: Params) -> bool:
    """Whether rows of the same features may count as one: squared losses need only their number, mean and squares, if nothing is drawn by row."""
    return loss in ("RMSE", "MultiRMSE") and not p.bagging_temperature and not p.random_strength


def fit(df: pd.DataFrame, y: np.ndarray, names: list[str], categorical: list[str], p: Params, valid: tuple[pd.DataFrame, np.ndarray] | tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray] | None = None, n: np.ndarray | None = None) -> Model:
    """Fit on df[names]; y has a column per output (one-hot for classes).  With valid, stop early and keep the best.

    With n each row stands for as many alike, whose mean y is; valid then has their numbers and the sums of squares about their means besides.
    """
    if p.loss not in LOSSES:
        raise ValueError(f"unknown loss {p.loss!r}")
    if n is not None and not alike(p.loss, p):
        raise ValueError(f"rows of {p.loss!r} can't count as one")
    y = y.reshape(len(df), -1).astype(float)
    known, single = encodings(df, categorical, y, p.one_hot_max_size, n=n)
    base = start(p.loss, y, p.delta) if n is None else np.average(y, axis=0, weights=n)
    model = Model(names, base.tolist(), p.learning_rate, p.loss, encodings=known)
    judged = (lambda vy, vf: loss_value(p.loss, vy, vf, p.delta)) if n is None else (lambda vy, vf: squared_loss(vy, vf, *valid[2:]))
    x = model.matrix(df.assign(**{c: df[c].astype(str) for c in categorical}))
    cand = split_candidates(x, {names.index(c) for c in single}, p.border_count, n)
    side = np.stack([bits(Tree([f], [at], [same], [], []), x)[:, 0] for f, at, same in cand]) if cand else np.zeros((0, len(x)), bool)
    rng = np.random.default_rng(p.seed)
    f = np.tile(np.array(model.base), (len(x), 1))
    if valid is not None:
        vx = model.matrix(valid[0].assign(**{c: valid[0][c].astype(str) for c in categorical}))
        vy, vf = valid[1].reshape(len(vx), -1).astype(float), np.tile(np.array(model.base), (len(vx), 1))
        best = (judged(vy, vf), 0)
    for i in range(p.iterations):
        weight = rng.exponential(1, len(x)) ** p.bagging_temperature if p.bagging_temperature else np.ones(len(x))
        g, h = gradients(p.loss, y, f, p.delta)
        tree = grow(x, g, h, side, cand, p, rng, weight, n)
        if not tree.features:
            break
        model.trees.append(tree)
        f += p.learning_rate * np.array(tree.values)[leaves(tree, x)]
        if valid is not None:
            vf += p.learning_rate * np.array(tree.values)[leaves(tree, vx)]
            now = judged(vy, vf)
            if now < best[0]:
                best = (now, i + 1)
            elif p.early_stopping_rounds and i + 1 - best[1] >= p.early_stopping_rounds:
                break
    model.best_iteration = best[1] if valid is not None else len(model.trees)
    if valid is not None:
        model.trees = model.trees[: max(1, best[1])]
    return model


def expectations(t: Tree, fixed: set[int]) -> np.ndarray:
    """(leaf patterns, outputs): the tree's value when features in `fixed` follow the pattern, others by cover."""
    d = len(t.features)
    pattern = np.arange(1 << d)
    value = np.broadcast_to(np.array(t.values)[None], (1 << d, 1 << d, len(t.values[0])))
    cover = np.array(t.covers)
    for level in range(d - 1, -1, -1):
        low, high = value[:, 0::2], value[:, 1::2]
        c0, c1 = cover[0::2], cover[1::2]
        if t.features[level] in fixed:
            took = (pattern >> (d - 1 - level)) & 1
            value = np.where(took[:, None, None] == 1, high, low)
        else:
            w = np.divide(c1, c0 + c1, out=np.full(len(c0), 0.5), where=c0 + c1 > 0)[None, :, None]
            value = low * (1 - w) + high * w
        cover = c0 + c1
    return value[:, 0]


def weighted(t: Tree, kinds: dict[int, str], nodes: np.ndarray) -> np.ndarray:
    """(quadrature nodes, leaf patterns, outputs): the sum over leaves of their value times a factor of each feature.

    With o telling whether the pattern goes the leaf's way at all splits on a feature, and z the share of the cover that does,
    the factor is o * n + z * (1 - n) at node n, or o - z where kinds says "less".  From the last level up, a level
    doubles the patterns and halves the nodes of the tree, so a pass costs depth * leaves.  Where several levels split on one
    feature, their product is of one side at a time: there is a pass for each choice of sides.
    """
    d, levels = len(t.features), {f: [k for k, g in enumerate(t.features) if g == f] for f in t.features}
    several = [f for f, at in levels.items() if len(at) > 1]
    covers = [np.array(t.covers)]
    for _ in range(d):
        covers.append(covers[-1][0::2] + covers[-1][1::2])
    n = nodes[:, None, None, None]
    out = np.zeros((len(nodes), 1 << d, len(t.values[0])))
    for sides in product((True, False), repeat=len(several)):
        side = dict(zip(several, sides, strict=True))
        value = np.broadcast_to(np.array(t.values)[None, None], (len(nodes), 1, 1 << d, len(t.values[0])))
        for level in range(d - 1, -1, -1):
            f, low, high = t.features[level], value[:, :, 0::2], value[:, :, 1::2]
            c0, c1 = covers[d - 1 - level][0::2], covers[d - 1 - level][1::2]
            z1 = np.divide(c1, c0 + c1, out=np.full(len(c0), 0.5), where=c0 + c1 > 0)[None, None, :, None]
            if f in side:
                took = (low, high) if side[f] else (low * (1 - z1) + high * z1,) * 2
            elif kinds.get(f) == "less":
                took = (low * z1 - high * z1, high * (1 - z1) - low * (1 - z1))
            else:
                mean = (low * (1 - z1) + high * z1) * (1 - n)
                took = (low * n + mean, high * n + mean)
            # The level's bit of the pattern is above those of the levels below.
            value = np.concatenate(took, 1)
        share = np.ones((len(nodes), 1, 1))
        for f, own in side.items():
            share = share * ((1.0 if own else -1.0) if kinds.get(f) == "less" else (nodes if own else 1 - nodes)[:, None, None])
        out += share * value[:, :, 0]
    return out


def tree_effects(t: Tree) -> dict[tuple[int, ...], np.ndarray]:
    """(leaf patterns, outputs) of each main effect (i,) and of both halves of each pair (i, j) together.

    Shapley weights are integrals over [0, 1] of the polynomials that ``weighted`` gives at a node, so a Gauss rule of half
    as many nodes as there are features sums over all subsets exactly.
    """
    own = sorted(set(t.features))
    x, w = np.polynomial.legendre.leggauss(max(1, (len(own) + 1) // 2))
    integral = lambda kinds: np.tensordot(w / 2, weighted(t, kinds, (x + 1) / 2), 1)
    out = {(i, j): integral({i: "less", j: "less"}) for i, j in combinations(own, 2)}
    for i in own:
        shapley = integral({i: "less"})
        out[i,] = shapley - sum((out[tuple(sorted((i, j)))] for j in own if j != i), np.zeros_like(shapley)) / 2
    return out


@dataclass
class Compiled:
    """A model's trees with the tables of their effects."""

    names: list[str]
    encodings: dict[str, dict[str, float]]
    keys: list[tuple[int, ...]]
    trees: list[tuple[Tree, np.ndarray, np.ndarray]]  # splits, places of the keys, (key, leaf pattern, output) with the learning rate

    matrix = Model.matrix

    def effects(self, x: np.ndarray) -> dict[tuple[int, ...], np.ndarray]:
        outputs = self.trees[0][2].shape[2] if self.trees else 1
        total = np.zeros((len(self.keys), len(x), outputs))
        for t, places, tables in self.trees:
            total[places] += tables[:, leaves(t, x)]
        return dict(zip(self.keys, total, strict=True))


def compiled(model: Model) -> Compiled:
    found = [(t, tree_effects(t)) for t in model.trees]
    keys = sorted({k for _, tables in found for k in tables})
    place = {k: i for i, k in enumerate(keys)}
    bare = lambda t: Tree(t.features, t.thresholds, t.equal, [], [])
    trees = [(bare(t), np.array([place[k] for k in tables], np.int64), model.learning_rate * np.stack(list(tables.values()))) for t, tables in found if tables]
    return Compiled(model.names, model.encodings, keys, trees)


def effects(model: Model, x: np.ndarray) -> dict[tuple[int, ...], np.ndarray]:
    """(rows, outputs) of every effect that any tree has; all of them and the expectation add up to the raw score."""
    return compiled(model).effects(x)


def expectation(model: Model) -> np.ndarray:
    return np.array(model.base) + model.learning_rate * sum((expectations(t, set())[0] for t in model.trees), np.zeros(len(model.base)))


def area(y: np.ndarray, p: np.ndarray) -> float:
    """The share of pairs of a 1 and a 0 that p ranks right, ties by half."""
    _, at, many = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[at]
    ones = y == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return float((rank[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def score_of(name: str, y: np.ndarray, p: np.ndarray) -> float:
    """A score, higher being better, of predictions: values, the probability of class 1, or one column per class (y one-hot).

    Scores of labels take the likeliest class, or whether the probability is over 0.5.
    """
    if name in ("neg_rmse", "neg_mae", "r2"):
        if name == "neg_mae":
            return -float(np.abs(y - p).mean())
        if name == "neg_rmse":
            return -float(np.sqrt(((y - p) ** 2).mean()))
        wrong, whole = ((y - p) ** 2).sum(0), ((y - y.mean(0)) ** 2).sum(0)
        return float(np.where(whole > 0, 1 - wrong / np.where(whole > 0, whole, 1), wrong == 0).mean())
    many = y.shape[1] > 1
    if name == "log_loss":
        true = (y * p).sum(1) if many else np.where(y[:, 0] == 1, p[:, 0], 1 - p[:, 0])
        return float(np.log(np.clip(true, np.finfo(float).eps, 1 - np.finfo(float).eps)).mean())
    if name == "roc_auc" and not many:
        return area(y[:, 0], p[:, 0])
    if name in ("roc_auc", "roc_auc_ovr") and many:
        each = np.array([area(y[:, k], p[:, k]) for k in range(y.shape[1])])
        share, there = y.mean(0), ~np.isnan(each)
        return float((each[there] * share[there]).sum() / share[there].sum()) if there.any() else float("nan")
    true, said = (y.argmax(1), p.argmax(1)) if many else (y[:, 0].astype(int), (p[:, 0] > 0.5).astype(int))
    if name == "accuracy":
        return float((true == said).mean())
    classes = np.arange(max(2, y.shape[1]))
    support, predicted, hits = (np.array([x(k) for k in classes]) for x in (lambda k: (true == k).sum(), lambda k: (said == k).sum(), lambda k: ((true == k) & (said == k)).sum()))
    if name == "balanced_accuracy":
        return float((hits[support > 0] / support[support > 0]).mean())
    f1 = 2 * hits / np.maximum(support + predicted, 1)
    if name in ("f1", "f1_weighted"):
        return float(f1[1]) if name == "f1" and not many else float((f1 * support).sum() / support.sum())
    raise ValueError(f"unknown score {name!r}")


#: Bytes of rows or models that are sent to every task; more rows are fitted by histograms, more models are sent block by block.
MOST_SENT = 64 << 20


def fit_folds(rows: DataFrame, fold: str, names: list[str], categorical: list[str], targets: list[str], params: Params, trials: list[dict] | None = None, own_trial: bool = False, scoring: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(fold, trial, score, best_iteration, model): a model per fold and trial, or of each fold with the trial of its number.

    A fold's model is fitted on the rows of the other folds.  score is that named by scoring, of predictions for the
    fold itself, else the negated loss.  Rows of at most ``most_sent`` bytes are sent out once, and each fit is a task of its own.
    Of more rows those of the same fold and features count as one, where the loss allows it and that leaves at most as many bytes;
    else rows stay where they lie, and all folds' trees are grown side by side from aggregated histograms, trial by trial.
    Fits run once, here; what is returned is a table.
    """
    from effectlens.operators import histograms

    spark = rows.sparkSession
    trials = trials or [{}]
    of = lambda k, i: Params(**asdict(params) | trials[i] | {"seed": params.seed + k})
    used = rows.select(fold, *names, *targets)
    bytes_of = sum((F.octet_length(c) + 16 if t == "string" else F.lit(8) for c, t in used.dtypes), F.lit(0))
    about = used.agg(F.sum(bytes_of).alias("size"), F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(fold, *names), 0.02).alias("groups"), F.collect_set(fold).alias("folds")).first()
    size, folds, many = about["size"] or 0, sorted(map(int, about["folds"])), False
    if size > most_sent and not scoring and all(alike(p.loss, p) for p in (of(0, i) for i in range(len(trials)))) and about["groups"] * (size / about["n"] + 16) <= most_sent:
        used, many = stored(rows_alike(used, [fold, *names], targets), "rows-alike"), True
    if size > most_sent and not many:
        dealt = [{k: of(k, k) for k in folds if k < len(trials)}] if own_trial else [{k: of(k, i) for k in folds} for i in range(len(trials))]
        found = [(k, k if own_trial else i, score, m) for i, each in enumerate(dealt) for k, score, m in histograms.fit_by_histograms(used, fold, names, categorical, targets, each, scoring)]
        return stored(histograms.as_table(spark, found), "fits")
    tasks = [(k, i) for i in range(len(trials)) for k in folds if not own_trial or i == k]
    if not tasks:
        return spark.createDataFrame([], FITS)
    table = spark.sparkContext.broadcast(used.toPandas())

    def fitted(k: int, trial: int) -> dict:
        p = of(k, trial)
        pdf = table.value.sort_values(names + targets, kind="stable")
        inside, outside = pdf[pdf[fold] != k], pdf[pdf[fold] == k]
        y, counts = outside[targets].to_numpy(float), [outside[c].to_numpy(float) for c in ("_n", "_q")] if many else []
        m = fit(inside, inside[targets].to_numpy(float), names, categorical, p, (outside, y, *counts) if p.early_stopping_rounds else None, inside["_n"].to_numpy(float) if many else None)
        x = m.matrix(outside.assign(**{c: outside[c].astype(str) for c in categorical}))
        lost = lambda raw: squared_loss(y, raw, *counts) if many else loss_value(p.loss, y, raw, p.delta)
        score = score_of(scoring, y, m.predict(x)) if scoring else -lost(m.raw(x))
        return {"fold": k, "trial": trial, "score": score, "best_iteration": m.best_iteration, "model": m.to_json()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                yield pd.DataFrame([fitted(int(t.fold), int(t.trial))])

    numbered = spark.createDataFrame([(n, k, i) for n, (k, i) in enumerate(tasks)], "n int, fold int, trial int")
    # By range of their number every fit has a partition of its own; by hash some would share one.
    return stored(numbered.repartitionByRange(len(tasks), "n").mapInPandas(run, FITS), "fits")


def rows_alike(rows: DataFrame, by: list[str], targets: list[str]) -> DataFrame:
    """(by, targets, _n, _q): rows of the same values as one, with their mean targets, their number and the sum of squares about the means."""
    squares = sum((F.var_pop(t) for t in targets), F.lit(0.0)) * F.count("*")
    return rows.groupBy(*by).agg(*[F.avg(t).alias(t) for t in targets], F.count("*").alias("_n"), squares.alias("_q"))


def trial_judge(rows: DataFrame, folds: dict[int, str], names: list[str], categorical: list[str], targets: list[str], params: Params, scoring: str, most_sent: int = MOST_SENT) -> Callable[[dict[int, list[dict]]], dict[int, list[tuple[float, float]]]]:
    """A function from trials, listed for each of several searches, to (mean score, mean best iteration) over the folds of the search.

    folds names each search's column of folds; rows without a fold there are not the search's.  Rows of at most ``most_sent`` bytes are sent out once, for all
    calls, and all fits of a call, of every search, trial and fold, are tasks of one job; more rows are fitted by histograms.
    """
    from effectlens.operators import histograms

    spark = rows.sparkSession
    used = rows.select(*names, *targets, *folds.values())
    size = used.agg(F.sum(sum((F.octet_length(c) + 16 if t == "string" else F.lit(8) for c, t in used.dtypes), F.lit(0)))).first()[0] or 0
    parts = {k: sorted(int(r[0]) for r in rows.select(c).distinct().collect() if r[0] is not None) for k, c in folds.items()}
    of = lambda f, trial: Params(**asdict(params) | trial | {"seed": params.seed + f})
    if size > most_sent:

        def by_histograms(trials: dict[int, list[dict]]) -> dict[int, list[tuple[float, float]]]:
            out = {}
            for k, listed in trials.items():
                mine = stored(used.filter(F.col(folds[k]).isNotNull()), "search-rows")
                found = [histograms.fit_by_histograms(mine, folds[k], names, categorical, targets, {f: of(f, t) for f in parts[k]}, scoring) for t in listed]
                out[k] = [(float(np.mean([s for _, s, _ in fits])), float(np.mean([m.best_iteration for _, _, m in fits]))) for fits in found]
            return out

        return by_histograms
    table = spark.sparkContext.broadcast(used.toPandas().sort_values(names + targets, kind="stable"))

    def judge(trials: dict[int, list[dict]]) -> dict[int, list[tuple[float, float]]]:
        tasks = [(k, i, f, json.dumps(t)) for k, listed in trials.items() for i, t in enumerate(listed) for f in parts[k]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for t in pdf.itertuples(index=False):
                    p, at = of(int(t.fold), json.loads(t.setting)), table.value[folds[int(t.search)]]
                    inside, outside = table.value[at.notna() & (at != t.fold)], table.value[at == t.fold]
                    y = outside[targets].to_numpy(float)
                    m = fit(inside, inside[targets].to_numpy(float), names, categorical, p, (outside, y) if p.early_stopping_rounds else None)
                    x = m.matrix(outside.assign(**{c: outside[c].astype(str) for c in categorical}))
                    yield pd.DataFrame([{"search": t.search, "trial": t.trial, "score": score_of(scoring, y, m.predict(x)), "best_iteration": m.best_iteration}])

        numbered = spark.createDataFrame([(n, *t) for n, t in enumerate(tasks)], "n int, search int, trial int, fold int, setting string")
        fits = numbered.repartitionByRange(max(1, len(tasks)), "n").mapInPandas(run, "search int, trial int, score double, best_iteration int")
        means = fits.groupBy("search", "trial").agg(F.avg("score").alias("score"), F.avg("best_iteration").alias("n")).collect()  # a row per trial
        by = {(r.search, r.trial): (r.score, r.n) for r in means}
        return {k: [by[k, i] for i in range(len(listed))] for k, listed in trials.items()}

    return judge


FITS = "fold int, trial int, score double, best_iteration int, model string"


def best_trials(fits: DataFrame) -> DataFrame:
    """(fold, trial, score): of each fold the trial of the highest mean score, the first of equals."""
    mean = fits.groupBy("fold", "trial").agg(F.avg("score").alias("score"))
    best = F.max_by(F.struct("trial", "score"), F.struct("score", -F.col("trial")))
    return mean.groupBy("fold").agg(best.alias("b")).select("fold", "b.trial", "b.score")


def tree_blocks(models: DataFrame, most_sent: int) -> list[list[int]]:
    """Numbers of the parts of ``split_models`` in blocks of at most most_sent bytes (or of one larger part)."""
    blocks, size = [[]], 0
    for r in models.select("part", "bytes").orderBy("part").collect():  # a row per part
        if blocks[-1] and size + r["bytes"] > most_sent:
            blocks.append([])
            size = 0
        blocks[-1].append(r.part)
        size += r["bytes"]
    return blocks


def split_models(models: DataFrame, make: Callable[[Model], object], most_sent: int, per_tree: Callable[[Model], int]) -> DataFrame:
    """(part, fold, first, bytes, body): models as a table of runs of trees, each pickled as ``make`` makes it of a model of these trees.

    Parts are numbered by fold and place; per_tree estimates a tree's bytes, and a part has as many trees as an eighth of most_sent allows.
    The first part of a fold has the model's base, the others none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                m = Model.from_json(r.model)
                many = max(1, most_sent // 8 // max(1, per_tree(m)))
                for at in range(0, max(1, len(m.trees)), many):
                    body = pickle.dumps(make(replace(m, trees=m.trees[at : at + many], base=m.base if at == 0 else [0.0] * len(m.base))))
                    yield pd.DataFrame({"part": [(int(r.fold) << 32) + at], "fold": [int(r.fold)], "first": [at == 0], "bytes": [len(body)], "body": [body]})

    spread = models.select("fold", "model").repartitionByRange(max(1, models.count()), "fold")
    return stored(spread.mapInPandas(run, "part long, fold int, first boolean, bytes long, body binary"), "model-parts")


def send(parts: DataFrame, block: list[int]):
    """The bodies of a block, broadcast by fold in order."""
    bodies: dict[int, list[bytes]] = {}
    for r in parts.filter(F.col("part").between(block[0], block[-1])).orderBy("part").collect() if block else []:  # at most a block's bytes
        bodies.setdefault(r.fold, []).append(bytes(r.body))
    return parts.sparkSession.sparkContext.broadcast(bodies)


def opened(sent) -> dict[int, list]:
    return {k: [pickle.loads(b) for b in bodies] for k, bodies in sorted(sent.value.items())}


def leaf_bytes(m: Model) -> int:
    return max((100 + 60 * len(t.features) + 40 * len(t.covers) * len(m.base) for t in m.trees), default=100)


def table_bytes(m: Model) -> int:
    deepest = max((len(t.features) for t in m.trees), default=1)
    return 200 + 8 * (1 << deepest) * len(m.base) * (deepest * (deepest + 1) // 2 + 1)


def predict_folds(rows: DataFrame, models: DataFrame, fold: str, key: str, categorical: list[str], every: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """(key, fold, pred): of each row by the model that hasn't seen it, or by every model.

    Rows stay where they lie: trees are sent to them in blocks of at most ``most_sent`` bytes.  One block is one pass; with more, each pass
    adds its trees' part to the raw scores and writes them down, so that a worker holds one block at a time.
    """
    parts = split_models(models, lambda m: m, most_sent, leaf_bytes)
    blocks = tree_blocks(parts, most_sent)
    loss = {r.fold: r.loss for r in models.select("fold", F.get_json_object("model", "$.loss").alias("loss")).collect()}
    kind = dict(rows.dtypes)[key]
    names = [c for c in rows.columns if c not in (key, fold)]

    def summed(sent, last: bool, carried: bool) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = opened(sent)
            for pdf in batches:
                if not carried:
                    pdf = pd.concat([pdf.assign(_fold=k) for k in loss]) if every else pdf.assign(_fold=pdf[fold])
                    pdf["_raw"] = None
                for k, part in pdf.groupby("_fold", sort=True):
                    if int(k) not in loss:
                        continue
                    raw = None if not carried else np.stack(part["_raw"].to_list())
                    ready = part.assign(**{c: part[c].astype(str) for c in categorical}) if int(k) in own else None
                    for m in own.get(int(k), []):
                        more = m.raw(m.matrix(ready))
                        raw = more if raw is None else raw + more
                    if raw is None:  # no tree of this fold so far
                        raw = np.zeros((len(part), 1))
                    if last:
                        yield pd.DataFrame({key: part[key].to_numpy(), "fold": int(k), "pred": list(shown(loss[int(k)], raw))})
                    else:
                        yield part.assign(_raw=list(raw))

        return run

    now, carried = rows, False
    schema = f"{key} {kind}, fold int, pred array<double>"
    for n, block in enumerate(blocks):
        last, sent = n + 1 == len(blocks), send(parts, block)
        if last:
            return now.mapInPandas(summed(sent, True, carried), schema)
        between = ", ".join(f"`{c}` {t}" for c, t in rows.select(key, fold, *names).dtypes)
        shaped = f"{between}, _fold int, _raw array<double>"
        step = summed(sent, False, carried)
        order = [key, fold, *names, "_fold", "_raw"]
        now = stored(now.mapInPandas(lambda batches, step=step: (out[order] for out in step(batches)), shaped), "raw-scores")
        carried = True
    return rows.sparkSession.createDataFrame([], schema)


def effects_by_fold(rows: DataFrame, models: DataFrame, fold: str, key: str, categorical: list[str], most_sent: int = MOST_SENT) -> DataFrame:
    """(row, fold, slice, eff, i, j, phi) of every row by its fold's model, of effects that aren't 0 in all of the fold's rows.

    The tables of all trees' effects are made once, model by model, and sent to the rows in blocks of at most ``most_sent`` bytes; with several, their parts are added up.
    """
    kind = dict(rows.dtypes)[key]
    columns = ["row", "fold", "slice", "eff", "i", "j", "phi"]
    schema = f"row {kind}, fold int, slice int, eff string, i string, j string, phi double"
    parts = split_models(models, compiled, most_sent, table_bytes)
    blocks = tree_blocks(parts, most_sent)

    def of_batch(m: Compiled, k: int, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = m.matrix(pdf.assign(**{c: pdf[c].astype(str) for c in categorical}))
        for eff, phi in m.effects(x).items():
            i, j = m.names[eff[0]], m.names[eff[1]] if len(eff) > 1 else None
            for s in range(phi.shape[1]):
                yield pd.DataFrame({"row": pdf[key].to_numpy(), "fold": k, "slice": s, "eff": i if j is None else f"{i} x {j}", "i": i, "j": j, "phi": phi[:, s]})

    def found_by(sent) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = opened(sent)
            for pdf in batches:
                made = [x for k, ms in own.items() if len(part := pdf[pdf[fold] == k]) for m in ms for x in of_batch(m, k, part)]
                if made:
                    yield pd.concat(made)

        return run

    found, several = None, len(blocks) > 1
    for block in blocks:
        one = rows.mapInPandas(found_by(send(parts, block)), schema)
        found = one if found is None else found.unionByName(one)
    if several or parts.groupBy("fold").count().filter("count > 1").take(1):
        found = found.groupBy(*columns[:-1]).agg(F.sum("phi").alias("phi"))
    found = stored(found, "attributions")
    alive = found.groupBy("fold", "slice", "eff").agg(F.max(F.abs("phi")).alias("most")).filter("most > 0").drop("most")
    return found.join(alive, ["fold", "slice", "eff"], "left_semi").select(*columns)
