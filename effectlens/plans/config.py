"""Task types and the defaults of a configuration, by the size of the data."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from copy import deepcopy

from effectlens.plans.sampler import Sampler

REGRESSION = ("regression", "multi_regression")
CLASSIFICATION = ("binary_classification", "multiclass_classification")

# Loss and score of each task.
LOSS_AND_SCORE = {
    "regression": ("RMSE", "neg_rmse"),
    "binary_classification": ("Logloss", "roc_auc"),
    "multiclass_classification": ("MultiClass", "balanced_accuracy"),
    "multi_regression": ("MultiRMSE", "neg_rmse"),
}


def task_of(config: dict) -> str:
    """The task named, else what outcome and score imply.  One outcome in a list is a single outcome."""
    model = config["modeling"]
    named = model.get("task_type")
    if named is not None:
        if named not in LOSS_AND_SCORE:
            raise ValueError(f"task_type must be one of {', '.join(sorted(LOSS_AND_SCORE))}, not {named!r}")
        return named
    if isinstance(model.get("outcome"), list) and len(model["outcome"]) > 1:
        return "multi_regression"
    score = (model.get("tuning") or {}).get("scoring")
    return "regression" if score is None or score == "r2" or score.startswith("neg_") else "binary_classification"


def fold_count(n: int, per_fold: int, fewest: int = 3) -> int:
    """The largest of 3, 5 and 10 folds of at least per_fold rows each."""
    return next((k for k in (10, 5) if n // per_fold >= k), fewest)


def search_space(n: int) -> dict[str, dict]:
    # The bounds of the ten parameters; three depend on the rows.
    return {
        "iterations": {"low": 100, "high": 5000},
        "learning_rate": {"low": 0.001, "high": 0.3, "log": True},
        "depth": {"low": 2, "high": max(3, min(10, int(math.log2(max(n / 5, 4)))))},
        "l2_leaf_reg": {"low": 0.01, "high": 100.0, "log": True},
        "min_data_in_leaf": {"low": 1, "high": max(2, min(200, n // 50))},
        "random_strength": {"low": 0.001, "high": 10.0, "log": True},
        "bagging_temperature": {"low": 0.1, "high": 1.0},
        "border_count": {"low": 32, "high": 255},
        "colsample_bylevel": {"low": 0.05, "high": 1.0},
        "one_hot_max_size": {"low": 2, "high": 25},
    }


def defaults(n: int, task: str) -> dict:
    outer = fold_count(n, 30)
    loss, score = LOSS_AND_SCORE[task]
    # Numbers of trials, rounds, resamples, knots and outputs, and their thresholds.
    return {
        "execution": {"n_jobs": os.cpu_count(), "random_seed": 42},
        "modeling": {"task_type": task, "loss_function": loss, "cv_folds": outer, "tuning": {"scoring": score, "n_iter": 300, "early_stopping_rounds": 250, "search_space": search_space(n)}},
        "shap": {
            "output_microdata_n": 10,
            "bootstrapping": {"n_boot": 2000 if n < 100 else 5000 if n < 500 else 10000, "alpha": 0.05, "fdr_correct": True, "stab_thresh": 2, "output_boots_n": 10},
            "splines": {"n_knots": 4, "degree": 3, "discrete_threshold": 15},
        },
    }


def merged(given: dict, standard: dict, path: str = "") -> tuple[dict, list[str]]:
    """given with what it lacks, and the dotted names of that.  A search space is taken whole or not at all."""
    out, filled = deepcopy(given), []
    for key, value in standard.items():
        if key not in out:
            out[key] = value
            filled.append(path + key)
        elif isinstance(value, dict) and isinstance(out[key], dict) and key != "search_space":
            out[key], more = merged(out[key], value, f"{path}{key}.")
            filled += more
    return out, filled


def resolve(config: dict, n_rows: int) -> tuple[dict, list[str]]:
    """The configuration with all defaults, and their names; what the user gives stays."""
    out, filled = merged(config, defaults(n_rows, task_of(config)))
    outer = out["modeling"]["cv_folds"]
    inner = fold_count(n_rows - n_rows // outer, 20, min(3, outer))
    if "inner_cv_folds" not in out["modeling"]["tuning"]:
        out["modeling"]["tuning"]["inner_cv_folds"] = inner
        filled.append("modeling.tuning.inner_cv_folds")
    for name, bounds in out["modeling"]["tuning"]["search_space"].items():
        if isinstance(bounds, dict) and {"low", "high"} <= set(bounds) and bounds["low"] >= bounds["high"]:
            raise ValueError(f"search space {name}: low {bounds['low']} is not under high {bounds['high']}")
    return out, filled


def draw_points(space: dict, n: int, seed: int) -> list[list[float]]:
    """n points of a low-discrepancy sequence in the unit cube, a side for each parameter."""
    steps = [2 ** (k / (len(space) + 1)) % 1 for k in range(1, len(space) + 1)]
    return [[((t + 1) * step + (seed % 997) / 997) % 1 for step in steps] for t in range(n)]


def setting(space: dict, point: list[float]) -> dict:
    """The parameters at a point. Lists are choices; two integers give integers; "log" spreads over magnitudes."""
    one = {}
    for (name, spec), u in zip(sorted(space.items()), point, strict=True):
        if isinstance(spec, list):
            one[name] = spec[min(int(u * len(spec)), len(spec) - 1)]
            continue
        low, high = spec["low"], spec["high"]
        x = low * (high / low) ** u if spec.get("log") else low + u * (high - low)
        one[name] = min(high, int(round(x))) if isinstance(low, int) and isinstance(high, int) else float(x)
    return one


def draw_trials(space: dict, n: int, seed: int) -> list[dict]:
    """n settings of the search space, a low-discrepancy sequence over its parameters."""
    return [setting(space, p) for p in draw_points(space, n, seed)]


def search(space: dict, n: int, seeds: dict[int, int], judge: Callable[[dict[int, list[dict]]], dict[int, list[float]]], rounds: int = 12) -> dict[int, tuple[dict, int]]:
    """(best setting, its place) of n trials for each of several searches, named by number, which go on side by side.

    The first trials, 10 at least, spread over the whole space; then in each round every search asks for its next from
    densities of its good and its bad trials.  judge scores the settings of a round of all searches at once, higher being
    better; a score that isn't a number is the worst.  Of equal scores the first wins.
    """
    if n < 1:
        raise ValueError("tuning.n_iter is under 1")
    samplers = {k: Sampler(len(space), seed) for k, seed in seeds.items()}
    first = min(n, max(10, n // rounds))
    asked = {k: draw_points(space, first, seed) for k, seed in seeds.items()}
    done = 0
    while True:
        found = judge({k: [setting(space, p) for p in points] for k, points in asked.items()})
        for k, points in asked.items():
            samplers[k].tell(points, found[k])
        done += len(next(iter(asked.values())))
        if done >= n:
            break
        asked = {k: s.ask(min(max(1, n // rounds), n - done)) for k, s in samplers.items()}
    best = {k: max(range(n), key=lambda t, s=s: (s.scores[t], -t)) for k, s in samplers.items()}
    return {k: (setting(space, samplers[k].points[t]), t) for k, t in best.items()}
