"""Trials of a search by the ratio of two densities: of the good points so far, and of all others."""

from __future__ import annotations

import math

import numpy as np

GOOD, MOST_GOOD = 0.1, 25  # share of the trials that are good ones, and their number at most
CANDIDATES = 24
NARROW = 0.7  # of a kernel's width against the distance to its neighbours


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """By a rational approximation that is right to seven digits."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z / 2)
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


class Parzen:
    """For each coordinate on its own, a normal kernel at each point, cut off at the unit interval, and one share for all of it."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        order = np.argsort(points, 0)
        ends = np.concatenate([np.zeros((1, points.shape[1])), np.take_along_axis(points, order, 0), np.ones((1, points.shape[1]))])
        gaps = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        self.points, self.width = points, np.empty_like(points)
        np.put_along_axis(self.width, order, np.clip(NARROW * gaps, 0.5 / min(100, n + 1), 0.5), 0)
        self.mass = normal_cdf((1 - points) / self.width) - normal_cdf(-points / self.width)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """(n, coordinates), reflected into the unit cube."""
        at = rng.integers(0, len(self.points), (n, self.points.shape[1]))
        out = np.take_along_axis(self.points, at, 0) + np.take_along_axis(self.width, at, 0) * rng.normal(size=at.shape)
        return np.clip(1 - np.abs(1 - np.abs(out)), 0, 1)

    def log(self, x: np.ndarray) -> np.ndarray:
        """(n, coordinates): logarithms of the densities at x."""
        z = (x[:, None] - self.points[None]) / self.width[None]
        kernel = np.exp(-z * z / 2) / (self.width * self.mass * math.sqrt(2 * math.pi))[None]
        return np.log((kernel.sum(1) + 1) / (len(self.points) + 1))


class Sampler:
    """Points of the unit cube, asked for in batches, and their scores, higher being better."""

    def __init__(self, size: int, seed: int):
        self.size, self.rng = size, np.random.default_rng(seed)
        self.points: list[list[float]] = []
        self.scores: list[float] = []

    def tell(self, points: list[list[float]], scores: list[float]) -> None:
        self.points += points
        self.scores += [-math.inf if s is None or math.isnan(s) else s for s in scores]

    def ask(self, n: int) -> list[list[float]]:
        """n points, each coordinate the most promising of some draws; points of a batch count as bad for those after them, so that they differ."""
        if not self.size:
            return [[] for _ in range(n)]
        points = np.array(self.points)
        order = np.argsort(-np.array(self.scores), kind="stable")
        many = min(MOST_GOOD, max(2, math.ceil(GOOD * len(points))), len(points))
        good, bad = Parzen(points[order[:many]]), points[order[many:]]
        out: list[list[float]] = []
        for _ in range(n):
            others = np.array([*bad.tolist(), *out])
            drawn = good.draw(CANDIDATES, self.rng)
            promise = good.log(drawn) - (Parzen(others).log(drawn) if len(others) else 0)
            out.append(drawn[promise.argmax(0), np.arange(self.size)].tolist())
        return out
