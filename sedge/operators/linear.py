"""Linear and elastic-net regression from moments: one pass over the rows answers every fold and every grid point.

A group's moments are its count, means and summed products of deviations. Those of several groups merge exactly, so a
training set is the merge of the other folds, and errors on a held-out fold follow from that fold's own moments.
What is solved on the driver has one row per feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Moments:
    """Count, means and summed products of deviations; the target is the last column."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        cross = np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + cross)


def moments(df: DataFrame, columns: Sequence[str], key: str) -> dict:
    """``Moments`` of the columns per value of ``key``, in one aggregation; rows must have all of them."""
    cast = [F.col(f"`{c}`").cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    lacking = F.count_if(F.greatest(*[(c.isNull() | F.isnan(c)).cast("int") for c in cast], F.lit(0)) > 0)
    rows = df.groupBy(key).agg(
        F.count("*").alias("n"), lacking.alias("lacking"), F.array(*[F.avg(c) for c in cast]).alias("mean"),
        F.array(*[F.covar_pop(cast[i], cast[j]) for i, j in pairs]).alias("co"),
    ).collect()
    if any(r["lacking"] for r in rows):
        raise ValueError("a training row lacks a number")
    out = {}
    for r in rows:
        products = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["co"], strict=True):
            products[i, j] = products[j, i] = v * r["n"]
        out[r[key]] = Moments(r["n"], np.array(r["mean"]), products)
    return out


def merged(parts: Iterable[Moments], columns: int) -> Moments:
    out = Moments(0, np.zeros(columns), np.zeros((columns, columns)))
    for part in parts:
        out = out + part
    return out


@dataclass(frozen=True)
class Line:
    intercept: float
    weights: np.ndarray

    def mean_squared_error(self, at: Moments) -> float:
        """Over the rows behind the moments."""
        w = np.r_[-self.weights, 1.0]
        off = float(w @ at.mean) - self.intercept
        return max(float(w @ at.products @ w) / at.n, 0.0) + off * off

    def stage(self, features: Sequence[str], out: str = "y_pred") -> SQLTransformer:
        terms = [f"{float(self.intercept)!r}D", *(f"({float(w)!r}D) * `{c}`" for w, c in zip(self.weights, features, strict=True))]
        return SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS `{out}` FROM __THIS__")


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample deviations (1 for a constant column), products of standardised features per row, and with the target."""
    k = len(m.mean) - 1
    spread = np.sqrt(np.diag(m.products)[:k] / max(m.n - 1, 1))
    spread[spread == 0] = 1.0
    return spread, m.products[:k, :k] / np.outer(spread, spread) / m.n, m.products[:k, k] / spread / m.n


def _line(m: Moments, weights: np.ndarray) -> Line:
    return Line(float(m.mean[-1] - weights @ m.mean[:-1]), weights)


def least_squares(m: Moments) -> Line:
    """Ordinary least squares; of several solutions the shortest in standardised features."""
    spread, gram, right = _standardised(m)
    return _line(m, np.linalg.lstsq(gram, right, rcond=1e-12)[0] / spread)


def elastic_net(m: Moments, alpha: float, l1_ratio: float, rounds: int = 10_000, close: float = 1e-13) -> Line:
    """Coordinate descent for 1/(2n)|y - Xw|^2 + alpha * l1_ratio * |w| + alpha * (1 - l1_ratio) / 2 * w^2 on standardised features."""
    spread, gram, right = _standardised(m)
    w, absolute, squared = np.zeros(len(right)), alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            rest = right[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - absolute, 0.0) / ((gram[j, j] + squared) or 1.0)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= close * (np.abs(w).max() or 1.0):
            break
    return _line(m, w / spread)


def search(folds: dict, points: Sequence[dict]) -> tuple[list[float], Moments]:
    """Mean root of the held-out squared error of each grid point over the folds, and the moments of all rows."""
    columns = len(next(iter(folds.values())).mean)
    error = np.zeros(len(points))
    for fold, held_out in folds.items():
        rest = merged((m for f, m in folds.items() if f != fold), columns)
        if not rest.n:
            raise ValueError("all rows are in one fold")
        error += [elastic_net(rest, **p).mean_squared_error(held_out) ** 0.5 for p in points]
    return (error / len(folds)).tolist(), merged(folds.values(), columns)
