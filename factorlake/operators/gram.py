"""Linear models on growing stretches of time, from sums that are made once.

Rows in order of time are cut into splits + 1 stretches; fold k is fitted on the
stretches before the k-th and tried on it. All that least squares need of a
stretch are its count, sums and products of features and target, and those of a
fold are the sums of its stretches' ones. So the rows are read and shuffled once
for all folds, as one partial sum a task and stretch; what comes to the driver is
(splits + 1) x (features + 2)^2 numbers, whatever the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = "1"


def stretch_of(i: Column, n: int, splits: int) -> Column:
    """Of row i of n: 0 for the first rows, which no fold is tried on, then 1 to splits of equal size."""
    size = n // (splits + 1)
    first = n - splits * size
    return F.when(i < first, 0).otherwise(1 + F.floor((i - first) / max(size, 1))).cast("int")


def gram_sums(df: DataFrame, features: list[str], target: str, stretch: str = "stretch") -> DataFrame:
    """stretch, a, b, total: sums of a * b over a stretch's rows for all pairs of features, target and the constant 1 (a before b, in this order); rows with nulls are left out."""
    names = [ONE, *features, target]
    value = lambda c: F.lit(1.0) if c == ONE else F.col(c)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = df.dropna(subset=[*features, target]).groupBy(stretch).agg(*[F.sum(value(a) * value(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("total")) for k, (a, b) in enumerate(pairs)])
    return rows.select(stretch, F.explode(entries).alias("e")).select(stretch, "e.a", "e.b", "e.total")


class Gram:
    """Count, means and centred products of features and target; adds up."""

    def __init__(self, features: list[str], target: str, sums: np.ndarray):
        """sums: products of (1, features, target) with each other."""
        self.features, self.target, self.sums = list(features), target, sums

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.features, self.target, self.sums + other.sums)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(products of features, of features and target, means of both), deviations from the means."""
        mean = self.sums[0, 1:] / max(self.n, 1.0)
        c = self.sums[1:, 1:] - self.n * np.outer(mean, mean)
        return c[:-1, :-1], c[:-1, -1], mean

    def _with_intercept(self, w: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, float]:
        return w, float(mean[-1] - w @ mean[:-1])

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) of least squares with alpha times their squares."""
        xx, xy, mean = self.centred()
        return self._with_intercept(np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0], mean)

    def lasso(self, alpha: float, rounds: int = 5000, enough: float = 1e-12) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) of half the mean squares with alpha times the absolute coefficients, by coordinate descent."""
        xx, xy, mean = self.centred()
        xx, xy = xx / max(self.n, 1.0), xy / max(self.n, 1.0)
        w = np.zeros(len(xy))
        for _ in range(rounds):
            before = w.copy()
            for j in range(len(w)):
                if xx[j, j] > 0:
                    rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                    w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / xx[j, j]
            if np.abs(w - before).max(initial=0.0) <= enough * max(1.0, np.abs(w).max(initial=0.0)):
                break
        return self._with_intercept(w, mean)


def grams(sums: DataFrame, features: list[str], target: str, splits: int, stretch: str = "stretch") -> list[Gram]:
    """The Gram of each stretch, 0 to splits; a stretch without rows is all zeros."""
    at = {c: i for i, c in enumerate([ONE, *features, target])}
    out = [np.zeros((len(at), len(at))) for _ in range(splits + 1)]
    for r in sums.collect():  # (splits + 1) x pairs of features
        out[r[stretch]][at[r["a"]], at[r["b"]]] = out[r[stretch]][at[r["b"]], at[r["a"]]] = r["total"]
    return [Gram(features, target, s) for s in out]


def fold_grams(stretches: list[Gram]) -> list[Gram]:
    """Of the rows that folds 1 to splits are fitted on: running sums of the stretches before."""
    out = [stretches[0]]
    for g in stretches[1:-1]:
        out.append(out[-1] + g)
    return out
