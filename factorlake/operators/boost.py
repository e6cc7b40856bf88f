"""Boosted trees of second order: quantile bins, gradient histograms, leaf-wise growth.

Features become bin numbers once, in a stored table. A tree grows by passes over
it: tasks add up rows, gradients and second derivatives by leaf, feature and bin,
Spark adds up the tasks' histograms, and the driver, which sees no rows, picks
splits by their regularised gain, always of the leaf that gains most. A pass makes
the histograms of the children of all open leaves, so that a tree needs about as
many passes as it has levels. Predictions so far are stored again every STORED
trees; in between, tasks add the newer trees themselves.

Losses are squares, for which gradients are prediction less target, and second
derivatives are 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import drop_written, materialize, written

#: Trees after which predictions are stored anew.
STORED = 10
HISTOGRAM = "leaf int, feature int, bin int, n double, g double"


def bin_edges(df: DataFrame, features: list[str], bins: int = 255, kind: str = "quantile") -> list[list[float]]:
    """Rising edges of each feature, at most bins - 1: approximate quantiles, or equal widths from least to largest value."""
    if kind == "width":
        ends = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(features)], *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(features)]).first()
        ends = [(ends[f"lo_{i}"], ends[f"hi_{i}"]) for i in range(len(features))]
        return [sorted({lo + (hi - lo) * k / bins for k in range(1, bins)}) if lo is not None and hi > lo else [] for lo, hi in ends]
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(c, shares, 20 * bins).alias(f"q_{i}") for i, c in enumerate(features)]).first()
    return [sorted({x for x in (found[f"q_{i}"] or []) if x is not None}) for i in range(len(features))]


def binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """df with _bins: for each feature, how many of its edges lie below its value."""
    schema = "array<short>"

    @F.pandas_udf(schema)
    def run(values: pd.DataFrame) -> pd.Series:
        at = [np.searchsorted(np.asarray(e), values.iloc[:, i].to_numpy(float), side="left") for i, e in enumerate(edges)]
        return pd.Series(list(np.stack(at, axis=1).astype(np.int16)) if len(values) else [], dtype=object)

    return df.withColumn("_bins", run(F.struct(*features)))


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root. A row goes left if its bin of the node's feature is at most the node's bin."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        for x, y in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x += [y, y]
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, a, b
        return a, b

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x features)."""
        node = np.zeros(len(bins), np.int64)
        feature, at, left, right = map(np.asarray, (self.feature, self.bin, self.left, self.right))
        inner = feature[node] >= 0
        while inner.any():
            k = np.flatnonzero(inner)
            own = node[k]
            node[k] = np.where(bins[k, feature[own]] <= at[own], left[own], right[own])
            inner[k] = feature[node[k]] >= 0
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(bins)]


def _sum(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += t.predict(bins)
    return out


def _adder(trees: list[Tree]):
    """A function of the column _bins: what trees add up to."""
    trees = list(trees)

    @F.pandas_udf("double")
    def run(bins: pd.Series) -> pd.Series:
        return pd.Series(_sum(trees, np.stack(bins.to_numpy()).astype(np.int64)) if len(bins) else [], dtype=float)

    return run


def histograms(rows: DataFrame, target: str, trees: list[Tree], tree: Tree, tried: dict[int, tuple[int, int]], n_features: int, n_bins: int, sampled: tuple[float, int] = (1.0, 0)) -> DataFrame:
    """leaf, feature, bin, n (rows) and g (summed gradients) over rows (_bins, _score and target).

    trees: those that _score doesn't hold yet; tree: the one that grows; tried:
    leaf -> (feature, bin) of the split whose sides the histograms are of, as
    leaves 2 x leaf and 2 x leaf + 1; without tried, those of the root, leaf 0.
    sampled: share of the rows, by a hash of their columns, and a seed.
    """
    share, seed = sampled
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = {leaf: k for k, leaf in enumerate(sorted(tried))} if tried else {0: 0}
        size = (2 * len(slots) if tried else 1) * n_features * n_bins
        n, g = np.zeros(size), np.zeros(size)
        feature_at = np.arange(n_features) * n_bins
        for pdf in batches:
            if not len(pdf):
                continue
            bins = np.stack(pdf["_bins"].to_numpy()).astype(np.int64)
            grad = pdf["_score"].to_numpy(float) + _sum(trees, bins) - pdf[target].to_numpy(float)
            side = np.zeros(len(bins), np.int64)
            if tried:
                leaf = tree.leaves(bins)
                side = np.full(len(bins), -1)
                for own, k in slots.items():
                    on = np.flatnonzero(leaf == own)
                    f, b = tried[own]
                    side[on] = 2 * k + (bins[on, f] > b)
                keep = side >= 0
                bins, grad, side = bins[keep], grad[keep], side[keep]
            at = ((side * n_features * n_bins)[:, None] + feature_at + bins).ravel()
            n += np.bincount(at, minlength=size)
            g += np.bincount(at, np.repeat(grad, n_features), minlength=size)
        some = np.flatnonzero(n)
        sides, rest = np.divmod(some, n_features * n_bins)
        names = np.array([2 * leaf + s for leaf in sorted(tried) for s in (0, 1)] if tried else [0])
        yield pd.DataFrame({"leaf": names[sides].astype(np.int32), "feature": (rest // n_bins).astype(np.int32), "bin": (rest % n_bins).astype(np.int32), "n": n[some], "g": g[some]})

    return rows.select("_bins", "_score", target).mapInPandas(run, HISTOGRAM).groupBy("leaf", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


def best_split(n: np.ndarray, g: np.ndarray, reg: float, least: float, cost: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split by histograms (features x bins); gain 0 or less if none is worth it."""
    n_left, g_left = n.cumsum(axis=1), g.cumsum(axis=1)
    n_all, g_all = n_left[:, -1:], g_left[:, -1:]
    score = lambda g, h: g * g / np.maximum(h + reg, 1e-12)
    gain = (score(g_left, n_left) + score(g_all - g_left, n_all - n_left) - score(g_all, n_all)) / 2 - cost
    gain[(n_left < least) | (n_all - n_left < least)] = -np.inf
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


@dataclass
class Boosted:
    """A fitted sum of trees over binned features."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    gains: np.ndarray

    def transform(self, df: DataFrame, out: str = "_y") -> DataFrame:
        return binned(df, self.features, self.edges).withColumn(out, self.base + _adder(self.trees)("_bins")).drop("_bins")


def fit(df: DataFrame, features: list[str], target: str, rounds: int = 500, rate: float = 0.05, leaves: int = 31, bins: int = 255, reg: float = 1.0, least: float = 20.0, cost: float = 0.0, subsample: float = 1.0, seed: int = 42, edges: list[list[float]] | None = None) -> Boosted:
    """Trees fitted to all rows without nulls. least: rows that a leaf has at least; reg and cost: penalties of squared leaf values, and of a leaf."""
    rows = df.dropna(subset=[*features, target])
    edges = edges or bin_edges(rows, features, bins)
    base = rows.agg(F.avg(target)).first()[0] or 0.0
    rows = binned(rows.select(*features, F.col(target).cast("double").alias(target)), features, edges)
    rows = rows.select("_bins", target, F.lit(float(base)).alias("_score"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "boost-rows")  # from here on a row keeps its number
    n_bins, n_features = max(map(len, edges), default=0) + 1, len(features)
    out = Boosted(list(features), edges, float(base), [], np.zeros(n_features))
    fresh: list[Tree] = []
    for k in range(rounds):
        tree = _grow(rows, target, fresh, n_features, n_bins, leaves, reg, least, cost, (subsample, seed + k), out.gains)
        tree.value = [rate * v for v in tree.value]
        if len(tree.feature) == 1 and abs(tree.value[0]) < 1e-15:
            break
        out.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == STORED and k + 1 < rounds:
            older = written(rows.sparkSession)[-1:]
            rows = materialize(rows.withColumn("_score", F.col("_score") + _adder(fresh)("_bins")), "boost-rows")
            drop_written(rows.sparkSession, older)
            fresh = []
    return out


def _grow(rows: DataFrame, target: str, trees: list[Tree], n_features: int, n_bins: int, leaves: int, reg: float, least: float, cost: float, sampled: tuple[float, int], gains: np.ndarray) -> Tree:
    tree = Tree()

    def pass_over(tried: dict[int, tuple[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found = histograms(rows, target, trees, tree, tried, n_features, n_bins, sampled).toPandas()  # leaves x features x bins numbers
        out = {}
        for leaf, h in found.groupby("leaf"):
            n, g = np.zeros((n_features, n_bins)), np.zeros((n_features, n_bins))
            n[h["feature"], h["bin"]], g[h["feature"], h["bin"]] = h["n"], h["g"]
            out[int(leaf)] = (n, g)
        return out

    none = (np.zeros((n_features, n_bins)), np.zeros((n_features, n_bins)))
    open_: list[tuple] = []  # (-gain, node, feature, bin): leaves that are worth a split

    def take(node: int, h: tuple[np.ndarray, np.ndarray]) -> None:
        n, g = h[0][0].sum(), h[1][0].sum()
        tree.value[node] = -g / max(n + reg, 1e-12)
        gain, f, b = best_split(*h, reg, least, cost)
        if gain > 0:
            heapq.heappush(open_, (-gain, node, f, b))

    take(0, pass_over({}).get(0, none))
    n_leaves, known = 1, {}
    while open_ and n_leaves < leaves:
        if open_[0][1] not in known:  # the sides of all open leaves that may still be split, in one pass
            tried = {node: (f, b) for _, node, f, b in heapq.nsmallest(leaves - n_leaves, open_) if node not in known}
            made = pass_over(tried)
            known |= {node: (made.get(2 * node, none), made.get(2 * node + 1, none)) for node in tried}
        gain, node, f, b = heapq.heappop(open_)
        left, right = tree.split(node, f, b)
        gains[f] -= gain
        n_leaves += 1
        for child, h in zip((left, right), known.pop(node)):
            take(child, h)
    return tree
