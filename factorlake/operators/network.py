"""A small network for any number of rows, trained where the rows lie.

Layers are linear, batch normalisation, rectifier and dropout; the last is linear.
A round sends the weights to all tasks; each goes once through its rows in
batches, with Adam steps from there, and gives its weights and the moments that
it saw; Spark averages them by rows, parameter by parameter, so that the driver
gets one set of weights, whatever the rows and tasks. The last rows in time are
held out: the round's first weights are tried on them, the rate is halved when
that stops getting better, and training ends when it stays so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize

EPS, MOMENTUM = 1e-5, 0.1
AVERAGED = "k int, v double, n double"


class Net:
    """Weights w, b of each layer; scale g and shift s, and running mean m and variance v, of each but the last."""

    def __init__(self, sizes: list[int], dropout: float = 0.0, seed: int = 42):
        r = np.random.default_rng(seed)
        self.sizes, self.dropout = list(sizes), dropout
        self.p: dict[str, np.ndarray] = {}
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            self.p[f"w{k}"], self.p[f"b{k}"] = r.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)
            if k < len(sizes) - 2:
                self.p |= {f"g{k}": np.ones(b), f"s{k}": np.zeros(b), f"m{k}": np.zeros(b), f"v{k}": np.ones(b)}

    @property
    def learned(self) -> list[str]:
        return [k for k in self.p if k[0] in "wbgs"]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.p])

    def load(self, flat: np.ndarray) -> Net:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        last = len(self.sizes) - 2
        for k in range(last):
            z = x @ self.p[f"w{k}"] + self.p[f"b{k}"]
            x = np.maximum((z - self.p[f"m{k}"]) / np.sqrt(self.p[f"v{k}"] + EPS) * self.p[f"g{k}"] + self.p[f"s{k}"], 0)
        return (x @ self.p[f"w{last}"] + self.p[f"b{last}"])[:, 0]

    def reach(self) -> np.ndarray:
        """How much of each input can come through, by absolute weights."""
        out = np.eye(self.sizes[0])
        for k in range(len(self.sizes) - 1):
            w = np.abs(self.p[f"w{k}"])
            out = out @ (w * np.abs(self.p[f"g{k}"]) / np.sqrt(self.p[f"v{k}"] + EPS) if f"g{k}" in self.p else w)
        return out[:, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray, r: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(mean squared error, its gradients, the batch's moments m and v of each layer). r: for dropout; without, nothing drops."""
        n, last, kept, moments = len(x), len(self.sizes) - 2, [], {}
        for k in range(last):
            z = x @ self.p[f"w{k}"] + self.p[f"b{k}"]
            mean, var = z.mean(axis=0), z.var(axis=0)
            moments |= {f"m{k}": mean, f"v{k}": var * n / max(n - 1, 1)}
            root = np.sqrt(var + EPS)
            hat = (z - mean) / root
            a = hat * self.p[f"g{k}"] + self.p[f"s{k}"]
            on = (a > 0).astype(float)
            if r is not None and self.dropout:
                on *= (r.random(a.shape) >= self.dropout) / (1 - self.dropout)
            kept.append((x, hat, root, on))
            x = a * on
        out = (x @ self.p[f"w{last}"] + self.p[f"b{last}"])[:, 0]
        d = (2 * (out - y) / n)[:, None]
        grads = {f"w{last}": x.T @ d, f"b{last}": d.sum(axis=0)}
        d = d @ self.p[f"w{last}"].T
        for k in range(last - 1, -1, -1):
            x, hat, root, on = kept[k]
            d = d * on
            grads |= {f"g{k}": (d * hat).sum(axis=0), f"s{k}": d.sum(axis=0)}
            d = d * self.p[f"g{k}"]
            d = (d - d.mean(axis=0) - hat * (d * hat).mean(axis=0)) / root
            grads |= {f"w{k}": x.T @ d, f"b{k}": d.sum(axis=0)}
            d = d @ self.p[f"w{k}"].T
        return float(np.mean((out - y) ** 2)), grads, moments


class Adam:
    def __init__(self, net: Net):
        self.m = {k: np.zeros_like(net.p[k]) for k in net.learned}
        self.v = {k: np.zeros_like(net.p[k]) for k in net.learned}
        self.t = 0

    def step(self, net: Net, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, d in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            net.p[k] = net.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def one_round(rows: DataFrame, net: Net, rate: float, batch: int, seed: int) -> tuple[np.ndarray | None, float | None]:
    """(weights after all tasks have gone through their rows, mean squared error of the weights before on held-out rows). rows: x (array), y, held."""
    flat, sizes, dropout = net.flat(), net.sizes, net.dropout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, own = Net(sizes, dropout).load(flat), Net(sizes, dropout).load(flat)
        adam, n, error, held_n, left = Adam(own), 0, 0.0, 0, None

        def steps(x: np.ndarray, y: np.ndarray) -> None:
            r = np.random.default_rng([seed, n])
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                if len(some) > 1 or len(x) == 1:
                    _, grads, moments = own.gradients(x[some], y[some], r)
                    adam.step(own, grads, rate)
                    for k, v in moments.items():
                        own.p[k] = (1 - MOMENTUM) * own.p[k] + MOMENTUM * v

        for pdf in batches:
            if not len(pdf):
                continue
            x, y, held = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float), pdf["held"].to_numpy(bool)
            if held.any():
                error += float(((before.predict(x[held]) - y[held]) ** 2).sum())
                held_n += int(held.sum())
            if (~held).any():
                steps(x[~held], y[~held])
                n += int((~held).sum())
        if n:
            v = own.flat()
            yield pd.DataFrame({"k": np.arange(len(v), dtype=np.int32), "v": v * n, "n": np.full(len(v), float(n))})
        if held_n:
            yield pd.DataFrame({"k": np.array([-1], np.int32), "v": [error], "n": [float(held_n)]})

    means = rows.mapInPandas(run, AVERAGED).groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()  # one row a parameter
    error = means.loc[means["k"] == -1, "v"]
    weights = means[means["k"] >= 0].sort_values("k")["v"].to_numpy()
    return (weights if len(weights) else None), (float(error.iloc[0]) if len(error) else None)


class Fitted:
    """A trained net with the scales of features and target."""

    def __init__(self, features: list[str], net: Net, mean: np.ndarray, sd: np.ndarray, y_mean: float, y_sd: float, errors: list[float]):
        self.features, self.net, self.mean, self.sd, self.y_mean, self.y_sd, self.errors = features, net, mean, sd, y_mean, y_sd, errors

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        net, mean, sd, y_mean, y_sd = self.net, self.mean, self.sd, self.y_mean, self.y_sd

        @F.pandas_udf("double")
        def run(x: pd.DataFrame) -> pd.Series:
            return pd.Series(net.predict((x.to_numpy(float) - mean) / sd) * y_sd + y_mean if len(x) else [], dtype=float)

        return df.withColumn(out, run(F.struct(*self.features)))


def fit(df: DataFrame, features: list[str], target: str, hidden=(128, 64, 32), epochs: int = 100, rate: float = 1e-3, batch: int = 1024, dropout: float = 0.2, held: float = 0.2, patience: int = 10, seed: int = 42, rows_a_task: int = 200_000) -> Fitted:
    """A net fitted to all rows without nulls (date, symbol, features, target); the last `held` of them in time are held out."""
    from .ml import row_numbers

    df = df.dropna(subset=[*features, target])
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("y"), F.stddev_pop(target).alias("ys"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not s["n"]:
        raise ValueError("no rows to fit")
    mean, sd = np.array([s[f"m{i}"] for i in range(len(features))]), np.array([s[f"s{i}"] or 1.0 for i in range(len(features))])
    y_mean, y_sd = s["y"], s["ys"] or 1.0
    scaled = F.array(*[(F.col(c).cast("double") - float(m)) / float(d) for c, m, d in zip(features, mean, sd)])
    cut = s["n"] - int(s["n"] * held)
    rows = row_numbers(df).select("date", "symbol", scaled.alias("x"), ((F.col(target).cast("double") - float(y_mean)) / float(y_sd)).alias("y"), (F.col("_i") >= cut).alias("held"))
    # dealt by a hash, so that tasks see all times
    rows = materialize(rows.repartition(max(1, -(-s["n"] // rows_a_task)), F.xxhash64("date", "symbol")).sortWithinPartitions("date", "symbol").select("x", "y", "held"), "network-rows")
    net = Net([len(features), *hidden, 1], dropout, seed)
    best, least, stale, errors = net.flat(), np.inf, 0, []
    for k in range(epochs + 1):
        now = net.flat()
        weights, error = one_round(rows, net, rate, batch, seed + k)
        if error is not None:
            errors.append(error)
            if error < least - 1e-6:
                best, least, stale = now, error, 0
            else:
                stale += 1
                if stale % max(1, patience // 2) == 0:
                    rate /= 2
                if stale >= patience:
                    break
        else:
            best = now if weights is None or k == epochs else weights
        if weights is None or k == epochs:
            break
        net.load(weights)
    return Fitted(list(features), net.load(best), mean, sd, float(y_mean), float(y_sd), errors)
