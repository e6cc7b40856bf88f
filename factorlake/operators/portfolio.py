"""From signals to target weights: tradable names, rebalance days, top-k equal weights."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import panel as P


def tradable(market: DataFrame) -> DataFrame:
    """date, symbol, tradable: there is a close, and a positive volume if volumes are given."""
    ok = F.col("close").isNotNull()
    if "volume" in market.columns:
        ok &= F.coalesce(F.col("volume"), F.lit(0)) > 0
    return market.select("date", "symbol", ok.alias("tradable"))


def rebalance_dates(market: DataFrame, freq: str = "W-FRI") -> DataFrame:
    return P.last_dates(market, freq)


def picked_weights(signals: DataFrame, market: DataFrame, top_k: int = 5, min_signal: float = 0.0, freq: str = "W-FRI") -> DataFrame:
    """date, symbol, weight of the names picked on rebalance days: the top_k largest signals above min_signal among tradable names, ties by symbol."""
    days = rebalance_dates(market, freq)
    can = tradable(market).where("tradable").join(days, "date", "left_semi")
    s = signals.select("date", "symbol", P.clean(F.col("value")).alias("value")).where(F.col("value") > min_signal)
    w = Window.partitionBy("date").orderBy(F.col("value").desc(), "symbol")
    top = s.join(can, ["date", "symbol"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k)
    return top.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))).select("date", "symbol", "weight")


def hold(weights: DataFrame, market: DataFrame, days: DataFrame) -> DataFrame:
    """symbol, date_idx, date, weight on market's grid: what was picked on the last of `days`, 0 before the first."""
    grid = P.densify(market.select("date", "symbol"))
    marks = days.select("date", F.lit(0.0).alias("_zero"))
    grid = grid.join(marks, "date", "left").join(weights, ["date", "symbol"], "left")
    w = Window.partitionBy("symbol").orderBy("date_idx")
    return grid.select("symbol", "date_idx", "date", F.coalesce(P.ffill(F.coalesce("weight", "_zero"), w), F.lit(0.0)).alias("weight"))


def shifted(targets: DataFrame) -> DataFrame:
    """Targets as they hold one day later, 0 on the first."""
    w = Window.partitionBy("symbol").orderBy("date_idx")
    return targets.withColumn("weight", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))


class BasePortfolioManager(ABC):
    @abstractmethod
    def generate_target_weights(self, signals: DataFrame, market: DataFrame) -> DataFrame: ...


class TopKPortfolio(BasePortfolioManager):
    """Long the top k, equally weighted, held between rebalance days; in cash where nothing passes."""

    def __init__(self, top_k: int = 5, min_signal: float = 0.0, rebalance_frequency: str = "W-FRI"):
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        self.top_k, self.min_signal, self.freq = top_k, min_signal, rebalance_frequency

    def generate_target_weights(self, signals: DataFrame, market: DataFrame) -> DataFrame:
        """date, symbol, weight of every day and name."""
        picked = picked_weights(signals, market, self.top_k, self.min_signal, self.freq)
        return hold(picked, market, rebalance_dates(market, self.freq)).select("date", "symbol", "weight")


def topk_dropout(signals: DataFrame, market: DataFrame, topk: int = 50, n_drop: int | None = None) -> DataFrame:
    """date, symbol, weight of a top-k portfolio that replaces at most n_drop (topk // 5) names a day, keyed by nothing else.

    Each day depends on what is held, so that one ordered pass makes it: over
    the day's names only, `topk` of which are state.
    """
    n_drop = topk // 5 if n_drop is None else n_drop
    can = tradable(market).where("tradable").join(signals.where("value is not null"), ["date", "symbol"]).select("date", "symbol", "value")
    # only names that can come into play reach the pass: a day's best topk + n_drop, and all that are held were such on some day
    w = Window.partitionBy("date").orderBy(F.col("value").desc(), "symbol")
    rank = can.withColumn("rank", F.row_number().over(w))
    ever = rank.where(F.col("rank") <= topk + n_drop).select("symbol").distinct()
    rows = rank.join(ever, "symbol", "left_semi").withColumn("strategy", F.lit("topk_dropout"))

    def run(pdf):
        import pandas as pd

        held, out = set(), []
        for date, day in pdf.sort_values(["date", "rank"]).groupby("date", sort=True):
            order = day["symbol"].tolist()
            place = {s: i for i, s in enumerate(order)}
            own = sorted((s for s in held if s in place), key=place.get)
            new = [s for s in order if s not in held][: n_drop + max(0, topk - len(held))]
            both = sorted(own + new, key=place.get)
            drop = {s for s in own if s in both[-n_drop:]} if n_drop and own else set()
            buy = new[: max(0, len(drop) + topk - len(held))]
            held = (held - drop) | set(buy)
            out += [(date, s, 1.0 / len(held)) for s in sorted(held)]
        return pd.DataFrame(out, columns=["date", "symbol", "weight"])

    return rows.groupBy("strategy").applyInPandas(run, "date date, symbol string, weight double")
