"""The cash account: whole shares, costs, targets carried out one day later.

What a day does depends on the cash and shares that the one before left. Only
that is an ordered pass, over each day's few names that have a target or may
still be held: a group of strategies goes through the days together, each with
its own cash. The pass gives the shares held before and after; the ledger, the
order of trades, costs, cash, values and weights are columns of these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import panel as P
from ..functions.scratch import materialize, stored

#: Words for the two sides of a trade. Fixed values.
SELL, BUY = "卖出", "买入"


def price_column(df: DataFrame, price: str | None = None) -> str:
    """The given one, else adj_close, else close."""
    for c in [price] if price else ["adj_close", "close"]:
        if c in df.columns:
            return c
    raise KeyError(f"no price column {price or 'adj_close or close'}")


def affordable(cash: np.ndarray, account: np.ndarray, need: np.ndarray, unit_cost: np.ndarray) -> np.ndarray:
    """Shares bought of each name in turn, as many as the cash left in its account allows; accounts are in rising order."""
    bought = np.zeros(len(need), np.int64)
    rows = np.flatnonzero(need > 0)
    new = np.r_[True, account[rows][1:] != account[rows][:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    left = cash.copy()
    for k in range(place.max() + 1 if len(rows) else 0):  # every account's k-th name at once
        r = rows[place == k]
        bought[r] = np.minimum(need[r], np.maximum(0, (left[account[r]] // unit_cost[r]).astype(np.int64)))
        left[account[r]] -= bought[r] * unit_cost[r]
    return bought


def holdings(account: np.ndarray, name: np.ndarray, day: np.ndarray, price: np.ndarray, target: np.ndarray, capital: float, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares before and after of each row, for many accounts at once.

    Rows are in order of day, account and symbol; account, name (of an account's symbol) and day are numbers from 0.
    A name that isn't among its account's rows of the account's day before is not held.
    """
    before, after = np.zeros(len(day), np.int64), np.zeros(len(day), np.int64)
    if not len(day):
        return before, after
    cash, seen = np.full(account.max() + 1, float(capital)), np.full(account.max() + 1, -1)
    held, seen_name = np.zeros(name.max() + 1, np.int64), np.full(name.max() + 1, -1)
    cuts = np.r_[0, np.flatnonzero(np.diff(day)) + 1, len(day)]
    total = lambda a, x: np.bincount(a, x, len(cash))
    for low, high in zip(cuts[:-1], cuts[1:]):
        a, i, p, t = account[low:high], name[low:high], price[low:high], target[low:high]
        own = np.where((seen_name[i] == seen[a]) & (seen[a] >= 0), held[i], 0)
        priced, wanted = np.isfinite(p), (p > 0) & (t > 0)
        worth = cash + total(a, np.nan_to_num(p) * own)
        safe = np.where(wanted, p, 1.0)
        goal = np.where(wanted, np.floor(worth[a] * t / (safe * (1 + cost))), 0).astype(np.int64)
        now = np.where(priced, np.minimum(own, goal), own)
        cash = cash + total(a, np.where(priced, own - now, 0) * np.where(priced, p, 0.0)) * (1 - cost)
        first = np.lexsort((-t, a))  # an account's large targets are bought first, ties by symbol
        unit = safe * (1 + cost)
        bought = affordable(cash, a[first], np.where(wanted, goal - now, 0)[first], unit[first])
        now[first] += bought
        cash = cash - total(a[first], bought * unit[first])
        held[i], seen_name[i], seen[a] = now, low, low
        before[low:high], after[low:high] = own, now
    return before, after


def numbered(column: pa.Array) -> np.ndarray:
    """The place of each value among the column's distinct ones in order, nulls first."""
    coded = pc.dictionary_encode(column, null_encoding="encode")
    values = coded.dictionary.to_pylist()
    place = np.empty(len(values), np.int64)
    place[sorted(range(len(values)), key=lambda k: (values[k] is not None, values[k]))] = np.arange(len(values))
    return place[coded.indices.to_numpy()]


@dataclass
class SimulationResult:
    """names: a row a strategy, date and name in play; trades: a row a strategy and date, the daily ledger."""

    names: DataFrame
    trades: DataFrame
    meta: dict = field(default_factory=dict)

    @property
    def equity_curve(self) -> DataFrame:
        return self.trades.select("strategy", "date", F.col("nav").alias("equity"))

    @property
    def returns(self) -> DataFrame:
        return self.trades.select("strategy", "date", F.col("net_return").alias("ret"))

    @property
    def positions(self) -> DataFrame:
        """Names held at the end of a day, with their share of its value."""
        value = self.trades.select("strategy", "date", "portfolio_value")
        held = self.names.where("shares > 0").join(value, ["strategy", "date"])
        return held.select("strategy", "date", "symbol", "shares", F.coalesce(F.try_divide(F.col("shares") * F.col("price"), "portfolio_value"), F.lit(0.0)).alias("weight"))

    @property
    def trade_details(self) -> DataFrame:
        """Every trade in order (seq): a day's sales by symbol, then what is bought, large targets first."""
        day = Window.partitionBy("strategy", "date").orderBy(F.col("moved") > 0, F.when(F.col("moved") > 0, -F.col("target")), "symbol")
        all_ = Window.partitionBy("strategy").orderBy("date", "seq").rowsBetween(P.FAR, 0)
        t = self.names.where("moved != 0").withColumn("seq", F.row_number().over(day) - 1)
        start = self.trades.select("strategy", "date", (F.col("portfolio_value") + F.col("total_cost")).alias("_start"))
        t = t.join(start, ["strategy", "date"])
        so_far = F.sum("total_cost").over(day.rowsBetween(P.FAR, 0))
        return t.select(
            "strategy", "date", "seq", "symbol", F.when(F.col("moved") > 0, BUY).otherwise(SELL).alias("action"), F.abs("moved").alias("shares"), "price", "notional", "commission_cost", "slippage_cost", "total_cost",
            (F.lit(self.meta["initial_capital"]) + F.sum("flow").over(all_)).alias("cash_after"), F.col("shares").alias("position_after"), (F.col("_start") - so_far).alias("portfolio_value_after"),
        )

    def totals(self) -> DataFrame:
        """One row a strategy: average and total turnover, total costs, last value."""
        return self.trades.groupBy("strategy").agg(
            F.avg("turnover").alias("avg_turnover"), F.sum("turnover").alias("total_turnover"), F.sum("commission_cost").alias("total_commission"),
            F.sum("slippage_cost").alias("total_slippage"), F.max_by("portfolio_value", "date").alias("ending_value"),
        )


class CashAccountEngine:
    """Runs target weights against prices; `weights` may hold a column strategy."""

    def __init__(self, commission: float = 0.001, slippage: float = 0.001, price_col: str | None = None, initial_capital: float = 1_000_000.0):
        if commission < 0 or slippage < 0:
            raise ValueError("costs can't be negative")
        if initial_capital <= 0:
            raise ValueError("initial_capital must be positive")
        self.commission, self.slippage, self.price_col, self.capital = commission, slippage, price_col, float(initial_capital)

    def in_play(self, weights: DataFrame, market: DataFrame) -> DataFrame:
        """strategy, date, symbol, price, target of the names with a target on a day, or on the day before.

        Prices are carried forward, targets too, from the day after on which they
        are given; only names that ever have a target get rows of the grid.
        """
        price = price_column(market, self.price_col)
        ever = weights.where("weight > 0").select("strategy", "symbol").distinct()
        days = market.select("date").where("date is not null").distinct()
        own = market.select("date", "symbol", P.clean(F.col(price)).alias("_p")).join(ever.select("symbol").distinct(), "symbol", "left_semi")
        prices = P.densify(own, "_p", days_of=market).withColumn("price", P.ffill(F.col("_p"))).select("symbol", "date", "price")
        grid = prices.join(ever, "symbol").select("strategy", "symbol", "date", F.lit(0).alias("_kind"), "price", F.lit(None).cast("double").alias("weight"))
        given = weights.select("strategy", "symbol", "date", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("price"), F.col("weight").cast("double").alias("weight"))
        # a day's weights come after its row of the grid, and so hold from the day after
        both = grid.unionByName(given.join(F.broadcast(days), "date", "left_semi"))
        both = P.dealt(both, "strategy", "symbol", rows=self.most_rows(weights, market) + weights.count())
        w = Window.partitionBy("strategy", "symbol")
        last = F.last("weight", ignorenulls=True).over(w.orderBy("date", "_kind").rowsBetween(P.FAR, -1))
        both = both.withColumn("target", F.greatest(F.coalesce(last, F.lit(0.0)), F.lit(0.0))).where("_kind = 0")
        both = both.withColumn("_last", F.lag("target").over(w.orderBy("date")))
        return both.where("target > 0 or _last > 0").select("strategy", "date", "symbol", "price", "target")

    @staticmethod
    def most_rows(weights: DataFrame, market: DataFrame) -> int:
        """How many rows in_play() has at most, about: every day of every name that ever has a target."""
        names = weights.where("weight > 0").agg(F.approx_count_distinct(F.xxhash64("strategy", "symbol"))).first()[0]
        return names * market.select("date").where("date is not null").distinct().count()

    def run_simulation(self, weights: DataFrame, market: DataFrame) -> SimulationResult:
        """Every date of market and strategy of weights; a strategy without any target stays in cash."""
        if "strategy" not in weights.columns:
            weights = weights.withColumn("strategy", F.lit("strategy"))
        capital, cost = self.capital, self.commission + self.slippage
        price_column(market, self.price_col)  # there is one
        weights, market = stored(weights, "weights"), stored(market, "market")
        rows = self.most_rows(weights, market)
        groups = max(1, math.ceil(rows / P.PART_ROWS))

        def run(table: pa.Table) -> pa.Table:
            account, symbol, day = (numbered(table[c].combine_chunks()) for c in ("strategy", "symbol", "date"))
            order = np.lexsort((symbol, account, day))
            name = np.unique(account * (symbol.max() + 1) + symbol, return_inverse=True)[1]
            number = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
            both = holdings(account[order], name[order], day[order], number("price")[order], number("target")[order], capital, cost)
            back = np.argsort(order)
            return table.drop_columns("_group").append_column("held", pa.array(both[0][back])).append_column("shares", pa.array(both[1][back]))

        played = self.in_play(weights, market).withColumn("_group", F.pmod(F.xxhash64("strategy"), F.lit(groups)))
        played = played.repartition(groups, "_group")
        names = played.groupBy("_group").applyInArrow(run, "strategy string, date date, symbol string, price double, target double, held long, shares long")
        names = names.withColumn("moved", F.col("shares") - F.col("held"))
        names = names.withColumn("notional", F.coalesce(F.abs("moved") * F.col("price"), F.lit(0.0)))
        names = names.withColumns({"commission_cost": F.col("notional") * self.commission, "slippage_cost": F.col("notional") * self.slippage})
        names = names.withColumn("total_cost", F.col("commission_cost") + F.col("slippage_cost"))
        names = names.withColumn("flow", F.when(F.col("moved") > 0, -F.col("notional")).otherwise(F.col("notional")) - F.col("total_cost"))
        names = materialize(names, "account-names")  # every part of the result reads it

        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        side = lambda sign: F.sum(F.when(F.col("moved") * sign > 0, F.abs("moved")).otherwise(0)).cast("double")
        parts = ["moved", "notional", "commission_cost", "slippage_cost", "total_cost", "flow"]
        moves = names.select("strategy", "date", *parts, (F.col("shares") * F.col("price")).alias("_held"))
        # every day of every strategy, with or without names; one deal by strategy for the sums and the windows
        every = weights.select("strategy").distinct().crossJoin(F.broadcast(market.select("date").where("date is not null").distinct()))
        moves = P.dealt(moves.unionByName(every, allowMissingColumns=True), "strategy", rows=2 * rows)
        sums = moves.groupBy("strategy", "date").agg(
            total("notional").alias("trade_notional"), total("commission_cost").alias("commission_cost"), total("slippage_cost").alias("slippage_cost"), total("total_cost").alias("total_cost"),
            side(1).alias("buy_shares"), side(-1).alias("sell_shares"), total("flow").alias("_flow"), total("_held").alias("_worth"),
        )
        w = Window.partitionBy("strategy").orderBy("date")
        sums = sums.withColumn("cash", F.lit(capital) + F.sum("_flow").over(w.rowsBetween(P.FAR, 0)))
        sums = sums.withColumn("portfolio_value", F.col("cash") + F.col("_worth"))
        before = F.coalesce(F.lag("portfolio_value").over(w), F.lit(capital))
        start = F.col("portfolio_value") + F.col("total_cost")  # trades change the value by their costs only
        trades = sums.select(
            "strategy", "date", F.when(start > 0, F.col("trade_notional") / start).otherwise(0.0).alias("turnover"), "trade_notional", "commission_cost", "slippage_cost", "total_cost",
            "buy_shares", "sell_shares", "cash", "portfolio_value", (F.col("portfolio_value") / capital).alias("nav"), F.when(before > 0, F.col("portfolio_value") / before - 1).otherwise(0.0).alias("net_return"),
        )
        return SimulationResult(names, trades, {"initial_capital": capital, "commission_rate": self.commission, "slippage_rate": self.slippage})
