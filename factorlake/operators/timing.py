"""Evaluation of timing factors, for all symbols at once, on the symbols' own rows.

A signal that stands at a day's close fills at the next day's close, and so
earns the return of the day after that: position(t) = sign(signal(t - 2)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import panel as P
from ..functions.scratch import stored

KEY = ["factor", "symbol"]


def _w():
    return P.by_date(*KEY)


def joined(signals: DataFrame, market: DataFrame, price: str = "close") -> DataFrame:
    """factor, symbol, date, signal, price and ret (change of the price from the symbol's row before)."""
    own = P.pct_change(P.dealt(market.select("symbol", "date", F.col(price).alias("price"))), "price", "ret")
    signals = stored(signals.select("factor", "symbol", "date", F.col("value").alias("signal")), "signals")
    # parts of so many rows for the join, and by symbol for the windows that follow
    n = signals.count()
    both = P.dealt(signals, "symbol", "date", rows=n).join(P.dealt(own, "symbol", "date", rows=n), ["symbol", "date"])
    return P.dealt(both.select("factor", "symbol", "date", "signal", "price", "ret"), rows=n)


def direction_win_rate(rows: DataFrame) -> DataFrame:
    """factor, symbol, direction_win_rate: share of days with a signal on which the price went its way; null without any."""
    on = rows.where("signal is not null and ret is not null and signal != 0")
    return on.groupBy(*KEY).agg(F.avg((F.signum("signal") == F.signum("ret")).cast("int")).alias("direction_win_rate"))


def strategy_returns(rows: DataFrame) -> DataFrame:
    """factor, symbol, date, ret, nav of going long, short or flat by the signal, without costs."""
    df = rows.where("signal is not null and price is not null")
    move = F.coalesce(F.try_divide("price", F.lag("price").over(_w())) - 1, F.lit(0.0))
    df = df.withColumn("_r", F.coalesce(F.signum(F.lag("signal", 2).over(_w())), F.lit(0.0)) * move)
    return df.select(*KEY, "date", F.col("_r").alias("ret")).withColumn("nav", P.cumprod(1 + F.col("ret"), _w()))


def benchmark_close(benchmark: DataFrame, symbol: str | None = None, price: str = "close") -> DataFrame:
    """date, price: of one symbol, or each date's first symbol's."""
    if symbol is not None:
        benchmark = benchmark.where(F.col("symbol") == symbol)
    return benchmark.where(F.col(price).isNotNull()).groupBy("date").agg(F.min_by(price, "symbol").alias("price"))


def buy_and_hold(close: DataFrame) -> DataFrame:
    """date, ret, nav of holding from the first date; the calendar has a row a day."""
    w = Window.orderBy("date")
    first = F.first("price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return close.select("date", (F.try_divide("price", F.lag("price").over(w)) - 1).alias("ret"), F.try_divide("price", first).alias("nav"))


def excess_returns(strategy: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """factor, symbol, date, excess: less the benchmark's return on the dates that both have; without a benchmark, the return itself."""
    if benchmark is None:
        return strategy.select(*KEY, "date", F.col("ret").alias("excess"))
    both = strategy.join(F.broadcast(benchmark.select("date", F.col("ret").alias("_b"))), "date")
    return both.where("ret is not null and _b is not null").select(*KEY, "date", (F.col("ret") - F.col("_b")).alias("excess"))


def excess_curve(excess: DataFrame) -> DataFrame:
    """factor, symbol, date, value: 100 compounded by the excess."""
    return excess.select(*KEY, "date", (100 * P.cumprod(1 + F.col("excess"), _w())).alias("value"))


def underwater(strategy: DataFrame) -> DataFrame:
    """factor, symbol, date, drawdown of the strategy's curve, which starts at 1."""
    peak = F.greatest(F.lit(1.0), F.max("nav").over(_w().rowsBetween(P.FAR, 0)))
    return strategy.select(*KEY, "date", (F.col("nav") / peak - 1).alias("drawdown"))


def trades(rows: DataFrame) -> DataFrame:
    """factor, symbol, date, price, position (after), action: where the position, the sign of the signal of the row before, changes."""
    own = rows.withColumn("position", F.coalesce(F.signum(F.lag("signal").over(_w())), F.lit(0.0)).cast("int"))
    own = own.withColumn("_before", F.coalesce(F.lag("position").over(_w()), F.lit(0)))
    return own.where("position != _before").select(*KEY, "date", "price", "position", F.when(F.col("position") > F.col("_before"), "buy").otherwise("sell").alias("action"))


def _metrics(df: DataFrame, ret: str, prefix: str, per_year: int, more_bars: int, risk_free: float = 0.0) -> DataFrame:
    nav = P.cumprod(1 + F.col(ret), _w())
    peak_from_start = lambda: F.try_divide("_nav", F.greatest(F.lit(1.0), F.max("_nav").over(_w().rowsBetween(P.FAR, 0)))) - 1
    s = df.withColumn("_nav", nav).withColumn("_dd", peak_from_start())
    s = s.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.product(1 + F.col(ret)).alias("_p"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.min("_dd").alias("_dd"))
    annual = F.when(F.col("_p") > 0, F.pow("_p", F.lit(float(per_year)) / (F.col("n") + more_bars)) - 1).otherwise(-1.0)
    s = s.withColumn("_a", annual)
    sharpe = F.try_divide(F.col("_m") - risk_free / per_year, "_s") * F.sqrt(F.lit(float(per_year)))
    return s.select(*KEY, F.col("n").alias(f"{prefix}n"), F.col("_a").alias(f"{prefix}annual_return"), F.abs("_dd").alias(f"{prefix}max_drawdown"), sharpe.alias(f"{prefix}sharpe"), F.try_divide("_a", F.abs("_dd")).alias(f"{prefix}calmar"))


def summary(signals: DataFrame, market: DataFrame, benchmark: DataFrame | None = None, benchmark_symbol: str | None = None, price: str = "close", per_year: int = 252, risk_free: float = 0.0, digits: int = 4) -> DataFrame:
    """One row a factor and symbol: win rate, annual return, drawdown, Sharpe, Calmar, and the excess's annual return and Calmar.

    The excess curve has one bar more than it has returns, which its annual return counts.
    """
    rows = joined(signals, market, price)
    own = strategy_returns(rows)
    bench = buy_and_hold(benchmark_close(benchmark, benchmark_symbol, price)) if benchmark is not None else None
    a = _metrics(own, "ret", "", per_year, 0, risk_free)
    e = _metrics(excess_returns(own, bench), "excess", "excess_", per_year, 1).where("excess_n >= 2")
    s = a.join(direction_win_rate(rows), KEY, "left").join(e.select(*KEY, "excess_annual_return", "excess_calmar"), KEY, "left")
    names = ["direction_win_rate", "annual_return", "max_drawdown", "sharpe", "calmar", "excess_annual_return", "excess_calmar"]
    return s.select(*KEY, *[F.round(c, digits).alias(c) for c in names])


class TimingReport:
    """The measures of timing factors on symbols; parts are DataFrames keyed by factor and symbol."""

    def __init__(self, signals: DataFrame, market: DataFrame, symbol: str | None = None, benchmark: DataFrame | None = None, benchmark_symbol: str | None = None, price: str = "close", per_year: int = 252, risk_free: float = 0.0):
        if symbol is not None:
            market, signals = market.where(F.col("symbol") == symbol), signals.where(F.col("symbol") == symbol)
            if market.isEmpty():
                raise KeyError(f"no rows for symbol {symbol}")
        self.signals, self.market, self.price, self.per_year, self.risk_free = signals, market, price, per_year, risk_free
        self.benchmark, self.benchmark_symbol = benchmark, benchmark_symbol

    def rows(self) -> DataFrame:
        return joined(self.signals, self.market, self.price)

    def strategy_returns(self) -> DataFrame:
        return strategy_returns(self.rows()).drop("nav")

    def nav(self) -> DataFrame:
        return strategy_returns(self.rows()).drop("ret")

    def benchmark_nav(self) -> DataFrame | None:
        if self.benchmark is None:
            return None
        return buy_and_hold(benchmark_close(self.benchmark, self.benchmark_symbol, self.price)).select("date", "nav")

    def direction_win_rate(self) -> DataFrame:
        return direction_win_rate(self.rows())

    def summary(self) -> DataFrame:
        return summary(self.signals, self.market, self.benchmark, self.benchmark_symbol, self.price, self.per_year, self.risk_free)

    def to_dict(self) -> dict:
        return {(r.factor, r.symbol): {k: v for k, v in r.asDict().items() if k not in KEY} for r in self.summary().collect()}

    def print(self) -> None:
        print(self.summary().orderBy(*KEY).toPandas().to_string(index=False))
