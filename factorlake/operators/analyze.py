"""Strategy statistics and the frames of its report, per strategy (and benchmark)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import panel as P
from .simulate import SimulationResult, price_column


def _w():
    return P.by_date("strategy")


def benchmark_returns(market: DataFrame, price: str | None = None) -> DataFrame:
    """date, symbol, ret of every benchmark on the union of dates, 0 where there is none; benchmarks without any price are left out."""
    price = price_column(market, price)
    grid = P.pct_change(P.densify(market, price), price, "ret")
    some = market.where(F.col(price).isNotNull()).select("symbol").distinct()
    return grid.join(some, "symbol", "left_semi").select("date", "symbol", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def equal_weight_benchmark(market: DataFrame, price: str = "close", name: str = "EW") -> DataFrame:
    """date, symbol (the name), ret of the mean price over all symbols."""
    mean = market.groupBy("date").agg(F.avg(price).alias("close")).withColumn("symbol", F.lit(name))
    return P.pct_change(mean, "close", "ret").select("date", "symbol", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def annual_return(product: Column, n: Column, per_year: int) -> Column:
    return F.when(n == 0, 0.0).when(product <= 0, -1.0).otherwise(F.pow(product, F.lit(float(per_year)) / n) - 1)


def sharpe(mean: Column, sd: Column, per_year: int, risk_free: float = 0.0) -> Column:
    return F.when(sd > 0, (mean - risk_free / per_year) / sd * F.sqrt(F.lit(float(per_year)))).otherwise(0.0)


def drawdowns(returns: DataFrame, ret: str, keys: list[str]) -> DataFrame:
    """keys, date, dd: the compounded curve below its peak so far."""
    w = Window.partitionBy(*keys).orderBy("date")
    nav = returns.withColumn("_nav", P.cumprod(1 + F.coalesce(ret, F.lit(0.0)), w))
    return nav.select(*keys, "date", P.drawdown("_nav", w).alias("dd"))


class StrategyAnalyzer:
    """Measures of a simulation; benchmarks: date, symbol, ret."""

    def __init__(self, result: SimulationResult, benchmarks: DataFrame | None = None, per_year: int = 252, risk_free: float = 0.0, name: str = "Strategy"):
        self.result, self.benchmarks, self.per_year, self.risk_free, self.name = result, benchmarks, per_year, risk_free, name

    def _returns(self) -> DataFrame:
        return self.result.returns.select("strategy", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))

    def nav(self) -> DataFrame:
        """strategy, date, nav, drawdown."""
        return self.result.trades.select("strategy", "date", "nav").withColumn("drawdown", P.drawdown("nav", _w()))

    def summary_stats(self) -> DataFrame:
        """One row a strategy; profit_loss_ratio is null where gains meet no loss."""
        r = self._returns()
        s = r.groupBy("strategy").agg(
            F.count(F.lit(1)).alias("_n"), F.product(1 + F.col("ret")).alias("_p"), F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"),
            F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("_g"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("_l"),
        )
        nav = self.nav()
        depth = nav.groupBy("strategy").agg(F.abs(F.min("drawdown")).alias("max_drawdown"), (F.max_by("nav", "date") - 1).alias("total_return"))
        length = P.longest_run(nav, ["strategy"], "date", F.col("drawdown") < 0, "max_drawdown_duration")
        s = s.join(self.result.totals(), "strategy").join(depth, "strategy").join(length, "strategy")
        s = s.withColumn("annual_return", annual_return(F.col("_p"), F.col("_n"), self.per_year))
        ratio = F.when(F.col("_g").isNull(), 0.0).otherwise(F.try_divide("_g", F.abs("_l")))
        return s.select(
            "strategy", F.lit(self.result.meta.get("initial_capital")).alias("initial_capital"), "ending_value", "total_return", "annual_return",
            (F.col("_s") * F.sqrt(F.lit(float(self.per_year)))).alias("annual_volatility"), sharpe(F.col("_m"), F.col("_s"), self.per_year, self.risk_free).alias("sharpe_ratio"),
            F.when(F.col("max_drawdown") > 0, F.col("annual_return") / F.col("max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
            "max_drawdown", "max_drawdown_duration", "win_rate", ratio.alias("profit_loss_ratio"), F.col("avg_turnover").alias("turnover"),
        )

    def excess(self) -> DataFrame:
        """strategy, benchmark, date, excess: every benchmark on the strategy's dates, 0 where it has no return."""
        names = self.benchmarks.select(F.col("symbol").alias("benchmark")).distinct()
        rows = self._returns().crossJoin(names)
        b = self.benchmarks.select("date", F.col("symbol").alias("benchmark"), F.col("ret").alias("_b"))
        return rows.join(b, ["date", "benchmark"], "left").select("strategy", "benchmark", "date", (F.col("ret") - F.coalesce("_b", F.lit(0.0))).alias("excess"))

    def benchmark_stats(self) -> DataFrame:
        """strategy, benchmark, excess_annual_return (the curve has one bar more than returns), information_ratio, excess_max_drawdown."""
        e, keys = self.excess(), ["strategy", "benchmark"]
        s = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.product(1 + F.col("excess")).alias("_p"), F.avg("excess").alias("_m"), F.stddev_pop("excess").alias("_s"))
        dd = drawdowns(e, "excess", keys).groupBy(*keys).agg(F.abs(F.min("dd")).alias("excess_max_drawdown"))
        return s.join(dd, keys).select(*keys, annual_return(F.col("_p"), F.col("_n") + 1, self.per_year).alias("excess_annual_return"), sharpe(F.col("_m"), F.col("_s"), self.per_year, self.risk_free).alias("information_ratio"), "excess_max_drawdown")

    def benchmark_nav(self) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("date")
        return self.benchmarks.select("symbol", "date", P.cumprod(1 + F.col("ret"), w).alias("nav"))

    def monthly_returns(self) -> DataFrame:
        """strategy, month, ret of every month from the first to the last, 0 for one without days."""
        m = self._returns().groupBy("strategy", F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
        span = m.groupBy("strategy").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("strategy", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
        return span.join(m, ["strategy", "month"], "left").select("strategy", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))

    def monthly_table(self) -> DataFrame:
        """strategy, year and a column for each of the twelve months."""
        m = self.monthly_returns().withColumns({"year": F.year("month"), "m": F.month("month")})
        return m.groupBy("strategy", "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))

    def rolling_sharpe(self, window: int = 60) -> DataFrame:
        """strategy, date, sharpe over the last `window` days; null where returns don't change but for rounding."""
        mean, sd = P.rolling_mean(F.col("ret"), window, _w()), P.rolling_std(F.col("ret"), window, 0, _w())
        return self._returns().select("strategy", "date", (F.try_divide(mean - self.risk_free / self.per_year, F.when(sd > 1e-9, sd)) * F.sqrt(F.lit(float(self.per_year)))).alias("sharpe"))

    def rebalance_records(self) -> DataFrame:
        """Every trade: strategy, date, symbol, action, shares, price, notional and the cash left."""
        return self.result.trade_details.select("strategy", "date", "seq", "symbol", "action", "shares", "price", "notional", F.col("cash_after").alias("balance"))

    def activity(self) -> DataFrame:
        """Days with any trade."""
        return self.result.trades.where("trade_notional != 0 or buy_shares != 0 or sell_shares != 0 or turnover != 0").select("strategy", "date", "trade_notional", "buy_shares", "sell_shares", F.col("cash").alias("balance"))

    def overview(self) -> DataFrame:
        return self.result.trades.select("strategy", "date", "portfolio_value", "cash", "turnover")
