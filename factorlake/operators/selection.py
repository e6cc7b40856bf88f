"""Evaluation of selection factors: IC, decay, turnover, forward returns, quantile portfolios, the report.

Everything is keyed by factor and period, so that one plan evaluates all
factors and periods. Frames: factors (date, symbol, factor, value), returns
(date, symbol, period, ret), IC series (factor, period, date, ic).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import panel as P
from ..functions import scan
from ..functions import stats as S
from ..functions.rankpairs import rank_correlations
from ..functions.scratch import materialize

KEY = ["factor", "period"]
PERIODS = (1, 5, 10, 20)


def forward_returns(market: DataFrame, periods=PERIODS, price: str = "close") -> DataFrame:
    """date, symbol, period, ret: entry one day after the date, exit `period` days later, counted on the grid."""
    grid = P.densify(market, price)
    w = Window.partitionBy("symbol").orderBy("date_idx")
    # one lead a period in one pass over the sorted partition
    rets = [F.struct(F.lit(int(p)).alias("period"), (F.try_divide(F.lead(price, 1 + p).over(w), F.lead(price, 1).over(w)) - 1).alias("ret")) for p in periods]
    out = grid.withColumn("_r", F.array(*rets)).select("date", "symbol", F.explode("_r").alias("r")).select("date", "symbol", "r.period", "r.ret")
    return out.where("ret is not null")


def wide_pairs(market: DataFrame, factors: list, periods=PERIODS, price: str = "close") -> tuple[DataFrame, list[str], dict[int, str]]:
    """date, symbol, a column a factor and a column a period's return, from one grid by one shuffle; with the factors' names and the periods' columns.

    The rows are what factor_panel() joined with forward_returns() has in
    len(factors) * len(periods) rows each. Only factors that work on the grid.
    """
    columns = sorted({c for f in factors for c in f.columns} | {price})
    grid = P.densify(market, *columns)
    for f in factors:
        grid = f.apply(grid)
    w = Window.partitionBy("symbol").orderBy("date")
    rets = {int(p): f"_ret_{int(p)}" for p in periods}
    grid = grid.withColumns({c: F.try_divide(F.lead(price, 1 + p).over(w), F.lead(price, 1).over(w)) - 1 for p, c in rets.items()})
    names = [f.name for f in factors]
    return grid.select("date", "symbol", *names, *rets.values()), names, rets


def with_leads(pairs: DataFrame, names: list[str], ret: str, max_lag: int = 20) -> tuple[DataFrame, dict[int, str]]:
    """date, symbol, factors and the returns `lag - 1` of the returns' dates ahead, a column a lag; ic_decay()'s pairs in wide rows."""
    pairs = materialize(pairs.select("date", "symbol", *names, ret), "decay-pairs")
    days = pairs.where(F.col(ret).isNotNull()).select("date").distinct()
    rows = P.dealt(pairs.join(F.broadcast(days), "date", "left_semi"), rows=pairs.count())
    w = Window.partitionBy("symbol").orderBy("date")
    lags = {k: f"_lag_{k}" for k in range(1, max_lag + 1)}
    return rows.select("date", "symbol", *names, *[F.lead(ret, k - 1).over(w).alias(c) for k, c in lags.items()]), lags


def cross_sections(pairs: DataFrame, names: list[str], rets: dict[int, str], n_groups: int | None = None, ranks: bool = True) -> DataFrame:
    """factor, period, date, n (pairs), ic (rank, of settled values) and groups (mean returns of quantile groups, spread over the period) of wide pairs.

    A date's rows are one group, with a number a factor and return: they are shuffled once, and not once for each factor and period.
    groups is null without n_groups, and below n_groups pairs or without two edges; a group without names is null in it.
    """
    periods = list(rets)

    def run(table: pa.Table) -> pa.Table:
        number = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        held = [pc.is_valid(table[c].combine_chunks()).to_numpy(zero_copy_only=False) for c in [*names, *rets.values()]]
        settled = lambda v: np.floor(v * 1e10 + 0.5) / 1e10
        x = [settled(number(c)) for c in names]
        y = [number(c) for c in rets.values()]
        out = []
        for j, period in enumerate(periods):
            last_rank = {}
            for i, name in enumerate(names):
                both = held[i] & held[len(names) + j]
                n = int(both.sum())
                if not n:
                    continue
                a, b = x[i][both], y[j][both]
                ic = None
                if ranks and n >= 3:
                    key = both.tobytes()  # most factors have values on the same rows
                    if key not in last_rank:
                        last_rank = {key: S.ranks(settled(b))}
                    ic = S.pearson(S.ranks(a), last_rank[key])
                out.append((name, period, table["date"][0].as_py(), n, ic, S.group_means(a, b, n_groups, period) if n_groups and n >= n_groups else None))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, [f.type for f in kind])], schema=kind)

    kind = pa.schema([("factor", pa.string()), ("period", pa.int32()), ("date", pa.date32()), ("n", pa.int64()), ("ic", pa.float64()), ("groups", pa.list_(pa.float64()))])
    some = pairs.select("date", *names, *rets.values()).where(F.coalesce(*[F.col(c) for c in names]).isNotNull() & F.coalesce(*[F.col(c) for c in rets.values()]).isNotNull())
    return some.groupBy("date").applyInArrow(run, "factor string, period int, date date, n long, ic double, groups array<double>")


def groups_in(sections: DataFrame) -> DataFrame:
    """factor, period, date, grp, ret of cross_sections(), as group_returns() has them."""
    out = sections.where("groups is not null").select(*KEY, "date", F.posexplode("groups").alias("_g", "ret"))
    return out.where("ret is not null").select(*KEY, "date", (F.col("_g") + 1).alias("grp"), "ret")


def ic_at(factors: DataFrame, returns: DataFrame, method: str = "rank") -> DataFrame:
    """One IC per (factor, period) over all the rows given, as for one cross-section; ranks of any number of rows go over many tasks."""
    both = factors.join(returns, ["date", "symbol"])
    return S.correlation(both, "value", "ret", KEY, method, large=True).select(*KEY, F.col("corr").alias("ic"))


def ic_of_all(pairs: DataFrame, names: list[str], rets: dict[int, str], rows: int = scan.SEGMENT_ROWS) -> DataFrame:
    """ic_at() by rank, of wide pairs: each factor and each return is sorted once for all its pairs."""
    columns = [*names, *rets.values()]
    data = pairs.select(*[S.settled(F.col(c)).alias(c) for c in columns])
    out = rank_correlations(data, names, list(rets.values()), rows)
    factor, period = (F.get(F.array(*[F.lit(v) for v in values]), F.col(c)) for values, c in ((names, "i"), (list(rets), "j")))
    return out.select(factor.alias("factor"), period.alias("period"), F.when(F.col("n") >= 3, F.col("corr")).alias("ic"))


def ic_series(factors: DataFrame, returns: DataFrame, method: str = "rank") -> DataFrame:
    """factor, period, date, ic; ic is null on dates with under three pairs, or a constant side."""
    both = factors.join(returns, ["date", "symbol"])
    return S.correlation(both, "value", "ret", [*KEY, "date"], method).select(*KEY, "date", F.col("corr").alias("ic"))


def ic_stats(ic: DataFrame) -> DataFrame:
    """Per factor and period: n (non-null ICs), mean, sd, icir (annualised, less by the root of the period), t (likewise), p and the share above 0 (by more than the last bits of a sum).

    Dates without an IC count in the share's denominator.
    """
    s = ic.groupBy(*KEY).agg(
        F.count("ic").alias("n"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        F.avg(F.coalesce(F.col("ic") > 1e-12, F.lit(False)).cast("int")).alias("ic_positive"),
    )
    root = F.sqrt(F.col("period").cast("double"))
    s = s.withColumn("icir", icir(F.col("ic_mean"), F.col("ic_std"), F.col("period"), annualize=True))
    s = s.withColumn("t_stat", F.try_divide(F.col("ic_mean"), F.col("ic_std") / F.sqrt(F.col("n").cast("double"))) / root)
    return s


def with_p_value(stats: DataFrame, t: str = "t_stat", n: str = "n") -> DataFrame:
    return stats.withColumn("p_value", S.p_value(F.col(t), (F.col(n) - 1).cast("double")))


def icir(mean, sd, period=1, annualize: bool = False, per_year: int = 252):
    """mean / sd / sqrt(period), times sqrt(per_year) if annualised; null for a null or zero sd."""
    period = period if hasattr(period, "cast") else F.lit(period)
    out = F.try_divide(mean, sd) / F.sqrt(period.cast("double"))
    return out * F.sqrt(F.lit(float(per_year))) if annualize else out


def t_stat(ic: DataFrame) -> DataFrame:
    """Per factor and period: plain one-sample t against 0 and its two-sided p; null under two ICs."""
    s = ic.groupBy(*KEY).agg(F.count("ic").alias("n"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("sd"))
    s = s.withColumn("t", F.when(F.col("n") > 1, F.try_divide("m", F.col("sd") / F.sqrt(F.col("n").cast("double")))))
    return with_p_value(s.select(*KEY, "n", "t"), "t")


def ic_decay(factors: DataFrame, returns, max_lag: int = 20, method: str = "rank") -> DataFrame:
    """factor, lag, ic: mean IC with one-period returns moved back lag - 1 of the returns' dates.

    returns: a frame (date, symbol, ret); or a mapping or a function of the lag
    that gives such a frame for each. A frame's leads are one array a row, made in
    one pass by symbol, and the factor's rows, joined to it once, are exploded after.
    """
    if not isinstance(returns, DataFrame):
        give = returns if callable(returns) else returns.__getitem__
        frames = [give(k).select("date", "symbol", F.lit(k).alias("period"), "ret") for k in range(1, max_lag + 1)]
        moved = reduce(DataFrame.unionByName, frames)
        both = factors.join(moved, ["date", "symbol"])
    else:
        grid = P.densify(returns.select("date", "symbol", "ret"), "ret")
        w = Window.partitionBy("symbol").orderBy("date_idx")
        leads = F.array(*[F.struct(F.lit(k).alias("period"), F.lead("ret", k - 1).over(w).alias("ret")) for k in range(1, max_lag + 1)])
        leads = grid.select("date", "symbol", F.filter(leads, lambda x: x["ret"].isNotNull()).alias("_l"))
        both = factors.join(leads, ["date", "symbol"]).withColumn("_x", F.explode("_l")).select("factor", "date", "value", F.col("_x.period").alias("period"), F.col("_x.ret").alias("ret"))
    s = S.correlation(both, "value", "ret", [*KEY, "date"], method)
    return s.groupBy("factor", F.col("period").alias("lag")).agg(F.avg("corr").alias("ic"))


def turnover(factors: DataFrame, quantiles: int = 5) -> DataFrame:
    """factor, date, turnover: half the summed change of the top quantile's equal weights from the factor's date before.

    Dates with under `quantiles` names weigh nothing; the first date's turnover is 0.
    """
    keys = ["factor", "date"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    top = factors.where("value is not null").withColumn("_n", n)
    top = top.withColumn("_top", S.in_top_quantile("value", keys, quantiles) & (F.col("_n") >= quantiles))
    days = factors.where("value is not null").select(*keys).distinct()
    # numbered dates of a factor: a few thousand rows a key
    days = days.withColumn("_i", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    held = top.where("_top").withColumn("_w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys))).select(*keys, "symbol", "_w").join(days, keys)
    # a weight changes on its own date and on the next one
    change = held.select("factor", "_i", "symbol", "_w").unionByName(held.select("factor", (F.col("_i") + 1).alias("_i"), "symbol", (-F.col("_w")).alias("_w")))
    change = change.groupBy("factor", "_i", "symbol").agg(F.sum("_w").alias("_d")).groupBy("factor", "_i").agg((F.sum(F.abs("_d")) / 2).alias("turnover"))
    out = days.join(change, ["factor", "_i"], "left")
    return out.select("factor", "date", F.when(F.col("_i") == 1, 0.0).otherwise(F.coalesce("turnover", F.lit(0.0))).alias("turnover"))


# --- quantile portfolios ---------------------------------------------------------


def group_returns(factors: DataFrame, returns: DataFrame, n_groups: int = 5) -> DataFrame:
    """factor, period, date, grp, ret: mean return of each quantile group, spread over the period's days; dates with under n_groups pairs are left out."""
    return groups_of(factors.join(returns, ["date", "symbol"]), n_groups)


def groups_of(pairs: DataFrame, n_groups: int = 5) -> DataFrame:
    """group_returns() of factors and returns that are joined already."""
    keys = [*KEY, "date"]
    both = pairs.where("value is not null and ret is not null")
    both = both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= n_groups)
    both = S.quantile_groups(both, "value", keys, n_groups).where("grp is not null")
    return both.groupBy(*keys, "grp").agg((F.avg("ret") / F.first("period")).alias("ret"))


def _dates(groups: DataFrame) -> DataFrame:
    return groups.groupBy(*KEY).agg(F.count_distinct("date").alias("n_dates"))


def cumulative_returns(groups: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY, "grp").orderBy("date")
    return groups.select(*KEY, "date", "grp", (P.cumprod(1 + F.col("ret"), w) - 1).alias("cumulative"))


def group_metrics(groups: DataFrame, per_year: int = 252) -> DataFrame:
    """factor, period, grp, annual_return, sharpe_ratio of each group."""
    s = groups.groupBy(*KEY, "grp").agg(F.product(1 + F.col("ret")).alias("_p"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s")).join(_dates(groups), KEY)
    annual = F.pow("_p", F.lit(float(per_year)) / F.col("n_dates")) - 1
    sharpe = F.try_divide("_m", "_s") * F.sqrt(F.lit(float(per_year))) / F.sqrt(F.col("period").cast("double"))
    return s.select(*KEY, "grp", annual.alias("annual_return"), sharpe.alias("sharpe_ratio"))


def spread_series(groups: DataFrame, n_groups: int = 5) -> DataFrame:
    """factor, period, date, long_short (top less bottom), top_excess (top less the groups' mean); null where a side is missing."""
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("ret")))
    s = groups.groupBy(*KEY, "date").agg(side(n_groups).alias("_t"), side(1).alias("_b"), F.avg("ret").alias("_m"))
    return s.select(*KEY, "date", (F.col("_t") - F.col("_b")).alias("long_short"), (F.col("_t") - F.col("_m")).alias("top_excess"))


def spread_metrics(spread: DataFrame, per_year: int = 252) -> DataFrame:
    """Per factor and period: annual return and max drawdown of both series, Sharpe ratio of the first, Calmar ratio of the second."""
    w = Window.partitionBy(*KEY).orderBy("date")
    s = spread.withColumns({"_wl": P.cumprod(1 + F.col("long_short"), w), "_we": P.cumprod(1 + F.col("top_excess"), w)})
    s = s.withColumns({"_dl": P.drawdown("_wl", w), "_de": P.drawdown("_we", w)})
    s = s.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + F.col("long_short")).alias("_pl"), F.product(1 + F.col("top_excess")).alias("_pe"),
        F.avg("long_short").alias("_m"), F.stddev_samp("long_short").alias("_s"), F.min("_dl").alias("ls_max_drawdown"), F.min("_de").alias("top_excess_max_drawdown"),
    )
    year = F.lit(float(per_year)) / F.greatest("n", F.lit(1))
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(per_year)))).otherwise(0.0) / F.sqrt(F.col("period").cast("double"))
    s = s.withColumns({"ls_annual": F.pow("_pl", year) - 1, "ls_sharpe": F.when(F.col("_m").isNotNull(), sharpe), "top_excess_annual": F.pow("_pe", year) - 1})
    calmar = F.when(F.col("top_excess_max_drawdown") < 0, F.col("top_excess_annual") / F.abs("top_excess_max_drawdown")).when(F.col("top_excess_annual").isNotNull(), 0.0)
    return s.select(*KEY, "n", "ls_annual", "ls_sharpe", "ls_max_drawdown", "top_excess_annual", "top_excess_max_drawdown", calmar.alias("top_excess_calmar"))


class LayeredResult:
    """Quantile portfolios of one or more (factor, period)s, each part a DataFrame."""

    def __init__(self, factors: DataFrame, returns: DataFrame | None, n_groups: int = 5, per_year: int = 252):
        """factors and returns, or the two joined and None."""
        self._take(groups_of(factors if returns is None else factors.join(returns, ["date", "symbol"]), n_groups), n_groups, per_year)

    @classmethod
    def of_groups(cls, groups: DataFrame, n_groups: int = 5, per_year: int = 252) -> LayeredResult:
        self = cls.__new__(cls)
        self._take(groups, n_groups, per_year)
        return self

    def _take(self, groups: DataFrame, n_groups: int, per_year: int) -> None:
        self.n_groups, self.group_returns = n_groups, groups
        self.cumulative_returns = cumulative_returns(self.group_returns)
        self.group_metrics = group_metrics(self.group_returns, per_year)
        self.spread = spread_series(self.group_returns, n_groups)
        w = Window.partitionBy(*KEY).orderBy("date")
        self.spread_cumulative = self.spread.select(*KEY, "date", (P.cumprod(1 + F.col("long_short"), w) - 1).alias("long_short_cumulative"))
        self.metrics = spread_metrics(self.spread, per_year)

    def wide(self) -> DataFrame:
        """factor, period, date and one column a group."""
        names = range(1, self.n_groups + 1)
        return self.group_returns.groupBy(*KEY, "date").pivot("grp", list(names)).agg(F.first("ret"))


class FactorReport:
    """All measures of all factors over all periods; forward returns are from opens by default."""

    def __init__(self, factors: DataFrame, market: DataFrame, periods=PERIODS, method: str = "rank", n_groups: int = 5, price: str = "open"):
        self.factors, self.periods, self.method, self.n_groups = factors, tuple(periods), method, n_groups
        self.returns = forward_returns(market, periods, price)
        self._made: dict[str, object] = {}

    @classmethod
    def of_bars(cls, market: DataFrame, factors: list, periods=PERIODS, n_groups: int = 5, price: str = "open") -> FactorReport:
        """The report of factors that work on the grid, whose rank ICs and groups come from wide rows: each date is shuffled once."""
        from .factors import factor_panel

        self = cls(factor_panel(market, factors), market, periods, "rank", n_groups, price)
        sections = materialize(cross_sections(*wide_pairs(market, factors, periods, price), n_groups), "report-sections")
        self._made["ic"] = sections.select(*KEY, "date", "ic")
        self._made["layered"] = LayeredResult.of_groups(groups_in(sections), n_groups)
        return self

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def pairs(self) -> DataFrame:
        """Factors and returns joined, from which IC and groups are taken; written once, as each measure reads it."""
        return self._once("pairs", lambda: materialize(self.factors.join(self.returns, ["date", "symbol"]).where("value is not null and ret is not null").repartition(*KEY, "date"), "report-pairs"))

    def ic_series(self) -> DataFrame:
        return self._once("ic", lambda: S.correlation(self.pairs(), "value", "ret", [*KEY, "date"], self.method).select(*KEY, "date", F.col("corr").alias("ic")))

    def icir(self) -> DataFrame:
        return ic_stats(self.ic_series()).select(*KEY, "icir")

    def t_stat(self) -> DataFrame:
        return t_stat(self.ic_series())

    def turnover(self) -> DataFrame:
        return self._once("turnover", lambda: turnover(self.factors, 5))

    def ic_decay(self, max_lag: int = 20) -> DataFrame:
        first = 1 if 1 in self.periods else self.periods[0]
        return ic_decay(self.factors, self.returns.where(F.col("period") == first), max_lag, self.method)

    def layered(self) -> LayeredResult:
        return self._once("layered", lambda: LayeredResult(self.pairs(), None, self.n_groups))

    def summary(self, digits: int = 4, p_values: bool = True) -> DataFrame:
        """One row a factor and period, rounded."""
        s = ic_stats(self.ic_series())
        s = with_p_value(s) if p_values else s
        mean = self.turnover().groupBy("factor").agg(F.avg("turnover").alias("turnover"))
        s = s.join(mean, "factor", "left").join(self.layered().metrics.drop("n"), KEY, "left")
        names = ["ic_mean", "ic_std", "icir", "t_stat", "ic_positive", "turnover", "ls_annual", "ls_sharpe", "ls_max_drawdown", "top_excess_annual", "top_excess_max_drawdown", "top_excess_calmar"]
        rounded = [F.round(c, digits).alias(c) for c in names]
        if p_values:
            rounded.insert(4, F.round("p_value", digits + 2).alias("p_value"))
        return s.select(*KEY, *rounded)

    def to_dict(self) -> dict:
        """{factor: {period: measures}}; the table has a row per factor and period."""
        out: dict = {}
        for r in self.summary().collect():
            d = r.asDict()
            out.setdefault(d.pop("factor"), {})[d.pop("period")] = d
        return out

    def print(self) -> None:
        print(self.summary().orderBy(*KEY).toPandas().to_string(index=False))


def grade(summary: DataFrame) -> DataFrame:
    """summary with a label of the mean IC's strength."""
    size = F.abs("ic_mean")
    return summary.withColumn("ic_label", F.when(size >= 0.05, "strong").when(size >= 0.03, "good").when(size >= 0.02, "weak").otherwise("none"))


# --- data of charts -----------------------------------------------------------------


def ic_histogram(ic: DataFrame, bins: int = 50) -> DataFrame:
    """factor, period, bin (1 to bins), n: equal bins from the lowest to the highest IC, that one in the last bin."""
    ic = ic.where("ic is not null")
    ends = ic.groupBy(*KEY).agg(F.min("ic").alias("_lo"), F.max("ic").alias("_hi"))
    at = F.floor(F.try_divide(F.col("ic") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins + 1e-9) + 1
    return ic.join(ends, KEY).withColumn("bin", F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).cast("int")).groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("n"))


def ic_chart(ic: DataFrame, window: int = 20) -> DataFrame:
    """IC series with its moving average."""
    w = Window.partitionBy(*KEY).orderBy("date")
    return ic.withColumn("ma", P.rolling_mean(F.col("ic"), window, w))
