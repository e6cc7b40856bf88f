"""The three pipelines: selection factors, timing factors, strategy backtest."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyze import StrategyAnalyzer
from ..operators.factors import BaseFactor, BaseTimingFactor, FactorRegistry, factor_grid, factor_panel
from ..operators.ml import MODELS, BaseModel
from ..operators.portfolio import TopKPortfolio
from ..operators.selection import FactorReport, forward_returns
from ..operators.simulate import CashAccountEngine
from ..operators.timing import TimingReport
from .config import load_config, load_timing_config


def _resolve(registry: FactorRegistry, factor) -> BaseFactor:
    if isinstance(factor, str):
        return registry.get(factor)
    return factor() if isinstance(factor, type) else factor


class SelectionPipeline:
    """Loads a market, computes factors, and evaluates them, or a model made of them."""

    def __init__(self, config: dict | None = None, registry: FactorRegistry | None = None):
        self.config = config or load_config()
        self.registry = registry or FactorRegistry(extra_paths=tuple(self.config["factors"]["extra_paths"]))
        self.loader, self.model, self.factors, self.market, self.fundamental = None, None, [], None, None

    def set_data_loader(self, loader) -> SelectionPipeline:
        self.loader = loader
        return self

    def add_factors(self, *factors) -> SelectionPipeline:
        self.factors += [_resolve(self.registry, f) for f in factors]
        return self

    def set_model(self, model: BaseModel | str) -> SelectionPipeline:
        self.model = MODELS[model](cv_splits=self.config["model"]["cv_splits"], seed=self.config["model"]["seed"]) if isinstance(model, str) else model
        return self

    def load_data(self, symbols=None, start=None, end=None, load_fundamental: bool = False) -> SelectionPipeline:
        if self.loader is None:
            raise ValueError("set a data loader first")
        self.market = self.loader.load_market_data(symbols, start, end)
        if load_fundamental:
            try:
                self.fundamental = self.loader.load_fundamental_data(symbols, start, end)
            except NotImplementedError as e:
                warnings.warn(f"no fundamental data: {e}", stacklevel=2)
        return self

    def run(self, symbols=None, start=None, end=None, load_fundamental: bool = False) -> dict:
        """Factor mode: {"report": FactorReport}. With a model: also "cv", "predictions" and "importance" (the 20 largest). ValueError without factors."""
        if self.market is None:
            self.load_data(symbols, start, end, load_fundamental)
        if not self.factors:
            raise ValueError("add a factor first")
        factors, e = self.factors, self.config["evaluation"]
        if self.model is None:
            panel = factor_panel(self.market, factors, self.fundamental)
            return {"report": FactorReport(panel, self.market, e["forward_periods"], e["ic_method"], e["n_groups"])}
        names = [f.name for f in factors]
        period = e["forward_periods"][1] if len(e["forward_periods"]) > 1 else e["forward_periods"][0]
        target = forward_returns(self.market, [period]).select("date", "symbol", F.col("ret").alias("target"))
        data = factor_grid(self.market, factors).join(target, ["date", "symbol"]).dropna()
        cv = self.model.cross_validate(data, names, "target")
        self.model.fit(data, names, "target")
        predicted = self.model.predict(data).select("date", "symbol", F.lit("model").alias("factor"), F.col("prediction").alias("value"))
        report = FactorReport(predicted, self.market, e["forward_periods"], e["ic_method"], e["n_groups"])
        return {"report": report, "cv": cv, "predictions": predicted, "importance": self.model.get_feature_importance(data.sparkSession).limit(20)}


class TimingPipeline:
    """Timing factors on any number of symbols, in one plan."""

    def __init__(self, config: dict | None = None, registry: FactorRegistry | None = None):
        self.config = config or load_timing_config()
        self.registry = registry or FactorRegistry(extra_paths=tuple(self.config["factors"]["extra_paths"]))
        self.loader, self.symbols, self.benchmark, self.factors, self.market = None, None, None, [], None

    def set_data_loader(self, loader) -> TimingPipeline:
        self.loader = loader
        return self

    def set_symbol(self, symbols: str | list[str]) -> TimingPipeline:
        self.symbols = [symbols] if isinstance(symbols, str) else list(symbols)
        return self

    def set_benchmark(self, symbol: str | None) -> TimingPipeline:
        self.benchmark = symbol
        return self

    def add_factors(self, *factors) -> TimingPipeline:
        for f in factors:
            f = _resolve(self.registry, f)
            if not isinstance(f, BaseTimingFactor):
                raise TypeError(f"{f.name} is no timing factor")
            self.factors.append(f)
        return self

    def load_data(self, start=None, end=None) -> TimingPipeline:
        wanted = None if self.symbols is None else sorted({*self.symbols, *([self.benchmark] if self.benchmark else [])})
        self.market = self.loader.load_market_data(wanted, start, end)
        return self

    def run(self, start=None, end=None) -> TimingReport:
        if self.market is None:
            self.load_data(start, end)
        factors = self.factors or [self.registry.get(n) for n in self.registry.list_timing()]
        own = self.market if self.symbols is None else self.market.where(F.col("symbol").isin(self.symbols))
        e = self.config["evaluation"]
        bench = self.market.where(F.col("symbol") == self.benchmark) if self.benchmark else None
        return TimingReport(factor_panel(own, factors), own, None, bench, self.benchmark, e["price_col"], e["trading_days"], e["risk_free"])


class StrategyPipeline:
    """Signals, target weights, simulation and analysis; each part can be replaced."""

    def __init__(self, alpha_model: BaseFactor | None = None, portfolio_manager=None, execution_engine=None, analyzer_cls=StrategyAnalyzer):
        self.alpha = alpha_model
        self.portfolio = portfolio_manager or TopKPortfolio()
        self.engine = execution_engine or CashAccountEngine()
        self.analyzer_cls = analyzer_cls

    def run(self, market: DataFrame, benchmark_returns: DataFrame | None = None) -> dict:
        if market.isEmpty():
            raise ValueError("no market data")
        signals = self.alpha.generate_signals(market)
        weights = self.portfolio.generate_target_weights(signals, market)
        result = self.engine.run_simulation(weights, market)
        try:
            analyzer = self.analyzer_cls(result, benchmarks=benchmark_returns)
        except TypeError:
            analyzer = self.analyzer_cls(result)
        return {"signals": signals, "weights": weights, "result": result, "analyzer": analyzer, "stats": analyzer.summary_stats()}
