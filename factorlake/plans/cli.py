"""Command lines: python -m factorlake.plans.cli strategy|selection|timing|universe --data PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import benchmark_returns
from ..operators.factors import Momentum
from ..operators.portfolio import TopKPortfolio
from ..operators.simulate import CashAccountEngine
from ..sources.loaders import LakeLoader, PanelLoader, SqliteLoader, universe, universe_by_history
from .pipelines import SelectionPipeline, StrategyPipeline, TimingPipeline
from .report import export_report, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("strategy", "selection", "timing"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True, help="CSV, Parquet or SQLite file")
        s.add_argument("--start")
        s.add_argument("--end")
        s.add_argument("--output", default=f"output/{name}")
        s.add_argument("--symbols", nargs="*")
        if name == "strategy":
            s.add_argument("--benchmarks", nargs="*", default=[])
            s.add_argument("--lookback", type=int, choices=(5, 10, 20), default=20)
            s.add_argument("--top-k", type=int, default=3)
            s.add_argument("--capital", type=float, default=1_000_000.0)
        elif name == "selection":
            s.add_argument("--factors", nargs="*")
            s.add_argument("--max-stocks", type=int, default=300)
            s.add_argument("--min-observations", type=int, default=80)
        else:
            s.add_argument("--factors", nargs="*")
            s.add_argument("--benchmark")
    s = sub.add_parser("universe", help="active securities of a lake, by symbol, and their factors' report with --factors")
    s.add_argument("--data", required=True, help="folder of the stored tables")
    s.add_argument("--market", default="A_stock")
    s.add_argument("--start")
    s.add_argument("--end")
    s.add_argument("--max-stocks", type=int, default=300)
    s.add_argument("--factors", nargs="*", default=[])
    s.add_argument("--output", default="output/universe")
    return p


def _universe(a: argparse.Namespace, spark: SparkSession) -> None:
    """The first active securities of a market by symbol, and the report of some factors on them."""
    loader = LakeLoader(spark, a.data, a.market)
    securities = loader.securities()
    if securities is None:
        raise FileNotFoundError(f"no securities under {a.data}")
    own = universe(securities, a.start, a.end, a.max_stocks, market=a.market)
    write_csv(own, f"{a.output}/universe")
    if a.factors:
        pipe = SelectionPipeline().add_factors(*a.factors)
        pipe.market = loader.load_market_data(own, a.start, a.end)
        write_csv(pipe.run()["report"].summary(), f"{a.output}/summary")
    write_csv(loader.skipped, f"{a.output}/skipped")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("factorlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "universe":
        return _universe(a, spark)
    loader = SqliteLoader(spark, a.data) if a.data.endswith((".db", ".sqlite", ".sqlite3")) else PanelLoader(spark, a.data)
    if a.command == "strategy":
        wanted = None if a.symbols is None else [*a.symbols, *a.benchmarks]
        market = loader.load_market_data(wanted, a.start, a.end)
        own, bench = market.where(~F.col("symbol").isin(a.benchmarks)), market.where(F.col("symbol").isin(a.benchmarks))
        pipe = StrategyPipeline(Momentum(a.lookback), TopKPortfolio(a.top_k), CashAccountEngine(initial_capital=a.capital))
        out = pipe.run(own, benchmark_returns(bench) if a.benchmarks else None)
        export_report(out["analyzer"], a.output)
    elif a.command == "selection":
        market = loader.load_market_data(a.symbols, a.start, a.end)
        keep = universe_by_history(market, a.min_observations, a.max_stocks)
        pipe = SelectionPipeline()
        pipe.market = market.join(keep.select("symbol"), "symbol", "left_semi")
        report = pipe.add_factors(*(a.factors or [])).run()["report"]
        write_csv(report.summary(), f"{a.output}/summary")
        write_csv(keep, f"{a.output}/universe")
    else:
        pipe = TimingPipeline().set_data_loader(loader).set_benchmark(a.benchmark).add_factors(*(a.factors or []))
        if a.symbols:
            pipe.set_symbol(a.symbols)
        write_csv(pipe.run(a.start, a.end).summary(), f"{a.output}/summary")


if __name__ == "__main__":
    main()
