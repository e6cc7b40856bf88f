"""Factor research and backtests on Spark: panels, factors, evaluation, strategies."""
