import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.operators import analyze as A
from factorlake.operators import portfolio as PF
from factorlake.operators.factors import Momentum
from factorlake.operators.simulate import BUY, SELL, CashAccountEngine
from factorlake.plans.pipelines import StrategyPipeline
from factorlake.plans.report import export_report
from factorlake.sources.fixtures import synthetic_bars


@pytest.fixture(scope="module")
def market(spark):
    return synthetic_bars(spark, 5, "2023-01-02", "2023-12-29").cache()


def test_targets_hold_one_day_later(spark):
    days = pd.bdate_range("2024-01-01", periods=4)
    m = spark.createDataFrame([(d.date(), "AAPL", p) for d, p in zip(days, (100.0, 110.0, 121.0, 133.1))], "date date, symbol string, close double")
    w = m.select("date", "symbol", F.lit(1.0).alias("weight"))
    res = CashAccountEngine(0.0, 0.0, initial_capital=1000.0).run_simulation(w, m)
    r = [x.ret for x in res.returns.orderBy("date").collect()]
    assert r[:2] == [0.0, 0.0] and r[2] == pytest.approx(0.099)
    first = res.trade_details.orderBy("date", "seq").first()
    assert (first.symbol, first.action, first.shares, first.price) == ("AAPL", BUY, 9, 110.0)


def plain_account(prices, weights, capital, c, s):
    """One day after the other, in plain Python."""
    symbols = sorted(prices.columns)
    prices = prices[symbols].ffill()
    want = weights.reindex(index=prices.index, columns=symbols).ffill().fillna(0).shift(1).fillna(0)
    cash, shares, out, log = capital, dict.fromkeys(symbols, 0), [], []
    for d in prices.index:
        p = prices.loc[d]
        worth = lambda: cash + sum(shares[x] * p[x] for x in symbols if p[x] == p[x])  # noqa: B023, E731
        equity = worth()
        goal = {x: int(np.floor(equity * want.loc[d, x] / (p[x] * (1 + c + s)))) if want.loc[d, x] > 0 and p[x] > 0 else 0 for x in symbols}
        for x in symbols:
            if goal[x] < shares[x]:
                q = shares[x] - goal[x]
                cash += q * p[x] * (1 - c - s)
                shares[x] = goal[x]
                log.append((d, x, SELL, q))
        for x in sorted((x for x in symbols if want.loc[d, x] > 0), key=lambda x: (-want.loc[d, x], x)):  # noqa: B023
            q = min(goal[x] - shares[x], int(cash // (p[x] * (1 + c + s))))
            if q > 0:
                cash -= q * p[x] * (1 + c + s)
                shares[x] += q
                log.append((d, x, BUY, q))
        out.append(worth())
    return np.array(out), log


def test_account_against_plain_python(market):
    weights = PF.TopKPortfolio(2, 0.0, "W-FRI").generate_target_weights(Momentum(5).generate_signals(market), market)
    res = CashAccountEngine(0.002, 0.001, initial_capital=50_000.0).run_simulation(weights, market)
    pivot = lambda df, v: df.toPandas().assign(date=lambda x: pd.to_datetime(x.date)).pivot(index="date", columns="symbol", values=v).sort_index().astype(float)
    want, log = plain_account(pivot(market, "close"), pivot(weights, "weight"), 50_000.0, 0.002, 0.001)
    got = res.trades.orderBy("date").toPandas()
    np.testing.assert_allclose(got.portfolio_value, want, rtol=1e-10)
    trades = [(pd.Timestamp(r.date), r.symbol, r.action, r.shares) for r in res.trade_details.orderBy("date", "seq").collect()]
    assert trades == log
    # what the ledger, the trades and the positions say agrees
    d = res.trade_details.toPandas()
    by_day = d.groupby("date")[["notional", "commission_cost", "total_cost"]].sum()
    g = got.set_index("date").loc[by_day.index]
    np.testing.assert_allclose(by_day["notional"], g.trade_notional)
    np.testing.assert_allclose(by_day["total_cost"], g.total_cost)
    last = d.sort_values("seq").groupby("date").last()
    np.testing.assert_allclose(last.cash_after, g.cash, atol=1e-6)
    np.testing.assert_allclose(last.portfolio_value_after, g.portfolio_value)
    assert got.cash.min() >= -1e-6
    share = res.positions.toPandas().groupby("date").weight.sum()
    np.testing.assert_allclose(share, 1 - (got.cash / got.portfolio_value).set_axis(got.date).loc[share.index], atol=1e-9)
    assert res.totals().first()["ending_value"] == pytest.approx(want[-1])


def test_weights(market):
    weights = PF.TopKPortfolio(2).generate_target_weights(Momentum(5).generate_signals(market), market).toPandas()
    total = weights.groupby("date").weight.sum()
    assert set(total.round(9)) <= {0.0, 1.0} and (weights.weight >= 0).all()
    assert (weights[weights.weight > 0].groupby("date").size() <= 2).all()
    with pytest.raises(ValueError):
        PF.TopKPortfolio(0)


def test_dropout_bounds_changes(market):
    out = PF.topk_dropout(Momentum(5).generate_signals(market), market, 3, 1).toPandas()
    held = out.groupby("date").symbol.apply(set)
    assert all(len(a - b) <= 1 for a, b in zip(held, held[1:]))
    assert max(map(len, held)) == 3


def test_engine_checks_its_settings(market):
    for bad in ({"initial_capital": 0}, {"commission": -1}):
        with pytest.raises(ValueError):
            CashAccountEngine(**bad)
    with pytest.raises(KeyError):
        CashAccountEngine(price_col="absent").run_simulation(market, market)


def test_many_strategies_at_once(market):
    sig = Momentum(5).generate_signals(market)
    both = None
    for k in (1, 3):
        w = PF.TopKPortfolio(k).generate_target_weights(sig, market).withColumn("strategy", F.lit(f"top{k}"))
        both = w if both is None else both.unionByName(w)
    res = CashAccountEngine().run_simulation(both, market)
    one = CashAccountEngine().run_simulation(both.where("strategy = 'top1'").drop("strategy"), market)
    got = [r.equity for r in res.equity_curve.where("strategy = 'top1'").orderBy("date").collect()]
    assert got == [r.equity for r in one.equity_curve.orderBy("date").collect()]


def test_pipeline_statistics_and_report(market, tmp_path):
    bench = A.equal_weight_benchmark(market, name="SPY")
    out = StrategyPipeline(Momentum(20), PF.TopKPortfolio(2)).run(market, bench)
    s = out["stats"].first()
    r = out["result"].returns.orderBy("date").toPandas().ret
    nav = (1 + r).cumprod()
    assert s.max_drawdown == pytest.approx(abs((nav / nav.cummax() - 1).min()))
    assert s.annual_volatility == pytest.approx(r.std(ddof=0) * np.sqrt(252))
    assert s.annual_return == pytest.approx(nav.iloc[-1] ** (252 / len(r)) - 1)
    assert s.win_rate == pytest.approx((r > 0).mean())
    assert s.profit_loss_ratio == pytest.approx(r[r > 0].mean() / abs(r[r < 0].mean()))
    b = out["analyzer"].benchmark_stats().first()
    assert b.benchmark == "SPY" and b.excess_max_drawdown >= 0
    assert len(out["analyzer"].monthly_table().columns) == 14
    (tmp_path / "old.html").write_text("x")
    files = export_report(out["analyzer"], str(tmp_path))
    assert "report.html" in files and "summary_stats.csv" in files and "old.html" not in files
    assert "<svg" in (tmp_path / "report.html").read_text()
    with pytest.raises(ValueError):
        StrategyPipeline(Momentum(5)).run(market.where("false"))


def test_benchmarks_without_prices_are_left_out(spark):
    rows = [("2024-01-01", "A", 1.0), ("2024-01-02", "A", 2.0), ("2024-01-01", "B", None), ("2024-01-02", "B", None)]
    m = spark.createDataFrame(rows, "date string, symbol string, close double").withColumn("date", F.to_date("date"))
    assert [(r.symbol, r.ret) for r in A.benchmark_returns(m).orderBy("date").collect()] == [("A", 0.0), ("A", 1.0)]


def test_accounts_go_through_the_days_together():
    from factorlake.operators.simulate import holdings

    r = np.random.default_rng(3)
    rows = [(d, a, s, np.nan if r.random() < 0.1 else r.uniform(1, 40), r.choice([0.0, 0.2, 0.2, 0.5])) for d in range(40) for a in range(12) for s in range(6) if r.random() < 0.7]
    p = pd.DataFrame(rows, columns=["day", "account", "symbol", "price", "target"])
    before, after = holdings(p.account.to_numpy(), (p.account * 6 + p.symbol).to_numpy(), p.day.to_numpy(), p.price.to_numpy(), p.target.to_numpy(), 1000.0, 0.002)
    p["before"], p["after"] = before, after
    for _, own in p.groupby("account"):  # one account by itself, name by name
        cash, held = 1000.0, {}
        for _, day in own.groupby("day"):
            have = [held.get(s, 0) for s in day.symbol]
            assert day.before.tolist() == have
            worth = cash + sum(n * x for n, x in zip(have, day.price) if x == x)
            goal = [int(worth * t / (x * 1.002) // 1) if x == x and t > 0 else 0 for x, t in zip(day.price, day.target)]
            now = [min(n, g) if x == x else n for n, g, x in zip(have, goal, day.price)]
            cash += sum((n - m) * x for n, m, x in zip(have, now, day.price) if x == x) * 0.998
            for k in sorted(range(len(now)), key=lambda k: (-day.target.iloc[k], day.symbol.iloc[k])):
                if goal[k] > now[k]:
                    more = min(goal[k] - now[k], max(0, int(cash // (day.price.iloc[k] * 1.002))))
                    now[k] += more
                    cash -= more * day.price.iloc[k] * 1.002
            assert day.after.tolist() == now
            held = {s: n for s, n in zip(day.symbol, now) if n}
    assert (after != before).sum() > 500
