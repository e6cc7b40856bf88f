import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.operators import factors as FA
from factorlake.operators import selection as SE
from factorlake.operators import timing as T


def make(spark, n_days=40, n=20, seed=7, link=None):
    r = np.random.default_rng(seed)
    days = pd.bdate_range("2024-01-01", periods=n_days)
    f = [(d.date(), f"S{i:02d}", "f", float(v)) for d in days for i, v in enumerate(r.normal(size=n))]
    rets = [(d, s, 1, float((0.01 * v if link else 0) + 0.001 * r.normal())) for d, s, _, v in f]
    return spark.createDataFrame(f, "date date, symbol string, factor string, value double").cache(), spark.createDataFrame(rets, "date date, symbol string, period int, ret double").cache()


def test_perfect_ic_is_one(spark):
    f, _ = make(spark)
    up = f.select("date", "symbol", F.lit(1).alias("period"), F.col("value").alias("ret"))
    down = up.withColumn("ret", -F.col("ret"))
    for r, want in ((up, 1.0), (down, -1.0)):
        for m in ("rank", "pearson"):
            assert all(x.ic == pytest.approx(want) for x in SE.ic_series(f, r, m).collect())
    assert SE.ic_at(f, up).first()["ic"] == pytest.approx(1.0)


def test_few_pairs_have_no_ic(spark):
    f = spark.createDataFrame([("2024-01-01", "A", "f", 1.0), ("2024-01-01", "B", "f", 2.0)], "date string, symbol string, factor string, value double").withColumn("date", F.to_date("date"))
    r = f.select("date", "symbol", F.lit(1).alias("period"), F.col("value").alias("ret"))
    assert SE.ic_series(f, r).first()["ic"] is None


def test_icir_and_t(spark):
    f, r = make(spark, link=True)
    ic = SE.ic_series(f, r)
    x = np.array([v.ic for v in ic.collect()])
    s = SE.with_p_value(SE.ic_stats(ic)).first()
    assert s.icir == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(252))
    assert s.t_stat == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(len(x))))
    assert s.ic_mean > 0.5 and 0 <= s.p_value < 1e-6
    t = SE.t_stat(ic).first()
    assert t.t == pytest.approx(s.t_stat)


def test_static_factor_has_no_turnover(spark):
    days = pd.bdate_range("2024-01-01", periods=10)
    rows = [(d.date(), s, "f", v) for d in days for s, v in zip("ABCDE", (1.0, 2.0, 3.0, 4.0, 5.0))]
    out = SE.turnover(spark.createDataFrame(rows, "date date, symbol string, factor string, value double")).collect()
    assert len(out) == 10 and all(r.turnover == 0 for r in out)


def test_turnover_is_bounded(spark):
    f, _ = make(spark)
    assert all(0 <= r.turnover <= 1 for r in SE.turnover(f).collect())


def test_rising_asset(spark):
    days = pd.bdate_range("2024-01-01", periods=30)
    df = spark.createDataFrame([(d.date(), "A", float(i + 1)) for i, d in enumerate(days)], "date date, symbol string, close double")
    out = SE.forward_returns(df, (1, 5)).toPandas()
    assert (out.ret > 0).all()
    first = out[(out.period == 5)].sort_values("date").iloc[0]
    assert first.ret == pytest.approx(7 / 2 - 1)


def test_decay_has_every_lag(spark):
    f, r = make(spark, link=True)
    out = {x.lag: x.ic for x in SE.ic_decay(f, r, 5).collect()}
    # returns given for each lag, by a function or a mapping, are taken as they are
    days = [d.date for d in r.select("date").distinct().orderBy("date").collect()]

    def moved(lag):
        pairs = spark.createDataFrame([(a, b) for a, b in zip(days, days[lag - 1 :])], "date date, _later date")
        return pairs.join(r.withColumnRenamed("date", "_later"), "_later").select("date", "symbol", "ret")

    for given in (moved, {k: moved(k) for k in range(1, 6)}):
        assert {x.lag: x.ic for x in SE.ic_decay(f, given, 5).collect()} == pytest.approx(out)
    assert sorted(out) == [1, 2, 3, 4, 5] and out[1] > 0.5 > abs(out[2])


def test_layers_spread(spark):
    f, r = make(spark, 60, 50, 5, True)
    res = SE.LayeredResult(f, r, 5)
    g = {x.grp: x.annual_return for x in res.group_metrics.collect()}
    assert sorted(g) == [1, 2, 3, 4, 5] and g[5] > g[1]
    m = res.metrics.first()
    assert m.ls_annual > 0 and m.ls_max_drawdown <= 0 and m.top_excess_annual > 0
    assert res.wide().columns[-5:] == ["1", "2", "3", "4", "5"]
    assert res.group_returns.where("date is null").count() == 0


def test_too_few_names_give_no_groups(spark):
    f, r = make(spark, 5, 3)
    assert SE.group_returns(f, r, 5).count() == 0


def bars(spark, n_days=60, n=20, seed=1):
    r = np.random.default_rng(seed)
    days = pd.bdate_range("2024-01-01", periods=n_days)
    rows = []
    for i in range(n):
        for d, p in zip(days, r.uniform(9, 11, n_days).tolist()):
            rows.append((d.date(), f"S{i:02d}", p, p * 1.01, p * 0.99, p, 1000.0))
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double").cache()


def test_report(spark):
    b = bars(spark)
    report = SE.FactorReport(FA.factor_panel(b, [FA.Momentum(5)]), b, (1, 5))
    s = report.summary().toPandas()
    assert sorted(s.period) == [1, 5] and {"ic_mean", "icir", "p_value", "turnover", "ls_annual", "top_excess_calmar"} <= set(s.columns)
    assert set(report.to_dict()["momentum_5"]) == {1, 5}
    assert report.ic_decay(3).count() == 3
    assert SE.grade(report.summary()).where("ic_label is null").count() == 0


def test_win_rate(spark):
    rows = [("f", "A", "2024-01-01", 1, 0.1), ("f", "A", "2024-01-02", -1, 0.1), ("f", "A", "2024-01-03", 0, 0.1), ("f", "A", "2024-01-04", 1, None), ("f", "B", "2024-01-01", 0, 0.1)]
    df = spark.createDataFrame(rows, "factor string, symbol string, date string, signal int, ret double")
    assert [(r.symbol, r.direction_win_rate) for r in T.direction_win_rate(df).collect()] == [("A", 0.5)]


def test_timing_against_plain_python(spark):
    b = bars(spark, 80, 3)
    sig = FA.factor_panel(b, [FA.MACross(), FA.RSI()])
    assert {r.value for r in sig.select("value").distinct().collect()} <= {-1.0, 0.0, 1.0}
    got = T.strategy_returns(T.joined(sig, b)).toPandas().sort_values(["factor", "symbol", "date"])
    own = T.joined(sig, b).toPandas().sort_values(["factor", "symbol", "date"])
    for key, g in own.groupby(["factor", "symbol"]):
        want = np.sign(g.signal.shift(2)).fillna(0) * (g.price / g.price.shift(1) - 1).fillna(0)
        x = got[(got.factor == key[0]) & (got.symbol == key[1])]
        np.testing.assert_allclose(x.ret.astype(float), want, atol=1e-12)
        np.testing.assert_allclose(x.nav.astype(float), (1 + want).cumprod(), atol=1e-12)
    s = T.TimingReport(sig, b, None, b, "S00").summary().toPandas()
    assert len(s) == 6 and (s.max_drawdown >= 0).all()
    with pytest.raises(KeyError):
        T.TimingReport(sig, b, "nope")


def test_without_benchmark_excess_is_the_return(spark):
    b = bars(spark, 40, 2)
    own = T.strategy_returns(T.joined(FA.factor_panel(b, [FA.MACross()]), b))
    assert T.excess_returns(own, None).count() == own.count()


def test_factor_page_and_charts(spark, tmp_path):
    from factorlake.operators.factors import Momentum, Volatility, factor_panel
    from factorlake.operators.selection import FactorReport
    from factorlake.plans import report as R
    from factorlake.sources.fixtures import synthetic_bars

    bars = synthetic_bars(spark, 8, "2023-01-02", "2023-04-28")
    report = FactorReport(factor_panel(bars, [Momentum(5), Volatility(5)]), bars, periods=(1, 5))
    R.factor_page(report, str(tmp_path / "f" / "page.html"), max_lag=5)
    page = (tmp_path / "f" / "page.html").read_text()
    assert page.count("<svg") == 8 and "momentum_5" in page and "group 5" in page and "IC decay by lag" in page and page.count("type='radio'") == 3
    assert "No data" in R.bars_and_lines("t", [1], [None]) and "<rect" in R.bars_and_lines("t", [1, 2], [0.5, -0.5]) and "M" in R.bars_and_lines("t", [1, 2, 3], None, {"<a>": [1.0, None, 2.0]})
    heat = R.heat_map(spark.createDataFrame([(2023, 0.1, -0.2), (2024, None, 0.0)], "year int, `1` double, `2` double"), "year")
    assert "200,40,40,1.00" in heat and "0,140,60,0.50" in heat and heat.count("<tr>") == 3
    assert R.heat_map(spark.createDataFrame([], "year int, `1` double"), "year") == "<p>No rows.</p>"


def test_wide_cross_sections_are_those_of_long_rows(spark):
    from factorlake.operators import factors as FA
    from factorlake.operators import selection as SE

    b = bars(spark, 60, 12).where("hash(symbol, date) % 9 != 0")
    own = [FA.Momentum(5), FA.Volatility(5), FA.HighLowSpread(20)]
    panel = FA.factor_panel(b, own)
    wide, names, rets = SE.wide_pairs(b, own, (1, 5))
    out = SE.cross_sections(wide, names, rets, 5).cache()
    returns = SE.forward_returns(b, (1, 5))

    def table(df, *keys):
        p = df.toPandas()
        return p.sort_values(list(keys)).reset_index(drop=True)[sorted(p.columns)]

    keys = ("factor", "period", "date")
    pd.testing.assert_frame_equal(table(out.select(*keys, "ic"), *keys), table(SE.ic_series(panel, returns), *keys), check_dtype=False)
    pd.testing.assert_frame_equal(table(SE.groups_in(out), *keys, "grp"), table(SE.group_returns(panel, returns), *keys, "grp"), check_dtype=False)
    leads, lags = SE.with_leads(wide, names, rets[1], 6)
    decay = SE.cross_sections(leads, names, lags).groupBy("factor", F.col("period").alias("lag")).agg(F.avg("ic").alias("ic"))
    pd.testing.assert_frame_equal(table(decay, "factor", "lag"), table(SE.ic_decay(panel, SE.forward_returns(b, (1,)), 6), "factor", "lag"), check_dtype=False)
    # a date is shuffled once: one exchange by date, whatever the number of factors and periods
    plan = out.select(*keys, "ic")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(factor" not in plan
