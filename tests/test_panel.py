import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import panel as P
from factorlake.functions import stats as S


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(42)
    days = pd.bdate_range("2024-01-01", periods=60)
    rows = []
    for k, s in enumerate("ABCDE"):
        price = 10 * np.cumprod(1 + r.normal(0, 0.02, len(days)))
        for d, p in zip(days, price):
            if r.random() < 0.9:
                rows.append((d.date(), s, float(p), float(p * 1.02), float(p * 0.98), float(p), float(1000 + k)))
    df = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double").cache()
    return df


def wide(df, value):
    p = df.toPandas()
    p["date"] = pd.to_datetime(p["date"])
    return p.pivot(index="date", columns="symbol", values=value).sort_index().astype(float)


@pytest.fixture(scope="module")
def grid(bars):
    return P.densify(bars, "close", "volume").cache()


def same(a, b):
    pd.testing.assert_frame_equal(a, b, check_names=False, check_freq=False, atol=1e-12, rtol=1e-9)


def test_densify_is_calendar_times_symbols(bars, grid):
    assert grid.count() == bars.select("date").distinct().count() * 5
    same(wide(grid, "close"), wide(bars, "close"))


@pytest.mark.parametrize("fill", ["pad", None])
def test_pct_change(grid, bars, fill):
    p = wide(bars, "close")
    p = p.ffill() if fill else p
    same(wide(P.pct_change(grid, "close", "x", 5, fill), "x"), p / p.shift(5) - 1)


def test_rolling(grid, bars):
    p = wide(bars, "close")
    same(wide(grid.withColumn("x", P.rolling_mean(F.col("close"), 5)), "x"), p.rolling(5).mean())
    same(wide(grid.withColumn("x", P.rolling_std(F.col("close"), 5)), "x"), p.rolling(5).std())
    same(wide(grid.withColumn("x", P.rolling_std(F.col("close"), 5, 0)), "x"), p.rolling(5).std(ddof=0))


def test_ewm(bars):
    df = bars.withColumn("d", P.diff(F.col("close")))
    want = df.toPandas().sort_values(["symbol", "date"])
    want["x"] = want.groupby("symbol")["d"].transform(lambda s: s.ewm(alpha=1 / 14, adjust=True, min_periods=14).mean())
    for segment in (None, 7, 1):
        g = P.with_ewm_mean(df, "d", "x", 1 / 14, 14, segment=segment).toPandas().sort_values(["symbol", "date"])
        np.testing.assert_allclose(g["x"].astype(float), want["x"], atol=1e-12)


@pytest.mark.parametrize("alpha", [1 / 14, 0.5, 1.0])
def test_ewm_of_long_histories_and_gaps(spark, alpha):
    r = np.random.default_rng(0)
    x = pd.Series(100 + 10 * np.sin(np.arange(20_000) / 3) + r.normal(size=20_000))
    x[r.random(20_000) < 0.1] = np.nan
    x[5000:13_000] = np.nan
    days = pd.date_range("1950-01-01", periods=len(x)).date
    df = spark.createDataFrame([(d, "a", None if v != v else float(v)) for d, v in zip(days, x)], "date date, symbol string, v double")
    got = P.with_ewm_mean(df, "v", "x", alpha, 14).orderBy("date").toPandas()["x"].astype(float)
    np.testing.assert_allclose(got, x.ewm(alpha=alpha, adjust=True, min_periods=14).mean(), rtol=1e-9)


def test_rsi_of_a_long_history(spark):
    from factorlake.operators.factors import RSI

    r = np.random.default_rng(1)
    p = 100 + 10 * np.sin(np.arange(20_000) / 5) + r.normal(size=20_000)
    days = pd.date_range("1950-01-01", periods=len(p)).date
    df = spark.createDataFrame([(d, "a", float(v)) for d, v in zip(days, p)], "date date, symbol string, close double")
    got = RSI().generate_signals(df).orderBy("date").toPandas()["value"]
    d = pd.Series(p).diff()
    up, down = (s.ewm(alpha=1 / 14, adjust=True, min_periods=14).mean() for s in (d.clip(lower=0), (-d).clip(lower=0)))
    rsi = 100 - 100 / (1 + up / down)
    want = np.select([rsi < 30, rsi > 70], [1, -1], 0)
    assert got.tolist() == want.tolist() and set(want[12_000:]) == {-1, 0, 1}


def test_cumprod_keeps_gaps(grid, bars):
    r = wide(bars, "close").pct_change(fill_method=None)
    df = P.pct_change(grid, "close", "r", 1, None)
    same(wide(df.withColumn("x", P.cumprod(1 + F.col("r"))), "x"), (1 + r).cumprod())


def test_longest_run(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, -1, -1, 0, -1, -1, -1, 0])], "k string, i int, v double")
    assert P.longest_run(df, ["k"], "i", F.col("v") < 0).first()["longest"] == 3


def test_periods(spark):
    days = pd.bdate_range("2024-01-01", periods=80)
    df = spark.createDataFrame([(d.date(),) for d in days], "date date")
    for freq in ("W-FRI", "ME", "QE", "YE"):
        want = sorted(d.date() for d in pd.Series(days, index=days).resample(freq).last())
        assert sorted(r.date for r in P.last_dates(df, freq).collect()) == want
    with pytest.raises(ValueError):
        P.period_end("H")


def test_qcut(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(v)) for k in range(12) for v in (r.integers(0, 8, 30) if k % 2 else r.normal(size=5 + k))]
    rows += [(99, 1.0)] * 6
    df = S.quantile_groups(spark.createDataFrame(rows, "k int, v double"), "v", ["k"], 5).toPandas()
    for k, g in df.groupby("k"):
        if k == 99:
            assert g["grp"].isna().all()
        else:
            want = pd.qcut(g["v"], 5, labels=False, duplicates="drop") + 1
            assert (g["grp"] == want).all()


def test_top_quantile(spark):
    r = np.random.default_rng(3)
    rows = [(n, f"s{i:03d}", float(v)) for n in range(5, 40) for i, v in enumerate(r.normal(size=n))]
    df = spark.createDataFrame(rows, "k int, symbol string, value double").withColumn("top", S.in_top_quantile("value", ["k"], 5)).toPandas()
    for _, g in df.groupby("k"):
        bins = pd.qcut(g["value"].rank(method="first"), 5, labels=False)
        assert (g["top"] == (bins == bins.max())).all()


def test_correlation_matches_pandas(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(a), float(b)) for k in range(6) for a, b in zip(r.integers(0, 6, 20), r.normal(size=20))] + [(7, 1.0, 2.0)] * 5 + [(8, 1.0, 2.0)] * 2
    df = spark.createDataFrame(rows, "k int, a double, b double")
    for method in ("rank", "pearson"):
        got = {x.k: x["corr"] for x in S.correlation(df, "a", "b", ["k"], method).collect()}
        assert got[7] is None and got[8] is None
        for k in range(6):
            p = pd.DataFrame([x[1:] for x in rows if x[0] == k])
            p = p.rank() if method == "rank" else p
            assert got[k] == pytest.approx(p[0].corr(p[1]), abs=1e-12)


def test_p_value(spark):
    assert S.two_sided_p(2.0, 10.0)[0] == pytest.approx(0.07338803, abs=1e-8)
    assert S.two_sided_p(0.0, 5.0)[0] == pytest.approx(1.0)
    # two degrees of freedom have a closed form
    t = np.array([0.3, 1.0, 4.0, 20.0])
    np.testing.assert_allclose(S.two_sided_p(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=1e-12)
    df = spark.createDataFrame([(2.0, 10.0), (None, 3.0), (1.0, 0.0)], "t double, df double")
    got = [r.p for r in df.select(S.p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.07338803, abs=1e-8) and got[1:] == [None, None]


def test_calendar(bars):
    c = P.calendar(bars).orderBy("date_idx").collect()
    assert [r.date_idx for r in c] == list(range(len(c))) and isinstance(c[0].date, datetime.date)


def test_densify_of_odd_rows(spark):
    rows = [("a", "2024-01-02", 1.0), ("a", "2024-01-04", 2.0), ("a", "2024-01-04", 3.0), ("b", "2024-01-03", None), ("c", None, 5.0), (None, "2024-01-02", 6.0), (None, "2024-01-05", 7.0), ("d", "2024-01-05", 8.0), ("d", None, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, day string, close double").select("symbol", F.col("day").cast("date").alias("date"), "close")

    def as_by_join(days_of):
        days = P.calendar(days_of)
        grid = df.select("symbol").distinct().crossJoin(days)
        return sorted(map(str, grid.join(df, ["symbol", "date"], "left").select("symbol", F.col("date_idx").cast("int"), "date", "close").collect()))

    for days_of in (df, df.where("symbol = 'a'"), df.where("date is null")):
        assert sorted(map(str, P.densify(df, "close", days_of=days_of).collect())) == as_by_join(days_of)


def test_parts_hold_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 50)
    sizes = []
    for symbols in (10, 40):
        df = spark.range(symbols * 20).select(F.expr("cast(id % {} as string)".format(symbols)).alias("symbol"), F.expr("date_add(date'2024-01-01', cast(id div {} as int))".format(symbols)).alias("date"), F.lit(1.0).alias("close"))
        for out in (P.dealt(df), P.densify(df, "close")):
            counts = out.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
            assert counts[0] == symbols * 20
            sizes.append(counts[1])
    assert max(sizes[2:]) < 5 * 50  # a part's rows don't grow with the table
