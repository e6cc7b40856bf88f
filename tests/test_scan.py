"""Ranks, running values and rolling moments over keys that span many segments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import moments as M
from factorlake.functions import scan
from factorlake.functions import stats as S


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    n = 4000
    p = pd.DataFrame({"k": np.where(r.random(n) < 0.6, "hot", r.choice(["a", "b", "c"], n)), "i": r.permutation(n), "v": np.where(r.random(n) < 0.35, 7.0, r.integers(0, 400, n) / 4)})
    p.loc[r.random(n) < 0.05, "v"] = np.nan
    p.loc[p.k == "c", "v"] = 1.5
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "k string, i long, v double").repartition(5)
    return p, df.unionByName(spark.createDataFrame([(None, 9000, 1.0), (None, 9001, 3.0), ("one", 9002, None)], df.schema))


@pytest.mark.parametrize("size", [300, 10_000])
def test_rank(rows, size):
    p, df = rows
    out = scan.average_rank(df.where("v is not null"), "v", ["k"], "r", size).toPandas()
    q = p.dropna()
    want = q.assign(r=q.groupby("k").v.rank()).set_index("i").r
    got = out[out.k.notna()].set_index("i").r
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    assert sorted(out[out.k.isna()].r) == [1.0, 2.0]


def test_no_task_ranks_a_whole_key(spark, rows, monkeypatch):
    seen = []
    inner = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, label: (seen.append(inner(df, label)), seen[-1])[1])
    scan.average_rank(rows[1].where("v is not null"), "v", ["k"], "r", 300)
    sizes = seen[0].groupBy("k", "_seg").count().toPandas()
    assert sizes["count"].max() < 1000 and (sizes.groupby("k").size().loc["hot"] > 4)


def test_correlation_of_large_keys(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50, 3000) / 7, r.normal(size=3000)
    df = spark.createDataFrame([("x", float(i), float(j + i / 9)) for i, j in zip(a, b)], "k string, a double, b double")
    small, large = (S.correlation(df, "a", "b", ["k"], large=x).first() for x in (False, True))
    assert small["n"] == large["n"] == 3000 and small["corr"] == pytest.approx(large["corr"], abs=1e-12)
    assert small["corr"] == pytest.approx(pd.Series(a).rank().corr(pd.Series(b + a / 9).rank()), abs=1e-9)
    noisy = spark.createDataFrame([("x", 0.1 + 0.2, 1.0), ("x", 0.3, 1.0), ("x", 0.5, 2.0)], df.schema)
    assert S.correlation(noisy, "a", "b", ["k"]).first()["corr"] == pytest.approx(1.0)


@pytest.mark.parametrize("size", [150, 10_000])
def test_running(rows, size):
    p, df = rows
    df = df.withColumn("g", 1 + F.col("v") / 1e5)
    out = scan.running(df, ["k"], ["i"], {"s": scan.Running("sum", "v"), "m": scan.Running("max", "v"), "l": scan.Running("min", "v"), "g2": scan.Running("product", "g")}, size).toPandas()
    out = out[out.k.isin(["hot", "a", "b", "c"])].sort_values("i")
    assert len(out) == len(p)
    for k, g in out.groupby("k"):
        v = g.v.astype(float)
        for got, want in ((g.s, v.cumsum()), (g.m, v.cummax()), (g.l, v.cummin()), (g.g2, (1 + v / 1e5).cumprod())):
            np.testing.assert_allclose(got.astype(float).to_numpy(), want.ffill().to_numpy(), rtol=1e-12)


def test_index(rows):
    out = scan.with_index(rows[1], ["k"], ["i"], "n", 200).toPandas()
    for _, g in out.groupby("k", dropna=False):
        assert g.sort_values("i").n.tolist() == list(range(len(g)))


@pytest.mark.parametrize("alpha,size", [(1 / 14, 10_000), (0.9, 300), (0.001, 77), (1 / 14, 50)])
def test_ewm(rows, alpha, size):
    p, df = rows
    out = scan.ewm_mean(df, ["k"], ["i"], "v", "x", alpha, 5, size).toPandas()
    for k, g in p.groupby("k"):
        g = g.sort_values("i")
        want = g.v.ewm(alpha=alpha, adjust=True, min_periods=5).mean()
        got = out[out.k == k].sort_values("i").x.astype(float)
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_ewm_over_a_long_gap(spark):
    v = [1.0, 3.0] + [None] * 2500 + [5.0]
    df = spark.createDataFrame([("x", i, x) for i, x in enumerate(v)], "k string, i long, v double")
    out = scan.ewm_mean(df, ["k"], ["i"], "v", "x", 0.5, 1, 100).orderBy("i").toPandas().x
    assert out.iloc[2000] == pytest.approx(7 / 3) and out.iloc[-1] == pytest.approx(5.0)


def test_states_go_up_levels(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").alias("s"))
    out = scan.compose_states(df, ["k"], "i", "s", F.lit(0).cast("long"), lambda a, b: a + b, fan=4).toPandas().sort_values("i")
    assert out.before.tolist() == [i * (i - 1) // 2 for i in range(1000)]


@pytest.mark.parametrize("n", [1, 2, 7, 60, 5000])
def test_rolling_moments(spark, n):
    r = np.random.default_rng(n)
    p = pd.DataFrame({"symbol": r.choice(["a", "b"], 400), "x": r.normal(size=400) + 1e4, "y": r.normal(size=400)})
    p["date"] = range(400)
    p.loc[::17, "x"], p.loc[5::31, "y"] = np.nan, np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "symbol string, x double, y double, date long")
    out = M.with_rolling_moments(df, "x", n).withColumns({"m": M.mean_of("_m", n), "sd": M.std_of("_m", n)})
    out = M.with_rolling_moments(out, "x", n, "_c", "y").withColumn("r", M.corr_of("_c", n)).toPandas()
    for k, g in p.groupby("symbol"):
        got = out[out.symbol == k].sort_values("date")
        w = g.x.rolling(n)
        np.testing.assert_allclose(got.m.astype(float).to_numpy(), w.mean().to_numpy(), rtol=1e-12)
        if n > 1:
            np.testing.assert_allclose(got.sd.astype(float).to_numpy(), w.std().to_numpy(), rtol=1e-6, atol=1e-6)
        if n > 2:
            both = g[["x", "y"]].where(g.x.notna() & g.y.notna())
            np.testing.assert_allclose(got.r.astype(float).to_numpy(), both.x.rolling(n).corr(both.y).to_numpy(), rtol=1e-4, atol=1e-6)


def test_rounding_of_large_values(spark):
    v = [1e16 + 2, 3.7e30, -2.5e19, 1.23456, -1.5, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    out = [r.x for r in df.select(S.rounded_half_up(F.col("v"), 4).alias("x")).collect()]
    assert out[:3] == pytest.approx(v[:3], rel=1e-15) and out[3:] == [1.2346, -1.5, None]


def test_running_product_beyond_a_long(spark):
    from factorlake.plans.queries import rounded

    df = spark.range(2000).select(F.lit("x").alias("k"), F.col("id").alias("i"), F.lit(1.05).alias("g"))
    out = rounded(scan.running(df, ["k"], ["i"], {"nav": scan.Running("product", "g")}, 300), "nav", digits=4).orderBy("i").toPandas().nav
    np.testing.assert_allclose(out, np.round(1.05 ** np.arange(1, 2001), 4), rtol=1e-10, atol=1.1e-4)


@pytest.mark.parametrize("size", [200, 100_000])
def test_ranks_among_marked_rows(spark, size):
    from factorlake.operators import selection as SE

    r = np.random.default_rng(8)
    p = pd.DataFrame({"a": np.where(r.random(1500) < 0.4, 2.0, r.normal(size=1500)), "b": r.integers(0, 30, 1500) / 4, "x": r.normal(size=1500), "y": r.integers(0, 9, 1500) / 8, "z": r.normal(size=1500)})
    for c in p:
        p.loc[r.random(1500) < 0.15, c] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "a double, b double, x double, y double, z double").repartition(4)
    out = SE.ic_of_all(df, ["a", "b"], {1: "x", 5: "y", 9: "z"}, size).collect()
    assert len(out) == 6
    for row in out:
        both = p[[row.factor, {1: "x", 5: "y", 9: "z"}[row.period]]].dropna()
        assert row.ic == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-9)
