"""Rank correlations of pairs of columns: exact, whatever the blocks and ranges, and with little moved and stored."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import scratch
from factorlake.operators import selection as SE


def frame(spark, p, parts=3):
    columns = ", ".join(f"{c} double" for c in p)
    return spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), columns).repartition(parts)


def check(out, p, rets):
    for row in out:
        both = p[[row.factor, rets[row.period]]].dropna()
        want = both.rank().corr().iloc[0, 1] if len(both) > 2 else np.nan
        assert row.ic is None if np.isnan(want) else row.ic == pytest.approx(want, abs=1e-9)


def test_few_bytes_are_moved_and_stored(spark):
    # a value has 8 bytes; shuffles and tables of rows that are ranked one by one took 53 a value
    shuffled = lambda: {f: f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    df = scratch.materialize(spark.range(60_000, numPartitions=3).select(*[F.randn(k).alias(c) for k, c in enumerate("abxy")]), "random")
    files, tables = shuffled(), set(scratch.written(spark))
    assert len(SE.ic_of_all(df, ["a", "b"], {1: "x", 5: "y"}, 10_000).collect()) == 4
    moved = sum(n for f, n in shuffled().items() if f not in files)
    stored = sum(f.stat().st_size for t in set(scratch.written(spark)) - tables for f in Path(t.removeprefix("file://")).glob("*.parquet"))
    assert (moved + stored) / (4 * 60_000) < 35


@pytest.mark.parametrize("most,rows", [(2**22, 200), (4_000, 150), (4_000, 10_000)])
def test_blocks_and_ranges(spark, monkeypatch, most, rows):
    from factorlake.functions import rankpairs as R

    monkeypatch.setattr(R, "BLOCK_RANKS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    r = np.random.default_rng(3)
    n = 3000
    p = pd.DataFrame({"a": np.where(r.random(n) < 0.7, 0.0, r.normal(size=n)), "b": r.choice([-3e7, 5.0, 8e12, 1e250, -1e250], n), "none": np.nan, "x": r.normal(size=n) * 1e6, "same": 2.5, "few": np.nan})
    p.loc[r.random(n) < 0.2, "a"], p.loc[r.random(n) < 0.3, "x"], p.loc[:1, "few"] = np.nan, np.nan, [1.0, 2.0]
    p.loc[0, "a"] = 0.5
    rets = {1: "x", 5: "same", 9: "few"}
    try:
        out = SE.ic_of_all(frame(spark, p), ["a", "b", "none"], rets, rows).collect()
        nothing = SE.ic_of_all(frame(spark, p).where("a > 1e9"), ["a", "b"], rets, rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not nothing and {(o.factor, o.period) for o in out} >= {(f, k) for f in "ab" for k in (1, 5)}
    assert {o.ic for o in out if o.period != 1} == {None}
    check(out, p, rets)


def test_large_values_keep_their_order():
    from factorlake.functions import rankpairs as R

    v = np.array([-np.inf, -1e300, -1e300 * (1 - 1e-15), -2e12, -R.NEAR, np.nextafter(-R.NEAR, 0), -5.0, -1e-10, 0.0, 1e-10, 2e-10, 112589.0, np.nextafter(R.NEAR, 0), R.NEAR, 1e6, np.nextafter(1e6, 1e7), 1e300, np.inf, np.nan])
    k = R.whole(v)
    assert (np.diff(k.astype(object)) >= 0).all() and len(set(k.tolist())) >= len(v) - 2
    assert R.whole(np.array([-0.0, 0.0])).tolist() == [0, 0]
    n = np.arange(2**49, 2**49 + 1000)
    assert (R.whole(n / 1e10) == n).all()
    assert (R.wide(R.narrow(R.steps(k)), len(k)).cumsum() + k[0] == k).all()
