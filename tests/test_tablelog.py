"""Stored tables after failures: stopped writers, other writers, broken and lost files."""

import datetime
import os
import warnings

import pytest
from pyspark.sql import functions as F

from factorlake.functions.scratch import materialize, scratch_dir, scratch_scope, stored, written
from factorlake.sources import etl, loaders
from factorlake.sources.fixtures import supplier_bars, synthetic_bars
from factorlake.sources.quarantine import probe
from factorlake.sources.tablelog import ConcurrentWrite, TableLog


@pytest.fixture(scope="module")
def raw(spark):
    bars = synthetic_bars(spark, 4, "2022-12-20", "2024-01-12").withColumn("amount", F.col("close") * F.col("volume"))
    return bars.withColumnRenamed("date", "trade_date").withColumn("adjust_flag", F.lit("2")).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_stopped_upsert_leaves_the_table_whole(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert etl.upsert_bars(spark, raw, root) == 0
    log = TableLog(spark, f"{root}/market_data")
    before = rows(log.read())
    pinned = log.read()

    def stop(self, manifest):
        raise RuntimeError("stopped between write and swap")

    with monkeypatch.context() as m:
        m.setattr(TableLog, "_commit", stop)
        with pytest.raises(RuntimeError):
            etl.upsert_bars(spark, raw.withColumn("close", F.lit(1.0)), root)
    assert rows(TableLog(spark, f"{root}/market_data").read()) == before
    new = raw.where("trade_date >= '2024-01-01'").withColumn("close", F.lit(1.0))
    assert etl.upsert_bars(spark, new, root) == 1
    assert log.read().where("close = 1.0").count() == new.count() and log.read().count() == len(before)
    assert rows(pinned) == before == rows(log.read(0))  # a reader keeps its version
    old, now = log.manifest(0)["folders"], log.manifest(1)["folders"]
    assert [k for k in now if now[k] != old[k]] == ["market=A_stock/year=2024"]  # other years weren't rewritten
    assert [tuple(r)[:2] for r in log.history().orderBy("version").collect()] == [(0, "upsert"), (1, "upsert")]
    # what the stopped writer left, and the old version, go
    assert len(os.listdir(tmp_path / "market_data" / "_data")) == 3
    gone = log.vacuum(keep=1, older_than=-1)
    assert len(gone) == 1 and log.versions() == [1] and log.read().count() == len(before)


def test_two_writers(spark, tmp_path, monkeypatch):
    log = TableLog(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    log.overwrite(one)
    base = log.manifest()
    with pytest.raises(ConcurrentWrite):
        log._commit(base)
    inner, raced = TableLog._commit, []

    def race(self, manifest):
        if not raced:  # another writer is faster, once
            raced.append(1)
            TableLog(spark, self.path).upsert(spark.createDataFrame([("b", 2)], one.schema), ["k"], etl.keep_last)
        inner(self, manifest)

    monkeypatch.setattr(TableLog, "_commit", race)
    assert log.upsert(spark.createDataFrame([("a", 3)], one.schema), ["k"], etl.keep_last) == 2
    assert rows(log.read()) == rows(spark.createDataFrame([("a", 3), ("b", 2)], one.schema))


def test_tables_by_partition(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("x:1 %", "A", 1), (None, "B", 2), ("z", "C", 3)], "market string, symbol string, v int")
    log = TableLog(spark, f"{root}/t")
    log.replace_partitions(df, ["market"])
    assert rows(log.read().select("market", "symbol", "v")) == rows(df)
    log.upsert(df.withColumn("v", F.col("v") + 10), ["market", "symbol"], etl.keep_last, ["market"])
    assert rows(log.read().select("market", "symbol", "v")) == rows(df.withColumn("v", F.col("v") + 10)) and len(log.manifest()["folders"]) == 3
    with pytest.raises(ValueError):
        log.upsert(df, ["market", "symbol"], etl.keep_last)
    with pytest.raises(ValueError):
        log.upsert(df.drop("v"), ["market", "symbol"], etl.keep_last, ["market"])
    # a refresh to nothing empties its market, and no other
    etl.replace_market(spark, df.where("market = 'z'"), root, "s", "z")
    etl.replace_market(spark, df.withColumn("market", F.lit("y")), root, "s", "y")
    etl.replace_market(spark, df.where("false"), root, "s", "z")
    assert [r.market for r in TableLog(spark, f"{root}/s_by_market").read().select("market").distinct().collect()] == ["y"]
    with pytest.raises(FileNotFoundError):
        TableLog(spark, f"{root}/none").read()
    empty = TableLog(spark, f"{root}/e")
    empty.overwrite(df.where("false"))
    assert empty.read().count() == 0 and empty.read().columns == df.columns


def test_broken_and_lost_files_are_listed(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path)
    with monkeypatch.context() as m:  # one file for each part, which small tables would not get
        m.setattr(etl, "layout_of", lambda files: lambda df: df.repartition(4).sortWithinPartitions("symbol"))
        etl.upsert_bars(spark, raw, root)
    loader = loaders.LakeLoader(spark, root)
    assert loader.load_market_data().count() == raw.count() and loader.skipped.count() == 0
    folder = tmp_path / "market_data" / "_data"
    files = sorted(p for p in folder.rglob("*.parquet") if "year=2023" in str(p))
    cut, lost = files[0], files[1]
    n_cut, n_lost = (spark.read.parquet(str(p)).count() for p in (cut, lost))
    cut.write_bytes(cut.read_bytes()[:-40])
    crc = cut.with_name(f".{cut.name}.crc")
    if crc.exists():
        crc.unlink()
    lost.unlink()
    with pytest.warns(UserWarning, match="corrupt 1, missing 1"):
        df = loader.load_market_data()
    assert df.count() == raw.count() - n_cut - n_lost
    skipped = {r.path.rsplit("/", 1)[-1]: (r.status, r.reason) for r in loader.skipped.collect()}
    assert skipped[cut.name][0] == "corrupt" and "footer" in skipped[cut.name][1] and skipped[lost.name][0] == "missing"
    with warnings.catch_warnings():  # years without the bad files aren't probed
        warnings.filterwarnings("error", message="files skipped")
        assert loader.load_market_data(None, "2024-01-01").count() == raw.where("trade_date >= '2024-01-01'").count()


def test_plain_folders(spark, raw, tmp_path):
    root = tmp_path / "lake"
    raw.withColumns({"market": F.lit("A_stock"), "year": F.year("trade_date")}).repartition(2).write.partitionBy("market", "year").parquet(str(root / "market_data"))
    loader = loaders.LakeLoader(spark, str(root))
    assert loader.load_market_data(None, "2023-01-01", "2023-12-31").count() == raw.where("year(trade_date) = 2023").count()
    (root / "market_data" / "market=A_stock" / "year=2023" / "part-bad.parquet").write_bytes(b"not parquet at all")
    spark.createDataFrame([], raw.schema).coalesce(1).write.mode("append").parquet(str(root / "market_data" / "market=A_stock" / "year=2022"))
    with pytest.warns(UserWarning, match="corrupt 1"):
        assert loader.load_market_data().count() == raw.count()
    assert [r.reason for r in loader.skipped.collect()] == ["doesn't begin like a Parquet file"]
    statuses = {r.status for r in probe(spark, [str(root / "market_data")], raw.schema).collect()}
    assert statuses == {"ok", "empty", "corrupt"}


def test_last_of_a_batch_doesnt_depend_on_partitions(spark, tmp_path):
    r = [(i % 7, i % 3, float(i)) for i in range(300)]
    path = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(r[i * 100 : i * 100 + 100], "k int, d int, v double").coalesce(1).write.mode("append").parquet(path)
    results = []
    for size in ("64m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        new = etl.in_file_order(spark.read.parquet(path))
        results.append(rows(etl.keep_last(None, new, ["k", "d"])))
        results.append(rows(etl.keep_last(None, new.repartition(5), ["k", "d"])))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(map(tuple, results))) == 1
    new = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("a", 2, 3.0), ("b", None, None)], "k string, at int, v double")
    old = spark.createDataFrame([("a", 9, 9.0), ("c", 1, None), ("b", 1, 1.0)], new.schema)
    want = [("a", 2, 4.0), ("b", None, None), ("c", 1, None)]
    for n in (1, 4):
        assert sorted(map(tuple, etl.keep_last(old, new.repartition(n), ["k"], ["at"]).collect())) == want
    assert sorted(map(tuple, etl.keep_last(None, new, ["k"]).collect())) == [("a", 2, 4.0), ("b", None, None)]


def test_trades_with_large_keys_keep_their_order(spark, tmp_path):
    day = datetime.datetime(1995, 1, 2)
    rows_ = [(7 * 10**18, 20_000_000_000, 1, 2, 1.0, 200.0, day), (7 * 10**18, 20_000_000_000, 1, 1, 1.0, 100.0, day), (5, 30_000_000_000, 1, 7, 1.0, 50.0, day)]
    df = spark.createDataFrame(rows_, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    b = supplier_bars(spark, str(tmp_path), "day").first()
    assert (b.open, b.high, b.low, b.close) == (50.0, 200.0, 50.0, 200.0)


def test_scratch(spark, tmp_path):
    df = spark.range(10).write.parquet(str(tmp_path / "t")) or spark.read.parquet(str(tmp_path / "t"))
    n = len(written(spark))
    assert stored(df.where("id > 3").select("id")).count() == 6 and len(written(spark)) == n
    with scratch_scope(spark):
        kept = stored(df.groupBy("id").count())
        materialize(kept, "x").count()
        assert len(written(spark)) == n + 2
        folder = scratch_dir(spark).removeprefix("file://")
        inside = len(os.listdir(folder))
    assert len(written(spark)) == n and len(os.listdir(folder)) == inside - 2


def test_universe_command(spark, raw, tmp_path):
    from factorlake.plans.cli import main

    root, out = str(tmp_path / "lake"), str(tmp_path / "out")
    etl.upsert_bars(spark, raw, root)
    sec = [(f"S000{i}", "A_stock", "stock" if i < 4 else "index", "n", None, None, "SSE") for i in (1, 2, 3, 4)]
    etl.upsert_table(spark, spark.createDataFrame(sec, "symbol string, market string, asset_type string, name string, list_date date, delist_date date, exchange string"), root, "securities")
    main(["universe", "--data", root, "--max-stocks", "2", "--start", "2023-01-01", "--factors", "momentum_5", "--output", out], spark)
    assert [r.symbol for r in spark.read.csv(f"{out}/universe", header=True).orderBy("symbol").collect()] == ["S0001", "S0002"]
    assert spark.read.csv(f"{out}/summary", header=True).count() == 4
