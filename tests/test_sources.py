import datetime
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake import schema
from factorlake.functions import codes as C
from factorlake.plans.cli import main
from factorlake.plans.config import load_config, load_timing_config, merge
from factorlake.sources import etl, loaders
from factorlake.sources.fixtures import synthetic_bars
from factorlake.sources.tablelog import ConcurrentWrite, TableLog
from factorlake.streaming.bars import event_bars, keep_bars_up_to_date


@pytest.fixture(scope="module")
def bars(spark):
    return synthetic_bars(spark, 3, "2023-12-25", "2024-01-12").withColumn("amount", F.col("close") * F.col("volume")).cache()


def test_file_loaders(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "p.parquet"))
    bars.withColumnRenamed("close", "px").coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    db = str(tmp_path / "m.db")
    with sqlite3.connect(db) as con:
        con.execute("create table market (date text, symbol text, open real, high real, low real, close real, volume real)")
        con.executemany("insert into market values (?,?,?,?,?,?,?)", [(str(r.date), r.symbol, r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()])
    n = bars.count()
    for loader in (loaders.PanelLoader(spark, str(tmp_path / "p.parquet")), loaders.PanelLoader(spark, str(tmp_path / "c.csv"), column_mapping={"px": "close"}), loaders.PanelLoader(spark, db)):
        df = loader.load_market_data()
        assert df.count() == n and df.schema["date"].dataType == T.DateType() and df.schema["symbol"].dataType == T.StringType()
        one = loader.load_market_data(["S0001"], "2024-01-01", "2024-01-05")
        assert one.count() == 5 and {r.symbol for r in one.collect()} == {"S0001"}
        assert loader.load_market_data([]).count() == 0
    with pytest.raises(ValueError):
        loaders.PanelLoader(spark).load_market_data()
    with pytest.raises(NotImplementedError):
        loader.load_fundamental_data()
    with pytest.raises(FileNotFoundError):
        loaders.SqliteLoader(spark, str(tmp_path / "absent.db"))


def test_sqlite_loader(spark, tmp_path):
    db = str(tmp_path / "us.db")
    with sqlite3.connect(db) as con:
        con.execute("create table bars (symbol text, market text, frequency text, dt text, open real, high real, low real, close real, volume integer, turnover real, adjust_factor real)")
        con.executemany("insert into bars values (?,?,?,?,?,?,?,?,?,?,?)", [("A", "US", "1d", f"2024-01-0{i} 00:00:00", 1, 1, 1, 10.0, 5, None, 1.5) for i in range(1, 6)] + [("A", "US", "1m", "2024-01-01", 1, 1, 1, 1, 1, 1, 1), ("B", "HK", "1d", "2024-01-01", 1, 1, 1, 1, 1, 1, 1)])
        con.execute("create table fundamentals (symbol text, market text, dt text, pe_ratio real, pb_ratio real, ps_ratio real, market_cap real, roe real, roa real, gross_profit_margin real, profit_growth_rate real, debt_to_asset real, current_ratio real)")
        con.execute("insert into fundamentals values ('A','US','2024-01-02 10:00:00',1,2,3,4,5,6,7,8,9,10)")
    loader = loaders.SqliteLoader(spark, db)
    df = loader.load_market_data(["A", "B"], "2024-01-02", "2024-01-04")
    assert [(r.date, r.adj_close) for r in df.orderBy("date").collect()] == [(datetime.date(2024, 1, d), 15.0) for d in (2, 3, 4)]
    assert loader.load_market_data([]).count() == 0
    f = loader.load_fundamental_data(None, "2024-01-01", "2024-01-02").first()
    assert (f.pe, f.gross_margin, f.date) == (1.0, 7.0, datetime.date(2024, 1, 2))


def test_lake_upsert_and_load(spark, bars, tmp_path):
    root = str(tmp_path)
    raw = bars.withColumnRenamed("date", "trade_date").withColumn("adjust_flag", F.lit("2"))
    etl.upsert_bars(spark, raw, root)
    etl.upsert_bars(spark, raw.where("symbol = 'S0001' and trade_date >= '2024-01-08'").withColumn("close", F.lit(1.0)), root)
    loader = loaders.LakeLoader(spark, root)
    df = loader.load_market_data()
    assert df.count() == bars.count() and df.where("close = 1.0").count() == 5
    assert loader.load_market_data(None, "2024-01-01").count() == bars.where("date >= '2024-01-01'").count()
    plan = loader.load_market_data(None, "2024-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:200]
    sec = spark.createDataFrame([("S0001", "A_stock", "stock", "a", None, None, "SSE"), ("S0002", "A_stock", "stock", "b", None, datetime.date(2023, 1, 1), "SSE")], "symbol string, market string, asset_type string, name string, list_date date, delist_date date, exchange string")
    etl.upsert_table(spark, sec, root, "securities")
    assert {r.symbol for r in loader.load_market_data(None, "2024-01-01").select("symbol").distinct().collect()} == {"S0001"}
    assert loaders.universe(sec, "2022-01-01", None, 1).first()["symbol"] == "S0001"
    assert loaders.LakeLoader(spark, str(tmp_path / "absent")).load_market_data().count() == 0
    with pytest.raises(NotImplementedError):
        loader.load_fundamental_data()


def test_tables_and_update(spark, bars, tmp_path):
    root = str(tmp_path)
    assert len(etl.create_tables(spark, root)) == 4 and etl.create_tables(spark, root) == []
    raw = bars.withColumnRenamed("date", "trade_date").withColumn("adjust_flag", F.lit("2"))
    val = etl.parse_valuation(spark.createDataFrame([("S0001", "2024-01-02", "12.5", "x", "")], "symbol string, date string, peTTM string, pbMRQ string, psTTM string"))
    done = etl.run_update(spark, root, raw, valuation=val, window=("2024-01-01", "2024-01-31"))
    assert done["daily_valuation"] == 1 and done["market_data"] == bars.where("date >= '2024-01-01'").count()
    assert etl.run_update(spark, root, raw, valuation=val)["daily_valuation"] == 1
    v = loaders.LakeLoader(spark, root).load_fundamental_data().first()
    assert v.pe_ttm == 12.5 and v.pb is None


def test_parsing(spark):
    raw = spark.createDataFrame([("sh.600519", "2024-01-02", "1.5", "", "bad", "2", "3", None)], "code string, date string, open string, high string, low string, close string, volume string, amount string")
    b = etl.clean_bars(raw, "2").first()
    assert (b.symbol, b.open, b.high, b.low, b.adjust_flag) == ("600519.SH", 1.5, None, None, "2")
    rep = spark.createDataFrame([("A", "2023-12-31", None, "1.5"), ("A", "junk", "2024-01-01", "2")], ["symbol", "报告期", "公告日期", "净利润"])
    got = etl.parse_reports(rep).collect()
    assert len(got) == 1 and got[0].net_profit == 1.5 and got[0].publish_date is None
    cal = etl.parse_calendar(spark.createDataFrame([("2024-01-01", "0"), ("2024-01-02", "1"), ("", "1")], "calendar_date string, is_trading_day string")).orderBy("trade_date").collect()
    assert [r.is_open for r in cal] == [False, True]


def test_codes_and_dates(spark):
    df = spark.createDataFrame([("600519", "2024/01/05"), ("000001.sz", "20240105"), ("830001", "2024-01-05")], "s string, d string")
    got = df.select(C.to_vendor_code(F.col("s")).alias("v"), C.bare_code(F.col("s")).alias("b"), C.dashed_date(F.col("d")).alias("d")).collect()
    assert [(r.v, r.b, r.d) for r in got] == [("sh.600519", "600519", "2024-01-05"), ("sz.000001", "000001", "2024-01-05"), ("sz.830001", "830001", "2024-01-05")]
    with pytest.raises(Exception, match="YYYYMMDD"):
        df.select(C.compact_date(F.lit("2024-1-5"))).collect()


def test_point_in_time(spark):
    d = datetime.date
    days = spark.createDataFrame([("A", d(2024, 1, 1)), ("A", d(2024, 5, 1))], "symbol string, date date")
    reps = spark.createDataFrame([("A", d(2023, 12, 31), d(2024, 4, 1), 5.0)], "symbol string, report_date date, publish_date date, eps double")
    assert [r.eps for r in loaders.point_in_time(days, reps, ["eps"]).orderBy("date").collect()] == [None, 5.0]


def test_pulled_source_retries(spark):
    class Flaky(loaders.PulledSource):
        tries = 0

        def wait(self, attempt):
            return 0.0

        def fetch(self, request):
            self.tries += 1
            if request["symbol"] == "bad" or self.tries < 2:
                raise RuntimeError
            return [{"symbol": request["symbol"], "x": 1.0}]

    req = spark.createDataFrame([("a",), ("bad",)], "symbol string").coalesce(1)
    out = Flaky().pull(req, T.StructType().add("symbol", "string").add("x", "double"))
    assert [(r.symbol, r.x) for r in out.collect()] == [("a", 1.0)]


def test_progress(spark, tmp_path):
    path = str(tmp_path / "progress")
    s = spark.createDataFrame([("A",), ("B",)], "symbol string")
    etl.mark_done(path, s.where("symbol = 'A'"), "t")
    etl.mark_done(path, s.where("symbol = 'A'"), "t")
    assert [r.symbol for r in etl.to_do(s, spark.read.parquet(path), "t").collect()] == ["B"]
    assert etl.task_key("2016-01-01", "2024-01-01") == "market_20160101_20240101_adj2"


def test_schema_and_config(spark, bars, tmp_path):
    with pytest.warns(UserWarning):
        assert schema.validate_schema(bars.drop("close")) == ["close"]
    with pytest.raises(ValueError):
        schema.validate_schema(bars.drop("close"), strict=True)
    assert schema.check_unique(bars.unionByName(bars)).count() == bars.count()
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    path = tmp_path / "c.yaml"
    path.write_text("evaluation:\n  n_groups: 10\n")
    c = load_config(str(path))
    assert c["evaluation"]["n_groups"] == 10 and c["evaluation"]["forward_periods"] == [1, 5, 10, 20]
    assert load_timing_config()["evaluation"]["trading_days"] == 252


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "bars.parquet")
    synthetic_bars(spark, 8, "2023-01-02", "2023-06-30").write.parquet(path)
    main(["strategy", "--data", path, "--benchmarks", "S0008", "--lookback", "5", "--output", str(tmp_path / "s")], spark)
    assert (tmp_path / "s" / "report.html").exists()
    main(["selection", "--data", path, "--factors", "momentum_5", "--output", str(tmp_path / "f")], spark)
    assert spark.read.csv(str(tmp_path / "f" / "summary"), header=True).count() == 4
    main(["timing", "--data", path, "--symbols", "S0001", "--benchmark", "S0002", "--output", str(tmp_path / "t")], spark)
    assert spark.read.csv(str(tmp_path / "t" / "summary"), header=True).count() == 2


def test_streamed_bars(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(src)
    q = keep_bars_up_to_date(stream, str(tmp_path / "lake"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = TableLog(spark, str(tmp_path / "lake" / "market_data")).read().select("trade_date", "symbol", "open", "close", "volume")
    want = event_bars(events).selectExpr("date as trade_date", "symbol", "open", "close", "volume")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
