"""Cleaning, keyed upserts, tables and progress of the stored data."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import as_date, from_vendor_code, safe_double, soft_date
from ..schema import DAILY_VALUATION, FINANCIAL_REPORTS, KEYS, RAW_BARS, TABLES
from .tablelog import TableLog


def in_file_order(df: DataFrame) -> DataFrame:
    """df, read from Parquet files, with _seq: the file and the row's place in it, which don't depend on how the files are dealt to tasks."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_seq"))


def keep_last(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of old and new with one row a key: new before old, and within new the later.

    Later is the higher by the columns `order`, by default by _seq (which goes,
    see in_file_order()) if there is one. Rows that tie, or all of a key where
    there is no order, are told apart by their columns: the greatest stays. So the
    result never depends on partitions or retries.
    """
    names = [c for c in new.columns if c != "_seq"]
    order = order if order is not None else ["_seq"] if "_seq" in new.columns else []
    places = [f"_o{i}" for i in range(len(order))]
    both = new.select(*names, *[F.col(c).alias(o) for c, o in zip(order, places)], F.lit(1).alias("_batch"))
    if old is not None:
        before = old.select(*names, *[F.lit(None).cast(both.schema[o].dataType).alias(o) for o in places], F.lit(0).alias("_batch"))
        both = before.unionByName(both)
    # the first row of a key is all that a task sends on
    w = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in ("_batch", *places, *names)])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*names)


def layout_of(files: int):
    """How bars are dealt before they are written: by market, year and about `files` parts of the symbols, each in order."""
    return lambda df: df.repartition("market", "year", F.pmod(F.xxhash64("symbol"), F.lit(files))).sortWithinPartitions("market", "year", "symbol", "trade_date")


def upsert_bars(spark: SparkSession, new: DataFrame, root: str, market: str = "A_stock", files: int = 8, order: list[str] | None = None) -> int:
    """Merge bars into the versioned table market_data, by market and year: only the years that new touches are read and rewritten, in about `files` files each; the new version.

    Until that version is in the log, readers see the table before, whole.
    """
    new = new.withColumns({"market": F.lit(market), "year": F.year("trade_date")})
    merge = lambda old, rows, keys: keep_last(old, rows, keys, order)
    return TableLog(spark, f"{root}/market_data").upsert(new, ["market", "year", "symbol", "trade_date"], merge, ["market", "year"], layout_of(files))


def upsert_table(spark: SparkSession, new: DataFrame, root: str, name: str, order: list[str] | None = None) -> int:
    """INSERT OR REPLACE by the table's key; the new version."""
    return TableLog(spark, f"{root}/{name}").upsert(new, KEYS[name], lambda old, rows, keys: keep_last(old, rows, keys, order))


def replace_market(spark: SparkSession, new: DataFrame, root: str, name: str, market: str = "A_stock") -> int:
    """Full refresh of one market's rows, even to none; the other markets keep their folders. The table is stored by market, in a folder name_by_market of its own."""
    own = new.where(F.col("market") == market)
    touched = spark.createDataFrame([(market,)], "market string")
    return TableLog(spark, f"{root}/{name}_by_market").replace_partitions(own, ["market"], touched)


def create_tables(spark: SparkSession, root: str) -> list[str]:
    """Make the stored tables that aren't there yet, empty; safe to repeat."""
    made = []
    for name, schema in TABLES.items():
        log = TableLog(spark, f"{root}/{name}")
        if not log.exists():
            log.overwrite(spark.createDataFrame([], schema))
            made.append(name)
    return made


# --- parsing of vendor rows ---------------------------------------------------


def clean_bars(raw: DataFrame, adjust_flag: str) -> DataFrame:
    """Vendor bars (code, date, text numbers) as the stored bars; what is no number becomes null."""
    numbers = [safe_double(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")]
    return raw.select(from_vendor_code(F.col("code")).alias("symbol"), F.to_date("date").alias("trade_date"), *numbers, F.lit(adjust_flag).alias("adjust_flag")).select(*RAW_BARS.names)


def parse_valuation(raw: DataFrame) -> DataFrame:
    """Vendor valuation rows (symbol, date, peTTM, pbMRQ, psTTM); the other measures are null."""
    found = {"pe_ttm": "peTTM", "pb": "pbMRQ", "ps_ttm": "psTTM"}
    values = [(safe_double(F.col(found[c])) if found.get(c) in raw.columns else F.lit(None).cast("double")).alias(c) for c in DAILY_VALUATION.names[2:]]
    return raw.select("symbol", F.to_date("date").alias("trade_date"), *values)


#: Vendor's column names of financial reports. Fixed values.
REPORT_COLUMNS = {
    "报告期": "report_date", "公告日期": "publish_date", "营业总收入": "total_revenue", "营业收入": "revenue", "净利润": "net_profit", "扣非净利润": "net_profit_excl",
    "总资产": "total_assets", "总负债": "total_liabilities", "股东权益合计": "equity", "经营活动产生的现金流量净额": "oper_cashflow", "基本每股收益": "eps", "每股净资产": "bps",
    "净资产收益率": "roe", "销售毛利率": "gross_margin", "销售净利率": "net_margin", "资产负债率": "debt_ratio",
}


def parse_reports(raw: DataFrame) -> DataFrame:
    """Vendor reports as the stored table; rows without a readable report date go."""
    df = raw.withColumnsRenamed(REPORT_COLUMNS)
    dates = [(soft_date(F.col(c)) if c in df.columns else F.lit(None).cast("date")).alias(c) for c in ("report_date", "publish_date")]
    values = [(safe_double(F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in FINANCIAL_REPORTS.names[3:]]
    return df.select("symbol", *dates, *values).where("report_date is not null")


def parse_securities(raw: DataFrame, market: str = "A_stock") -> DataFrame:
    """Vendor security list (code, code_name, ipoDate, outDate, type)."""
    code, kind = F.trim(F.col("code")), F.trim(F.coalesce(F.col("type").cast("string"), F.lit("1")))
    blank = lambda c: as_date(F.nullif(F.trim(F.col(c)), F.lit("")))
    return raw.where(F.length(code) > 0).select(
        from_vendor_code(code).alias("symbol"),
        F.lit(market).alias("market"),
        F.when(kind == "1", "stock").when(kind == "2", "index").otherwise("other").alias("asset_type"),
        F.col("code_name").alias("name"),
        blank("ipoDate").alias("list_date"),
        blank("outDate").alias("delist_date"),
        F.when(code.startswith("sh"), "SSE").otherwise("SZSE").alias("exchange"),
    )


def parse_calendar(raw: DataFrame, market: str = "A_stock") -> DataFrame:
    day = soft_date(F.col("calendar_date"))
    return raw.select(day.alias("trade_date"), F.lit(market).alias("market"), (F.trim(F.col("is_trading_day").cast("string")) == "1").alias("is_open")).where("trade_date is not null")


# --- progress -------------------------------------------------------------------


def to_do(symbols: DataFrame, progress: DataFrame, task: str) -> DataFrame:
    """Symbols without an entry for the task."""
    return symbols.select("symbol").distinct().join(progress.where(F.col("task") == task), "symbol", "left_anti")


def mark_done(progress_path: str, done: DataFrame, task: str) -> None:
    """Append (task, symbol) rows; repeats do no harm."""
    done.select(F.lit(task).alias("task"), "symbol").write.mode("append").parquet(progress_path)


def task_key(start: str, end: str, adjust_flag: str = "2") -> str:
    return f"market_{start.replace('-', '')}_{end.replace('-', '')}_adj{adjust_flag}"


def progress_status(bars: DataFrame, securities: DataFrame, start: str, end: str, tolerance_days: int = 30, today: str | None = None) -> DataFrame:
    """symbol, last_date, n and status of every symbol with bars, and of securities outside the range.

    done: the bars reach to within tolerance_days of the range's (or the
    delisting's) end, or the security never traded in the range; else stale.
    """
    d = lambda s: F.lit(s).cast("date")
    until = min(end, today or datetime.date.today().isoformat())
    seen = bars.groupBy("symbol").agg(F.max("trade_date").alias("last_date"), F.count("trade_date").alias("n"))
    both = seen.join(securities.select("symbol", "list_date", "delist_date").withColumn("_known", F.lit(True)), "symbol", "full")
    outside = F.coalesce(F.col("list_date") > d(end), F.lit(False)) | F.coalesce(F.col("delist_date") < d(start), F.lit(False))
    stop = F.when(F.col("delist_date") < d(until), F.col("delist_date")).otherwise(d(until))
    late = F.coalesce(F.col("last_date") >= F.date_sub(stop, tolerance_days), F.lit(False))
    out = both.withColumn("status", F.when(outside | late, "done").otherwise("stale"))
    return out.where(F.col("n").isNotNull() | outside).select("symbol", "last_date", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "status")


def last_quarter_end(today: Column) -> Column:
    """The latest quarter end that isn't after today."""
    this = F.last_day(F.add_months(F.trunc(today, "quarter"), 2))
    return F.when(this == today, this).otherwise(F.date_sub(F.trunc(today, "quarter").cast("date"), 1))


def incremental_window(today: datetime.date, lookback_days: int = 7) -> tuple[str, str]:
    return (today - datetime.timedelta(days=lookback_days)).isoformat(), today.isoformat()


def run_update(spark: SparkSession, root: str, bars: DataFrame, valuation: DataFrame | None = None, reports: DataFrame | None = None, securities: DataFrame | None = None, calendar: DataFrame | None = None, window: tuple[str, str] | None = None) -> dict[str, int]:
    """Full or (with a window of dates) incremental update of all tables from parsed rows; rows written by table."""
    create_tables(spark, root)
    if securities is not None:
        upsert_table(spark, securities, root, "securities")
    if calendar is not None:
        upsert_table(spark, calendar, root, "trade_calendar")
    if window:
        bars = bars.where(F.col("trade_date").between(*[F.lit(x).cast("date") for x in window]))
    upsert_bars(spark, bars, root)
    if valuation is not None:
        upsert_table(spark, valuation, root, "daily_valuation")
    if reports is not None:
        upsert_table(spark, reports, root, "financial_reports")
    return {n: TableLog(spark, f"{root}/{n}").read().count() for n in ("market_data", *TABLES)}
