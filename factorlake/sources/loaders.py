"""Loaders of market and fundamental panels.

Symbols: None means all, an empty list none. Dates are inclusive at both ends
and compared as dates. Panels are long, with date DATE, symbol STRING and
DOUBLE values.
"""

from __future__ import annotations

import os
import warnings
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.codes import soft_date
from ..schema import BARS, Col, validate_schema
from .quarantine import SKIPPED, read_good
from .sqlite import read_sqlite
from .tablelog import TableLog, path_exists


def standardize(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename columns, make date a DATE and symbol a STRING."""
    df = df.withColumnsRenamed(mapping or {})
    if Col.DATE in df.columns:
        kind = dict(df.dtypes)[Col.DATE]
        df = df.withColumn(Col.DATE, soft_date(F.substring(Col.DATE, 1, 10)) if kind == "string" else F.col(Col.DATE).cast("date"))
    return df.withColumn(Col.SYMBOL, F.col(Col.SYMBOL).cast("string")) if Col.SYMBOL in df.columns else df


def between_dates(df: DataFrame, start=None, end=None, column: str = Col.DATE) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(str(end)).cast("date"))


def only_symbols(df: DataFrame, symbols, column: str = Col.SYMBOL) -> DataFrame:
    """Rows of the given symbols: None all, a DataFrame by semi-join, a list by IN (none for an empty one)."""
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(F.col(symbols.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin([str(s) for s in symbols])) if symbols else df.where("false")


def filter_panel(df: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    return between_dates(only_symbols(df, symbols), start, end)


def sorted_panel(df: DataFrame) -> DataFrame:
    """By date, then symbol: for sinks only."""
    return df.orderBy(Col.DATE, Col.SYMBOL)


def active_securities(securities: DataFrame, start=None, end=None, market: str = "A_stock", asset_type: str = "stock") -> DataFrame:
    """symbol of the securities listed by `end` and not delisted before `start`; null dates pass."""
    df = securities.where((F.col("market") == market) & (F.col("asset_type") == asset_type))
    if end is not None:
        df = df.where(F.col("list_date").isNull() | (F.col("list_date") <= F.lit(str(end)).cast("date")))
    if start is not None:
        df = df.where(F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(str(start)).cast("date")))
    return df.select("symbol")


def universe(securities: DataFrame, start=None, end=None, limit: int | None = None, **kind) -> DataFrame:
    df = active_securities(securities, start, end, **kind).orderBy("symbol")
    return df if limit is None else df.limit(limit)


def universe_by_history(bars: DataFrame, least: int = 80, limit: int | None = None, start=None, end=None) -> DataFrame:
    """symbol and n of the symbols with at least `least` bars, by symbol."""
    n = between_dates(bars, start, end).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("symbol")
    return n if limit is None else n.limit(limit)


def point_in_time(days: DataFrame, reports: DataFrame, values: list[str]) -> DataFrame:
    """days (date, symbol) with the values of the report published last by that day.

    Reports and days of a symbol are laid in one order of time and the last
    report carried forward: one shuffle by symbol, without a range join.
    """
    from pyspark.sql import Window

    known = F.coalesce("publish_date", "report_date")
    r = reports.select("symbol", known.alias("date"), F.lit(0).alias("_kind"), F.struct("report_date", *values).alias("_r"))
    d = days.select("symbol", "date", F.lit(1).alias("_kind"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    w = Window.partitionBy("symbol").orderBy("date", "_kind", F.col("_r.report_date")).rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(d).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_kind = 1").select("date", "symbol", *[F.col(f"_last.{v}") for v in values])


class Loader(ABC):
    @abstractmethod
    def load_market_data(self, symbols=None, start=None, end=None) -> DataFrame: ...

    def load_fundamental_data(self, symbols=None, start=None, end=None) -> DataFrame:
        raise NotImplementedError("this loader has no fundamental data")


class PanelLoader(Loader):
    """CSV or Parquet files, or an SQLite table, with a column mapping."""

    def __init__(self, spark: SparkSession, market_path: str | None = None, market_table: str = "market", column_mapping: dict[str, str] | None = None, fundamental_path: str | None = None, fundamental_table: str = "fundamental"):
        self.spark, self.mapping = spark, column_mapping
        self.paths = {"market": (market_path, market_table), "fundamental": (fundamental_path, fundamental_table)}

    def _read(self, which: str) -> DataFrame:
        path, table = self.paths[which]
        if not path:
            raise ValueError(f"no path for {which} data")
        if path.endswith((".db", ".sqlite", ".sqlite3")):
            df = read_sqlite(self.spark, path, table)
        elif path.endswith(".csv"):
            df = self.spark.read.csv(path, header=True, inferSchema=True)
        else:
            df = self.spark.read.parquet(path)
        return standardize(df, self.mapping)

    def load_market_data(self, symbols=None, start=None, end=None) -> DataFrame:
        df = self._read("market")
        validate_schema(df)
        return filter_panel(df, symbols, start, end)

    def load_fundamental_data(self, symbols=None, start=None, end=None) -> DataFrame:
        if not self.paths["fundamental"][0]:
            raise NotImplementedError("no path for fundamental data")
        return filter_panel(self._read("fundamental"), symbols, start, end)


class LakeLoader(Loader):
    """Stored tables under a folder: market_data by market and year, securities, daily_valuation, financial_reports.

    A table may have a log of versions (tablelog.TableLog) or be a plain Parquet
    folder. A date range becomes a range of years too, so that partitions are
    pruned. A missing table gives an empty panel. Files that can't be read, or
    that a table with a log has lost, are skipped with a warning, and listed with
    their reasons in `skipped` (a DataFrame) after each load; check_files=False
    leaves the probing of footers out, and then a bad file raises an error.
    """

    def __init__(self, spark: SparkSession, root: str, market: str = "A_stock", check_files: bool = True):
        self.spark, self.root, self.market, self.check_files = spark, root.rstrip("/"), market, check_files
        self.skipped = spark.createDataFrame([], SKIPPED)

    def _table(self, name: str, keep: dict | None = None) -> DataFrame | None:
        path = f"{self.root}/{name}"
        log = TableLog(self.spark, path)
        if log.exists():
            if not self.check_files:
                return log.read()
            df, skipped = log.read_checked(keep)
            self.skipped = self.skipped.unionByName(skipped)
            return df
        if not path_exists(self.spark, path):
            warnings.warn(f"no table {name} under {self.root}", stacklevel=3)
            return None
        plain = self._plain_schema(path)
        if plain is None or not self.check_files:
            return None if plain is None else self.spark.read.schema(plain).parquet(path)
        parts = [c for c in ("market", "year") if c in plain.names and name == "market_data"]
        df, skipped = read_good(self.spark, [path], plain, path, None, StructType([f for f in plain.fields if f.name not in parts]))
        self.skipped = self.skipped.unionByName(skipped)
        return df

    def _plain_schema(self, path: str) -> StructType | None:
        """From the first file whose footer can be read."""
        try:
            return self.spark.read.option("ignoreCorruptFiles", True).parquet(path).schema
        except AnalysisException:
            warnings.warn(f"no readable file under {path}", stacklevel=4)
            return None

    def load_market_data(self, symbols=None, start=None, end=None) -> DataFrame:
        self.skipped = self.spark.createDataFrame([], SKIPPED)
        low, high = (int(str(d)[:4]) if d is not None else None for d in (start, end))
        in_range = lambda y: y.isdigit() and (low is None or int(y) >= low) and (high is None or int(y) <= high)
        keep = {"market": lambda m: m == self.market} | ({} if low is None and high is None else {"year": in_range})
        df = self._table("market_data", keep)
        if df is None:
            return self.spark.createDataFrame([], BARS)
        df = df.where(F.col("market") == self.market)
        if low is not None:
            df = df.where(F.col("year") >= low)
        if high is not None:
            df = df.where(F.col("year") <= high)
        df = standardize(df.drop("market", "year"), {"trade_date": "date"})
        df = filter_panel(df, symbols, start, end)
        securities = self._table("securities")
        if securities is not None:
            df = only_symbols(df, active_securities(securities, start, end, self.market))
        validate_schema(df)
        return df

    def securities(self) -> DataFrame | None:
        return self._table("securities")

    def load_fundamental_data(self, symbols=None, start=None, end=None) -> DataFrame:
        df = self._table("daily_valuation")
        if df is None:
            raise NotImplementedError("no valuation table")
        return filter_panel(standardize(df, {"trade_date": "date", "total_mv": "mkt_cap"}), symbols, start, end)

    def load_financial_reports(self, symbols=None, start=None, end=None) -> DataFrame:
        """Reports by report date (with point_in_time() for what was known on a day)."""
        df = self._table("financial_reports")
        if df is None:
            raise NotImplementedError("no table of financial reports")
        return between_dates(only_symbols(df, symbols), start, end, "report_date")


class SqliteLoader(Loader):
    """Tables bars and fundamentals of an SQLite file; symbols, dates and columns go into its query."""

    FUNDAMENTALS = {
        "dt": "date", "symbol": "symbol", "pe_ratio": "pe", "pb_ratio": "pb", "ps_ratio": "ps", "market_cap": "mkt_cap", "roe": "roe", "roa": "roa",
        "gross_profit_margin": "gross_margin", "profit_growth_rate": "profit_growth", "debt_to_asset": "debt_ratio", "current_ratio": "current_ratio",
    }

    def __init__(self, spark: SparkSession, path: str, market: str = "US"):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        self.spark, self.path, self.market = spark, path, market

    def _where(self, symbols, start, end, first: str) -> tuple[str, list]:
        parts, params = [first], [self.market]
        for sign, d in ((">=", start), ("<=", end)):
            if d is not None:
                parts.append(f"date(dt) {sign} ?")
                params.append(str(d))
        if symbols is not None:
            parts.append(f"symbol IN ({', '.join('?' * len(symbols))})" if symbols else "0")
            params += [str(s) for s in symbols]
        return " AND ".join(parts), params

    def load_market_data(self, symbols=None, start=None, end=None) -> DataFrame:
        where, params = self._where(symbols, start, end, "market = ? AND frequency = '1d'")
        names = ["dt", "symbol", "open", "high", "low", "close", "volume", "turnover", "adjust_factor"]
        df = read_sqlite(self.spark, self.path, "bars", names, where, params)
        df = standardize(df, {"dt": "date"})
        doubles = {c: F.col(c).cast("double") for c in names[2:]}
        df = df.withColumns(doubles)
        return df.withColumn("adj_close", adjusted_close()).drop("adjust_factor")

    def load_fundamental_data(self, symbols=None, start=None, end=None) -> DataFrame:
        where, params = self._where(symbols, start, end, "market = ?")
        df = read_sqlite(self.spark, self.path, "fundamentals", list(self.FUNDAMENTALS), where, params)
        return standardize(df, self.FUNDAMENTALS)


def adjusted_close(close: str = "close", factor: str = "adjust_factor"):
    return F.round(F.col(close) * F.col(factor), 6)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class PulledSource(ABC):
    """Where a remote vendor's rows come from. Give `fetch`; the ETL runs it on executors, a request per row of a table of them."""

    retries = 3

    @abstractmethod
    def fetch(self, request: dict) -> list[dict]: ...

    def pull(self, requests: DataFrame, schema) -> DataFrame:
        """Rows of every request; a failing one is tried again after 5 * 2^k seconds and then gives none (it stays to do)."""
        source, names = self, [f.name for f in schema.fields]

        def run(batches):
            import random
            import time

            import pandas as pd

            for pdf in batches:
                rows = []
                for request in pdf.to_dict("records"):
                    for attempt in range(source.retries + 1):
                        try:
                            rows += source.fetch(request)
                            break
                        except Exception:
                            if attempt < source.retries:
                                time.sleep(source.wait(attempt) + random.uniform(0, 2) * (source.wait(attempt) > 0))
                yield pd.DataFrame(rows, columns=names)

        return requests.mapInPandas(run, schema)

    def wait(self, attempt: int) -> float:
        return 5.0 * 2**attempt
