"""Bars derived from the driver's tables, and synthetic bars.

No table is an OHLCV table; a supplier stands for a symbol, and a line item's
unit price for a trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded_half_up


def half_up(c: Column, digits: int) -> Column:
    """Rounded in plain double arithmetic, which every engine does alike."""
    return rounded_half_up(c, digits)


def supplier_bars(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """date, symbol, OHLCV and amount of each supplier's unit prices per week, month or day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = half_up(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    # trades in time; a struct, as no number holds keys of any size side by side
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = li.where("l_quantity != 0").select(F.date_trunc(bucket, "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("symbol"), price.alias("u"), key.alias("k"), "l_quantity", "l_extendedprice")
    return rows.groupBy("date", "symbol").agg(
        F.min_by("u", "k").alias("open"),
        F.max("u").alias("high"),
        F.min("u").alias("low"),
        F.max_by("u", "k").alias("close"),
        F.sum("l_quantity").alias("volume"),
        half_up(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, OHLCV of each user's event values per day; volume counts events."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    key = F.struct("ts", "event_id")
    return ev.groupBy(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("symbol")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume")
    )


def calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly supplier bars whose prices are 100 + ln(price): in the same order, without jumps by orders of magnitude."""
    bars = supplier_bars(spark, sf_dir)
    calm = [half_up(100 + F.ln(c), 6).alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("date", "symbol", *calm, "volume", "amount")


def synthetic_bars(spark: SparkSession, symbols: int, start: str, end: str, seed: int = 42, drift: float = 0.0003, vol: float = 0.012, price: float = 100.0) -> DataFrame:
    """Geometric random walks on business days with an OHLC envelope; every value follows from (seed, symbol, day)."""
    from pyspark.sql import Window

    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}', interval 1 day)) AS date").where("weekday(date) < 5")
    ids = spark.range(symbols).select(F.format_string("S%04d", F.col("id") + 1).alias("symbol"))

    def uniform(k: int):
        h = F.xxhash64(F.lit(seed), F.lit(k), "symbol", "date")
        return (F.pmod(h, F.lit(2**40)) + 0.5) / float(2**40)

    def normal(k: int):
        return F.sqrt(-2 * F.ln(uniform(k))) * F.cos(2 * F.pi() * uniform(k + 100))

    w = Window.partitionBy("symbol").orderBy("date")
    walk = price * F.exp(F.sum(drift - vol * vol / 2 + vol * normal(0)).over(w))
    df = ids.crossJoin(F.broadcast(days)).withColumn("close", walk)
    df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(price)) * (1 + 0.2 * vol * normal(1)))
    df = df.withColumn("high", F.greatest("open", "close") * (1 + F.abs(0.3 * vol * normal(2)))).withColumn("low", F.least("open", "close") * (1 - F.abs(0.3 * vol * normal(3))))
    return df.withColumn("volume", F.floor(1000 + 4000 * uniform(4)).cast("double")).select("date", "symbol", "open", "high", "low", "close", "volume")
