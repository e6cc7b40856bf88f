"""Bars from a stream of events (an extension: batch is all that backtests need)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.etl import upsert_bars


def event_bars(events: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Windowed OHLCV of each user's values; windows close once the watermark has passed them."""
    key = F.struct("ts", "event_id")
    w = events.where("value is not null").withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), F.col("user_id").cast("string").alias("symbol"))
    bars = w.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select(F.col("w.start").cast("date").alias("date"), "symbol", "open", "high", "low", "close", "volume")


def keep_bars_up_to_date(events: DataFrame, root: str, checkpoint: str, market: str = "events"):
    """A query that merges each batch's bars into the stored ones; available data, then stop."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.withColumnRenamed("date", "trade_date").withColumns({"amount": F.lit(None).cast("double"), "adjust_flag": F.lit("0")})
        upsert_bars(batch.sparkSession, rows.select("trade_date", "symbol", "open", "high", "low", "close", "volume", "amount", "adjust_flag"), root, market)

    return event_bars(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
