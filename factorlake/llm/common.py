"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import drop_written, materialize, scratch_dir, written  # noqa: F401

#: Keys with more than this share of the rows are "heavy": there are at most HEAVY_PARTS of them, whatever the data's size.
HEAVY_PARTS = 1000

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hashes(text: Column) -> Column:
    """128 bits by which texts are told apart, as an array of two numbers."""
    return F.array(F.xxhash64(text), F.xxhash64(F.lit(7), text))


def repeated(df: DataFrame, times: str, number: str, at_once: int = 10_000) -> DataFrame:
    """Each row `times` times, numbered from 0 by a column `number`; rows with many copies are made by several tasks."""
    few = df.where(F.col(times).between(1, at_once)).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    many = df.where(F.col(times) > at_once).withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / at_once)))).repartition("_stretch")
    last = F.least(F.col(times), (F.col("_stretch") + 1) * at_once) - 1
    many = many.withColumn(number, F.explode(F.sequence(F.col("_stretch") * at_once, last))).drop("_stretch")
    return few.unionByName(many)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on key, where right has one row a key and its column weight says how many left rows hold it.

    Keys with over total / HEAVY_PARTS rows are joined by broadcast: by their
    weight there can't be more than HEAVY_PARTS of them. The others are
    joined by a shuffle, in which no key is large.
    """
    least = max(1, total // HEAVY_PARTS)
    heavy = right.where(F.col(weight) > least)
    light = right.where(F.col(weight) <= least)
    marked = left.join(F.broadcast(heavy.select(key, F.lit(True).alias("_heavy"))), key, "left")
    by_broadcast = left.join(F.broadcast(heavy), key)
    by_shuffle = marked.where("_heavy is null").drop("_heavy").join(light, key)
    return by_broadcast.unionByName(by_shuffle)


def usable_vector(c: Column) -> Column:
    """Not null, no null, NaN or infinite component, and not zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)
