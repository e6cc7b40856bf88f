"""Bars stored by symbol, so that factors of them move no rows.

Windows, grids and joins along a symbol need its rows in one place. A table that
is bucketed by symbol has them there already, and every later run over it saves
the shuffle that this one write makes. Each bucket is one file, in order of
symbol and date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a bucket should hold, about, and buckets of a table at least.
BUCKET_ROWS, LEAST = 5_000_000, 8


class BarStore:
    """A catalog table of bars, bucketed and sorted by symbol; in the warehouse, or at a path.

    Joins by symbol and date over it need no shuffle only where Spark may co-locate
    by a part of the keys. That is a setting of a session, and not one for all
    plans, so that the bars are read in a session of the store's own.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.name, self.path, self.spark = name, path, spark.newSession()
        for key, value in spark.conf.getAll.items():
            if self.spark.conf.isModifiable(key):
                self.spark.conf.set(key, value)
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def write(self, bars: DataFrame, buckets: int | None = None) -> BarStore:
        """Replace the table by these bars. As many buckets as the rows ask for, at least LEAST, by default."""
        if buckets is None:
            buckets = max(LEAST, -(-bars.count() // BUCKET_ROWS))
        # dealt by the hash that buckets go by: a task writes one file
        writer = bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
