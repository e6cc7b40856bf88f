"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Tables written by materialize() and not yet deleted, by application.
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir); a temporary one where that is unset and Spark runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _own_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage like checkpoint(), but keeps column pruning and filter
    pushdown for the readers, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that materialize() has written and drop_written() hasn't deleted."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that materialize() wrote. Call it only when every result that reads them is stored elsewhere."""
    own = _written.get(spark.sparkContext.applicationId, [])
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in [p for p in paths if p in own]:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
        own.remove(path)


#: Plan nodes that cost no more than reading a file again.
_CHEAP = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "LocalRelation", "Range", "View"}


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """df itself if it only reads, filters and projects; else written once, for callers that read it several times."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in _CHEAP:
            return materialize(df, label)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return df


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that materialize() writes inside. Store results elsewhere before it ends: frames made inside can't be read after it."""
    before = set(written(spark))
    try:
        yield
    finally:
        drop_written(spark, [p for p in written(spark) if p not in before])
