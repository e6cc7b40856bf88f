"""Files that can't be read: found before a load, listed with a reason, and left out of it.

Footers are probed on the executors by a scan without columns, which opens each
file's footer and no more. Files that it doesn't bring back are looked at once
more, each for itself: an empty file is fine, any other is skipped. Where the
writer left a list of its files, files that are gone are told too.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SKIPPED = "path string, length long, status string, reason string"
#: Paths that are looked at in one job, and files beyond which the good ones are no longer listed one by one.
AT_ONCE, LISTED = 1_000, 10_000


def _plain(path) -> F.Column:
    """A path as all of Spark's columns can be made to give it: one slash after the scheme, nothing encoded."""
    path = F.when(F.instr(path, "%") > 0, F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and length of the Parquet files under some folders; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths)
    return found.select(_plain(F.col("path")).alias("path"), "length")


def _closer(spark: SparkSession, schema: StructType, paths: list[str]) -> list[tuple[str, str]]:
    """(path, reason) of the files among paths that can't be read; empty ones can."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    def fine(some: list[str]) -> bool:
        try:
            spark.read.schema(schema).option("ignoreCorruptFiles", False).parquet(*some).count()
            return True
        except (PySparkException, Py4JJavaError):
            return False

    out = []
    for at in range(0, len(paths), AT_ONCE):
        some = paths[at : at + AT_ONCE]
        raw = spark.read.format("binaryFile").load(some).select(_plain(F.col("path")).alias("path"), "length", F.expr("substring(content, 1, 4)").alias("head"), F.expr("right(content, 4)").alias("tail"))
        magic = F.lit("PAR1").cast("binary")
        reason = F.when(F.col("length") < 12, "shorter than any Parquet file").when(F.col("head") != magic, "doesn't begin like a Parquet file").when(F.col("tail") != magic, "ends without a footer: cut short, or not Parquet")
        bad = {r.path: r.reason for r in raw.select("path", reason.alias("reason")).collect()}  # one short row for each file that wasn't read
        rest = [p for p, why in bad.items() if why is None]
        out += [(p, why) for p, why in bad.items() if why is not None]
        if rest and not fine(rest):
            out += [(p, "the footer can't be read") for p in rest if not fine([p])]
    return out


def probe(spark: SparkSession, paths: list[str], schema: StructType, expected: DataFrame | None = None) -> DataFrame:
    """path, length, n_rows, status (ok, empty, corrupt or missing) and reason of every file under paths.

    expected: path and length of the files that should be there, as list_files() gives them; what isn't is missing.
    """
    files = list_files(spark, paths)
    scan = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).parquet(*paths)
    n = scan.groupBy(_plain(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    both = files.join(n, "path", "left")
    unread = [r.path for r in both.where("n_rows is null").select("path").collect()]  # a row for each file without rows
    bad = spark.createDataFrame(_closer(spark, schema, unread), "path string, reason string")
    status = F.when(F.col("n_rows").isNotNull(), "ok").when(F.col("reason").isNotNull(), "corrupt").otherwise("empty")
    out = both.join(bad, "path", "left").select("path", "length", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"), "reason")
    if expected is not None:
        gone = expected.join(files.select("path"), "path", "left_anti")
        gone = gone.select("path", "length", F.lit(0).cast("long").alias("n_rows"), F.lit("missing").alias("status"), F.lit("no longer there").alias("reason"))
        out = out.unionByName(gone)
    return out


def read_good(spark: SparkSession, paths: list[str], schema: StructType, base: str | None = None, expected: DataFrame | None = None, file_schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows of all files that can be read, the files that were skipped with status and reason); warns with their number.

    file_schema: the columns in the files, if schema has partition columns too. A
    file whose footer can be read but whose pages can't raises an error when it is read.
    """
    found = probe(spark, paths, file_schema or schema, expected).cache()
    counts = {r.status: r["count"] for r in found.groupBy("status").count().collect()}
    skipped = [tuple(r) for r in found.where("status in ('corrupt', 'missing')").select("path", "length", "status", "reason").collect()]  # what is broken, a row a file
    reader = spark.read.schema(schema)
    reader = reader.option("basePath", base) if base else reader
    if not skipped:
        df = reader.option("ignoreCorruptFiles", False).parquet(*paths)
    elif counts.get("ok", 0) + counts.get("empty", 0) <= LISTED:
        good = [r.path for r in found.where("status in ('ok', 'empty')").select("path").collect()]
        df = reader.option("ignoreCorruptFiles", False).parquet(*good) if good else spark.createDataFrame([], schema)
    else:
        df = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*paths)
    found.unpersist()
    if skipped:
        told = ", ".join(f"{k} {v}" for k, v in sorted(counts.items()) if k in ("corrupt", "missing"))
        warnings.warn(f"files skipped: {told}; the first: {skipped[0][0]} ({skipped[0][3]})", stacklevel=3)
    return df, spark.createDataFrame(skipped, SKIPPED)
