"""Stored tables that a failure leaves whole: immutable data folders, and a log of versions.

    table/_log/00000000000000000003.json   the folders that version 3 consists of
    table/_data/batch=b<id>/...            what one write made; never changed afterwards
    table/_files/b<id>/...                 which files it made

A write puts its rows into a new folder, and only then a file of the log appears,
by one rename that fails if the file is there already. Until then readers see the
version before, whole; if the writer stops, the folder is left over and belongs to
no version. Readers take the newest version, or a given one, and read exactly its
folders, so that writers never disturb them. Two writers of one version can't both
win: the later one reads anew and merges again.

A version lists one folder per written partition of the table (or one, if it has
no partitions), so it grows with the partitions, not with files or rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .quarantine import SKIPPED, list_files, read_good


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    return fs, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def list_root(spark: SparkSession, path: str) -> str:
    """The path as list_files() tells it, with its scheme."""
    _, where, system = _hadoop(spark, path)
    return re.sub("^([A-Za-z0-9]+):/+", r"\1:/", system.makeQualified(where).toString())


def path_exists(spark: SparkSession, path: str) -> bool:
    _, where, system = _hadoop(spark, path)
    return system.exists(where)


class TableLog:
    """A versioned Parquet table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def exists(self) -> bool:
        return self.latest() is not None

    def versions(self) -> list[int]:
        _, where, system = _hadoop(self.spark, f"{self.path}/_log")
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        _, where, system = _hadoop(self.spark, f"{self.path}/_log/{version:020d}.json")
        stream = system.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Make the version visible, by one rename that never overwrites."""
        fs, temporary, system = _hadoop(self.spark, f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = system.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = fs.Path(f"{self.path}/_log/{manifest['version']:020d}.json")
        context = fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, final, never)
        except Exception as e:
            system.delete(temporary, False)
            if system.exists(final):
                raise ConcurrentWrite(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    # --- reading ---

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifest(version)["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest by default); later writes don't change what this frame reads."""
        return self._frame(self.manifest(version))

    def _frame(self, manifest: dict, folders: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = list(manifest["folders"].values()) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/_data/{f}" for f in folders]
        with_batch = StructType(list(schema.fields)).add("batch", "string")
        return self.spark.read.schema(with_batch).option("basePath", f"{self.path}/_data").parquet(*paths).select(*schema.names)

    def read_checked(self, keep: dict | None = None, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, skipped files): as read(), with each file probed first; corrupt and missing files are left out and listed.

        keep: partition column -> test of its value as text; partitions that fail it are neither probed nor read.
        """
        manifest = self.manifest(version)
        folders = [f for k, f in manifest["folders"].items() if all(test(dict(p.split("=", 1) for p in k.split("/"))[c]) for c, test in (keep or {}).items())]
        schema = StructType.fromJson(manifest["schema"])
        present = [f for f in folders if path_exists(self.spark, f"{self.path}/_data/{f}")]
        if not folders:
            return self.spark.createDataFrame([], schema), self.spark.createDataFrame([], SKIPPED)
        in_files = StructType([f for f in schema.fields if f.name not in manifest["partition_by"]])
        with_batch = StructType(list(schema.fields)).add("batch", "string")
        df, skipped = read_good(self.spark, [f"{self.path}/_data/{f}" for f in present], with_batch, f"{self.path}/_data", self.expected_files(folders), in_files)
        return df.select(*schema.names), skipped

    # --- writing ---

    def _store(self, df: DataFrame, partition_by: list[str]) -> dict[str, str]:
        """Write df into a new folder; partition -> its folder, below _data."""
        batch = f"batch=b{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/_data/{batch}")
        self._list(batch)
        if not partition_by:
            return {"": batch}
        _, root, system = _hadoop(self.spark, f"{self.path}/_data/{batch}")
        level = [("", root)]
        for _ in partition_by:
            level = [(f"{k}/{s.getPath().getName()}".lstrip("/"), s.getPath()) for k, p in level for s in system.listStatus(p) if s.isDirectory()]
        return {unquote(k): f"{batch}/{k}" for k, _ in level}

    def _list_of(self, batch: str) -> str:
        return f"{self.path}/_files/{batch.removeprefix('batch=')}"

    def _list(self, batch: str) -> None:
        """Leave a list of the batch's files, by which a file that is lost later can be told."""
        try:
            files = list_files(self.spark, [f"{self.path}/_data/{batch}"])
        except AnalysisException:
            return
        below = F.substring_index("path", f"/{batch}/", -1)
        files.select(F.lit(batch).alias("batch"), below.alias("file"), "length").coalesce(1).write.parquet(self._list_of(batch))

    def expected_files(self, folders: list[str]) -> DataFrame | None:
        """path and length of the files that were written into some folders of versions."""
        root = list_root(self.spark, f"{self.path}/_data")
        lists = [p for p in dict.fromkeys(self._list_of(f.split("/")[0]) for f in folders) if path_exists(self.spark, p)]
        if not lists:
            return None
        files = self.spark.read.parquet(*lists).select(F.concat_ws("/", F.lit(root), "batch", "file").alias("path"), "length")
        wanted = F.lit(False)
        for f in folders:
            wanted = wanted | F.col("path").startswith(f"{root}/{f}/")
        return files.where(wanted)

    def _next(self, base: dict | None, schema: StructType, folders: dict[str, str], partition_by: list[str], operation: str) -> int:
        version = 0 if base is None else base["version"] + 1
        self._commit({"version": version, "operation": operation, "at": time.time(), "schema": json.loads(schema.json()), "partition_by": partition_by, "folders": folders})
        return version

    def _base(self) -> dict | None:
        at = self.latest()
        return None if at is None else self.manifest(at)

    def overwrite(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version of these rows alone."""
        base, parts = self._base(), partition_by or []
        return self._next(base, df.schema, self._store(df, parts), parts, "overwrite")

    def replace_partitions(self, df: DataFrame, partition_by: list[str], touched: DataFrame | None = None) -> int:
        """A new version in which the partitions that df has rows of are df's; the others keep their folders.

        touched: partition values (a frame of the partition columns) that go even where df has no rows of them.
        """
        base = self._base()
        self._check(base, df.schema, partition_by)
        made = self._store(df, partition_by)
        kept = dict(base["folders"]) if base else {}
        for row in [] if touched is None else touched.select(*partition_by).distinct().collect():  # one row a partition
            kept.pop(self._partition(row, partition_by), None)
        return self._next(base, df.schema, kept | made, partition_by, "replace partitions")

    def upsert(self, new: DataFrame, keys: list[str], merge, partition_by: list[str] | None = None, layout=None, attempts: int = 3) -> int:
        """A new version with new merged into the old rows by merge(old or None, new, keys); only partitions that new has rows of are read and rewritten.

        layout(df) may deal and sort the merged rows before they are written. If
        another writer was faster, its version is read and merged anew.
        """
        parts = partition_by or []
        for attempt in range(attempts):
            base = self._base()
            self._check(base, new.schema, parts)
            old, kept = None, {}
            if base:
                touched = list(base["folders"])
                if parts:
                    values = new.select(*parts).distinct().collect()  # one row a partition
                    own = {self._partition(v, parts) for v in values}
                    touched = [k for k in base["folders"] if k in own]
                kept = {k: f for k, f in base["folders"].items() if k not in touched}
                if touched:
                    old = self._frame(base, [base["folders"][k] for k in touched]).select(*new.columns)
            merged = merge(old, new, keys)
            made = self._store(layout(merged) if layout else merged, parts)
            try:
                return self._next(base, new.schema, kept | made, parts, "upsert")
            except ConcurrentWrite:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    @staticmethod
    def _partition(row, partition_by: list[str]) -> str:
        return "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else row[c]}" for c in partition_by)

    @staticmethod
    def _check(base: dict | None, schema: StructType, partition_by: list[str]) -> None:
        if base and base["partition_by"] != partition_by:
            raise ValueError(f"the table is partitioned by {base['partition_by']}, not by {partition_by}")
        if base and {f["name"] for f in base["schema"]["fields"]} != set(schema.names):
            raise ValueError("the table has other columns")

    # --- upkeep ---

    def history(self) -> DataFrame:
        """version, operation, at, n_folders of every version in the log."""
        rows = [(m["version"], m["operation"], float(m["at"]), len(m["folders"])) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version long, operation string, at double, n_folders long").withColumn("at", F.timestamp_seconds("at"))

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600.0) -> list[str]:
        """Delete versions before the last `keep`, and folders that no remaining version lists and that are older than so many seconds; the batches deleted.

        A running writer's folder is in no version yet: older_than must be longer than any write takes.
        """
        stay = self.versions()[-keep:] if keep > 0 else self.versions()
        used = {f.split("/")[0] for v in stay for f in self.manifest(v)["folders"].values()}
        gone = []
        for v in [v for v in self.versions() if v not in stay]:
            _, where, system = _hadoop(self.spark, f"{self.path}/_log/{v:020d}.json")
            system.delete(where, False)
        _, root, system = _hadoop(self.spark, f"{self.path}/_data")
        for s in system.listStatus(root) if system.exists(root) else []:
            name = s.getPath().getName()
            if name not in used and s.getModificationTime() / 1000 < time.time() - older_than:
                system.delete(s.getPath(), True)
                _, listed, _ = _hadoop(self.spark, self._list_of(name))
                system.delete(listed, True)
                gone.append(name)
        return gone


def read_stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest (or a given) version of a table with a log; a plain Parquet folder as it is; None if there is neither."""
    log = TableLog(spark, path)
    if log.exists():
        return log.read(version)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
