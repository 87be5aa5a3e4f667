"""The document library: reading folders, the versioned extraction cache, the manifest and the swap of snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.segment import split_game

TEXT_VERSION, TABLE_VERSION = "1", "1"
T_ = TypeVar("T_")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, path, modified_time, content of all files below a folder; file formats of Hadoop's file systems."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.sha2("path", 256).alias("file_id"), "path", F.col("modificationTime").cast("string").alias("modified_time"), "content")


def kind_of(path: Column) -> Column:
    """text, pdf, or unsupported by the ending of a path."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.(txt|md|markdown)$"), "text").when(low.endswith(".pdf"), "pdf").otherwise("unsupported")


def extract(files: DataFrame) -> DataFrame:
    """file_id, path, modified_time, game, source, kind, text. Bytes that are no UTF-8 become the replacement character.

    PDF needs an extractor that this library does not bring; such files and
    unsupported ones have an empty text and can be listed by kind.
    """
    game, source = split_game(F.col("path"))
    kind = kind_of(F.col("path"))
    safe = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("file_id", "path", "modified_time", game.alias("game"), source.alias("source"), kind.alias("kind"), F.when(kind == "text", safe).otherwise("").alias("text"))


def staleness(files: DataFrame, cache: DataFrame, text_version: str = TEXT_VERSION, table_version: str = TABLE_VERSION) -> DataFrame:
    """file_id, text_stale, tables_stale: each half is fresh with the same modified_time and its own version."""
    c = cache.select(F.col("file_id"), F.col("modified_time").alias("c_time"), F.col("mdv").alias("c_md"), F.col("tbv").alias("c_tb"))
    same = F.col("modified_time").eqNullSafe(F.col("c_time"))
    return files.join(c, "file_id", "left").select(
        "file_id", (~(same & F.col("c_md").eqNullSafe(F.lit(text_version)))).alias("text_stale"), (~(same & F.col("c_tb").eqNullSafe(F.lit(table_version)))).alias("tables_stale")
    )


def refreshed(files: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """file_id, text: cached texts that are still good and fresh ones (file_id, text) for the rest; blank texts go."""
    good = staleness(files, cache).filter("NOT text_stale").select("file_id")
    kept = cache.join(good, "file_id", "left_semi").select("file_id", "text")
    new = fresh.join(good, "file_id", "left_anti").select("file_id", "text")
    return kept.unionByName(new).filter(T.trim_all(F.col("text")) != "")


def write_cache(records: DataFrame, path: str) -> None:
    """One partition per game; rewritten partitions replace the old ones, others stay."""
    records.write.partitionBy("game").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def manifest(docs: DataFrame, version: str) -> DataFrame:
    """One row: version, documents and a digest of the paths that does not depend on their order."""
    part = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return docs.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("files"))


def write_manifest(docs: DataFrame, version: str, path: str) -> None:
    """The manifest as JSON, with the paths as a table beside it; written last, its presence says that everything else is there."""
    docs.select("path").sort("path").write.mode("overwrite").parquet(f"{path}-files")
    manifest(docs, version).coalesce(1).write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON object {"entries": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


class Snapshots:
    """Versions of a set of tables below a folder; the newest complete one is current.

    ``publish`` writes all tables of a version into a folder of its own and a
    marker last, which gets its name when it is whole. Nothing that a
    reader may hold is ever moved or deleted, so a reader finds the old version
    or the new one, never none and never a mix: it asks once and reads every
    table from the version that it got.
    """

    MARK = "COMPLETE.json"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Paths of the complete versions, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder)) if f.isDirectory()]
        marked = [n for n in names if n.startswith("v-") and self._fs.exists(self._path(f"{self.folder}/{n}/{self.MARK}"))]
        return [f"{self.folder}/{n}" for n in sorted(marked)]

    def current(self) -> str | None:
        """Path of the current version."""
        return (self.versions() or [None])[-1]

    def publish(self, tables: DataFrame | dict[str, DataFrame], version: str) -> str:
        """Write a version of one table, or of several by name, and make it the current one; returns its path."""
        tables = tables if isinstance(tables, dict) else {"table": tables}
        last = self.current()
        number = int(last.rsplit("/v-", 1)[1].split("-", 1)[0]) + 1 if last else 1
        path = f"{self.folder}/v-{number:08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        fresh = self._path(f"{path}/_mark")
        stream = self._fs.create(fresh, False)
        stream.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}), "utf-8"))
        stream.close()
        self._fs.rename(fresh, self._path(f"{path}/{self.MARK}"))
        return path

    def label(self, path: str) -> str:
        """The version string that a path was published under."""
        return json.loads(self.spark.read.text(f"{path}/{self.MARK}").first()[0])["version"]

    def read(self, name: str = "table", path: str | None = None) -> DataFrame | None:
        """A table of the current version, or of one that was asked for before."""
        path = path or self.current()
        return None if path is None else self.spark.read.parquet(f"{path}/{name}")

    def drop_before(self, keep: int = 2) -> list[str]:
        """Delete all but the newest versions, for which the caller knows that nobody reads the rest."""
        old = self.versions()[: -keep or None]
        for path in old:
            self._fs.delete(self._path(path), True)
        return old


def refresh(shots: Snapshots, files: DataFrame, cache: DataFrame, extract_: Callable[[DataFrame], DataFrame], version: str, force: bool = False, keep_blank: bool = False) -> str:
    """Extract what is stale (all files if forced), put it with what the cache still has and publish it, under the folder's lock.

    ``extract_`` gives file_id, text for the files it gets. Raises Busy while another refresh runs.
    """
    spark = shots.spark
    with exclusive(spark, shots.folder):
        if force:
            texts = extract_(files)
            texts = texts if keep_blank else texts.filter(T.trim_all(F.col("text")) != "")
        else:
            stale = files.join(staleness(files, cache).filter("text_stale").select("file_id"), "file_id", "left_semi")
            texts = refreshed(files, cache, extract_(stale))
        return shots.publish(texts, version)


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def exclusive(spark: SparkSession, folder: str, stale_seconds: int = 6 * 3600):
    """Hold the lock file of a folder, or raise Busy at once; a lock older than ``stale_seconds`` is taken over.

    The file is created exclusively, which the stores' file systems do atomically.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_LOCK")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_seconds:
        fs.delete(path, False)
    try:
        stream = fs.create(path, False)
    except Py4JJavaError as error:
        raise Busy(f"another refresh holds {path}") from error
    stream.write(bytearray(str(time.time()), "utf-8"))
    stream.close()
    try:
        yield
    finally:
        fs.delete(path, False)


def with_attempts(read: Callable[[], T_], attempts: int = 3, wait: float = 2.0) -> T_:
    """What ``read`` gives, tried so often with growing pauses; the last error is raised. For driver-side calls of a store; tasks are retried by Spark."""
    for attempt in range(attempts):
        try:
            return read()
        except (OSError, Py4JJavaError):
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * (attempt + 1))
    raise ValueError("no attempts")
