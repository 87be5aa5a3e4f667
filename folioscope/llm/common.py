"""Shared helpers: materialisation in the cluster's shared folder and byte-level text arrays.

Text columns are handled as one run of UTF-8 bytes per Arrow batch with row
offsets, so that word splitting, hashing and windowing are numpy passes over
whole batches.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ``[\x20\x09-\x0D]``: the white space that separates words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that one numpy pass handles; bounds the memory of a worker.
SLICE_BYTES = 4 << 20

NULL_ID = -(1 << 63)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one is made in local mode and a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"


@contextmanager
def eager_shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the statements run inside go as soon as each has ended."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def materialize(df: DataFrame, name: str, codec: str = "zstd", row_group: int = 128 << 20) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with eager_shuffle_cleanup(spark):
        df.write.option("compression", codec).option("parquet.block.size", row_group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(df: DataFrame) -> str:
    """The folder behind a DataFrame made by materialize() that has files."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by materialize()."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/folioscope/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about ``limit`` bytes in the column (one row at least)."""
    _, offsets = byte_rows(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = max(end, row + 1)
        yield batch.slice(row, end - row)
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and offsets of each row's words among them."""
    solid = ~IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PolyHash:
    """Polynomial hashes of arbitrary ranges of a sequence by prefix sums modulo 2**64.

    Ranges with equal content have equal hashes wherever they stand. Callers
    feed values that are mixed already or mix the results.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        power, self.inverse = self._powers(base, len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.prefix[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(20, (n - 1).bit_length())
            tables = []
            for b in (base, pow(base, -1, 1 << 64)):
                table = np.ones(size, np.uint64)
                done, step = 1, b
                while done < size:  # doubling: the next stretch is the present one times base**done
                    table[done : 2 * done] = table[:done] * np.uint64(step)
                    done, step = 2 * done, step * step % (1 << 64)
                tables.append(table)
            cls._tables[base] = have = tuple(tables)
        return have

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    return mix64(PolyHash(data.astype(np.uint64) + np.uint64(1)).ranges(starts, ends))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values, by doubling; len(values) - width + 1 results."""
    n, have, out = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]
