"""Substring dedup by a log-structured fingerprint index.

Batches of documents arrive in the order of doc_id. The index is a list of
sorted immutable runs: tables bucketed and sorted by key that hold fingerprints
of the windows seen so far (see windows.py for how few fingerprints name all
windows). A new batch is put in the same order once and merge-joined with every
run; entries found in a run, or earlier in the batch, repeat earlier windows in
full. What is new becomes a run, and runs are compacted into one when there are
FAN_IN of them. Entries that share an anchor with another entry but differ
around it are verified window by window by 128-bit digests of their words, and
only a window that starts earlier elsewhere is removed.

Defined cases: a null or empty text has no words and nothing to remove; texts
are read whole; rows that share doc_id and text are one place, so neither is
earlier than the other; a null doc_id comes before all others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, byte_rows, eager_shuffle_cleanup, materialize, slices, word_spans
from folioscope.llm.windows import (
    HOT,
    REMOVED,
    covered,
    entry_table,
    keyed,
    list_arrays,
    pos_count,
    pos_first,
    pos_marks,
    removed_rows,
    window_digests,
    with_lists,
)

WIDTH, GRAM = 20, 7
BATCHES, FAN_IN = 3, 3


@contextmanager
def _bucket_joins(spark: SparkSession):
    """Let joins on (k, f) use the buckets by k of the runs."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


_MANIFEST = "width int, gram int, fan_in int, buckets int, runs array<string>"


class FingerprintIndex:
    """Runs of window fingerprints in the warehouse; ``add`` takes the next batch."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.width, self.gram, self.fan_in = spark, width, gram, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.settled: list[DataFrame] = []
        self._old: list[str] = []

    def save(self, path: str) -> None:
        """Write down which runs the index has, so that another session can go on with it."""
        row = (self.width, self.gram, self.fan_in, self.buckets, self.runs)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        row = spark.read.schema(_MANIFEST).json(path).first()
        index = cls(spark, row["width"], row["gram"], row["fan_in"])
        index.buckets, index.runs = row["buckets"], list(row["runs"])
        return index

    def drop(self, runs: list[str] | None = None) -> None:
        """Drop the tables of runs (all that the index has made, if not said otherwise)."""
        for run in self._old + self.runs if runs is None else runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def _save(self, df: DataFrame) -> str:
        name = f"folioscope_run_{uuid.uuid4().hex}"
        with eager_shuffle_cleanup(self.spark), _bucket_joins(self.spark):
            df.write.option("compression", "zstd").bucketBy(self.buckets, "k").sortBy("k", "f").saveAsTable(name)
        return name

    def _live(self, run: str) -> DataFrame:
        return self.spark.table(run).filter("live").select("k", "f", "doc", "tag", "pos", "live", "lead")

    def add(self, rows: DataFrame) -> None:
        """Merge a batch (doc, tag, text), later than all before it, with the runs."""
        batch = entry_table(rows, "word", self.width, self.gram, all_occurrences=False).repartition(self.buckets, "k")
        order = Window.partitionBy("k", "f").orderBy("doc", pos_first(F.col("pos")), "tag")
        place = F.struct("doc", pos_first(F.col("pos")))
        batch = batch.withColumn("rank", F.row_number().over(order)).withColumn("least", F.first(place).over(order))
        # texts that share a place all stay open, one row of each; the first is the run's entry for later batches
        batch = batch.withColumn("other", (F.col("rank") == 1) | (F.lag("tag").over(order) != F.col("tag")))
        known = F.lit(False)
        for i, run in enumerate(self.runs):
            past = self.spark.table(run).filter("lead").select(F.col("k").alias(f"k{i}"), F.col("f").alias(f"f{i}")).hint("merge")
            batch = batch.join(past, (F.col("k") == F.col(f"k{i}")) & (F.col("f") == F.col(f"f{i}")), "left")
            known = known | F.col(f"k{i}").isNotNull()
        marked = pos_marks(F.col("pos")).bitwiseAND(F.lit(REMOVED)) != 0
        removed = marked | (place > F.col("least")) | known
        live, lead = ~removed & F.col("other"), ~removed & (F.col("rank") == 1)
        table = self._save(batch.select("k", "f", "doc", "tag", "pos", removed.alias("removed"), live.alias("live"), lead.alias("lead")))
        self.settled.append(removed_rows(self.spark.table(table).filter("removed")))
        self.runs.append(table)
        if len(self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one sorted run."""
        if len(self.runs) > 1:
            merged = self._live(self.runs[0])
            for run in self.runs[1:]:
                merged = merged.unionByName(self._live(run))
            self._old += self.runs  # their removed rows are read until they are dropped
            self.runs = [self._save(merged.repartition(self.buckets, "k"))]

    def unsettled(self) -> DataFrame:
        """Live entries that share their anchor with an entry of other content."""
        merged = self._live(self.runs[0])
        for run in self.runs[1:]:
            merged = merged.unionByName(self._live(run))
        hot = F.max(pos_marks(F.col("pos")).bitwiseAND(F.lit(HOT)))
        shared = merged.groupBy("k").agg(F.min("f").alias("least"), F.max("f").alias("most"), hot.alias("hot"))
        shared = shared.filter("least <> most OR hot > 0").select(F.col("k").alias("s_k"))
        return merged.join(shared, F.col("k") == F.col("s_k"), "left_semi")

    def verify(self, rows: DataFrame) -> DataFrame:
        """Removed windows among the unsettled entries: those that start earlier elsewhere."""
        with _bucket_joins(self.spark):
            open_ = self.unsettled().select("doc", "tag", pos_first(F.col("pos")).alias("first"), pos_count(F.col("pos")).alias("count"))
            open_ = materialize(open_, "window-open")
        digests = materialize(window_digests(with_lists(rows, open_, ["first", "count"]), "word", self.width, all_occurrences=False), "window-digests")
        place = F.struct("doc", pos_first(F.col("pos")).alias("first"))
        marked = pos_marks(F.col("pos")).bitwiseAND(F.lit(REMOVED)) != 0
        firsts = digests.filter(~marked).groupBy(F.col("d1").alias("f1"), F.col("d2").alias("f2"))
        firsts = firsts.agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = digests.filter(~marked).join(firsts, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).filter(place > F.col("lead"))
        one = later.select("doc", "tag", "pos").unionByName(digests.filter(marked).select("doc", "tag", "pos"))
        one = one.select("doc", "tag", pos_first(F.col("pos")).alias("first"), F.lit(1).cast("long").alias("count"))
        return materialize(one, "window-later")


def removed_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """doc, tag, first, count: runs of windows that start earlier elsewhere."""
    rows, index = keyed(docs), FingerprintIndex(docs.sparkSession, width, gram, fan_in)
    cuts = sorted({int(q) for q in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001)})
    bounds = [None, *cuts, None]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull()) if low is None else part.filter(doc <= high)
        index.add(keyed(part))
    gone = index.verify(rows)
    for part in index.settled:
        gone = gone.unionByName(part)
    gone = materialize(gone, "window-gone")
    index.drop()
    return gone


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def remove_windows(docs: DataFrame, removed: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Per document what is left once the words of removed windows are gone."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, byte_offsets = byte_rows(part.column("text"))
                starts, ends, offsets = word_spans(data, byte_offsets)
                gone = covered(offsets, *_flat(list_arrays(part.column("items"), 2)), width)
                raw = data.tobytes()
                out = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "text")}
                for i in range(part.num_rows):
                    low, high = offsets[i], offsets[i + 1]
                    keep = np.flatnonzero(~gone[low:high]) + low
                    left = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                    out["n_words"].append(int(high - low))
                    out["n_removed"].append(int(high - low - len(keep)))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    out["text"].append(left.decode() if with_text else None)
                ids = [None if x == NULL_ID else x for x in part.column("doc").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": out["kept_sha256"], "text": pa.array(out["text"], pa.string())})

    def _flat(lists):
        item_offsets, (first, count) = lists
        return item_offsets, first, count

    return with_lists(keyed(docs), removed, ["first", "count"]).mapInArrow(run, SCHEMA)


def op1_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier 20-word window, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_windows(docs, removed_windows(docs), with_text=False).drop("text")


OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT doc_id, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS win FROM t
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later FROM g WHERE i + {WIDTH - 1} <= n
), c AS (
  SELECT g.doc_id, g.i, g.word, max(CASE WHEN f.later THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY g.i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.i = g.i
), s AS (
  SELECT doc_id, sum(gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""
