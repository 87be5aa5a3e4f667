"""Re-indexing as a stream: new manifests start a rebuild, one at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from folioscope.sources.library import exclusive

MANIFEST = "version string, documents long, files string"
POLL = "30 seconds"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of manifests that appear in a folder."""
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 16).json(folder)


def watch(spark: SparkSession, folder: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Call ``rebuild(manifests, batch)`` for new manifests.

    The checkpoint remembers which manifests were seen, so those that were there
    at an earlier start do not trigger again; micro-batches run one after the
    other, so rebuilds never overlap.
    """
    writer = manifests(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(rebuild)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def guarded(spark: SparkSession, folder: str, rebuild: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``rebuild`` under the lock of a folder; while another run holds it, the batch fails and is tried again by the stream's next start."""

    def run(batch: DataFrame, number: int) -> None:
        with exclusive(spark, folder):
            rebuild(batch, number)

    return run


def _on_the_clock(instant: str) -> Column:
    """An instant's date and time in UTC, without a zone."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(unix_micros({instant}) AS DECIMAL(18, 0)) / 1000000)")


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An addition for streams of events (ts, event_type, value): windowed counts and sums with a bound on lateness.

    A ts without a time zone is taken as UTC, since watermarks need an instant;
    its windows then have no zone either.
    """
    bare = isinstance(events.schema["ts"].dataType, TimestampNTZType)
    if bare:
        events = events.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    if bare:
        found = found.withColumn("window", F.struct(*(_on_the_clock(f"window.{end}").alias(end) for end in ("start", "end"))))
    return found
