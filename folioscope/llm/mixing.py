"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. Target over size is the copy rate
of its documents: the whole part is taken for certain, the fraction is a
probability. The pivotal method pairs two fractional documents of a source and
moves word mass from one to the other, in a random direction that keeps both
expectations, until one of the two is integral; the words of the pair stay the
same throughout. Documents are dealt into chunks by hash, a chunk leaves one
fractional document at most, and these residuals meet in a reduction tree with
a fixed fan-in until one a source is left, which is rounded alone. A source
therefore misses its target by less than one document.

Defined cases: a null text has size 0; null sources form one source, which
comes last; sources are in code-point order; repeated rows (same doc_id, text
and source) get the same number of copies; an empty table gives no rows; other
columns of the input are ignored. Random numbers come from hashes of keys, so
reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import byte_rows, fresh_names, materialize, word_spans

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
CHUNK_ROWS = 4096
FAN_IN = 256

_UNIT = "doc_id long, tie long, source string, size long, n long, base long, weight double, p double, group long, chunk long, level int"


def add_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, tie (hash of the text) and size (words of the text)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("tie"),
        F.col("text").cast("string").alias("text"),
    )

    def count(batches):
        for batch in batches:
            data, offsets = byte_rows(batch.column("text"))
            _, _, words = word_spans(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("tie"), pa.array(np.diff(words), pa.int64())],
                ["doc_id", "source", "tie", "size"],
            )

    return rows.mapInArrow(count, "doc_id long, source string, tie long, size long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[dict]:
    """Targets in words: shares by weight, stopped at ``cap`` times a source's size, the excess dealt again by weight.

    The list has one entry a source, not a document; that bounds what the driver holds.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8", "surrogatepass")))
    out = [{"source": s, "size": n, "weight": weights[i % len(weights)], "target": 0.0} for i, (s, n) in enumerate(order)]
    left, open_ = share * sum(n for _, n in order), list(out)
    while open_:
        total = sum(x["weight"] for x in open_)
        over = [x for x in open_ if left * x["weight"] / total > cap * x["size"]]
        if not over:
            for x in open_:
                x["target"] = left * x["weight"] / total
            break
        for x in over:
            x["target"] = cap * x["size"]
        left -= sum(x["target"] for x in over)
        open_ = [x for x in open_ if all(x is not y for y in over)]
    return out


def _round_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding of one chunk: all but one of its rows become integral."""
    rows = rows.sort_values(["doc_id", "tie", "size"], kind="stable", na_position="first").reset_index(drop=True)
    weight, p = rows["weight"].to_numpy(), rows["p"].to_numpy(copy=True)
    draws = np.random.default_rng([int(x) & 0xFFFFFFFF for x in key]).random(len(rows))
    held = 0
    for j in range(1, len(rows)):
        up = min((1 - p[held]) * weight[held], p[j] * weight[j])
        down = min(p[held] * weight[held], (1 - p[j]) * weight[j])
        if draws[j] * (up + down) < down:  # with this chance, expectations stay
            full = (1 - p[held]) * weight[held] <= p[j] * weight[j]
            p[held], p[j] = (1.0 if full else p[held] + up / weight[held]), (p[j] - up / weight[j] if full else 0.0)
        else:
            gone = p[held] * weight[held] <= (1 - p[j]) * weight[j]
            p[held], p[j] = (0.0 if gone else p[held] - down / weight[held]), (p[j] + down / weight[j] if gone else 1.0)
        p[held], p[j] = min(max(p[held], 0.0), 1.0), min(max(p[j], 0.0), 1.0)
        if p[held] in (0.0, 1.0):
            held = j
    rows["p"] = p
    rows["level"] = rows["level"] + 1
    rows["chunk"] = rows["chunk"] // FAN_IN
    return rows


def mix_units(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per distinct (doc_id, tie, source): size, n rows, copies, source_size, target."""
    spark = docs.sparkSession
    sized = materialize(add_sizes(docs), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    plan = targets([(r["source"], r["size"]) for r in per_source], weights, share, cap)
    counts = {r["source"]: r["n"] for r in per_source}
    rates = []
    for i, x in enumerate(plan):
        rate = min(cap, x["target"] / x["size"]) if x["size"] else 0.0
        chunks = max(1, math.ceil(counts[x["source"]] / CHUNK_ROWS))
        whole = math.floor(rate + 1e-12)
        rates.append((x["source"], i, int(x["size"]), float(x["target"]), whole, max(0.0, rate - whole) if rate - whole > 1e-12 else 0.0, chunks))
    rate_table = spark.createDataFrame(
        rates, "r_source string, group long, source_size long, target double, base long, p double, chunks long"
    )
    units = (
        sized.groupBy("doc_id", "tie", "source", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(rate_table, F.col("source").eqNullSafe(F.col("r_source")))
        .select(
            "doc_id", "tie", "source", "size", "n", "base",
            (F.col("size") * F.col("n")).cast("double").alias("weight"),
            F.when(F.col("size") > 0, F.col("p")).otherwise(0.0).alias("p"),
            "group",
            F.pmod(F.xxhash64("doc_id", "tie", F.lit("chunk")), F.col("chunks")).alias("chunk"),
            F.lit(0).alias("level"),
        )
    )
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    level = materialize(units, "mix-units")
    parts, most = [level.filter(~fractional)], max((r[6] for r in rates), default=1)
    while True:
        level = level.filter(fractional).groupBy("group", "chunk", "level").applyInPandas(_round_group, _UNIT)
        level = materialize(level, "mix-level")
        parts.append(level.filter(~fractional))
        if most <= 1:
            break
        most = -(-most // FAN_IN)
    last = level.filter(fractional)
    draw = F.pmod(F.xxhash64("doc_id", "tie", F.lit("last")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts.append(last.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done.join(rate_table.select("group", "source_size", "target"), "group").select(
        "doc_id", "tie", "source", "size", "n", (F.col("base") + F.col("p").cast("long")).alias("copies"), "source_size", "target"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken."""
    units = mix_units(docs, **options).filter("copies > 0")
    doc_id, tie, source, copies, copy = fresh_names(docs, "_mix_doc_id", "_mix_tie", "_mix_source", "_mix_copies", "_mix_copy")
    units = units.select(F.col("doc_id").alias(doc_id), F.col("tie").alias(tie), F.col("source").alias(source), F.col("copies").alias(copies))
    same = (
        docs["doc_id"].cast("long").eqNullSafe(F.col(doc_id))
        & (F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0)) == F.col(tie))
        & docs["source"].cast("string").eqNullSafe(F.col(source))
    )
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return docs.join(units, same).withColumn(copy, times).select(*docs.columns)


def op9_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, its source's words and target, and the words taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return (
        mix_units(docs)
        .withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
    )
