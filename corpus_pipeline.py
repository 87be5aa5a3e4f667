"""A corpus in five stages: quality, near-dedup, substring dedup, mixing, packing.

Each stage works on all rows that its predecessor kept and returns the columns
of documents; the last returns packed sequences. Between stages the rows are
written as Parquet to the shared folder and read again.

Defined cases, for every stage: an empty table gives no rows; further columns
pass through unchanged, whatever their names; a null text counts as an empty one
and stays null; texts are read whole. Quality scores an empty text as a document
without text. Near-dedup keeps of a group the row with the smallest id, one of
rows that share id and text, and of rows without an id one where no other row of
the group has one. Substring dedup takes repeated bytes out of all documents
that have them, equal rows included, and counts n_chars anew. Mixing takes
repeated rows equally often; a null source is a source of its own. Packing gives
a null or empty text its end id alone. Ties go to the smaller id, then to hashes
of the text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import ship
from folioscope.llm import mixing, near_copies, packing, quality_cnn, suffix_dedup
from folioscope.llm.common import fresh_names, materialize

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on labels of documents in docs."""
    ship(spark)
    params = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh_names(docs, "_pipeline_quality")
    return quality_cnn.score(docs, params, score).filter(F.col(score) >= quality_cnn.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash and pigeonring chains: the one with the smallest id."""
    ship(spark)
    return near_copies.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur more than once."""
    ship(spark)
    return suffix_dedup.cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    ship(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences with their ids, bucketed by length."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Training, hashing and rounding are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
