"""Ligature repair against a word list, as joins over distinct words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIXES = ["s", "es", "ed", "ing"]
INSERTS = ["i", "l", "fi", "fl"]


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Of words (w), those that the dictionary (word) has, as they are or without a usual ending."""
    low = F.lower("w")
    stems = [F.struct(low.alias("base"))]
    for suffix in SUFFIXES:
        n = len(suffix)
        fits = low.endswith(suffix) & (F.length("w") > n + 1)
        stems.append(F.struct(F.when(fits, low.substr(F.lit(1), F.length("w") - n)).alias("base")))
    bases = words.select("w", F.explode(F.array(*stems)).alias("b")).select("w", "b.base").filter("base IS NOT NULL")
    return bases.join(dictionary.select(F.lower("word").alias("base")).distinct(), "base", "left_semi").select("w").distinct()


def repair(rows: DataFrame, key: str, column: str, dictionary: DataFrame, least_words: int = 1000) -> DataFrame:
    """Unknown words with an f get the first insertion after an f that makes a known word.

    Only distinct words travel; with fewer than ``least_words`` words in the
    dictionary nothing is guessed.
    """
    if least_words and dictionary.limit(least_words).count() < least_words:
        return rows
    pieces = rows.select(key, F.posexplode(F.regexp_extract_all(column, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("at", "w"))
    suspects = pieces.select("w").distinct().filter(F.lower("w").contains("f") & F.col("w").rlike("^[A-Za-z]"))
    suspects = suspects.join(known_words(suspects, dictionary), "w", "left_anti")
    places = suspects.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k")).filter(F.lower(F.col("w").substr(F.col("k"), F.lit(1))) == "f")
    inserts = F.explode(F.array(*(F.struct(F.lit(x).alias("ins"), F.lit(i).alias("r")) for i, x in enumerate(INSERTS)))).alias("x")
    tries = places.select("w", "k", inserts).select(
        F.col("w").alias("old"), (F.col("k") * 10 + F.col("x.r")).alias("rank"),
        F.concat(F.col("w").substr(F.lit(1), F.col("k")), F.col("x.ins"), F.col("w").substr(F.col("k") + 1, F.length("w"))).alias("w"),
    )
    good = tries.join(known_words(tries.select("w").distinct(), dictionary), "w", "left_semi")
    fixed = good.groupBy("old").agg(F.min_by("w", "rank").alias("fixed"))
    joined = pieces.join(fixed, pieces["w"] == fixed["old"], "left").select(key, F.struct("at", F.coalesce("fixed", "w").alias("w")).alias("p"))
    texts = joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"]), "").alias("_fixed"))
    return rows.join(texts, key, "left").withColumn(column, F.coalesce("_fixed", column)).drop("_fixed")
