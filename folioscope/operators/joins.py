"""Joins of cards, tables, headings and names that are not plain equi-joins.

Each is written so that rows meet only where they can match: overlaps through
their rarest cells, intervals by carrying the last anchor forward, brackets and
labels through small sorted tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (id, key, cells) that share less than half of their cells with every row of right (key, cells).

    A row that shares ``need`` of its cells shares one of its rarest
    ``distinct - need + 1``, so only those meet, rarest by how many different
    sets of right have a cell; equal rows of either side meet once.
    """
    cells = F.array_sort(F.array_distinct("cells"))
    sets = right.select("key", cells.alias("other")).distinct()
    rows = left.select("id", "key", cells.alias("mine"), F.ceil(F.size("cells") / 2).cast("int").alias("need"))
    kinds = rows.select("key", "mine", "need").distinct()
    spread = sets.select("key", "other", F.explode("other").alias("cell"))
    counts = spread.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("key", "mine", "need").orderBy(F.coalesce("n", F.lit(0)), "cell")
    rare = kinds.select("*", F.explode("mine").alias("cell")).join(counts, ["key", "cell"], "left").withColumn("place", F.row_number().over(place))
    rare = rare.filter((F.col("place") <= F.size("mine") - F.col("need") + 1) & F.col("n").isNotNull())
    met = rare.join(spread, ["key", "cell"]).filter(F.size(F.array_intersect("mine", "other")) >= F.col("need"))
    gone = met.select("key", "mine", "need").distinct()
    empty = F.col("need") == 0  # a row without cells is covered by any row of its key
    covered = rows.filter(empty).join(sets.select("key").distinct(), "key", "left_semi").select("id")
    return rows.filter(~empty).join(gone, ["key", "mine", "need"], "left_anti").select("id").unionByName(rows.filter(empty).select("id").join(covered, "id", "left_anti"))


def first_on_page(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """rows (page, ...) with ``name``, the first heading (page, ord, name) of their page; rows of pages without one go."""
    first = headings.groupBy("page").agg(F.min_by("name", "ord").alias("name"))
    return rows.join(first, "page")


def contained_best(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """wanted, id: for each entry (wanted, cells, page) the row (id, cells, page) that has all of its cells, one on its page before others, then the smallest id."""
    asked = wanted.select("wanted", F.col("page").alias("asked"), F.size(F.array_distinct("cells")).alias("need"), F.explode(F.array_distinct("cells")).alias("cell"))
    have = cells.select("id", "page", F.explode(F.array_distinct("cells")).alias("cell"))
    full = asked.join(have, "cell").groupBy("wanted", "asked", "need", "id", "page").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    best = F.min(F.struct((F.col("page") != F.col("asked")).alias("elsewhere"), "id")).alias("best")
    return full.groupBy("wanted").agg(best).select("wanted", "best.id")


def best_label(labels: DataFrame, names: DataFrame, default: str) -> DataFrame:
    """label, name: the name (name) that shares the most words with a label (label), the first of equals; ``default`` if none does."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"\s+")))
    asked = labels.select("label").distinct().select("label", words(F.col("label")).alias("word"))
    have = names.select("name").distinct().select("name", words(F.col("name")).alias("word"))
    shared = asked.join(have, "word").groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("label").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    return labels.join(best, "label", "left").withColumn("name", F.coalesce("name", F.lit(default)))


def bracket(rows: DataFrame, size: Column, brackets: list[tuple[int, int]], name: str = "value") -> DataFrame:
    """rows with the value of the first bracket (upper bound, value) that reaches their size, the last one's beyond all."""
    steps = sorted(brackets)
    out = F.lit(steps[-1][1])
    for upto, value in reversed(steps):
        out = F.when(size <= upto, value).otherwise(out)
    return rows.withColumn(name, out)


def first_by_name(rows: DataFrame) -> DataFrame:
    """id, first: each row (id, name) with the smallest id that bears its name."""
    first = rows.groupBy("name").agg(F.min("id").alias("first"))
    return rows.select("id", "name").join(first, "name").select("id", "first")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys new does not have, and all of new, told apart by ``side``."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))


def with_history(people: DataFrame, terms: DataFrame) -> DataFrame:
    """people (person) with ``served`` (terms that count) and ``last`` (the greatest rank held) of terms (person, counts, rank)."""
    past = terms.groupBy("person").agg(F.count_if("counts").alias("served"), F.max("rank").alias("last"))
    joined = people.join(past, "person", "left")
    return joined.withColumn("served", F.coalesce("served", F.lit(0))).withColumn("last", F.coalesce("last", F.lit("")))


def without_chrome(spans: DataFrame, titles: DataFrame) -> DataFrame:
    """Spans (font, text, ...) in fonts that no page title (text) is set in."""
    bare = titles.select(F.lower("text").alias("title")).distinct()
    fonts = spans.join(bare, F.lower("text") == F.col("title"), "left_semi").select("font").distinct()
    return spans.join(fonts, "font", "left_anti")
