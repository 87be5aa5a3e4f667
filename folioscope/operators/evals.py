"""Evaluation: facts found in retrieved text, structure of extracted tables, heading recall, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

#: Words that say nothing about a fact (fixed values).
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "if", "in", "is", "it", "of", "on", "or", "that", "the", "then", "to", "with", "you", "your"]
COVERAGE = 0.70


def content_tokens(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(STOP) & ((F.length(t) >= 2) | t.rlike(r"^\d+$")))


def token_hit(t: Column, hay: Column, folded: Column) -> Column:
    """Found as it is, or without a plural s, or by a common start of four letters; numbers only as they are."""
    near = F.exists(hay, lambda p: (F.length(p) >= 4) & (p.startswith(t) | t.startswith(p)))
    return F.array_contains(hay, t) | (~t.rlike(r"^\d+$") & (F.array_contains(folded, T.singular(t)) | ((F.length(t) >= 4) & near)))


def fact_coverage(fact: Column, text: Column) -> Column:
    """1 for a fact that stands in the text word for word, else the share of its content tokens that are found."""
    norm = T.normal_words(fact)
    hay = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    folded = F.transform(hay, T.singular)
    want = content_tokens(fact)
    found = F.size(F.filter(want, lambda t: token_hit(t, hay, folded)))
    return F.when((norm != "") & T.normal_words(text).contains(norm), 1.0).when(F.size(want) == 0, 0.0).otherwise(found / F.size(want))


def recall(facts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, facts, found, recall from facts (query_id, fact) and the retrieved text of each query (query_id, text)."""
    joined = facts.join(retrieved, "query_id", "left")
    hit = fact_coverage(F.col("fact"), F.coalesce("text", F.lit(""))) >= COVERAGE
    return joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(hit).alias("found"), F.round(F.avg(hit.cast("int")), 6).alias("recall"))


def check_table(rows: Column, headers: Column, labels: Column, least: Column, most: Column) -> Column:
    """Struct of missing headers and labels and whether the table is right; the header row is the one with most expected headers."""
    norm = lambda c: F.upper(T.collapse(c))
    want = F.transform(headers, norm)
    counts = F.transform(rows, lambda r: F.size(F.array_intersect(want, F.transform(r, norm))))
    header = F.transform(F.get(rows, F.array_position(counts, F.array_max(counts)).cast("int") - 1), norm)
    first = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: norm(F.get(r, F.lit(0))))
    no_header, no_label = F.array_except(want, header), F.array_except(F.transform(labels, norm), first)
    right = (F.size(no_header) == 0) & (F.size(no_label) == 0) & (F.size(rows) >= least) & ((most == 0) | (F.size(rows) <= most))
    return F.struct(no_header.alias("missing_headers"), no_label.alias("missing_labels"), right.alias("correct"))


def by_system(scores: DataFrame, value: str) -> DataFrame:
    """Means per system and overall in one pass; system is null for all."""
    return scores.rollup("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def fingerprints(rows: DataFrame, group: str, line: Column) -> DataFrame:
    """Count and fingerprint of each group's lines in any order: the sum of 60 bits of their digests, so no group is gathered."""
    part = F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fp"))


def snapshot_diff(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """Groups whose count or fingerprint changed, from two tables of fingerprints."""
    a, b = before.select(group, F.col("n").alias("n_a"), F.col("fp").alias("fp_a")), after.select(group, F.col("n").alias("n_b"), F.col("fp").alias("fp_b"))
    both = a.join(b, group, "full")
    return both.filter(~F.col("fp_a").eqNullSafe(F.col("fp_b"))).select(group, F.coalesce("n_a", F.lit(0)).alias("before"), F.coalesce("n_b", F.lit(0)).alias("after"))


def heading_recall(toc: DataFrame, headings: DataFrame, before: int = 3) -> DataFrame:
    """doc, titles, found of contents titles (doc, title, page) that a heading (doc, title, page) on their page or shortly before covers.

    Pages are cut into stretches that become keys of an equi-join: a heading counts in its stretch and the next one, where
    the pages are compared. Sizes are known only after the headings are made, so the join is not left to a broadcast.
    """
    stretch = lambda c: F.floor(F.col(c) / (before + 1))
    heads = headings.select("doc", F.col("page").alias("at"), stretch("page").alias("s"), T.long_tokens(F.col("title"), 2).alias("have"))
    heads = heads.select("doc", "at", F.explode(F.array("s", F.col("s") + 1)).alias("s"), "have")
    want = toc.select("doc", "title", "page", stretch("page").alias("s"), T.long_tokens(F.col("title"), 2).alias("want"))
    near = F.col("at").between(F.col("page") - before, F.col("page"))
    covers = F.when(near, F.coalesce(F.size(F.array_intersect("want", "have")) / F.greatest(F.size("want"), F.lit(1)), F.lit(0.0))).otherwise(0.0)
    best = want.join(heads.hint("merge"), ["doc", "s"], "left").groupBy("doc", "title", "page").agg(F.max(covers).alias("cover"))
    return best.groupBy("doc").agg(F.count(F.lit(1)).alias("titles"), F.count_if(F.col("cover") >= 0.6).alias("found"))
