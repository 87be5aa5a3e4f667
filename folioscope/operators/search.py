"""Ranked retrieval: a postings table, collection statistics and BM25 for many queries at once.

Statistics always cover all chunks; scopes filter candidates alone. A query
term is joined with its postings (equi-join on the term), so a query touches
the postings of its terms and nothing else; repeated query terms count again.
Postings of asked terms are dealt by chunk and asked terms sent to them, so a
chunk's scores are added up where its postings are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

K1, B, HEADING_BOOST, CUTOFF = 1.5, 0.75, 1.0, 0.40
#: Most query terms, with their queries, that go to the postings; more of them are shuffled to meet.
FEW_TERMS = 200_000
#: Bytes of chunks, as the planner reckons them, for a partition of postings, and most partitions (a table of unknown size would have far more).
PART_BYTES, MOST_PARTS = 8 << 20, 20_000


def _parts(chunks: DataFrame) -> list[int]:
    """The number of partitions where files of known size need more than the session's, so that a task's share stays bounded."""
    size = int(str(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // PART_BYTES)
    return [parts] if int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) < parts <= MOST_PARTS else []


def index(chunks: DataFrame, terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """postings (term, chunk_id, tf, dl, in_heading), term_stats (term, df) and corpus (n, avg_len).

    chunks: chunk_id, section, text. The section's tokens are indexed with the
    text. With ``terms`` (term) only their postings and frequencies are made:
    the texts' words are held against the few spellings that fold to a term
    before any is folded. The corpus is counted in full.
    """
    section = F.coalesce(F.col("section"), F.lit(""))
    whole = F.lower(F.concat_ws(" ", F.nullif(section, F.lit("")), F.coalesce("text", F.lit(""))))
    rows = chunks.select("chunk_id", whole.alias("whole"), T.tokenize(section).alias("heading"))
    spelled = rows.select("chunk_id", "heading", F.regexp_extract_all("whole", F.lit(T.TOKEN), F.lit(0)).alias("raw")).withColumn("dl", F.size("raw"))
    tokens = spelled.select("chunk_id", "dl", "heading", F.explode("raw").alias("raw"))
    if terms is None:
        tokens = tokens.groupBy("chunk_id", "raw").agg(F.count(F.lit(1)).alias("times"), F.max("dl").alias("dl"), F.first("heading").alias("heading")).withColumn("term", T.stem(F.col("raw")))
    else:
        forms = terms.select("term").distinct().select("term", F.explode(T.spellings(F.col("term"))).alias("raw")).filter(T.stem(F.col("raw")) == F.col("term"))
        # by chunk alone, so that postings and the scores made of them need no further shuffle
        tokens = tokens.join(forms, "raw").withColumn("times", F.lit(1)).drop("raw").repartition(*_parts(chunks), "chunk_id")
    postings = tokens.groupBy("term", "chunk_id").agg(F.sum("times").alias("tf"), F.max("dl").alias("dl"), F.max(F.array_contains("heading", F.col("term"))).alias("in_heading"))
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length = F.regexp_count("whole", F.lit(T.TOKEN))
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length) / F.count(F.lit(1)), F.lit(0.0)).alias("avg_len"))
    return {"postings": postings, "term_stats": stats, "corpus": corpus}


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query has it, from query_id, query."""
    return queries.select("query_id", F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(idx: dict[str, DataFrame], queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of every chunk with a query term; scope: the chunk_ids that may answer."""
    corpus = F.broadcast(idx["corpus"])  # one row
    terms = query_terms(queries)
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    asked = terms.join(idx["term_stats"], "term", "left").crossJoin(corpus)
    df = F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))
    asked = asked.select("query_id", "term", "times", F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)).alias("idf"), F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len")).alias("mean"))
    hits = idx["postings"].join(F.broadcast(asked) if few else asked, "term")
    if scope is not None:
        hits = hits.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
    idf = F.col("idf")
    length = F.greatest(F.col("dl"), F.lit(1)) / F.col("mean")
    body = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    part = F.col("times") * (body + F.when(F.col("in_heading"), HEADING_BOOST * idf).otherwise(0.0))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).filter("score > 0")


def top_hits(scores: DataFrame, k: int, min_rel: float | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: hits of at least min_rel of the query's best, then the k best.

    Hits that reach a share of the best come first in order, so the k best are
    taken first, by every task from its own, and held against the best after.
    """
    rel = CUTOFF if min_rel is None else min_rel
    best = Window.partitionBy("query_id")
    order = best.orderBy(F.desc("score"), "chunk_id")
    first = scores.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kept = first.withColumn("top", F.max("score").over(best)).filter(F.col("score") >= F.col("top") * rel)
    return kept.select("query_id", "rank", "chunk_id", "score")


def in_scope(chunks: DataFrame, game: str | None = None, book: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """Chunks of a game, a book and some categories, each where given."""
    good: Column = F.lit(True)
    if game:
        good &= F.col("game") == game
    if book:
        good &= F.col("source") == book
    if categories:
        good &= F.col("category").isin(categories)
    return chunks.filter(good)


def lookup(hits: DataFrame, chunks: DataFrame, keep: int = 8) -> DataFrame:
    """The first ``keep`` hits that are no reference clutter, ranked anew."""
    named = hits.join(chunks.select("chunk_id", "category"), "chunk_id").filter("category <> 'reference'")
    order = Window.partitionBy("query_id").orderBy("rank")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("query_id", "rank", "chunk_id", "score")


def auto_select(hits: DataFrame, at_least: float = 0.6) -> DataFrame:
    """query_id, opens: whether exactly one hit reaches ``at_least``."""
    return hits.groupBy("query_id").agg((F.count_if(F.col("score") >= at_least) == 1).alias("opens"))


def merge_hits(direct: DataFrame, exploded: DataFrame) -> DataFrame:
    """Union of both; of equal (query_id, source, leaf) the higher score, direct before exploded."""
    both = direct.withColumn("_from", F.lit(0)).unionByName(exploded.withColumn("_from", F.lit(1)))
    order = Window.partitionBy("query_id", "source", F.lower("leaf")).orderBy(F.desc("score"), "_from", "ord")
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_from")
