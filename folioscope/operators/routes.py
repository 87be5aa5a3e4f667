"""Commands composed from search, name matching and tables: domain lookups and careers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import careers as K
from folioscope.operators import classify as P
from folioscope.operators import grids as G
from folioscope.operators import search as S

# Limits of the commands (fixed values).
TEXT_HITS, MOST, CERTAIN, CAREER_HITS = 8, 25, 0.6, 12
CATALOGUES = ["items", "transport", "item"]
CAREER_WORDS = "career qualification skills rank"


def direct_entries(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, source, leaf, item, score of chunks whose section's last part shares a word with a query (query_id, query).

    Words are the keys of the join, so a name meets the queries that it shares one with.
    """
    q = asked.select("query_id", T.tokenize(F.col("query")).alias("wanted"))
    leaf = T.crumb_leaf(F.coalesce("section", F.lit("")))
    named = chunks.select("chunk_id", "source", leaf.alias("leaf"), T.tokenize(leaf).alias("have"))
    met = q.withColumn("word", F.explode(F.array_distinct("wanted"))).join(named.withColumn("word", F.explode(F.array_distinct("have"))), "word")
    met = met.dropDuplicates(["query_id", "chunk_id"])
    return met.select("query_id", "chunk_id", "source", "leaf", F.col("leaf").alias("item"), F.round(T.name_score(F.col("wanted"), F.col("have")), 6).alias("score")).filter("score > 0")


def explode_items(hits: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, score) whose chunk has a grid, as one entry per row that shares a word with the query; the others as they are."""
    rows = hits.join(chunks.select("chunk_id", "source", "section", "rows"), "chunk_id").join(asked, "query_id")
    leaf = T.crumb_leaf(F.coalesce("section", F.lit("")))
    grid = F.coalesce(F.size("rows"), F.lit(0)) > 1
    plain = rows.filter(~grid).select("query_id", "chunk_id", "source", leaf.alias("leaf"), leaf.alias("item"), "score")
    each = rows.filter(grid).select("query_id", "query", "chunk_id", "source", G.name_column(F.col("rows")).alias("at"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("r"))
    each = each.withColumn("item", T.item_name(F.coalesce(F.get("r", F.col("at")), F.lit("")))).filter("item <> ''")
    each = each.withColumn("score", F.round(T.name_score(T.tokenize(F.col("query")), T.tokenize(F.col("item"))), 6)).filter("score > 0")
    return plain.unionByName(each.select("query_id", "chunk_id", "source", F.col("item").alias("leaf"), "item", "score"))


def domain_lookup(chunks: DataFrame, idx: dict[str, DataFrame], asked: DataFrame, domain: str, game: str | None = None, book: str | None = None) -> DataFrame:
    """query_id, rank, chunk_id, source, item, score, opens for queries among the categories of a domain.

    Entries that a query names win. In catalogues the rows of tables that were
    found join them; elsewhere what was found in the text counts only where
    nothing is named. Of an item of a book the best entry stays; ``opens`` says
    that exactly one entry is certain, and it comes first.
    """
    scope = S.in_scope(chunks, game, book).filter(P.domain(F.col("category")) == domain)
    hits = S.top_hits(S.bm25(idx, asked, scope), TEXT_HITS).select("query_id", "chunk_id", "score")
    direct = direct_entries(scope, asked)
    catalogue = F.max(F.col("category").isin(CATALOGUES).cast("int")).alias("catalogue")
    is_catalogue = scope.agg(catalogue)  # one row
    found = explode_items(hits, chunks, asked).crossJoin(F.broadcast(is_catalogue))
    named = direct.select("query_id").distinct().withColumn("named", F.lit(True))
    kept = found.join(named, "query_id", "left").filter((F.col("catalogue") == 1) | F.col("named").isNull()).drop("catalogue", "named")
    both = S.merge_hits(direct.withColumn("ord", F.col("chunk_id")), kept.withColumn("ord", F.col("chunk_id")))
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.desc("score"), "ord", F.lower("leaf"))
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST)
    certain = F.sum((F.col("score") >= CERTAIN).cast("int")).over(by) == 1
    return ranked.withColumn("opens", (F.col("rank") == 1) & (F.col("score") >= CERTAIN) & certain).select("query_id", "rank", "chunk_id", "source", "item", "score", "opens")


def structured_careers(chunks: DataFrame) -> DataFrame:
    """game, name, ord, label, text, options of all careers on cards (category card, with rows), the first of each label."""
    cards = chunks.filter((F.col("category") == "card") & (F.coalesce(F.size("rows"), F.lit(0)) >= 2)).select(F.col("chunk_id").alias("card"), "game", "rows")
    sections = K.card_sections(cards.select("card", "rows")).join(cards.select("card", "game"), "card")
    return K.merge_sections(sections.withColumn("ord", F.struct("card", "ord")))


def find_career(chunks: DataFrame, idx: dict[str, DataFrame], game: str, name: str) -> DataFrame:
    """how, ord, label, text of a career: its card's sections, or else what the books say of it."""
    exact = structured_careers(chunks.filter(F.col("game") == game)).filter(F.lower("name") == name.lower())
    order = Window.partitionBy("name").orderBy("ord")
    options = F.array_join("options", ", ")
    exact = exact.select(F.lit("structured").alias("how"), F.row_number().over(order).alias("ord"), "label", F.when(F.col("text") != "", F.col("text")).otherwise(options).alias("text"))
    if not exact.isEmpty():
        return exact
    asked = chunks.sparkSession.createDataFrame([(1, f"{name} {CAREER_WORDS}")], "query_id int, query string")
    hits = S.top_hits(S.bm25(idx, asked, S.in_scope(chunks, game)), CAREER_HITS).join(chunks, "chunk_id")
    return K.assemble(hits, name).select(F.lit("assembled").alias("how"), "ord", "label", "text")
