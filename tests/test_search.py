"""Ranking invariants on small literal chunks."""

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import search as S
from folioscope.operators import segment as G

CHUNKS = [
    (1, "G1", "Core", "rules", "Skill Tests", "roll two dice and add the skill; eight or more passes"),
    (2, "G1", "Core", "rules", "Making People", "later a skill test may come up while choosing"),
    (3, "G1", "Core", "items", "Arms › L9", "the L9 carbine fires light rounds"),
    (4, "G2", "Core", "rules", "Skill Tests", "other game, other skill test"),
    (5, "G2", "Core", "reference", "A", ""),
]
DDL = "chunk_id int, game string, source string, category string, section string, text string"


def ranked(spark, query, k=5, rel=None, **scope):
    chunks = spark.createDataFrame(CHUNKS, DDL)
    queries = spark.createDataFrame([(1, query)], "query_id int, query string")
    hits = S.top_hits(S.bm25(S.index(chunks), queries, S.in_scope(chunks, **scope)), k, rel)
    return [r.chunk_id for r in hits.orderBy("rank").collect()]


def test_section_named_chunk_is_first(spark):
    assert ranked(spark, "skill test", game="G1")[0] == 1


def test_scope_isolates_games(spark):
    assert ranked(spark, "skill test", game="G2") == [4]


def test_blank_query_has_no_hits(spark):
    assert ranked(spark, "  ") == []


def test_cutoff_trims_and_zero_keeps(spark):
    every = ranked(spark, "skill test roll", rel=0.0)
    assert set(ranked(spark, "skill test roll", rel=0.9)) < set(every)


def test_spelling_and_plural_fold(spark):
    row = spark.range(1).select(*(F.element_at(T.tokenize(F.lit(x)), 1).alias(f"c{i}") for i, x in enumerate(["armour", "armor", "rolls", "status", "success", "arms"]))).first()
    assert list(row) == ["armor", "armor", "roll", "status", "success", "arms"]


def test_statistics_ignore_the_scope(spark):
    chunks = spark.createDataFrame(CHUNKS, DDL)
    queries = spark.createDataFrame([(1, "skill")], "query_id int, query string")
    idx = S.index(chunks)
    whole = {r.chunk_id: r.score for r in S.bm25(idx, queries).collect()}
    part = {r.chunk_id: r.score for r in S.bm25(idx, queries, S.in_scope(chunks, game="G1")).collect()}
    assert part == {k: v for k, v in whole.items() if k in part} and part


def test_empty_chunks(spark):
    chunks = spark.createDataFrame([], DDL)
    queries = spark.createDataFrame([(1, "skill")], "query_id int, query string")
    assert S.top_hits(S.bm25(S.index(chunks), queries), 5).count() == 0


def test_word_budget_resets_when_full(spark):
    row = spark.range(1).select(G.greedy_segments(F.array(*map(F.lit, [60, 60, 10, 200, 1, 1])))).first()[0]
    assert row == [0, 0, 1, 1, 2, 2]


def test_scores_are_added_up_where_postings_are(spark):
    """Pairs of query and chunk are far more than postings: none is shuffled before each task has its k best."""
    chunks = spark.createDataFrame([(i, "G", "Core", "rules", "", f"skill test {i % 3} roll") for i in range(60)], DDL)
    queries = spark.createDataFrame([(q, "skill test roll") for q in range(40)], "query_id int, query string")
    hits = S.top_hits(S.bm25(S.index(chunks, S.query_terms(queries)), queries), 2)
    got = {(r.query_id, r.rank): r.chunk_id for r in hits.collect()}
    assert got == {(q, i + 1): i for q in range(40) for i in range(2)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id#" in plan
    assert not any("hashpartitioning(query_id" in line and "chunk_id" in line for line in plan.splitlines())
    every = {(r.query_id, r.rank): r.chunk_id for r in S.top_hits(S.bm25(S.index(chunks), queries), 2).collect()}
    assert every == got


def test_many_query_terms_are_shuffled_to_meet(spark, monkeypatch):
    chunks = spark.createDataFrame(CHUNKS, DDL)
    queries = spark.createDataFrame([(1, "skill test"), (2, "carbine rounds")], "query_id int, query string")
    ranks = lambda: sorted(map(tuple, S.top_hits(S.bm25(S.index(chunks, S.query_terms(queries)), queries), 3).collect()))
    few = ranks()
    monkeypatch.setattr(S, "FEW_TERMS", 1)
    assert ranks() == few and few


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame(CHUNKS, DDL).write.parquet(f"{tmp_path}/c.parquet")
    chunks = spark.read.parquet(f"{tmp_path}/c.parquet")
    assert S._parts(chunks) == []
    monkeypatch.setattr(S, "PART_BYTES", 100)
    assert S._parts(chunks)[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    unknown = chunks.mapInArrow(lambda batches: batches, DDL)
    monkeypatch.setattr(S, "MOST_PARTS", 1)
    assert S._parts(unknown) == []
