"""Queries over larger or odder tables than the small ones, against their SQL."""

import duckdb

from folioscope import catalog
from folioscope.cluster import ship
from folioscope.operators import evals as E

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def compared(spark, folder, name, *tables):
    """Sorted rows of a query and of its SQL over the tables of a folder, columns in the order of their names."""
    ship(spark)
    frame = catalog.QUERIES[name](spark, str(folder))
    columns = ", ".join(sorted(frame.columns))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, frame.select(*sorted(frame.columns)).collect()))), sorted(map(str, want))


def test_best_part_weighs_large_keys_against_cents(spark, tmp_path):
    rows = [(5, "a b", "B1", "X", 1, 100.00), (40000, "a b", "B1", "X", 1, 100.01), (7, "a b", "B2", "X", 1, 9.5), (9, "a b", "B2", "X", 1, 9.75), (3, "a b", "B3", "X", 1, None), (4, "a b", "B3", "X", 1, 1.0), (6, "a b", "B4", "X", 1, None)]
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got, want = compared(spark, tmp_path, "O6_argmax", "part")
    assert got == want and "(5, 'B1')" in got


def test_headings_cover_titles_of_the_pages_after_them_without_a_broadcast(spark):
    titles = [(1, f"alpha beta {p}", p) for p in range(-9, 40)]
    heads = [(1, "Alpha Beta", p) for p in (-7, 2, 3, 11, 30)] + [(1, "Alpha", 20), (2, "Alpha Beta", 24)]
    toc, headings = (spark.createDataFrame(x, "doc int, title string, page int") for x in (titles, heads))
    got = E.heading_recall(toc, headings)
    covered = sum(any(p - 3 <= at <= p for d, t, at in heads if d == 1 and t == "Alpha Beta") for _, _, p in titles)
    assert got.collect() == [(1, len(titles), covered)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
