"""Grids of many pages: pages that several Arrow batches share, edges of the rules, and no frame for a page."""

import random

import pytest

from folioscope import catalog
from folioscope.operators import geometry as Z

BOX = "doc string, page int, x0 double, y0 double, x1 double, y1 double"


def page(doc, number, mark):
    """Words of an unruled page with three rows; the second row's cell has two words, one of them struck twice."""
    rows = [(10.0, 10.0, "Roll"), (80.0, 10.0, "Event"), (10.0, 22.0, "1"), (80.0, 22.0, "Rain"), (104.0, 22.0, mark), (103.6, 22.4, mark), (10.0, 34.0, "2"), (81.0, 34.0, "Sun")]
    return [(doc, number, x, y, x + 20, y + 8, t) for x, y, t in rows]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_go_on_over_batches(spark, small_batches):
    rows = [w for doc in ("a", "b", None) for n in (1, 2, None) for w in page(doc, n, f"{doc}{n}")]
    random.Random(1).shuffle(rows)
    rows += [("a", 1, None, 10.0, 30.0, 18.0, "nowhere"), ("a", 2, 10.0, float("nan"), 30.0, 18.0, "nowhere"), ("b", 1, 10.0, 10.0, 30.0, 18.0, None)]
    words = spark.createDataFrame(rows, BOX + ", text string")
    shades = spark.createDataFrame([(d, n, 5.0, y, 130.0, y + 11.0) for d in ("a", None) for n in (1, None) for y in (8.0, 32.0)], BOX)
    want = lambda d, n: (d, n, [["Roll", "Event"], ["1", f"Rain {d}{n}"], ["2", "Sun"]])
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, Z.unruled_grids(words).collect()), key=key) == sorted((want(d, n) for d in ("a", "b", None) for n in (1, 2, None)), key=key)
    assert sorted(map(tuple, Z.shaded_grids(shades, words).collect()), key=key) == sorted((want(d, n) for d in ("a", None) for n in (1, None)), key=key)


def test_empty_pages(spark):
    words, cells = spark.createDataFrame([], BOX + ", text string"), spark.createDataFrame([("a", 1, x, y, x + 50, y + 12) for y in (100.0, 112.0) for x in (10.0, 60.0)], BOX)
    assert not Z.unruled_grids(words).count() and not Z.header_anchored_grids(words).count() and not Z.shaded_grids(cells, words).count() and not Z.grids(cells, words).count()


def test_words_round_as_in_sql():
    import numpy as np

    assert Z._half_up(np.array([0.5, 1.5, -0.5, -1.4, 0.49999999999999994, 2.0])).tolist() == [1.0, 2.0, -1.0, -1.0, 0.0, 2.0]


@pytest.mark.parametrize("name", ["Z1_grids_drawn", "Z3_titles_drawn", "Z4_shaded_drawn", "Z5_side_by_side_drawn", "Z6_anchored_drawn", "Z8_columns_drawn"])
def test_no_frame_for_a_page(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
