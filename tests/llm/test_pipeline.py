"""The pipeline's stages, each on its own input, against plain Python; then the whole."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioscope.llm import mixing, packing, quality_cnn

from .test_near_copies import check_one_of_each
from .test_operators import WORD, prose

DDL = "doc_id long, text string, lang string, source string, n_chars long, copies int, left string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of good and bad prose with copies, near copies, shared passages and odd rows; labels of most."""
    rng, rows, labels = random.Random(8), [], []
    shared = prose(rng, 80)
    for i in range(120):
        good = i % 4 > 0
        text = prose(rng, rng.randint(20, 90))
        if i % 10 == 1:
            text += " " + shared
        if not good:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}", len(text), 1, "x"))
        labels.append((i, int(good), 0))
    rows += [(200, rows[1][1], "en", None, None, None, None), (201, rows[2][1] + " x", "en", "s1", 1, 2, "y"), (202, None, None, "s1", None, None, None), (203, "", "en", "s2", 0, 0, ""), rows[5], (None, prose(rng, 60), "en", "s1", 3, 3, "z")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage(spark, tables):
    path, docs = tables
    got = corpus_pipeline.quality(spark, docs, path)
    assert got.columns == docs.columns
    params = quality_cnn.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = [tuple(r) for r in docs.collect() if quality_cnn.score_rows(params, pa.array([r.text], pa.string()))[0] >= 0.7]
    assert as_rows(got) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_near_dedup_stage(spark, tables):
    _, docs = tables
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    check_one_of_each([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in got.collect()])


def test_substring_stage(spark, tables):
    _, docs = tables
    got = {(r[0], r.lang, r.source): r for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    rows = docs.collect()
    count = collections.Counter()
    for r in rows:
        raw = (r.text or "").encode()
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))
    for r in rows:
        raw, mine = (r.text or "").encode(), got[(r[0], r.lang, r.source)]
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        assert mine.text == (None if r.text is None else left)
        assert mine.n_chars == (r.n_chars if r.text is None else len(left))
        assert (mine.copies, mine.left) == (r.copies, r.left)


def test_mixing_stage(spark, tables):
    _, docs = tables
    rows, got = docs.collect(), corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    size = lambda t: len(WORD.findall(t or ""))
    times = collections.Counter(map(tuple, rows))
    taken = collections.Counter(map(tuple, got.collect()))
    assert set(taken) <= set(times) and all(taken[r] <= 2 * times[r] for r in taken)
    total = collections.Counter()
    for r in rows:
        total[r.source] += size(r.text)
    for x in mixing.targets(list(total.items())):
        mine = sum(n * size(r[1]) for r, n in taken.items() if r[3] == x["source"])
        assert abs(mine - x["target"]) <= 2 * max(size(r.text) for r in rows if r.source == x["source"])


def test_packing_stage(spark, tables):
    from tokenizers import Tokenizer

    _, docs = tables
    tok = Tokenizer.from_file(packing.tokenizer_path())
    whole = collections.Counter()
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole[r.doc_id] += r.length
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert whole == want


def test_run_is_the_chain_of_stages(spark, tables):
    path, docs = tables
    chained = docs
    for _, stage in corpus_pipeline.STAGES:
        chained = stage(spark, chained, path)
    digest = lambda df: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, path)) == digest(chained)


def test_empty_documents(spark, tables, tmp_path):
    path, docs = tables
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_clashing_names_pass_through(spark, tables):
    path, docs = tables
    from pyspark.sql import functions as F

    names = ["_pipeline_quality", "_mix_hash", "_mix_doc_id", "_mix_tie", "_mix_copies", "_mix_copy", "_near_id", "_near_hash", "hash", "root", "tag", "doc", "pos", "k", "items", "row", "sig", "stays"]
    odd = docs.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, path)
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for n in names), name
    assert corpus_pipeline.pack(spark, odd, path).count() > 0
