"""Row identity, bounded blocks and long texts of the two substring operators, against plain Python."""

import random

import numpy as np
import pyarrow as pa

from folioscope.llm import suffix_dedup, window_dedup, windows
from tests.llm.test_operators import brute_bytes, brute_words, key


def check_words(spark, rows, width, gram):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = window_dedup.remove_windows(docs, window_dedup.removed_windows(docs, width, gram), width).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, width)


def check_bytes(spark, rows, width, gram):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_windows(docs, suffix_dedup.removed_windows(docs, width, gram), width).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, width)


def nameless_rows():
    """5,000 rows of which most have no id, or the id of others, and texts that share passages."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    passages = [" ".join(rng.choices(words, k=12)) for _ in range(40)]
    out = []
    for i in range(5000):
        text = " ".join(rng.choices(words, k=rng.randint(1, 14)))
        if i % 9 == 0:
            text += " " + rng.choice(passages) + " " + " ".join(rng.choices(words, k=rng.randint(0, 5)))
        out.append((None if i % 3 else (7 if i % 2 else i), text))
    return out


def test_rows_without_an_id_or_with_a_shared_one_keep_apart(spark):
    rows = nameless_rows()
    check_words(spark, rows, 6, 2)
    check_bytes(spark, rows, 30, 11)


def test_tags_are_as_wide_as_the_hash(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(20_000)], "doc_id long, text string")
    assert windows.keyed(docs).select("tag").distinct().count() == 20_000


def test_many_contexts_on_one_cool_anchor_stay_bounded(spark, monkeypatch):
    """A passage that every row has once, in slices so small that none finds it frequent."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    rows = [(i, "".join(rng.choice("qrstuvwxyz ") for _ in range(40)) + passage + "".join(rng.choice("qrstuvwxyz ") for _ in range(40))) for i in range(2500)]
    rows += [(3000 + i, rows[i][1][i % 30 :]) for i in range(60)]
    monkeypatch.setattr(windows, "HOT_AT", 10**6)
    monkeypatch.setattr(suffix_dedup, "GROUP_LETTERS", 20_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_LETTERS", 10_000)
    check_bytes(spark, rows, 60, 20)


def test_windows_of_a_frequent_anchor_are_settled_in_runs(spark):
    """Many copies of a text with an edit each: only what lies at the edits is looked at window by window."""
    rng = random.Random(12)
    base = [rng.choice("abcdefghijklmnop ") for _ in range(1200)]
    rows = []
    for i in range(120):
        text = list(base)
        text[rng.randrange(300, 900)] = rng.choice("QRSTUVWXYZ")
        rows.append((i, "".join(text)[rng.randrange(40) : 1200 - rng.randrange(40)]))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, rows[3][1][:210]), (502, rows[3][1][-203:])]
    check_bytes(spark, rows, 200, 72)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.removed_windows(docs).count() < 40 * len(rows)


def test_pieces_of_long_texts_give_the_same_windows(spark, monkeypatch):
    rng = random.Random(4)
    long_ = " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 30)) for _ in range(3000))
    rows = [(1, long_), (2, long_[500:2500]), (3, "x " * 500), (4, long_[::-1])]
    for piece in (64, 1000):
        for unit, width, gram in (("byte", 30, 9), ("word", 7, 3)):
            units = windows.Units(pa.array([t for _, t in rows]), unit)
            whole, cut = np.zeros(int(units.offsets[-1]), bool), np.zeros(int(units.offsets[-1]), bool)
            for flags, size in ((whole, 1 << 22), (cut, piece)):
                for row, first, count, *_ in windows.entries(units, width, gram, size):
                    for r, f, c in zip(row, first, count, strict=True):
                        assert not flags[f : f + c].any()
                        assert units.offsets[r] <= f and f + c - 1 + width <= units.offsets[r + 1]
                        flags[f : f + c] = True
            assert (whole == cut).all()
    monkeypatch.setattr(windows, "DIGESTS", 50)
    check_words(spark, rows, 7, 3)
    check_bytes(spark, rows, 30, 9)


def test_covered_units_are_those_of_any_window():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        want, items, first, count = np.zeros(int(offsets[-1]), bool), [0], [], []
        for r, size in enumerate(sizes):
            for _ in range(rng.randint(0, 5) if size >= 10 else 0):
                f = rng.randint(0, size - 10)
                c = rng.randint(1, size - 10 - f + 1)
                first.append(f), count.append(c)
                want[offsets[r] + f : offsets[r] + f + c - 1 + 10] = True
            items.append(len(first))
        got = windows.covered(offsets, np.array(items), np.array(first, np.int64), np.array(count, np.int64), 10)
        assert (got == want).all()


def test_an_index_goes_on_in_another_session_and_leaves_no_tables(spark, tmp_path):
    rng = random.Random(12)
    words = ["w" + str(i) for i in range(60)]
    shared = " ".join(rng.choices(words, k=15))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 25))) + (" " + shared if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("folioscope_run_")}
    before = tables()
    index = window_dedup.FingerprintIndex(spark, 6, 2)
    for low in (0, 80):
        index.add(windows.keyed(docs.filter(f"doc_id >= {low} AND doc_id < {low + 80}")))
    index.save(f"{tmp_path}/index")
    later = window_dedup.FingerprintIndex.load(spark, f"{tmp_path}/index")
    later.add(windows.keyed(docs.filter("doc_id >= 160")))
    gone = later.verify(windows.keyed(docs))
    for part in [*index.settled, *later.settled]:
        gone = gone.unionByName(part)
    got = window_dedup.remove_windows(docs, gone, 6).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, 6)
    index.drop()
    later.drop()
    window_dedup.removed_windows(docs, 6, 2)
    assert tables() == before
