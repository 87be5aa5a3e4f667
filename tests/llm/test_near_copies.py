"""Near copies against the Jaccard similarity of all pairs, and the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import near_copies

from .test_operators import WORD, prose


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(rows):
    """A number for each row, equal for rows of one component."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    before = None
    while before != label:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def brute_labels(rows):
    label, best = brute_groups(rows), {}
    for (d, _), x in zip(rows, label):
        best[x] = min(best.get(x, d), d, key=lambda v: (v is None, v or 0))
    return sorted(((d, best[x]) for (d, _), x in zip(rows, label)), key=str)


def check_one_of_each(rows, kept):
    """Of each component one row is kept, that of the smallest id; rows and kept: (doc_id, text)."""
    groups, left = {}, list(kept)
    for row, x in zip(rows, brute_groups(rows)):
        groups.setdefault(x, []).append(row)
    assert len(kept) == len(groups)
    for members in groups.values():
        least = min((d for d, _ in members if d is not None), default=None)
        mine = [r for r in left if r in members and r[0] == least]
        assert mine
        left.remove(mine[0])


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near(spark):
    rng, rows = random.Random(4), []
    line = prose(rng, 15)
    for i in range(60):
        text = prose(rng, rng.randint(4, 300)) + " " + line
        rows += [(len(rows) + j, edited(rng, text, j)) for j in range(rng.randint(1, 5))]
    base = prose(rng, 100)
    rows += [(len(rows) + j, edited(rng, base, 1)) for j in range(40)]
    rows += [(None, base), (900, None), (901, " "), (902, "one two three four"), (903, "one two three FOUR"), (None, "alone"), (904, base)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [1024, 4])
def test_all_pairs_of_similarity_are_linked(near, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows, docs = near
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()), key=str)
    assert got == brute_labels(rows)


def test_stage_drops_near_copies(spark, near):
    rows, docs = near
    check_one_of_each(rows, [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()])


def test_one_row_stays_of_repeated_rows_and_of_rows_without_an_id(spark):
    rng = random.Random(9)
    one, two = prose(rng, 60), prose(rng, 70)
    rows = [(None, one), (None, one), (None, one + " x"), (4, two), (4, two), (4, two + " y"), (None, two), (4, one[::-1]), (5, None), (5, None), (None, "")]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, _near_id string, hash int, root string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    check_one_of_each(rows, [(r.doc_id, r.text) for r in got.collect()])


def test_a_large_loose_group_is_one_component(spark, monkeypatch):
    """Copies of a text of which most pairs are less similar than 0.8, in blocks of a group."""
    monkeypatch.setattr(near_copies, "GROUP", 40)
    rng = random.Random(2)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.randint(1, 6))) for i in range(200)] + [(500 + i, prose(rng, 100)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()), key=str) == brute_labels(rows)


def test_a_repeated_id_does_not_take_another_text_along(spark):
    rng = random.Random(5)
    one, two = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(3, one), (7, one + " x"), (7, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted([(3, one), (7, two)])


def common_starts(one, two):
    """Differing bits of the chains from the segments that two sets have in common on a ring where one is no guest."""
    found = {}
    values, at = np.concatenate([np.sort(one), np.sort(two)]), np.array([0, len(one), len(one) + len(two)])
    for sets, keys, chains, _ in near_copies.rings(values, at):
        for s, k, c in zip(sets.tolist(), keys.tolist(), chains.tolist()):
            found.setdefault(k, {})[s] = c
    guest = int(near_copies._GUEST)
    return [x[0] ^ x[1] for x in found.values() if len(x) == 2 and x[0] & x[1] < guest]


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_segment_whose_chains_keep_every_budget(seed):
    """Sets of all sizes that differ in as many shingles as similarity 0.8 allows, dealt to both in any way."""
    rng = np.random.default_rng(seed)
    for small in [*range(1, 80), 99, 100, 101, 243, 400, 1000]:
        for large in {small, small * 9 // 8, small * 5 // 4}:
            shared = int(near_copies.least_overlap(small + large))
            assert shared <= small
            pool = rng.integers(0, 1 << 64, small + large - shared, np.uint64)
            starts = common_starts(pool[:small], np.concatenate([pool[:shared], pool[small:]]))
            assert near_copies.viable(np.array(starts, np.uint64)).any(), (small, large)


def test_unrelated_sets_that_share_a_segment_fail_the_chains():
    rng = np.random.default_rng(7)
    starts = [x for _ in range(1500) for x in common_starts(*rng.integers(0, 1 << 64, (2, 200), np.uint64))]
    assert len(starts) > 20  # segments that are empty in both
    assert near_copies.viable(np.array(starts, np.uint64)).mean() < 0.01


def test_a_pair_beyond_the_budget_of_a_chain_is_not_compared():
    n, words = np.array([200, 200, 200]), [np.zeros(3, np.uint64)] * len(near_copies.SIGNATURE)
    chains = np.array([0, 0b1, 0b110], np.uint64)  # two segments may differ in one shingle, so not in two
    good = near_copies.plausible(n, chains, words, np.arange(3)[:, None], np.arange(3)[None, :], np.triu(np.ones((3, 3), bool), 1))
    assert np.argwhere(good).tolist() == [[0, 1]]


def test_texts_that_go_on_longer_are_linked_across_classes_of_size(spark):
    rng, rows = random.Random(11), []
    for size in [1, 4, 5, 8, 9, 12, 15, 16, 20, 25, 40, 60, 61, 75, 76, 150]:
        text = prose(rng, size + 4).split()
        more = size // 4
        rows += [(len(rows) + j, " ".join(text + [f"more{size}x{i}" for i in range(extra)])) for j, extra in enumerate((0, more, more + 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()), key=str) == brute_labels(rows)
