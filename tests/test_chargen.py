"""Life paths and archetypes: rules that hold for every character, and given steps."""

import itertools

import pytest

from folioscope.operators import chargen as C
from folioscope.plans.domain import _book


@pytest.fixture(scope="module")
def book(spark):
    return _book(spark)


def asked(flow, book, draft, given=None):
    """A sheet and the steps that were asked for, in order, as (step, sides, value)."""
    log = []

    def roller(number, step, sides):
        value = (given[step] - 1) % sides + 1 if given and step in given else C.seeded(number, step, sides)
        log.append((step, sides, value))
        return value

    return flow(book, draft, roller), log


def test_life_paths_keep_the_rules(book):
    for draft in range(300):
        sheet, log = asked(C.life_path, book, draft)
        steps = [s for s, _, _ in log]
        assert len(steps) == len(set(steps)) and sheet == C.life_path(book, draft)
        value = {s: v for s, _, v in log}
        terms = sheet["terms"]
        assert 1 <= terms <= C.MOST_TERMS and sheet["war"] == (value.get(f"war_{terms}", 9) < terms)
        assert all(value[f"war_{t}"] >= t for t in range(2, terms)) and "war_1" not in value and "age_effect_1" not in value
        assert sheet["age"] == 18 + sum(value[f"age_{t}"] for t in range(1, terms + 1))
        first = sheet["history"][0].split(" (")[0]
        assert first not in ("Officer", "Doctor")  # both ask for terms served
        if first == "Combat Arms":
            assert C.FIRST_SKILL in sheet["skills"] and "skill_1_1" not in value
        names = [h.split(" (")[0] for h in sheet["history"]]
        for i, name in enumerate(names):
            if name == "Officer":
                assert set(names[:i]) & {"Combat Arms", "Officer"}
            if name == "Doctor":
                assert names[:i].count("Sciences") >= 2
        assert len(sheet["specialties"]) == len(set(sheet["specialties"]))
        assert bool(sheet["rank"]) == bool(set(names) & {"Combat Arms", "Officer"})
        raises = value["attr_increases_0"] + value["attr_increases_1"]
        drops = sum(s.startswith("age_drop_") for s in steps)
        assert sum(C.LADDER.index(x) for x in sheet["attributes"].values()) == 4 + min(raises, 8) - drops
        gained = sum(C.SKILL_LADDER.index(x) for x in sheet["skills"].values())
        assert gained <= 1 + 2 * terms + 2


def test_two_raises_of_a_term_differ(book):
    for draft in range(200):
        _, log = asked(C.life_path, book, draft)
        for t in range(1, 11):
            mine = [(s, sides) for s, sides, _ in log if s.startswith(f"skill_{t}_")]
            assert [s for s, _ in mine] == [f"skill_{t}_{i}" for i in range(len(mine))] and len(mine) <= 2
            for (_, a), (_, b) in itertools.pairwise(mine):
                assert b <= a  # what was raised is not offered again


def test_given_steps_decide(book):
    given = {"nationality": 2, "childhood": 1, "childhood_skill": 1, "childhood_spec": 6, "childhood_spec_pick": 1, "attr_increases_0": 1, "attr_increases_1": 1, "attr_raise_0": 1, "attr_raise_1": 1,
             "career_1": 1, "skill_1_0": 2, "advance_1": 6, "spec_1": 1, "age_1": 4, "career_2": 1, "skill_2_0": 1, "skill_2_1": 1, "advance_2": 1, "age_2": 2, "age_effect_2": 1, "age_drop_2": 1, "war_2": 1, "atwar_skill_0": 1, "atwar_skill_1": 1}
    sheet, log = asked(C.life_path, book, 1, given)
    assert {s for s, _, _ in log} <= set(given)
    assert sheet["nation"] == "soviet" and sheet["russian"] and sheet["childhood"] == "City"
    assert sheet["attributes"] == {"STR": "B", "AGL": "C", "INT": "C", "EMP": "C"}  # two raises, one step lost to age
    assert sheet["terms"] == 2 and sheet["age"] == 24 and sheet["war"]
    assert sheet["history"][0].startswith("Combat Arms (") and sheet["rank"] == "Yefreitor" and sheet["cuf"] == "C"
    assert sheet["specialties"][0] == "Hacker" and len(sheet["specialties"]) == 2  # no entry for six, so one is picked
    assert sheet["hit"] == 5 and sheet["stress"] == 4


def test_archetypes(book):
    for draft in range(200):
        sheet, log = asked(C.archetype, book, draft)
        value = {s: v for s, _, v in log}
        assert sorted(sheet["skills"].values()) == ["B", "C", "C", "D", "D", "D"]
        dropped = value["archetype_attr_drop"] > 1
        assert sum(s.startswith("archetype_attr_") for s in value) - 1 == (4 if dropped else 3)
        assert ("D" in sheet["attributes"].values()) == dropped
        assert sheet["template"] in ("The Grunt", "The Medic") and len(sheet["specialties"]) == 1


def test_drafts_are_dealt_to_all_cores(spark, book):
    drafts = spark.range(0, 400, 1, 1).withColumnRenamed("id", "draft_id")
    whole = C.characters(drafts, book, seed="s")
    assert whole.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = {i: C.life_path(book, i, lambda n, step, sides: C.seeded(n, step, sides, "s")) for i in range(400)}
    assert {r.draft_id: r.asDict() for r in whole.collect()} == want
    some = C.characters(drafts, book, seed="s", fields=["nation", "draft_id"])
    assert some.columns == ["nation", "draft_id"] and {r.draft_id: r.nation for r in some.collect()} == {i: s["nation"] for i, s in want.items()}
