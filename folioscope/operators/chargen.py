"""Characters drawn step by step: life paths and archetypes over a book of rules.

A character is a function of the book and of what its steps give: dice and
choices are asked for by the step's name, so they can be columns, a seed, or
both, and going through the steps again gives the same character. The book is
of bounded size and goes to the executors with the function; drafts stream
through in Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from folioscope.operators.domain import ATTRIBUTES, EDUCATION, LADDER, RATINGS, requirement_clauses

# Rules of play (fixed values).
SKILL_LADDER = ["F", *LADDER]
BASE, CUF_START, START_AGE, MOST_TERMS, RAISES_A_TERM, SUCCESS = "C", "D", 18, 10, 2, 6
FIRST_SKILL = "Ranged Combat"
NATIONS = ["us", "soviet", "polish", "swedish", "other"]
RUSSIAN = {"soviet", "polish"}
ARCHETYPE_SKILLS = {"C": 2, "D": 3}

Roller = Callable[[int, str, int], int]


def seeded(draft: int, step: str, sides: int, seed: str = "") -> int:
    """1 to ``sides``, from the first 28 bits of a digest of seed, draft and step."""
    return 1 + int(hashlib.md5(f"{seed}{draft}|{step}".encode()).hexdigest()[:7], 16) % sides


@dataclass
class Career:
    name: str
    requirement: str = ""
    military: bool = False
    rank: str = ""
    skills: list[str] = field(default_factory=list)
    specialties: list[str] = field(default_factory=list)
    gear: list[str] = field(default_factory=list)
    clauses: list[dict] = field(default_factory=list)


@dataclass
class Archetype:
    name: str
    key: str = ""
    skills: list[str] = field(default_factory=list)
    specialties: list[str] = field(default_factory=list)
    cuf: str = ""


@dataclass
class Book:
    """Careers, archetypes, childhoods (name: skills, specialty by D6) and the names of ranks by nation."""

    careers: list[Career]
    archetypes: list[Archetype] = field(default_factory=list)
    childhoods: dict[str, tuple[list[str], dict[int, str]]] = field(default_factory=dict)
    ranks: list[dict[str, str]] = field(default_factory=list)

    def skills(self) -> list[str]:
        found = {s for c in self.careers for s in c.skills} | {s for a in self.archetypes for s in a.skills} | {s for names, _ in self.childhoods.values() for s in names}
        return sorted(found)

    def with_clauses(self, spark) -> Book:
        """The requirements of all careers, read once by the operator that reads them for tables."""
        rows = spark.createDataFrame([(c.name, c.requirement) for c in self.careers], "career string, requirement string")
        for row in sorted(requirement_clauses(rows).collect(), key=lambda r: r["ord"]):  # a book's clauses
            next(c for c in self.careers if c.name == row["career"]).clauses.append(row.asDict())
        return self


def meets(clause: dict, attributes: dict[str, str], history: list[Career]) -> bool:
    """Whether a character fulfils a clause; what cannot be read never blocks."""
    kind, level = clause["kind"], clause["level"]
    value = lambda a: LADDER.index(attributes.get(a, BASE))
    if kind == "lacks":
        return all(attributes.get(a, BASE) != level for a in ATTRIBUTES)
    if kind == "among":
        return attributes.get(clause["attrs"][0], BASE) in level
    if kind == "reaches":
        return (any if clause["any_of"] else all)(value(a) >= LADDER.index(level) for a in clause["attrs"])
    if kind != "terms":
        return True
    target = clause["target"]
    group = target.removeprefix("education").strip(" ()") if target.startswith("education") else None

    def counts(term: Career) -> bool:
        name = term.name.lower()
        if target == "military":
            return term.military
        if group is not None:
            return name in EDUCATION if group in ("", "any") else name == group
        return name.startswith(target)

    served = sum(map(counts, history))
    return served == 0 if clause["need"] == 0 else served >= clause["need"]


class Character:
    """What a flow fills in."""

    def __init__(self, draft: int, roller: Roller):
        self.draft, self.roller = draft, roller
        self.attributes = dict.fromkeys(ATTRIBUTES, BASE)
        self.skills: dict[str, str] = {}
        self.specialties: list[str] = []
        self.history: list[Career] = []
        self.labels: list[str] = []
        self.gear: list[str] = []
        self.nation = self.childhood = self.rank = self.template = ""
        self.cuf, self.age, self.war, self.level = CUF_START, START_AGE, False, -1

    def roll(self, step: str, sides: int) -> int:
        return self.roller(self.draft, step, sides)

    def choose(self, step: str, options: list[str]) -> str:
        return options[self.roll(step, len(options)) - 1]

    def raise_skill(self, skill: str) -> None:
        self.skills[skill] = climb(self.skills.get(skill, "F"), SKILL_LADDER, 1)

    def raise_attributes(self, prefix: str, times: int, without: str = "") -> None:
        for i in range(times):
            open_ = [a for a in ATTRIBUTES if a != without and self.attributes[a] != LADDER[-1]]
            if not open_:
                return
            a = self.choose(f"{prefix}{i}", open_)
            self.attributes[a] = climb(self.attributes[a], LADDER, 1)

    def raise_distinct(self, prefix: str, times: int, skills: list[str], raised: set[str]) -> None:
        """So many different skills of those given that are not at the top."""
        for i in range(times):
            open_ = [s for s in skills if s not in raised and self.skills.get(s) != SKILL_LADDER[-1]]
            if not open_:
                return
            skill = self.choose(f"{prefix}{i}", open_)
            self.raise_skill(skill)
            raised.add(skill)

    def sheet(self) -> dict:
        die = lambda a: RATINGS[self.attributes[a]]
        return {
            "draft_id": self.draft, "template": self.template, "nation": self.nation, "russian": self.nation in RUSSIAN, "childhood": self.childhood,
            "attributes": dict(self.attributes), "skills": dict(sorted(self.skills.items())), "specialties": self.specialties, "history": self.labels, "gear": self.gear,
            "rank": self.rank, "cuf": self.cuf, "terms": len(self.history), "age": self.age, "war": self.war,
            "hit": math.ceil((die("STR") + die("AGL")) / 4), "stress": math.ceil((die("INT") + die("EMP")) / 4),
        }


SHEET = "draft_id long, template string, nation string, russian boolean, childhood string, attributes map<string,string>, skills map<string,string>, specialties array<string>, history array<string>, gear array<string>, rank string, cuf string, terms int, age int, war boolean, hit int, stress int"


def climb(level: str, ladder: list[str], by: int) -> str:
    """So many steps up a ladder, stopped at its ends."""
    return ladder[max(0, min(len(ladder) - 1, ladder.index(level) + by))]


def life_path(book: Book, draft: int, roller: Roller = seeded) -> dict:
    """A character by terms of service until war breaks out."""
    it = Character(draft, roller)
    it.nation = it.choose("nationality", NATIONS)
    it.raise_attributes("attr_raise_", it.roll("attr_increases_0", 3) + it.roll("attr_increases_1", 3))
    _childhood(book, it)
    for term in range(1, MOST_TERMS + 1):
        _term(book, it, term)
        if term > 1:
            if it.roll(f"age_effect_{term}", 8) < term:
                worn = [a for a in ATTRIBUTES if it.attributes[a] != LADDER[0]]
                if worn:
                    a = it.choose(f"age_drop_{term}", worn)
                    it.attributes[a] = climb(it.attributes[a], LADDER, -1)
            if it.roll(f"war_{term}", 8) < term:
                it.war = True
                break
    it.raise_distinct("atwar_skill_", 2, sorted(it.skills), set())
    return it.sheet()


def _childhood(book: Book, it: Character) -> None:
    if not book.childhoods:
        return
    it.childhood = it.choose("childhood", list(book.childhoods))
    skills, by_roll = book.childhoods[it.childhood]
    it.raise_skill(it.choose("childhood_skill", skills))
    if by_roll:
        found = by_roll.get(it.roll("childhood_spec", 6)) or it.choose("childhood_spec_pick", sorted(set(by_roll.values())))
        it.specialties.append(found)


def _term(book: Book, it: Character, term: int) -> None:
    """A career the character qualifies for (any if there is none), two different raises, advancement, gear and years."""
    fit = [c for c in book.careers if all(meets(x, it.attributes, it.history) for x in c.clauses)] or book.careers
    name = it.choose(f"career_{term}", [c.name for c in fit])
    career = next(c for c in fit if c.name == name)
    if career.military and book.ranks:
        it.level = max(it.level, _first_rank(book, career.rank))
        it.rank = _rank_name(book, it)
    elif career.military and not it.rank:
        it.rank = career.rank
    raised: set[str] = set()
    if term == 1 and FIRST_SKILL in career.skills:
        it.raise_skill(FIRST_SKILL)
        raised.add(FIRST_SKILL)
    it.raise_distinct(f"skill_{term}_", RAISES_A_TERM - len(raised), career.skills, raised)
    best = max([RATINGS[it.skills[s]] for s in career.skills if it.skills.get(s, "F") in RATINGS] + [RATINGS[x] for x in it.attributes.values()])
    won = ""
    if it.roll(f"advance_{term}", best) >= SUCCESS:
        if it.level >= 0:
            it.level = min(it.level + 1, len(book.ranks) - 1)
            it.rank, it.cuf = _rank_name(book, it), climb(it.cuf, LADDER, 1)
        fresh = [s for s in career.specialties if s not in it.specialties]
        if fresh:
            won = it.choose(f"spec_{term}", fresh)
            it.specialties.append(won)
    it.gear = list(career.gear)
    it.history.append(career)
    it.labels.append(f"{career.name} ({won})" if won else career.name)
    it.age += it.roll(f"age_{term}", 6)


def _first_rank(book: Book, rank: str) -> int:
    levels = [r["us"].lower() for r in book.ranks]
    want = rank.lower()
    return levels.index(want) if want in levels else next((i for i, x in enumerate(levels) if want and want in x), 0)


def _rank_name(book: Book, it: Character) -> str:
    names = book.ranks[it.level]
    return names.get(it.nation) or names["us"]


def archetype(book: Book, draft: int, roller: Roller = seeded) -> dict:
    """A character from a template: three raises, or four with one attribute lowered; one B skill of the template, two C and three D; a specialty."""
    it = Character(draft, roller)
    names = [a.name for a in book.archetypes]
    it.template = it.choose("archetype", names)
    made = book.archetypes[names.index(it.template)]
    it.nation = it.choose("nationality", NATIONS)
    drop = it.choose("archetype_attr_drop", ["none", *ATTRIBUTES])
    if drop in ATTRIBUTES:
        it.attributes[drop] = climb(BASE, LADDER, -1)
    it.raise_attributes("archetype_attr_", 4 if drop in ATTRIBUTES else 3, without=drop)
    it.skills[it.choose("archetype_b_skill", made.skills or book.skills())] = "B"
    for level, times in ARCHETYPE_SKILLS.items():
        for i in range(times):
            free = [s for s in book.skills() if s not in it.skills]
            if free:
                it.skills[it.choose(f"archetype_{level.lower()}_skill_{i}", free)] = level
    if made.specialties:
        it.specialties.append(it.choose("archetype_spec", made.specialties))
    it.cuf = made.cuf or CUF_START
    return it.sheet()


def characters(drafts: DataFrame, book: Book, flow: Callable[[Book, int, Roller], dict] = life_path, seed: str = "", fields: list[str] | None = None) -> DataFrame:
    """Sheets of drafts (draft_id, and, where there is one, rolls: map of step to what it gave); steps without a roll are drawn by seed.

    ``fields`` are the columns wanted; a character is gone through in full for any. Drafts are dealt
    to all cores first, as a small file of them is many characters' work.
    """
    given = "rolls" in drafts.columns
    types = dict(c.split(" ", 1) for c in SHEET.split(", "))
    wanted = fields or list(types)
    kept = ", ".join(f"{c} {types[c]}" for c in wanted)
    schema = to_arrow_schema(_parse_datatype_string(kept))

    def run(batches) -> Iterator:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in wanted}
            rolls = batch.column("rolls").to_pylist() if given else [None] * batch.num_rows
            for draft, own in zip(batch.column("draft_id").to_pylist(), rolls, strict=True):
                fixed = dict(own) if own is not None else {}

                def roller(number: int, step: str, sides: int, fixed=fixed) -> int:
                    # a given roll is brought into the range of its die or options
                    return (fixed[step] - 1) % sides + 1 if step in fixed else seeded(number, step, sides, seed)

                sheet = flow(book, int(draft), roller)
                for c in wanted:
                    columns[c].append(list(sheet[c].items()) if isinstance(sheet[c], dict) else sheet[c])
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], schema.field(c).type) for c in wanted], schema=schema)

    spark = drafts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return drafts.select("draft_id", *(["rolls"] if given else [])).repartition(parts).mapInArrow(run, kept)
