"""Dice, checks, construction budgets and requirement rules over columns.

Rolls are data: operators never draw random numbers unless a seed is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Rules of play (fixed values).
MAX_DICE, MAX_SIDES, MAX_AMMO = 100, 1000, 50
RATINGS = {"A": 12, "B": 10, "C": 8, "D": 6}
LADDER = ["D", "C", "B", "A"]
ATTRIBUTES = ["STR", "AGL", "INT", "EMP"]
EDUCATION = ["liberal arts", "sciences"]
COUNTS = {"no": 0, "at least one": 1, "one or more": 1, "one": 1, "a": 1, "two": 2, "three": 3}
HULL_MCR, MDRIVE_MCR, JDRIVE_MCR, JDRIVE_LEAST, JDRIVE_EXTRA = 0.05, 2.0, 1.5, 10.0, 5.0
BASIC_POWER, DRIVE_POWER, BRIDGE_MCR, ROOM_TONS, ROOM_MCR, JUMP_FUEL, PLANT_FUEL = 0.20, 0.10, 0.5, 4, 0.5, 0.10, 0.10


def dice_terms(expr: Column) -> Column:
    """Terms (sign, count, sides, flat) of an expression such as 2d6+1; sides is null for flat numbers."""
    s = F.regexp_replace(expr, r"\s+", "")
    s = F.when(s.rlike("^[+-]"), s).otherwise(F.concat(F.lit("+"), s))
    parts = F.regexp_extract_all(s, F.lit("([+-])([^+-]+)"), F.lit(0))

    def term(p: Column) -> Column:
        body = F.substring(p, 2, 1 << 20)
        count, sides = F.regexp_extract(body, r"^(\d*)[dD](\d+)$", 1), F.regexp_extract(body, r"^(\d*)[dD](\d+)$", 2)
        return F.struct(
            F.when(p.startswith("+"), 1).otherwise(-1).alias("sign"),
            F.when(sides != "", F.coalesce(count.try_cast("int"), F.lit(1))).alias("count"),
            sides.try_cast("int").alias("sides"),
            F.when(body.rlike(r"^\d+$"), body.try_cast("int")).alias("flat"),
        )

    return F.transform(parts, term)


def dice_error(expr: Column) -> Column:
    """Why an expression cannot be rolled; null if it can."""
    s = F.regexp_replace(expr, r"\s+", "")
    terms = dice_terms(expr)
    dice = F.filter(terms, lambda t: t["sides"].isNotNull())
    return (
        F.when(s == "", "empty")
        .when(~F.concat(F.when(s.rlike("^[+-]"), "").otherwise("+"), s).rlike("^([+-][^+-]+)+$"), "unparsable")
        .when(F.exists(terms, lambda t: t["sides"].isNull() & t["flat"].isNull()), "bad term")
        .when(F.exists(dice, lambda t: (t["count"] < 1) | (t["count"] > MAX_DICE)), "dice")
        .when(F.exists(dice, lambda t: (t["sides"] < 2) | (t["sides"] > MAX_SIDES)), "sides")
        .when((F.size(dice) == 0) & (F.aggregate(terms, F.lit(0), lambda a, t: a + t["sign"] * F.coalesce(t["flat"], F.lit(0))) == 0), "nothing to roll")
    )


def dice_total(expr: Column, rolls: Column) -> Column:
    """Total of an expression for given rolls, one array per dice term."""
    terms = dice_terms(expr)
    flat = F.aggregate(terms, F.lit(0), lambda a, t: a + t["sign"] * F.coalesce(t["flat"], F.lit(0)))
    dice = F.filter(terms, lambda t: t["sides"].isNotNull())
    signed = F.zip_with(dice, rolls, lambda t, r: t["sign"] * F.aggregate(F.coalesce(r, F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x))
    return flat + F.aggregate(signed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def die_of(rating: Column) -> Column:
    """Die size of a letter rating or of a raw size (d8, 8); null if it is neither."""
    key = F.upper(T.trim_all(rating))
    size = F.regexp_replace(key, "^D+", "").try_cast("int")
    known = F.create_map(*(F.lit(x) for pair in RATINGS.items() for x in pair))
    return F.coalesce(known[key], F.when(size.isin(*RATINGS.values()), size))


def successes(value: Column) -> Column:
    return F.when(value >= 10, 2).when(value >= 6, 1).otherwise(0)


def check(dice: Column, ammo: Column) -> Column:
    """Struct of a check's outcomes from its die values and ammo dice (null or empty: none)."""
    count = lambda a, good: F.size(F.filter(F.coalesce(a, F.array().cast("array<int>")), good))
    hits = F.aggregate(dice, F.lit(0), lambda a, x: a + successes(x))
    extra, ones = count(ammo, lambda x: x >= 6), count(dice, lambda x: x == 1)
    spent = F.when(F.size(F.coalesce(ammo, F.array().cast("array<int>"))) > 0, F.aggregate(ammo, F.lit(0), lambda a, x: a + x) + 1).otherwise(0)
    return F.struct(
        hits.alias("successes"), ones.alias("ones"), extra.alias("ammo_hits"), (ones + count(ammo, lambda x: x == 1)).alias("jam_ones"), spent.alias("rounds_spent"),
        F.when(hits >= 1, hits + extra).otherwise(0).alias("total_successes"),
    )


def step(level: Column, by: int, ladder: list[str] = LADDER) -> Column:
    """The level so many steps up the ladder, stopped at its ends."""
    steps = F.array(*map(F.lit, ladder))
    at = F.array_position(steps, level).cast("int") + by
    return F.element_at(steps, F.greatest(F.lit(1), F.least(F.lit(len(ladder)), at)))


def derived(*dice: Column) -> Column:
    """A quarter of two die sizes, rounded up."""
    return F.ceil(sum(dice[1:], dice[0]) / 4)


def round1(x: Column) -> Column:
    """To one decimal, half to even on the decimal value."""
    return F.bround(x, 1)


def ship_lines(builds: DataFrame) -> DataFrame:
    """build_id, ord, label, tons, cost of every component.

    builds: build_id, hull, cost_mod, thrust, thrust_pct, jump, jump_pct,
    plant_power, plant_cost, bridge_tons, rooms. A null percentage or plant
    leaves its component out; the cargo hold takes the tonnage that is left.
    """
    b = builds
    mt, jt = round1(F.col("hull") * F.col("thrust_pct")), F.greatest(F.lit(JDRIVE_LEAST), round1(F.col("hull") * F.col("jump_pct")) + JDRIVE_EXTRA)
    need = F.col("hull") * (BASIC_POWER + DRIVE_POWER * F.col("thrust") + DRIVE_POWER * F.col("jump"))
    # a millionth keeps a need that is whole on paper from rounding up
    b = b.withColumn("mt", mt).withColumn("jt", F.when(F.col("jump_pct").isNotNull(), jt)).withColumn("pt", F.ceil(need / F.col("plant_power") - 1e-6).cast("double"))
    fuel = JUMP_FUEL * F.col("hull") * F.col("jump") + F.when(F.col("pt").isNotNull(), F.greatest(F.lit(1.0), F.ceil(PLANT_FUEL * F.col("pt") - 1e-6).cast("double"))).otherwise(0.0)
    b = b.withColumn("fuel", F.round(fuel, 1))
    used = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("mt", "jt", "pt", "fuel")), F.col("bridge_tons") + F.col("rooms") * ROOM_TONS)
    b = b.withColumn("cargo", F.round(F.col("hull") - used, 1))

    def line(i: int, label: str, tons: Column, cost: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), tons.cast("double").alias("tons"), F.round(cost.cast("double"), 6).alias("cost")))

    zero = F.lit(0.0)
    lines = F.array(
        line(1, "Hull", zero, F.col("hull") * HULL_MCR * (1 + F.col("cost_mod")), F.lit(True)),
        line(2, "M-Drive", F.col("mt"), F.col("mt") * MDRIVE_MCR, F.col("mt").isNotNull()),
        line(3, "J-Drive", F.col("jt"), F.col("jt") * JDRIVE_MCR, F.col("jt").isNotNull()),
        line(4, "Power Plant", F.col("pt"), F.col("pt") * F.col("plant_cost"), F.col("pt").isNotNull()),
        line(5, "Bridge", F.col("bridge_tons"), BRIDGE_MCR * F.col("hull") / 100, F.lit(True)),
        line(6, "Fuel", F.col("fuel"), zero, F.col("fuel") > 0),
        line(7, "Staterooms", F.col("rooms") * ROOM_TONS, F.col("rooms") * ROOM_MCR, F.col("rooms") > 0),
        line(8, "Cargo hold", F.col("cargo"), zero, F.col("cargo") > 0.05),
    )
    return b.select("build_id", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("build_id", "l.*")


def feasible(choices: DataFrame) -> DataFrame:
    """Choices (build_id, step, slots, budget) with whether the budget still holds after each, in order."""
    so_far = F.sum("slots").over(Window.partitionBy("build_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return choices.withColumn("used", so_far).withColumn("fits", F.col("used") <= F.col("budget"))


def requirement_clauses(careers: DataFrame) -> DataFrame:
    """career, ord, text, kind, attrs, level, need, any_of, target of every clause (career, requirement).

    Kinds: lacks (no attribute at the level), among (one of two levels),
    reaches (a threshold, with and / or), terms (a number of terms served), and
    advisory for what cannot be read, which never blocks.
    """
    blank = F.lower(T.trim_all(F.coalesce("requirement", F.lit("")))).isin("", "none", "–", "-", "—", "n/a")
    rows = careers.filter(~blank).select("career", F.posexplode(F.split("requirement", ",")).alias("ord", "raw")).withColumn("text", T.trim_all(F.col("raw"))).filter("text <> ''")
    low = F.lower("text")
    names = F.transform(F.regexp_extract_all(low, F.lit(r"\b(str|agl|int|emp)\b"), F.lit(1)), F.upper)
    among, reaches = r"^(str|agl|int|emp)\s+([abcd])\s+or\s+([abcd])$", r"^[a-z]{3}(?:\s+(?:and|or)\s+[a-z]{3})*\s+([abcd])\+$"
    terms = r"^(no|at least one|one or more|two|three|one|a)\s+terms?\s+(?:in|as)\s+(.+)$"
    kind = F.when(low.rlike(r"^no\s+[abcd]\s+attribute"), "lacks").when(low.rlike(among), "among").when(low.rlike(reaches) & (F.size(names) > 0), "reaches").when(low.rlike(terms), "terms").otherwise("advisory")
    count = F.create_map(*(F.lit(x) for pair in COUNTS.items() for x in pair))
    level = (
        F.when(kind == "lacks", F.upper(F.regexp_extract(low, r"^no\s+([abcd])", 1)))
        .when(kind == "among", F.upper(F.concat(F.regexp_extract(low, among, 2), F.regexp_extract(low, among, 3))))
        .when(kind == "reaches", F.upper(F.regexp_extract(low, reaches, 1)))
        .otherwise("")
    )
    return rows.select(
        "career", "ord", "text", kind.alias("kind"), names.alias("attrs"), level.alias("level"),
        F.coalesce(count[F.regexp_extract(low, terms, 1)], F.lit(0)).alias("need"), low.contains(" or ").alias("any_of"),
        F.regexp_replace(T.trim_all(F.regexp_extract(low, terms, 2)), r"^(the|an?)\s+", "").alias("target"),
    )


def eligibility(drafts: DataFrame, clauses: DataFrame) -> DataFrame:
    """draft_id, career, eligible, unmet texts.

    drafts: draft_id, attrs (map, C where missing), history (array of struct name,
    military). Clauses are a rule book of bounded size and meet every draft.
    """
    level_of = lambda a: F.coalesce(F.col("attrs")[a], F.lit("C"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, LADDER)), x)
    all_attrs = F.array(*map(F.lit, ATTRIBUTES))
    hits = F.transform("names", lambda a: rank(level_of(a)) >= rank(F.col("level")))
    edu = F.regexp_extract("target", r"^education(?:\s*\((.+)\))?$", 1)
    is_edu = F.col("target").rlike(r"^education(\s*\(.+\))?$")

    def served(h: Column) -> Column:
        name = F.lower(h["name"])
        return (
            F.when(F.col("target") == "military", h["military"])
            .when(is_edu & ~edu.isin("", "any"), name == edu)
            .when(is_edu, name.isin(EDUCATION))
            .otherwise((name == F.col("target")) | F.startswith(name, F.col("target")))
        )

    terms = F.size(F.filter("history", served))
    met = (
        F.when(F.col("kind") == "lacks", F.forall(all_attrs, lambda a: level_of(a) != F.col("level")))
        .when(F.col("kind") == "among", F.contains(F.col("level"), level_of(F.get("names", F.lit(0)))))
        .when(F.col("kind") == "reaches", F.when(F.col("any_of"), F.exists(hits, lambda x: x)).otherwise(F.forall(hits, lambda x: x)))
        .when(F.col("kind") == "terms", F.when(F.col("need") == 0, terms == 0).otherwise(terms >= F.col("need")))
        .otherwise(True)
    )
    met_rows = drafts.crossJoin(clauses.withColumnRenamed("attrs", "names")).withColumn("met", met)
    unmet = F.array_sort(F.collect_list(F.when(~F.col("met"), F.struct("ord", "text"))))
    return met_rows.groupBy("draft_id", "career").agg(F.bool_and("met").alias("eligible"), F.transform(unmet, lambda x: x["text"]).alias("unmet"))
