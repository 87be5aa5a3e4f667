"""Queries of dice (D), builders (B), character rules (Q) and rendering (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chargen as C
from folioscope.operators import domain as D
from folioscope.operators import grids as G
from folioscope.operators.render import fit_width, render
from folioscope.plans.base import Rows, query, table

ROLLS = Rows("id int, expr string, a array<int>, b array<int>", [(1, "2d6+1", [3, 4], None), (2, "d20", [17], None), (3, " 3d8 - 2 ", [1, 8, 8], None), (4, "2d6 + 1d8 - 1d4", [6, 6], [2]), (5, "", [], None), (6, "2x6", [], None), (7, "101d6", [], None), (8, "d1", [], None), (9, "5", [], None), (10, "0", [], None)])


@query("D1_dice", f"""SELECT id, CASE WHEN id IN (5) THEN 'empty' WHEN id = 6 THEN 'bad term' WHEN id = 7 THEN 'dice' WHEN id = 8 THEN 'sides' WHEN id = 10 THEN 'nothing to roll' ELSE '' END AS error,
  CAST(CASE id WHEN 1 THEN list_sum(a) + 1 WHEN 2 THEN list_sum(a) WHEN 3 THEN list_sum(a) - 2 WHEN 4 THEN list_sum(a) + list_sum(b) - 3 WHEN 9 THEN 5 ELSE 0 END AS INTEGER) AS total FROM {ROLLS.sql}""")
def dice(spark, d):
    rolls = F.when(F.col("id") == 4, F.array("a", "b", F.array(F.lit(3)))).otherwise(F.array("a"))
    error = D.dice_error(F.col("expr"))
    return ROLLS.df(spark).select("id", F.coalesce(error, F.lit("")).alias("error"), F.when(error.isNull(), D.dice_total(F.col("expr"), rolls)).otherwise(0).alias("total"))


RATINGS = Rows("id int, r string", list(enumerate(["A", " b ", "d8", "6", "E", "20", ""])))


@query("D2_ratings", f"SELECT id, coalesce(CASE upper(trim(r)) WHEN 'A' THEN 12 WHEN 'B' THEN 10 WHEN 'C' THEN 8 WHEN 'D' THEN 6 ELSE CASE WHEN TRY_CAST(regexp_replace(upper(trim(r)), '^D+', '') AS INTEGER) IN (12, 10, 8, 6) THEN TRY_CAST(regexp_replace(upper(trim(r)), '^D+', '') AS INTEGER) END END, 0) AS die FROM {RATINGS.sql}")
def ratings(spark, d):
    return RATINGS.df(spark).select("id", F.coalesce(D.die_of(F.col("r")), F.lit(0)).alias("die"))


@query("D3_successes", "SELECT l_orderkey, l_linenumber, CASE WHEN 1 + l_quantity % 12 >= 10 THEN 2 WHEN 1 + l_quantity % 12 >= 6 THEN 1 ELSE 0 END AS s FROM lineitem")
def successes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.successes(1 + F.col("l_quantity").cast("int") % 12).alias("s"))


_HITS = "list_sum(list_transform(dice, lambda x: CASE WHEN x >= 10 THEN 2 WHEN x >= 6 THEN 1 ELSE 0 END))"


@query("D4_checks", f"""WITH g AS (SELECT l_orderkey, list(CAST(1 + l_quantity % 12 AS INTEGER)) AS dice, list(CAST(1 + l_partkey % 6 AS INTEGER)) AS ammo FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, CAST({_HITS} AS INTEGER) AS successes, CAST(len(list_filter(dice, lambda x: x = 1)) AS INTEGER) AS ones, CAST(len(list_filter(ammo, lambda x: x >= 6)) AS INTEGER) AS ammo_hits,
  CAST(len(list_filter(dice, lambda x: x = 1)) + len(list_filter(ammo, lambda x: x = 1)) AS INTEGER) AS jam_ones, CAST(list_sum(ammo) + 1 AS INTEGER) AS rounds_spent, CAST(CASE WHEN {_HITS} >= 1 THEN {_HITS} + len(list_filter(ammo, lambda x: x >= 6)) ELSE 0 END AS INTEGER) AS total_successes FROM g""")
def checks(spark, d):
    die, ammo = (1 + F.col("l_quantity").cast("int") % 12), (1 + F.col("l_partkey") % 6).cast("int")
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(die).alias("dice"), F.collect_list(ammo).alias("ammo"))
    return groups.select("l_orderkey", D.check(F.col("dice"), F.col("ammo")).alias("c")).select("l_orderkey", "c.*")


_BUILDS_SQL = "(SELECT p_partkey AS build_id, 100 + p_size * 20 AS hull, CASE WHEN p_type = 'SMALL' THEN 0.2 ELSE 0.0 END AS cost_mod, 1 + p_size % 3 AS thrust, 0.02 AS tp, p_size % 2 AS jump, p_size % 2 AS hasj, 10.0 AS pp, 0.5 AS pc, 10 AS bt, p_size % 4 AS rooms FROM part)"


@query("B2_ship_build", f"""WITH a AS (SELECT *, round(hull * tp, 1) AS mt, CASE WHEN hasj = 1 THEN greatest(10.0, round(hull * 0.05, 1) + 5.0) END AS jt, ceil(round(hull * (0.2 + 0.1 * thrust + 0.1 * jump) / pp, 6)) AS pt FROM {_BUILDS_SQL}),
  b AS (SELECT *, round(0.1 * hull * jump + greatest(1, ceil(round(0.1 * pt, 6))), 1) AS fuel FROM a), c AS (SELECT *, round(hull - (mt + coalesce(jt, 0) + pt + fuel + bt + rooms * 4), 1) AS cargo FROM b)
  SELECT build_id, 1 AS ord, 'Hull' AS label, CAST(0.0 AS DOUBLE) AS tons, round(CAST(hull * 0.05 * (1 + cost_mod) AS DOUBLE), 6) AS cost FROM c UNION ALL SELECT build_id, 2, 'M-Drive', CAST(mt AS DOUBLE), round(CAST(mt * 2 AS DOUBLE), 6) FROM c UNION ALL SELECT build_id, 3, 'J-Drive', CAST(jt AS DOUBLE), round(CAST(jt * 1.5 AS DOUBLE), 6) FROM c WHERE jt IS NOT NULL
  UNION ALL SELECT build_id, 4, 'Power Plant', CAST(pt AS DOUBLE), round(CAST(pt * pc AS DOUBLE), 6) FROM c UNION ALL SELECT build_id, 5, 'Bridge', CAST(bt AS DOUBLE), round(CAST(0.5 * hull / 100 AS DOUBLE), 6) FROM c UNION ALL SELECT build_id, 6, 'Fuel', CAST(fuel AS DOUBLE), CAST(0.0 AS DOUBLE) FROM c WHERE fuel > 0
  UNION ALL SELECT build_id, 7, 'Staterooms', CAST(rooms * 4 AS DOUBLE), round(CAST(rooms * 0.5 AS DOUBLE), 6) FROM c WHERE rooms > 0 UNION ALL SELECT build_id, 8, 'Cargo hold', CAST(cargo AS DOUBLE), CAST(0.0 AS DOUBLE) FROM c WHERE cargo > 0.05""")
def ship_build(spark, d):
    odd = F.col("p_size") % 2
    builds = table(spark, d, "part").select(
        F.col("p_partkey").alias("build_id"), (100 + F.col("p_size") * 20).alias("hull"), F.when(F.col("p_type") == "SMALL", 0.2).otherwise(0.0).alias("cost_mod"),
        (1 + F.col("p_size") % 3).alias("thrust"), F.lit(0.02).alias("thrust_pct"), odd.alias("jump"), F.when(odd == 1, 0.05).alias("jump_pct"),
        F.lit(10.0).alias("plant_power"), F.lit(0.5).alias("plant_cost"), F.lit(10).alias("bridge_tons"), (F.col("p_size") % 4).alias("rooms"),
    )
    return D.ship_lines(builds)


CATALOGUE = Rows("kind string, ord int, rows array<array<string>>", [
    ("configs", 1, [["Hull Configuration", "Cost"], ["Standard", "—"], ["Streamlined", "+20%"], ["Dispersed", "-50%"]]),
    ("thrust", 2, [["Rating", "1", "2"], ["% of Hull", "1%", "2%"], ["TL", "9", "10"]]),
    ("plants", 3, [["Power Plant", "Power per Ton", "Cost"], ["Fusion", "10", "MCr0.5"], ["Chemical", "5", "Cr250000"]]),
    ("chassis", 4, [["Size", "Base Slots", "Base Hits", "Cost"], ["1", "1", "1", "Cr100"], ["2", "2", "4", "Cr200"]]),
    ("locomotion", 5, [["Locomotion", "Cost"], ["None", "x 1"], ["Wheels", "x 2"]]),
])


@query("B1_ship_catalogue", "SELECT * FROM (VALUES ('configs', 'Standard', 0.0), ('configs', 'Streamlined', 0.2), ('configs', 'Dispersed', 0.5), ('plants', 'Fusion', 0.5), ('plants', 'Chemical', 0.25), ('thrust', '1', 0.01), ('thrust', '2', 0.02)) v(kind, name, value)")
def ship_catalogue(spark, d):
    cat = CATALOGUE.df(spark)
    data = cat.filter("kind IN ('configs', 'plants')").select("kind", F.get("rows", F.lit(0)).alias("h"), F.explode(F.slice("rows", 2, 100)).alias("r"))
    cost = F.get("r", G.column_of(F.col("h"), "cost"))
    named = data.select("kind", F.get("r", F.lit(0)).alias("name"), F.when(F.col("kind") == "configs", T.percent(cost)).otherwise(T.money_millions(cost)).alias("value"))
    steps = cat.filter("kind = 'thrust'").select(F.inline(G.named_rows(F.col("rows")))).filter("label LIKE '%Hull%'")
    return named.unionByName(steps.select(F.lit("thrust").alias("kind"), F.col("rating").alias("name"), T.percent(F.col("value")).alias("value")))


@query("B3_robots", "SELECT * FROM (VALUES (1, 'None', 100), (1, 'Wheels', 200), (2, 'None', 200), (2, 'Wheels', 400)) v(size, locomotion, base_cost)")
def robots(spark, d):
    def data(kind):
        return CATALOGUE.df(spark).filter(F.col("kind") == kind).select(F.explode(F.slice("rows", 2, 100)).alias("r"))

    chassis = data("chassis").select(F.get("r", F.lit(0)).cast("int").alias("size"), (T.money_millions(F.get("r", F.lit(3))) * 1_000_000).alias("cost"))
    moves = data("locomotion").select(F.get("r", F.lit(0)).alias("locomotion"), F.regexp_extract(F.get("r", F.lit(1)), r"x\s*([0-9.]+)", 1).try_cast("double").alias("mult"))
    return chassis.crossJoin(moves).select("size", "locomotion", F.round(F.col("cost") * F.col("mult")).cast("int").alias("base_cost"))


ARMOR = Rows("id int, row array<string>", [(1, ["Vest, Light Vest, Heavy", "+3 +5", "6 7"]), (2, ["Shield", "+1", "1"])])


@query("B4_armour", "SELECT * FROM (VALUES (1, 'Vest', 'Vest, Light', 3), (1, 'Vest', 'Vest, Heavy', 5), (2, 'Shield', 'Shield', 1)) v(id, family, suit, protection)")
def armour(spark, d):
    rows = ARMOR.df(spark).select("id", F.explode(G.grade_rows(F.col("row"), 1, 0)).alias("r"))
    return rows.select("id", T.base_name(F.get("r", F.lit(0))).alias("family"), F.get("r", F.lit(0)).alias("suit"), T.first_int(F.regexp_replace(F.get("r", F.lit(1)), r"\+", "")).alias("protection"))


@query("B5_feasible_choices", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS used, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) <= 100 AS fits FROM lineitem")
def feasible_choices(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("build_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("step"), F.col("l_quantity").alias("slots"), F.lit(100.0).alias("budget"))
    return D.feasible(rows).select(F.col("build_id").alias("l_orderkey"), F.col("step.l_linenumber").alias("l_linenumber"), "used", "fits")


CAREERS = Rows("career string, requirement string", [("Agent", "INT B+, no D attribute"), ("Officer", "STR or AGL B+, At least one term in Combat Arms"), ("Doctor", "Two terms in Education (Sciences), EMP C or D"), ("Monk", "no terms in prison, odd words"), ("Bum", "–"), ("Vet", "one term in military")])


@query("Q1_requirements", "SELECT * FROM (VALUES ('Agent', 0, 'reaches', 'B', 0, ''), ('Agent', 1, 'lacks', 'D', 0, ''), ('Officer', 0, 'reaches', 'B', 0, ''), ('Officer', 1, 'terms', '', 1, 'combat arms'), ('Doctor', 0, 'terms', '', 2, 'education (sciences)'), ('Doctor', 1, 'among', 'CD', 0, ''), ('Monk', 0, 'terms', '', 0, 'prison'), ('Monk', 1, 'advisory', '', 0, ''), ('Vet', 0, 'terms', '', 1, 'military')) v(career, ord, kind, level, need, target)")
def requirements(spark, d):
    return D.requirement_clauses(CAREERS.df(spark)).select("career", "ord", "kind", "level", "need", "target")


@query("Q2_eligibility", """SELECT * FROM (VALUES (1, 'Agent', true, ''), (1, 'Officer', true, ''), (1, 'Doctor', false, 'Two terms in Education (Sciences)'), (1, 'Monk', true, ''), (1, 'Vet', true, ''),
  (2, 'Agent', false, 'INT B+|no D attribute'), (2, 'Officer', false, 'STR or AGL B+|At least one term in Combat Arms'), (2, 'Doctor', true, ''), (2, 'Monk', false, 'no terms in prison'), (2, 'Vet', false, 'one term in military')) v(draft_id, career, eligible, unmet)""")
def eligibility(spark, d):
    drafts = spark.createDataFrame(
        [(1, {"STR": "B", "INT": "A"}, [("Combat Arms", True)]), (2, {"STR": "D"}, [("Sciences", False), ("Sciences", False), ("Prison", False)])],
        "draft_id int, attrs map<string,string>, history array<struct<name:string,military:boolean>>",
    )
    out = D.eligibility(drafts, D.requirement_clauses(CAREERS.df(spark)))
    return out.withColumn("unmet", F.array_join("unmet", "|"))


@query("Q3_ladder", "SELECT p_partkey, (['D','C','B','A'])[least(4, 1 + p_size % 4 + 1)] AS up, (['D','C','B','A'])[greatest(1, 1 + p_size % 4 - 1)] AS down FROM part")
def ladder(spark, d):
    level = F.element_at(F.array(*map(F.lit, D.LADDER)), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", D.step(level, 1).alias("up"), D.step(level, -1).alias("down"))


@query("Q4_derived_stats", "SELECT p_partkey, CAST(ceil((6 + 2 * (p_size % 4) + 6 + 2 * (p_partkey % 4)) / 4.0) AS BIGINT) AS hit FROM part")
def derived_stats(spark, d):
    a, b = 6 + 2 * (F.col("p_size") % 4), 6 + 2 * (F.col("p_partkey") % 4)
    return table(spark, d, "part").select("p_partkey", D.derived(a, b).alias("hit"))


def _book(spark) -> C.Book:
    """A small book of careers, childhoods, archetypes and ranks."""
    careers = [
        C.Career("Combat Arms", "STR or AGL C+", True, "Private", ["Ranged Combat", "Heavy Weapons", "Close Combat", "Driving"], ["Rifleman", "Gunner", "Ranger"], ["Rifle"]),
        C.Career("Officer", "INT B+, At least one term in military", True, "Second Lieutenant", ["Ranged Combat", "Command", "Persuasion"], ["Leader", "Planner"], ["Pistol", "Map"]),
        C.Career("Sciences", "INT C+", False, "", ["Tech", "Medical Aid", "Survival"], ["Physicist", "Chemist"], ["Notebook"]),
        C.Career("Doctor", "Two terms in Education (Sciences)", False, "", ["Medical Aid", "Persuasion"], ["Surgeon"], ["Bag"]),
        C.Career("Prison", "", False, "", ["Close Combat", "Mobility"], ["Brawler"], ["Knife"]),
    ]
    childhoods = {"City": (["Tech", "Persuasion"], {1: "Reader", 2: "Runner", 3: "Reader", 4: "Hacker", 5: "Runner"}), "Farm": (["Survival", "Driving"], {k: "Farmer" for k in range(1, 7)})}
    archetypes = [C.Archetype("The Grunt", "STR", ["Ranged Combat", "Close Combat"], ["Rifleman", "Gunner"], "B"), C.Archetype("The Medic", "EMP", ["Medical Aid"], ["Surgeon"], "C")]
    ranks = [{"us": "Private", "soviet": "Ryadovoi"}, {"us": "Corporal", "soviet": "Yefreitor"}, {"us": "Second Lieutenant", "soviet": "Leitenant"}, {"us": "Captain", "soviet": ""}]
    return C.Book(careers, archetypes, childhoods, ranks).with_clauses(spark)


def _drafts(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("draft_id"))


def _roll_sql(step: str, sides: int) -> str:
    """SQL of the seeded roll of a step."""
    return f"(1 + CAST('0x' || left(md5(c_custkey || '|' || {step}), 7) AS BIGINT) % {sides})"


_TERMS_SQL = f"""(SELECT c_custkey, coalesce(min(t) FILTER (WHERE t > 1 AND {_roll_sql("'war_' || t", 8)} < t), {C.MOST_TERMS}) AS terms, coalesce(bool_or(t > 1 AND {_roll_sql("'war_' || t", 8)} < t), false) AS war FROM customer, range(1, {C.MOST_TERMS + 1}) r(t) GROUP BY c_custkey)"""


@query("Q5_life_paths", f"""SELECT c_custkey AS draft_id, ['us','soviet','polish','swedish','other'][{_roll_sql("'nationality'", 5)}] AS nation, ['City','Farm'][{_roll_sql("'childhood'", 2)}] AS childhood, CAST(terms AS INTEGER) AS terms, war,
  CAST({C.START_AGE} + (SELECT sum({_roll_sql("'age_' || t", 6)}) FROM range(1, {C.MOST_TERMS + 1}) r(t) WHERE t <= terms) AS INTEGER) AS age FROM {_TERMS_SQL}""")
def life_paths(spark, d):
    return C.characters(_drafts(spark, d), _book(spark)).select("draft_id", "nation", "childhood", "terms", "war", "age")


@query("Q5_given_rolls", "SELECT c_custkey AS draft_id, CAST(2 + c_custkey % 5 AS INTEGER) AS terms, CAST(18 + 3 * (2 + c_custkey % 5) AS INTEGER) AS age, true AS war FROM customer")
def given_rolls(spark, d):
    """Rolls as a column: years of three, and war in a term that the draft's number gives."""
    last = F.col("draft_id") % 5 + 2
    terms = F.sequence(F.lit(1), F.lit(C.MOST_TERMS))
    years = F.transform(terms, lambda t: F.struct(F.concat(F.lit("age_"), t.cast("string")).alias("key"), F.lit(3).alias("value")))
    wars = F.transform(terms, lambda t: F.struct(F.concat(F.lit("war_"), t.cast("string")).alias("key"), F.when(t == last, 1).otherwise(8).alias("value")))
    rolls = F.map_from_entries(F.concat(years, wars))
    return C.characters(_drafts(spark, d).withColumn("rolls", rolls), _book(spark)).select("draft_id", "terms", "age", "war")


@query("Q6_archetypes", f"""SELECT c_custkey AS draft_id, ['The Grunt','The Medic'][a] AS template, ['us','soviet','polish','swedish','other'][{_roll_sql("'nationality'", 5)}] AS nation,
  CASE a WHEN 1 THEN ['Ranged Combat','Close Combat'][{_roll_sql("'archetype_b_skill'", 2)}] ELSE 'Medical Aid' END AS best, CASE a WHEN 1 THEN ['Rifleman','Gunner'][{_roll_sql("'archetype_spec'", 2)}] ELSE 'Surgeon' END AS specialty,
  CASE a WHEN 1 THEN 'B' ELSE 'C' END AS cuf, 6 AS skills, 3 AS raised FROM (SELECT *, {_roll_sql("'archetype'", 2)} AS a FROM customer)""")
def archetypes(spark, d):
    rows = C.characters(_drafts(spark, d), _book(spark), C.archetype)
    above = F.aggregate(F.map_values("attributes"), F.lit(0), lambda n, x: n + F.array_position(F.array(*map(F.lit, D.LADDER)), x).cast("int") - 2)
    best = F.get(F.map_keys(F.map_filter("skills", lambda k, v: v == "B")), F.lit(0))
    return rows.select("draft_id", "template", "nation", best.alias("best"), F.get("specialties", F.lit(0)).alias("specialty"), "cuf", F.size("skills").alias("skills"), above.alias("raised"))


def replay(events):
    """session, choices: what is left of each session's steps (session, seq, choice; a null choice goes one step back).

    A session is the fold of its log, so going back drops the last recorded
    result and nothing is computed twice.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "choice")))
    empty = F.array().cast("array<string>")

    def step(acc, e):
        back = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(e["choice"].isNull(), back).otherwise(F.concat(acc, F.array(e["choice"])))

    return events.groupBy("session").agg(log.alias("log")).select("session", F.aggregate("log", empty, step).alias("choices"))


@query("Q7_replay", """WITH RECURSIVE e AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CASE WHEN o_orderstatus <> 'P' THEN left(o_orderpriority, 1) END AS c FROM orders),
  f AS (SELECT session, i, CASE WHEN c IS NULL THEN CAST([] AS VARCHAR[]) ELSE [c] END AS s FROM e WHERE i = 1 UNION ALL SELECT e.session, e.i, CASE WHEN e.c IS NULL THEN CASE WHEN len(f.s) > 0 THEN f.s[1:len(f.s) - 1] ELSE f.s END ELSE list_append(f.s, e.c) END FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1)
  SELECT session, coalesce(array_to_string(s, ''), '') AS choices FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i DESC) AS r FROM f) WHERE r = 1""")
def replay_sessions(spark, d):
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") != "P", F.left("o_orderpriority", F.lit(1))).alias("choice"))
    return replay(events).withColumn("choices", F.array_join("choices", ""))


# ------------------------------------------------------------------ V
@query("V1_fit_widths", "SELECT grid, (SELECT max(w) FROM range(3, 61) t(w) WHERE (SELECT sum(least(x, w)) FROM (SELECT unnest(nat) AS x)) <= 100) AS cap FROM (SELECT p_partkey // 8 AS grid, list(p_size) AS nat FROM part GROUP BY grid)")
def fit_widths(spark, d):
    # eight neighbouring parts stand for the columns of a grid, their sizes for natural widths
    rows = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("grid")).agg(F.collect_list("p_size").alias("nat"))
    return rows.select("grid", fit_width(F.col("nat"), F.lit(100)).cast("long").alias("cap"))


RENDERED = Rows("id int, rows array<array<string>>, want string", [
    (1, [["D6", "Result"], ["1", "Fall"], ["2", "Stand"]], "D6 | Result\n---+-------\n1  | Fall\n2  | Stand"),
    (2, [["Name", "Cost", "A long description column"], ["Rope", "5", "twenty metres of rather good hemp rope"]], "Name: Rope\nCost: 5\nA long description column: twenty metres of rather good hemp rope"),
    (3, [["Only header"]], "Only header\n-----------"),
])


@query("V2_render_table", f"SELECT id, want AS text FROM {RENDERED.sql}")
def render_table(spark, d):
    return RENDERED.df(spark).select("id", render(F.col("rows")).alias("text"))


@query("V3_stat_card", "SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Size: ' || p_size AS card FROM part")
def stat_card(spark, d):
    rows = F.array(F.array(F.lit("Name"), F.lit("Brand"), F.lit("Size")), F.array("p_name", "p_brand", F.col("p_size").cast("string")))
    pairs = F.transform(G.item_pairs(rows, F.lit(1)), lambda p: F.concat(p["label"], F.lit(": "), p["value"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, "\n").alias("card"))


@query("V4_sheet", "SELECT c_custkey, '**' || c_name || '** (' || lower(c_mktsegment) || ')' AS sheet FROM customer")
def sheet(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.format_string("**%s** (%s)", "c_name", F.lower("c_mktsegment")).alias("sheet"))
