"""Queries of classification (P) and grid algebra (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import classify as P
from folioscope.operators import grids as G
from folioscope.plans.base import Rows, query, table

# Literal grids with the answer that is known for each.
GRIDS = Rows("id int, chapter string, rows array<array<string>>, want string", [
    (1, "", [["WEAPON", "DAMAGE", "RANGE", "COST"], ["Stick", "1", "2", "5"], ["Long Stick", "2", "3", "9"]], "items"),
    (2, "", [["VEHICLE", "ARMOR", "SPEED", "COST"], ["Cart", "1", "20", "50"], ["Wagon", "2", "15", "90"]], "transport"),
    (3, "", [["D6", "Result"], ["1", "Fall"], ["2", "Stand"]], "rules"),
    (4, "", [["Hull", "10 tons", "—", "1"], ["M-Drive", "Thrust 1", "1", "2"], ["Power Plant", "Fuse", "1", "1"], ["Bridge", "", "2", "1"]], "transport"),
    (5, "", [["CAREER", "Baker", "EMT"], ["SKILLS", "Heat", "Aid"], ["GEAR", "Pan", "Bag"]], "card"),
    (6, "", [["7", "8"], ["a", "b"]], "noise"),
    (7, "", [["TYPE", "ROF", "AMMO"], ["Gun", "2", "9mm"], ["Rifle", "3", "5mm"]], "items"),
    (8, "", [["ARMOR", "AC", "BULK"], ["Suit", "2", "1"], ["Coat", "1", "1"]], "items"),
    (9, "", [["SHIELD", "HARDNESS", "HP"], ["Buckler", "3", "6"], ["Tower", "5", "20"]], "items"),
    (10, "", [["NAME", "FUEL", "SPEED"], ["Bike", "5", "90"], ["Boat", "9", "20"]], "transport"),
    (11, "Player Characters", [["A", "B", "C", "D", "E"], ["1", "2", "3", "4", "5"], ["1", "2", "3", "4", "5"]], "card"),
    (12, "EQUIPMENT", [["Thing", "Note"], ["Rope", "long"], ["Lamp", "bright"]], "items"),
    (13, "VEHICLES", [["Thing", "Note"], ["Rope", "long"], ["Lamp", "bright"]], "transport"),
    (14, "", [["PROFESSOR", "Note"], ["Rope", "long"], ["Lamp", "bright"]], "rules"),
    (15, "", [["Agility", "1"], ["Speed (cruise)", "High"], ["Passengers", "3"], ["Crew", "1"], ["Cost", "9"]], "transport"),
    (16, "", [["CALIBER", "WEIGHT"], ["9mm", "1"], ["5mm", "2"]], "items"),
    (17, "", [["KEY ATTRIBUTE", "X"], ["STR", "1"], ["AGL", "2"]], "card"),
])


def _expected(column: str = "want") -> str:
    return f"SELECT id, {column} AS out FROM {GRIDS.sql}"


#: Words that headers are drawn from, and chapters; a part's key, size and line choose among them.
_HEADER = ["NAME", "WEAPON", "DAMAGE", "RANGE", "ROF", "AMMO", "REL", "CRIT", "BLAST", "CALIBER", "WEIGHT", "PRICE", "ARMOR", "ARMOUR", "LOCATION", "AC", "BULK", "DEX", "PROTECTION", "TL", "SHIELD", "HARDNESS", "FUEL", "SPEED", "VEHICLE", "COMBAT SPEED", "Career path", "Last Career", "SPECIALTY (D6)", "KEY ATTRIBUTE", "ATTRIBUTE", "Roll", "2d6", "D6", "7", "Professor", "x-rel y", "12"]
_CHAPTERS = ["", "EQUIPMENT", "Vehicles", "Player Characters", "Combat"]
_GRID_SQL = "(SELECT p_partkey AS id, " + f"[{', '.join(map(repr, _CHAPTERS))}][p_partkey % 5 + 1] AS chapter, [{', '.join(map(repr, _HEADER))}] AS w FROM part)"
_TOP_SQL = f"(SELECT id, chapter, list_transform(range(0, CAST(id % 4 + 2 AS BIGINT)), lambda i: w[(id * (2 * i + 3) + i * 7) % {len(_HEADER)} + 1]) AS top, id // 7 % 4 AS more FROM {_GRID_SQL})"


def _word_sql(*words: str) -> str:
    return " AND ".join(f"regexp_matches(h, '\\b({w})\\b')" for w in words)


@query("P4_classify_table", f"""SELECT id, CASE
  WHEN len(list_filter(top, lambda c: regexp_matches(c, '[A-Za-z]'))) < 2 AND 1 + more < 3 THEN 'noise'
  WHEN regexp_matches(trim(top[1]), '(?i)^(roll\\b|\\d*d\\d)') THEN 'rules'
  WHEN h LIKE 'CAREER%' OR ({_word_sql('LAST', 'CAREER')}) OR contains(h, 'SPECIALTY (D6)') OR contains(h, 'KEY ATTRIBUTE') THEN 'card'
  WHEN {_word_sql('VEHICLE')} OR contains(h, 'COMBAT SPEED') THEN 'transport'
  WHEN {_word_sql('ROF')} OR ({_word_sql('AMMO', 'REL')}) OR ({_word_sql('DAMAGE', 'CRIT', 'BLAST')}) OR ({_word_sql('CALIBER', 'WEIGHT|PRICE')}) OR ({_word_sql('ARMOU?R', 'LOCATION')}) OR ({_word_sql('ARMOU?R', 'AC', 'BULK|DEX|PRICE')}) OR ({_word_sql('ARMOU?R', 'PROTECTION', 'TL')}) OR ({_word_sql('SHIELD', 'HARDNESS')}) OR ({_word_sql('WEAPON', 'DAMAGE|REL')}) THEN 'items'
  WHEN {_word_sql('FUEL', 'ARMOU?R|SPEED')} THEN 'transport'
  WHEN upper(chapter) LIKE '%PLAYER CHARACTERS%' AND len(top) >= 5 AND NOT ({' OR '.join(f"contains(h, '{m}')" for m in P.CARD_MARKERS)}) THEN 'card'
  WHEN upper(chapter) = 'EQUIPMENT' THEN 'items' WHEN upper(chapter) = 'VEHICLES' THEN 'transport' ELSE 'rules' END AS out
  FROM (SELECT *, upper(array_to_string(top, ' ')) AS h FROM {_TOP_SQL}) UNION ALL {_expected('want')}""")
def classify_table(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    words, chapters = F.array(*map(F.lit, _HEADER)), F.array(*map(F.lit, _CHAPTERS))
    top = F.transform(F.sequence(F.lit(0).cast("long"), F.col("id") % 4 + 1), lambda i: F.get(words, ((F.col("id") * (2 * i + 3) + i * 7) % len(_HEADER)).cast("int")))
    body = F.transform(F.sequence(F.lit(1).cast("long"), F.floor(F.col("id") / 7) % 4 + 1), lambda i: F.array(F.concat(F.lit("row "), i.cast("string")), F.lit("x")))
    rows = F.concat(F.array(top), F.slice(body, F.lit(2), F.size(body) - 1))
    drawn = part.select("id", F.get(chapters, (F.col("id") % 5).cast("int")).alias("chapter"), rows.alias("rows"))
    both = drawn.unionByName(GRIDS.df(spark).select(F.col("id").cast("long").alias("id"), "chapter", "rows"))
    return both.select("id", P.table_class(F.col("chapter"), F.col("rows"), ["EQUIPMENT"], ["VEHICLES"]).alias("out"))


_COL0 = "list_filter(list_transform(rows, lambda r: lower(trim(coalesce(r[1], '')))), lambda c: c <> '')"
_SHIP = "[" + ", ".join(repr(x) for x in G.SHIP_PARTS) + "]"
_VEH = "[" + ", ".join(repr(x) for x in G.VEHICLE_PARTS) + "]"
_VEHM = "[" + ", ".join(repr(x) for x in G.VEHICLE_MARKERS) + "]"


@query("P5_stat_blocks", f"SELECT id, len(c) >= 4 AND len(list_filter(c, lambda x: list_contains({_SHIP}, x))) >= greatest(3, len(c) // 2) AS ship, len(c) >= 4 AND len(list_filter(c, lambda x: list_contains({_VEHM}, x))) >= 2 AND len(list_filter(c, lambda x: list_contains({_VEH}, x))) >= greatest(4, len(c) // 2) AS vehicle FROM (SELECT id, {_COL0} AS c FROM {GRIDS.sql})")
def stat_blocks(spark, d):
    return GRIDS.df(spark).select("id", G.is_ship_block(F.col("rows")).alias("ship"), G.is_vehicle_block(F.col("rows")).alias("vehicle"))


SPARSE = Rows("id int, rows array<array<string>>", [(1, [["", "", "7", ""], ["", "3", "", ""], ["", "", "", "9"], ["1", "", "", ""]]), (2, [["1", "2"], ["3", "4"]]), (3, [["Name", ""], ["Rope", ""], ["Lamp", ""], ["Wire", ""]]), (4, [["a", "b"], ["c"]])])


@query("P6_real_table", rf"SELECT id, len(f) >= 4 AND NOT (1 - len(f) / len(c) > 0.35 AND len(list_filter(f, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3)) / len(f) < 0.25) AS real FROM (SELECT id, flatten(rows) AS c, list_filter(flatten(rows), lambda x: trim(x) <> '') AS f FROM {SPARSE.sql})")
def real_table(spark, d):
    return SPARSE.df(spark).select("id", G.is_real(F.col("rows")).alias("real"))


# P1-P3
_ALT = lambda words: "(" + "|".join(words) + ")"
HEADINGS = Rows("id int, book string, chapter string, section string", [(1, "Core", "Combat", "Ship Weapons"), (2, "Gear Book", "Rules", ""), (3, "Core", "Player Character", "Gear"), (4, "Core", "Vehicles", "Weapons"), (5, "High Guard", "", ""), (6, "Core", "Magic", "Spells"), (7, "Core", "Childhood", "Tank"), (8, "Core", "Armour", "x")])


def _ladder(*columns: str) -> str:
    return " ".join(f"WHEN regexp_matches({c}, '(?i)\\b{_ALT(P.VEHICLE_HEADINGS)}\\b') THEN 'transport' WHEN regexp_matches({c}, '(?i)\\b{_ALT(P.ITEM_HEADINGS)}\\b') THEN 'items'" for c in columns)


_CHARGEN = P.CHARGEN


@query("P1_category", f"SELECT id, CASE WHEN regexp_matches(chapter, '{_CHARGEN}') OR regexp_matches(book, '{_CHARGEN}') THEN 'rules' {_ladder('section', 'chapter', 'book')} ELSE 'rules' END AS category FROM {HEADINGS.sql} UNION ALL SELECT doc_id + 100, CASE {_ladder('text')} ELSE 'rules' END FROM documents")
def category(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") + 100).alias("id"), P.category(F.lit(""), F.lit(""), F.col("text")).alias("category"))
    return HEADINGS.df(spark).select(F.col("id").cast("long"), P.category(F.col("book"), F.col("chapter"), F.col("section")).alias("category")).unionByName(docs)


BODIES = Rows("doc int, id int, section_key string, category string, text string", [(1, 1, "A › B", "rules", "prose about fields"), (1, 2, "A › B", "rules", "| Name | ROF | 3 |"), (1, 3, "A › B", "rules", "| HULL | 3 |"), (1, 4, "", "rules", "an assault rifle here"), (1, 5, "", "rules", "nothing"), (2, 1, "A › B", "items", "other document"), (2, 2, "C", "rules", "a carbine")])


@query("P2_retag", f"""SELECT doc, id, CASE s WHEN 2 THEN 'transport' WHEN 1 THEN 'items' ELSE category END AS category FROM (SELECT *, CASE WHEN section_key = '' THEN r ELSE max(r) OVER (PARTITION BY doc, section_key) END AS s FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i)\\|\\s*{_ALT(P.VEHICLE_COLUMNS)}\\s*\\|') THEN 2 WHEN regexp_matches(text, '(?i)\\|\\s*{_ALT(P.WEAPON_COLUMNS)}\\s*\\|') OR regexp_matches(text, '(?i)\\b{_ALT(P.WEAPON_PHRASES)}\\b') THEN 1 ELSE 0 END AS r FROM {BODIES.sql}))""")
def retag(spark, d):
    return P.retag(BODIES.df(spark)).select("doc", "id", "category")


@query("P3_reference_clutter", r"""SELECT doc_id, CASE WHEN len(t) >= 12 AND len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$'))) >= 0.30 * len(t) THEN 'reference' ELSE 'rules' END AS category FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)""")
def reference_clutter(spark, d):
    return table(spark, d, "documents").select("doc_id", P.guard(F.lit("rules"), F.lit("Some section"), F.col("text")).alias("category"))


NAMES = Rows("id int, name string", list(enumerate(["Long Stick", "10 units", "Total MCr 29979", "TL12", "is destroyed by fire", "ends.", "50% off", "one two three four five six seven", "M1911A1", "x", "takes  takes cover"])))
_PHRASE = lambda ps: " AND ".join(f"NOT contains(lower(name), '{p}')" for p in ps)


@query("P7_names", rf"SELECT id, length(name) BETWEEN 2 AND 40 AND NOT contains(name, '%') AND name NOT LIKE '%.' AND NOT regexp_matches(name, '^\d') AND NOT regexp_matches(name, '(?i)^tl\s*\d+$') AND NOT regexp_matches(name, '\d{{4,}}') AND {_PHRASE([*P.NOT_NAMES, ' dm-', ' dm+'])} AND len(list_filter(string_split(name, ' '), lambda w: w <> '')) <= 6 AS catalog, length(name) BETWEEN 2 AND 40 AND name NOT LIKE '%.' AND NOT contains(name, '%') AND regexp_matches(name, '[A-Za-z]') AND len(list_filter(string_split(name, ' '), lambda w: w <> '')) <= 8 AND {_PHRASE(P.NOT_NAMES)} AS card FROM {NAMES.sql}")
def names(spark, d):
    return NAMES.df(spark).select("id", P.is_catalog_name(F.col("name")).alias("catalog"), P.is_card_title(F.col("name")).alias("card"))


TOPICS = Rows("id int, chapter string, name string", [(1, "Combat & Damage", "RADIATION SICKNESS"), (2, "3. Travelling", "Table"), (3, "x.pdf", "zzz"), (4, "1. Odd Chapter", "zzz"), (5, "", "Foraging"), (6, "Gear", "zzz"), (7, "", "")])


@query("P8_topic", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i)\\b{_ALT(keys)}') THEN '{label}'" for c in ("name", "chapter") for label, keys in P.TOPICS.items()) + rf" WHEN chapter <> '' AND NOT regexp_matches(trim(chapter), '(?i)^(pdf|page|\d+|.*\.pdf)$') THEN trim(regexp_replace(chapter, '^[^.]*\.', '')) ELSE 'Other' END AS topic FROM {TOPICS.sql}")
def topics(spark, d):
    return TOPICS.df(spark).select("id", P.topic(F.col("chapter"), F.col("name")).alias("topic"))


@query("P9_name_cells", rf"SELECT id, trim(name) <> '' AND NOT regexp_matches(trim(name), '^\d{{1,2}}$') AND NOT regexp_matches(name, '(?i)\(?d6\)?') AND regexp_matches(name, '[A-Za-z]{{2,}}') AS looks FROM {NAMES.sql}")
def name_cells(spark, d):
    s = T.trim_all(F.col("name"))
    looks = (s != "") & ~s.rlike(r"^\d{1,2}$") & ~F.col("name").rlike(r"(?i)\(?d6\)?") & F.col("name").rlike("[A-Za-z]{2,}")
    return NAMES.df(spark).select("id", looks.alias("looks"))


@query("P10_row_shapes", rf"SELECT id, regexp_matches(trim(rows[2][1]), '^\d{{1,2}}([–-]\d{{1,2}})?$') AS roll, len(list_filter(rows[1][2:], lambda c: trim(c) <> '')) >= 3 AND len(list_filter(rows[1][2:], lambda c: trim(c) <> '' AND NOT (length(c) <= 25 AND regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '[0-9]')))) = 0 AS catalog FROM {GRIDS.sql}")
def row_shapes(spark, d):
    return GRIDS.df(spark).select("id", G.is_roll_row(F.get("rows", F.lit(1))).alias("roll"), G.is_catalog_header(F.get("rows", F.lit(0))).alias("catalog"))


PROFILES = Rows("ord int, name string, keyword string", [(1, "alpha", "src1"), (2, "beta", "src"), (3, "gamma", "src19")])


@query("P11_profile", f"SELECT source AS game, arg_min(p.name, p.ord) AS profile FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN {PROFILES.sql} p ON contains(lower(source), keyword) GROUP BY source")
def profile(spark, d):
    return P.first_profile(table(spark, d, "documents").select(F.col("source").alias("game")), PROFILES.df(spark))


CATS = Rows("category string", [(c,) for c in [*P.DOMAINS, "reference", "curse"]])


@query("P12_domain", f"SELECT category, CASE category {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in P.DOMAINS.items())} ELSE 'rule' END AS domain FROM {CATS.sql} WHERE category <> 'reference'")
def domains(spark, d):
    return CATS.df(spark).select("category", P.domain(F.col("category")).alias("domain")).filter("domain IS NOT NULL")


@query("P13_resolve", "SELECT DISTINCT source FROM documents WHERE lower(source) = lower(trim('  SRC7 '))")
def resolve(spark, d):
    return table(spark, d, "documents").select("source").distinct().filter(F.lower("source") == F.lower(F.trim(F.lit("  SRC7 "))))


@query("P14_suggest", "SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY name LIMIT 25")
def suggest(spark, d):
    return P.suggest(table(spark, d, "part").select(F.col("p_name").alias("name")), "Ring")


@query("P15_table_suggest", "SELECT DISTINCT p_type AS topic, p_name AS leaf FROM part ORDER BY topic, leaf LIMIT 25")
def table_suggest(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("topic"), F.col("p_name").alias("leaf")).dropDuplicates().orderBy("topic", "leaf").limit(25)


# ------------------------------------------------------------------ G: answers of literal grids
SHAPES = Rows("id int, rows array<array<string>>, cleaned string, dense string, unrolled string, name_col int, pairs string", [
    (1, [["Score", "Mod", "Score", "Mod"], ["1", "-5", "10", "0"]], "Score|Mod|Score|Mod/1|-5|10|0", "Score|Mod|Score|Mod/1|-5|10|0", "Score|Mod/1|-5/10|0", 0, ""),
    (2, [[" a ", ""], ["", ""], ["b"]], "a|/b", " a //b", " a |/|/b", 0, ""),
    (3, [["D10", "Name"], ["1", "Rope"], ["2", "M16"]], "D10|Name/1|Rope/2|M16", "D10|Name/1|Rope/2|M16", "D10|Name/1|Rope/2|M16", 1, ""),
    (4, [["TYPE", "AMMO"], ["Gun", "9mm"], ["BLAST", "MAG"], ["-", "10"]], "TYPE|AMMO/Gun|9mm/BLAST|MAG/-|10", "TYPE|AMMO/Gun|9mm/BLAST|MAG/-|10", "TYPE|AMMO/Gun|9mm/BLAST|MAG/-|10", 0, "TYPE=Gun;AMMO=9mm;BLAST=-;MAG=10"),
])


def shape(name: str, column: str, build):
    @query(name, f"SELECT id, {column} AS out FROM {SHAPES.sql}")
    def run(spark, d):
        return SHAPES.df(spark).select("id", build(F.col("rows")).alias("out"))

    return run


shape("G1_clean_grid", "cleaned", lambda r: G.text_of(G.clean(r)))
shape("G1_drop_empty_columns", "dense", lambda r: G.text_of(G.drop_empty_columns(r)))
shape("G2_name_column", "name_col", G.name_column)
shape("G9_unroll_columns", "unrolled", lambda r: G.text_of(G.unroll_repeats(r)))
shape("G11_wrapped_pairs", "pairs", lambda r: F.coalesce(F.array_join(F.transform(G.wrapped_pairs(r), lambda p: F.concat(p["label"], F.lit("="), p["value"])), ";"), F.lit("")))

PART_SQL = "(SELECT p_partkey, [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)] AS r FROM part)"


def part_grid(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("r"))


@query("G3_column_remap", f"SELECT p_partkey, r[1] || ' ' || r[2] || '|' || r[4] AS out FROM {PART_SQL}")
def column_remap(spark, d):
    return part_grid(spark, d).select("p_partkey", G.text_of(G.select_columns(F.array("r"), [[0, 1], [3]])).alias("out"))


GRADES = Rows("id int, row array<string>, want string", [(1, ["Suit, Low Suit, High", "+1 +2", "8 9", "same"], "Suit, Low|+1|8|same/Suit, High|+2|9|same"), (2, ["Coat", "+1", "7", "x"], "Coat|+1|7|x")])


@query("G4_grade_split", f"SELECT id, want AS out FROM {GRADES.sql}")
def grade_split(spark, d):
    return GRADES.df(spark).select("id", G.text_of(G.grade_rows(F.col("row"), 1, 0)).alias("out"))


@query("G5_normalize_rows", f"SELECT p_partkey, CASE WHEN r[3] = 'SMALL' THEN r[1] || '|' || r[4] ELSE array_to_string(r, '|') END AS out FROM {PART_SQL}")
def normalize_rows(spark, d):
    small = F.when(F.get("r", F.lit(2)) == "SMALL", G.select_columns(F.array("r"), [[0], [3]]))
    return part_grid(spark, d).select("p_partkey", G.text_of(F.coalesce(small, F.array("r"))).alias("out"))


STACKS = Rows("id int, rows array<array<string>>, rolls string, catalogs string", [
    (1, [["1D", "A"], ["1", "x"], ["2", "y"], ["1D", "B"], ["1", "p"], ["2", "q"], ["EVENTS", ""]], "1D|A/1|x/2|y#1D|B/1|p/2|q", "1D|A/1|x/2|y/1D|B/1|p/2|q/EVENTS|"),
    (2, [["Simple", "Price", "Damage", "Bulk"], ["Club", "1", "2", "1"], ["Knife", "1", "1", "0"], ["Martial", "Price", "Damage", "Bulk"], ["Sword", "9", "8", "1"], ["TABLE 6", "", "", ""]], "Simple|Price|Damage|Bulk/Club|1|2|1/Knife|1|1|0/Martial|Price|Damage|Bulk/Sword|9|8|1/TABLE 6|||", "Simple|Price|Damage|Bulk/Club|1|2|1/Knife|1|1|0#Martial|Price|Damage|Bulk/Sword|9|8|1"),
])
_JOIN = lambda parts: F.array_join(F.transform(parts, G.text_of), "#")


@query("G6_split_rolls", f"SELECT id, rolls AS out FROM {STACKS.sql}")
def split_rolls(spark, d):
    return STACKS.df(spark).select("id", _JOIN(G.split_roll_tables(F.col("rows"))).alias("out"))


@query("G7_split_catalogs", f"SELECT id, catalogs AS out FROM {STACKS.sql}")
def split_catalogs(spark, d):
    return STACKS.df(spark).select("id", _JOIN(G.split_catalogs(F.col("rows"))).alias("out"))


@query("G8_fan_out", f"SELECT id, CAST(i - 1 AS INTEGER) AS part, string_split(CASE WHEN contains(rolls, '#') THEN rolls ELSE catalogs END, '#')[i] AS out FROM {STACKS.sql}, range(1, 3) t(i)")
def fan_out(spark, d):
    rolls = G.split_roll_tables(F.col("rows"))
    parts = F.when(F.size(rolls) > 1, rolls).otherwise(G.split_catalogs(F.col("rows")))
    return STACKS.df(spark).select("id", F.posexplode(parts).alias("part", "seg")).select("id", "part", G.text_of(F.col("seg")).alias("out"))


@query("G10_headerless", f"SELECT p_partkey, r[1] || ' ' || r[2] || '|' || r[3] || ' ' || r[4] AS out FROM {PART_SQL}")
def headerless(spark, d):
    header = F.array(F.lit("Name"), F.lit(""), F.lit("Type"), F.lit(""))
    return part_grid(spark, d).select("p_partkey", F.array_join(G.merge_headerless(header, F.col("r")), "|").alias("out"))


@query("G12_part_value", "SELECT * FROM (VALUES (4, 'Hull', '10 tons (MCr 1)'), (4, 'M-Drive', 'Thrust 1 (1 t, MCr 2)'), (4, 'Power Plant', 'Fuse (1 t, MCr 1)'), (4, 'Bridge', '(2 t, MCr 1)')) v(id, label, out)")
def part_value(spark, d):
    rows = GRIDS.df(spark).filter("id = 4").select("id", G.width(F.col("rows")).alias("w"), F.explode("rows").alias("r"))
    return rows.select("id", F.get("r", F.lit(0)).alias("label"), G.part_value(F.col("r"), F.col("w")).alias("out"))


@query("G13_match_row", "SELECT * FROM (VALUES (1, 2), (2, -1), (3, -1)) v(id, place)")
def match_row(spark, d):
    return GRIDS.df(spark).filter("id <= 3").select("id", F.coalesce(G.match_row(F.col("rows"), F.lit("long stick")), F.lit(-1)).alias("place"))


@query("G14_item_pairs", f"SELECT p_partkey, 'Name=' || r[1] || ';Brand=' || r[2] || ';Size=' || r[4] AS out FROM {PART_SQL}")
def item_pairs(spark, d):
    grid = F.array(F.array(F.lit("Name"), F.lit("Brand"), F.lit(""), F.lit("Size")), F.col("r"))
    pairs = F.transform(G.item_pairs(grid, F.lit(1)), lambda p: F.concat(p["label"], F.lit("="), p["value"]))
    return part_grid(spark, d).select("p_partkey", F.array_join(pairs, ";").alias("out"))


STEPS = Rows("id int, rows array<array<string>>", [(1, [["Rating", "1", "2"], ["% of Hull", "1%", "2%"], ["TL", "9", "10"]])])


@query("G15_transposed", "SELECT * FROM (VALUES ('1', '% of Hull', '1%'), ('2', '% of Hull', '2%'), ('1', 'TL', '9'), ('2', 'TL', '10')) v(rating, label, value)")
def transposed(spark, d):
    return STEPS.df(spark).select(F.inline(G.named_rows(F.col("rows"))))


@query("G16_column_of", "SELECT * FROM (VALUES (1, 1, 3), (2, -1, 3), (3, -1, -1)) v(id, damage, cost)")
def column_of(spark, d):
    header = F.get("rows", F.lit(0))
    return GRIDS.df(spark).filter("id <= 3").select("id", G.column_of(header, "damage").alias("damage"), G.column_of(header, "co", "st").alias("cost"))


# ------------------------------------------------------------------ C: catalogues
CATALOG_SQL = "(SELECT p_brand AS source, p_type AS kind, p_partkey AS ord, p_name || CASE WHEN p_size % 7 = 0 THEN ' *' ELSE '' END AS cell, p_retailprice FROM part)"


def catalog(spark, d):
    cell = F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " *").otherwise(""))
    return table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ord"), cell.alias("cell"), "p_retailprice")


@query("C5_catalog_names", rf"SELECT source, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT source, lower(n) AS k, arg_min(n, ord) AS name FROM (SELECT source, ord, regexp_replace(trim(cell), '[ *†‡]+$', '') AS n FROM {CATALOG_SQL}) GROUP BY source, lower(n)) GROUP BY source")
def catalog_names(spark, d):
    rows = catalog(spark, d).withColumn("name", T.item_name(F.col("cell"))).filter(P.is_catalog_name(F.col("name")))
    first = rows.groupBy("source", F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("name"))
    return first.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))


@query("C6_catalog_cards", rf"SELECT source, k, ord, from_row FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY from_row DESC, ord) AS r FROM (SELECT source, lower(regexp_replace(trim(cell), '[ *†‡]+$', '')) AS k, ord, kind = 'SMALL' AS from_row FROM {CATALOG_SQL})) WHERE r = 1")
def catalog_cards(spark, d):
    rows = catalog(spark, d).select("source", F.lower(T.item_name(F.col("cell"))).alias("k"), "ord", (F.col("kind") == "SMALL").alias("from_row"))
    w = Window.partitionBy("source", "k").orderBy(F.desc("from_row"), "ord")  # a catalogue row beats a heading-named block
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query("C4_explode_items", rf"""WITH x AS (SELECT source, ord, regexp_replace(trim(cell), '[ *†‡]+$', '') AS name FROM {CATALOG_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY source, lower(name) ORDER BY ord) AS r FROM x)
  SELECT source, ord, name, CASE WHEN name = 'small ring' THEN 1.0 WHEN contains(name, 'small') AND contains(name, 'ring') THEN 0.7 WHEN contains(name, 'small') OR contains(name, 'ring') THEN 0.2 ELSE 0.0 END AS score FROM f WHERE r = 1""")
def explode_items(spark, d):
    rows = catalog(spark, d).select("source", "ord", T.item_name(F.col("cell")).alias("name"))
    w = Window.partitionBy("source", F.lower("name")).orderBy("ord")
    score = T.name_score(T.tokenize(F.lit("small ring")), T.tokenize(F.col("name")))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("source", "ord", "name", F.round(score, 6).alias("score"))


@query("C1_table_chunks", f"SELECT id, CASE want WHEN 'rules' THEN 'tables' ELSE want END AS category, rows[1][1] AS name FROM {GRIDS.sql} WHERE want <> 'noise' AND len(rows) >= 2 AND id NOT IN (6)")
def table_chunks(spark, d):
    rows = GRIDS.df(spark).filter((F.size("rows") >= 2) & G.is_real(F.col("rows")))
    kind = P.table_class(F.col("chapter"), F.col("rows"), ["EQUIPMENT"], ["VEHICLES"])
    rows = rows.withColumn("kind", kind).filter("kind <> 'noise'")
    name = T.table_name(F.lit(""), F.lit(""), F.get("rows", F.lit(0)))
    return rows.select("id", F.when(F.col("kind") == "rules", "tables").otherwise(F.col("kind")).alias("category"), name.alias("name"))


@query("C2_markdown_chunks", f"SELECT id, len(list_filter(flatten(rows[2:]), lambda c: trim(c) <> '')) AS filled FROM {GRIDS.sql} WHERE want <> 'noise' AND len(rows) >= 3 AND 2 * len(list_filter(flatten(rows[2:]), lambda c: trim(c) <> '')) >= len(flatten(rows[2:]))")
def markdown_chunks(spark, d):
    data = F.flatten(F.slice(F.col("rows"), F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))))
    filled = F.size(F.filter(data, lambda c: T.trim_all(c) != ""))
    keep = (G.width(F.col("rows")) >= 2) & (F.size("rows") >= 3) & G.is_real(F.col("rows")) & (2 * filled >= F.size(data))
    chosen = GRIDS.df(spark).filter(keep).filter(P.table_class(F.lit(""), F.col("rows")) != "noise")
    return chosen.select("id", filled.cast("long").alias("filled"))
