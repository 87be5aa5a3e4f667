"""Queries of the scalar text functions (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans.base import Rows, query, table

#: The stemmer as SQL over an expression x.
EQUIV_SQL = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.EQUIVALENT.items()) + " ELSE {x} END"


def stem_sql(x: str) -> str:
    t = EQUIV_SQL.format(x=x)
    return f"""(CASE WHEN length({t}) <= 4 THEN {t}
      WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y'
      WHEN regexp_matches({t}, '(ses|xes|zes|ches|shes)$') THEN left({t}, length({t}) - 2)
      WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, length({t}) - 1)
      ELSE {t} END)"""


def tokens_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda q: {stem_sql('q')})"


def score_sql(q: str, n: str) -> str:
    shared = f"len(list_intersect(list_distinct({q}), list_distinct({n})))"
    return f"""CASE WHEN len({q}) = 0 OR len({n}) = 0 THEN 0.0 WHEN {q} = {n} THEN 1.0
      WHEN {shared} = len(list_distinct({q})) THEN 0.7
      ELSE 0.6 * {shared} / len(list_distinct(list_concat({q}, {n}))) END"""


@query("N1_tokenize", f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def tokenize(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


STEMS = Rows("w string", [(w,) for w in "aging armour armoured boxes rolls specialties classes dashes status axis various pass gas quizzes armies lies colour glasses 12s modifiers".split()])


@query("N2_stem", f"SELECT w, {stem_sql('w')} AS stem FROM {STEMS.sql}")
def stem(spark, d):
    return STEMS.df(spark).select("w", T.stem(F.col("w")).alias("stem"))


@query("N3_name_match", f"WITH p AS (SELECT p_partkey, {tokens_sql('p_name')} AS n, {tokens_sql(chr(39) + 'red small bolts' + chr(39))} AS q FROM part) SELECT p_partkey, round({score_sql('q', 'n')}, 6) AS score FROM p")
def name_match(spark, d):
    score = T.name_score(T.tokenize(F.lit("red small bolts")), T.tokenize(F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


MESSY = Rows("id int, s string", [(1, "eﬀect ﬁre ﬂow ﬃ ﬄ ﬅ ﬆ"), (2, "a\x08b\x07c\td\x7f"), (3, "plain"), (4, "")])
_LIG = "s"
for _a, _b in T.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"


@query("N4_ligatures", f"SELECT id, {_LIG} AS out FROM {MESSY.sql}")
def ligatures(spark, d):
    return MESSY.df(spark).select("id", T.normalize_ligatures(F.col("s")).alias("out"))


@query("N5_strip_control", r"SELECT doc_id, length(regexp_replace(text || chr(8) || chr(10) || chr(127), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS n FROM documents")
def strip_control(spark, d):
    dirty = F.concat("text", F.lit("\x08\n\x7f"))
    return table(spark, d, "documents").select("doc_id", F.length(T.strip_controls(dirty)).alias("n"))


TITLES = Rows("id int, s string", [(1, "TIME LIMIT"), (2, "EMT GEAR"), (3, "Mixed Case"), (4, "CLOAK OF COLORS AND THE WIND"), (5, "  spaced   OUT "), (6, "O'NEIL ARMS-X"), (7, "of mice"), (8, "hull hull Armour armour"), (9, "Big Hull Big Hull"), (10, "")])
_TITLE = "list_aggregate(list_transform(regexp_extract_all(lower({w}), '[a-z]+|[^a-z]+'), lambda p: upper(left(p, 1)) || substr(p, 2)), 'string_agg', '')"
_WORDS = "list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')"


@query("N7_acronym_title", f"SELECT id, coalesce(array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{{1,3}}$') THEN w WHEN upper(w) = w AND regexp_matches(w, '[A-Z]') THEN {_TITLE.format(w='w')} ELSE w END), ' '), '') AS out FROM {TITLES.sql}")
def acronym_title(spark, d):
    return TITLES.df(spark).select("id", T.acronym_title(F.col("s")).alias("out"))


_SMALL = "[" + ", ".join(f"'{w}'" for w in T.SMALL_WORDS) + "]"


@query("N8_titlecase", f"SELECT id, coalesce(array_to_string(list_transform({_WORDS}, lambda w, i: CASE WHEN i > 1 AND list_contains({_SMALL}, lower(w)) THEN lower(w) ELSE upper(left(w, 1)) || substr(lower(w), 2) END), ' '), '') AS out FROM {TITLES.sql}")
def titlecase(spark, d):
    return TITLES.df(spark).select("id", T.entry_title(F.col("s")).alias("out"))


LINES = Rows("id int, s string", [(1, "  **Bold** and ~~gone~~<br>next "), (2, "==> picture omitted <=="), (3, "0 75 A B (Order #51743052)"), (4, "----- Start of picture text -----"), (5, ""), (6, "`code`  *x* <br/> y")])


@query("N9_clean_line", rf"SELECT id, CASE WHEN regexp_matches(s, '==>.*omitted.*<==|----- (Start|End) of picture text -----') OR regexp_matches(s, '\(Order #\d+\)') THEN '' ELSE trim(replace(replace(replace(trim(s), '<br>', ' '), '~~', ''), '**', '')) END AS out FROM {LINES.sql}")
def clean_line(spark, d):
    return LINES.df(spark).select("id", T.clean_line(F.col("s")).alias("out"))


@query("N10_clean_cell", rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(s, '<br\s*/?>', ' ', 'g'), '[*`]', '', 'g'), '\s+', ' ', 'g')) AS out FROM {LINES.sql}")
def clean_cell(spark, d):
    return LINES.df(spark).select("id", T.clean_cell(F.col("s")).alias("out"))


TAILS = Rows("id int, s string", [(1, "A soft light. ## 5TH LEVEL more"), (2, "struck ~~x~~"), (3, "clean # one"), (4, "")])


@query("N11_markup_tail", rf"SELECT id, regexp_replace(s, '\s*(#{{2,}}|~~).*$', '') AS out FROM {TAILS.sql}")
def markup_tail(spark, d):
    return TAILS.df(spark).select("id", T.cut_markup_tail(F.col("s")).alias("out"))


@query("N12_dedupe_header", f"""WITH w AS (SELECT id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM {TITLES.sql}),
  k AS (SELECT id, w, i, lag(lower(w)) OVER (PARTITION BY id ORDER BY i) AS p FROM w),
  l AS (SELECT id, list(w ORDER BY i) AS ws, list(lower(w) ORDER BY i) AS lo FROM k WHERE p IS NULL OR p <> lower(w) GROUP BY id)
  SELECT t.id, coalesce(CASE WHEN len(ws) % 2 = 0 AND lo[1:len(ws) // 2] = lo[len(ws) // 2 + 1:] THEN array_to_string(ws[1:len(ws) // 2], ' ') ELSE array_to_string(ws, ' ') END, '') AS out
  FROM {TITLES.sql} t LEFT JOIN l USING (id)""")
def dedupe_header(spark, d):
    return TITLES.df(spark).select("id", T.dedupe_header(F.col("s")).alias("out"))


@query("N13_letter_stats", r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 6) END AS caps,
  NOT regexp_matches(text, '[A-Za-z]') AS pure_number, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2))) AS long_tokens FROM documents""")
def letter_stats(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(T.caps_ratio(c), 6).alias("caps"), T.is_pure_number(c).alias("pure_number"), F.size(T.long_tokens(c, 2)).alias("long_tokens"))


CELLS = Rows("id int, s string", [(1, "MCr1.2"), (2, "Cr30,000"), (3, "—"), (4, ""), (5, "2500000"), (6, "+20%"), (7, "TL 12"), (8, "-3 dex"), (9, "free"), (10, "Suit, Low (TL7)"), (11, "a; b,, c")])
_MONEY = "replace(trim(s), ',', '')"


@query("N14_money", f"""SELECT id, round(CASE WHEN {_MONEY} IN ('', '—', '-') THEN 0.0 WHEN regexp_matches({_MONEY}, '(?i)MCr[0-9.]+') THEN TRY_CAST(regexp_extract({_MONEY}, '(?i)MCr([0-9.]+)', 1) AS DOUBLE)
  WHEN regexp_matches({_MONEY}, '(?i)Cr[0-9.]+') THEN TRY_CAST(regexp_extract({_MONEY}, '(?i)Cr([0-9.]+)', 1) AS DOUBLE) / 1000000
  ELSE coalesce(TRY_CAST(nullif(regexp_extract({_MONEY}, '([0-9.]+)', 1), '') AS DOUBLE) / 1000000, 0.0) END, 9) AS mcr FROM {CELLS.sql}""")
def money(spark, d):
    return CELLS.df(spark).select("id", F.round(T.money_millions(F.col("s")), 9).alias("mcr"))


@query("N15_numbers", rf"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(s, '([0-9.]+)\s*%', 1), '') AS DOUBLE) / 100, 0.0) AS pct, coalesce(TRY_CAST(nullif(regexp_extract(replace(s, ',', ''), '(-?\d+)', 1), '') AS INTEGER), -999) AS n FROM {CELLS.sql}")
def numbers(spark, d):
    return CELLS.df(spark).select("id", T.percent(F.col("s")).alias("pct"), F.coalesce(T.first_int(F.col("s")), F.lit(-999)).alias("n"))


@query("N16_base_name", rf"SELECT id, trim(regexp_replace(s, '(,| \().*$', '')) AS base FROM {CELLS.sql}")
def base_name(spark, d):
    return CELLS.df(spark).select("id", T.base_name(F.col("s")).alias("base"))


@query("N17_split_list", f"SELECT id, coalesce(array_to_string(list_filter(list_transform(string_split_regex(s, '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS items FROM {CELLS.sql}")
def split_list(spark, d):
    return CELLS.df(spark).select("id", F.array_join(T.split_list(F.col("s")), "|").alias("items"))


@query("N18_eval_norm", """SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm,
  array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: CASE WHEN length(t) >= 3 AND t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END), ' ') AS singular FROM benchmark""")
def eval_norm(spark, d):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", T.normal_words(F.col("text")).alias("norm"), F.array_join(F.transform(tokens, T.singular), " ").alias("singular"))


LABELS = Rows("id int, s string", [(i, x) for i, x in enumerate(["Specialist Skills", "Skills and training", "1D", "RANKS AND PAY", "Mustering out benefits", "Career progress", "MISHAPS", "Events table", "SPECIALITIES (D6)", "WEAPON LOCKER", "Other thing", ""])])
_LOW = "lower(trim(s))"


@query("N19_section_labels", f"""SELECT id, CASE WHEN {_LOW} LIKE 'special%' THEN 'specialty' ELSE {_LOW} END AS key,
  CASE WHEN contains({_LOW}, 'specialist') THEN 'Specialist Skills' WHEN {_LOW} LIKE 'skills%' THEN 'Skills' WHEN {_LOW} IN ('1d','2d','3d','d6','d66','d','') OR regexp_matches({_LOW}, '^[0-9]+$') THEN 'Skills'
  WHEN contains({_LOW}, 'rank') OR contains({_LOW}, 'traveller creation') THEN 'Ranks' WHEN contains({_LOW}, 'mustering') THEN 'Mustering Out' WHEN contains({_LOW}, 'career progress') OR contains({_LOW}, 'qualif') THEN 'Career Progress'
  WHEN {_LOW} LIKE 'mishap%' THEN 'Mishaps' WHEN {_LOW} LIKE 'event%' THEN 'Events' WHEN upper(trim(s)) = trim(s) AND regexp_matches(s, '[A-Z]') THEN {_TITLE.format(w='trim(s)')} ELSE trim(s) END AS label FROM {LABELS.sql}""")
def section_labels(spark, d):
    return LABELS.df(spark).select("id", T.section_key(F.col("s")).alias("key"), T.career_label(F.col("s")).alias("label"))


#: Aliases of rank names (fixed values).
RANK_ALIASES = {"2nd lieutenant": "second lieutenant", "1st lieutenant": "first lieutenant", "lt. colonel": "lieutenant colonel"}
RANKS = Rows("id int, s string", [(1, " 2nd  Lieutenant"), (2, "CAPTAIN"), (3, "Lt. Colonel"), (4, "")])


@query("N20_rank_alias", rf"SELECT id, CASE {{x}} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in RANK_ALIASES.items())} ELSE {{x}} END AS rank FROM {RANKS.sql}".replace("{x}", r"trim(regexp_replace(lower(s), '\s+', ' ', 'g'))"))
def rank_alias(spark, d):
    alias = F.create_map(*(F.lit(x) for pair in RANK_ALIASES.items() for x in pair))
    low = T.collapse(F.lower("s"))
    return RANKS.df(spark).select("id", F.coalesce(alias[low], low).alias("rank"))


CRUMBS = Rows("id int, s string, title string, header array<string>", [(1, "Combat › Damage › Sniper", "Speed Steps", ["a"]), (2, "One", "lower title", ["x"]), (3, "", "A sentence ends here.", ["", "First header"]), (4, "", "", ["", ""]), (5, "A › B", "one two three four five six seven", [])])


@query("N21_crumbs", f"SELECT id, trim(list_extract(string_split(s, '›'), -1)) AS leaf, trim(list_extract(string_split(s, '›'), 1)) AS root FROM {CRUMBS.sql}")
def crumbs(spark, d):
    return CRUMBS.df(spark).select("id", T.crumb_leaf(F.col("s")).alias("leaf"), T.crumb_root(F.col("s")).alias("root"))


@query("N22_table_name", rf"""SELECT id, CASE WHEN NOT (title = '' OR regexp_matches(title, '^[a-z]') OR regexp_matches(title, '[.,;]$') OR len(string_split(title, ' ')) > 6) THEN title
  WHEN trim(list_extract(string_split(s, '›'), -1)) <> '' THEN trim(list_extract(string_split(s, '›'), -1))
  ELSE coalesce(left(list_extract(list_filter(header, lambda x: x <> ''), 1), 40), 'Table') END AS name FROM {CRUMBS.sql}""")
def table_name(spark, d):
    return CRUMBS.df(spark).select("id", T.table_name(F.col("title"), F.col("s"), F.col("header")).alias("name"))


@query("N23_provenance", "SELECT doc_id, source || ' · p. ' || (doc_id % 90) AS label FROM documents")
def provenance(spark, d):
    return table(spark, d, "documents").select("doc_id", T.provenance(F.col("source"), F.concat(F.lit("p. "), F.col("doc_id") % 90)).alias("label"))


REPAIR = Rows("id int, s string", [(1, "the fre is difcult, Refex!"), (2, "free from fear"), (3, "no such word fx"), (4, "")])
DICTIONARY = Rows("word string", [(w,) for w in "the fire is difficult reflex free from fear no such word after".split()])


@query("N6_repair_ligatures", f"""WITH p AS (SELECT id, unnest(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+'), 1) AS i FROM {REPAIR.sql}),
  c AS (SELECT DISTINCT w, k, x.ins, x.r, left(w, k) || x.ins || substr(w, k + 1) AS cand FROM (SELECT DISTINCT w, unnest(range(1, length(w) + 1)) AS k FROM p) q, (VALUES ('i', 1), ('l', 2), ('fi', 3), ('fl', 4)) AS x(ins, r) WHERE lower(substr(w, k, 1)) = 'f'),
  known AS (SELECT DISTINCT v FROM (SELECT w AS v FROM p UNION SELECT cand FROM c) WHERE lower(v) IN (SELECT word FROM {DICTIONARY.sql}) OR EXISTS (SELECT 1 FROM (VALUES ('s'), ('es'), ('ed'), ('ing')) AS f(suf), {DICTIONARY.sql} AS dd WHERE lower(v) = dd.word || f.suf AND length(v) > length(f.suf) + 1)),
  best AS (SELECT w, arg_min(cand, k * 10 + r) AS fixed FROM c WHERE cand IN (SELECT v FROM known) AND w NOT IN (SELECT v FROM known) GROUP BY w)
  SELECT r.id, coalesce(string_agg(coalesce(best.fixed, p.w), '' ORDER BY p.i), '') AS out FROM {REPAIR.sql} r LEFT JOIN p USING (id) LEFT JOIN best ON p.w = best.w GROUP BY r.id""")
def repair_ligatures(spark, d):
    from folioscope.operators.repair import repair

    return repair(REPAIR.df(spark), "id", "s", DICTIONARY.df(spark), least_words=0).select("id", F.col("s").alias("out"))
