"""The same operators over grids, texts and rules drawn from the tables, with SQL that computes what they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import domain as D
from folioscope.operators import evals as E
from folioscope.operators import geometry as Z
from folioscope.operators import grids as G
from folioscope.operators import segment as H
from folioscope.operators.careers import rank_names
from folioscope.operators.render import render
from folioscope.plans.base import query, table
from folioscope.sources import library as L


def part(spark, d):
    """key, name, brand, kind and size (as text and as a number) of every part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("s"), F.col("p_size").alias("n"))


def row(*cells):
    return F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))


def if_(test, yes, no=""):
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(test, as_col(yes)).otherwise(as_col(no))


P = "(SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS s, p_size AS n FROM part)"
C = F.col


# ------------------------------------------------------------------ grids
@query("G1_clean_drawn", f"SELECT k, 'Name|Cost' || CASE WHEN n % 3 = 0 THEN '' ELSE '/' || name || '|' || CASE WHEN n % 2 = 0 THEN s ELSE '' END END || CASE WHEN n % 5 = 0 THEN '' ELSE '/|' || kind END AS out FROM {P}")
def clean(spark, d):
    rows = F.array(row(" Name ", "Cost"), row(if_(C("n") % 3 == 0, "  ", F.concat(F.lit(" "), "name")), if_((C("n") % 3 != 0) & (C("n") % 2 == 0), C("s"))), row(F.lit(None).cast("string"), if_(C("n") % 5 == 0, " ", F.concat("kind", F.lit(" ")))))
    return part(spark, d).select("k", G.text_of(G.clean(rows)).alias("out"))


@query("G1_dense_drawn", f"SELECT k, name || CASE WHEN n % 2 = 0 THEN '|' || brand ELSE '' END || '|' || s || '/' || CASE WHEN n % 2 = 0 THEN '|' ELSE '' END || '|' || kind AS out FROM {P}")
def dense(spark, d):
    rows = F.array(row(C("name"), "", if_(C("n") % 2 == 0, C("brand")), C("s")), row("", "", "", C("kind")))
    return part(spark, d).select("k", G.text_of(G.drop_empty_columns(rows)).alias("out"))


@query("G2_name_drawn", f"SELECT k, CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 THEN 1 ELSE 2 END AS at FROM {P}")
def name_column(spark, d):
    words = [if_(C("n") % 3 == i, C("name"), C("s")) for i in range(3)]
    rows = F.array(row("A", "B", "C"), F.array(*words), row(if_(C("n") % 3 == 0, C("kind"), "7"), if_(C("n") % 3 == 1, C("kind"), "8"), C("kind")))
    return part(spark, d).select("k", G.name_column(rows).alias("at"))


@query("G9_unroll_drawn", f"SELECT k, CASE WHEN n % 2 = 0 THEN 'Name|Cost/' || name || '|1/' || brand || '|2/' || kind || '|3' ELSE 'Name|Cost|Name|Bulk/' || name || '|1|' || brand || '|2/' || kind || '|3||' END AS out FROM {P}")
def unroll(spark, d):
    rows = F.array(row("Name", "Cost", "Name", if_(C("n") % 2 == 0, "Cost", "Bulk")), row(C("name"), "1", C("brand"), "2"), row(C("kind"), "3", "", ""))
    return part(spark, d).select("k", G.text_of(G.unroll_repeats(rows)).alias("out"))


@query("G6_rolls_drawn", f"SELECT k, CASE WHEN n % 2 = 0 THEN '1D|A/1|' || name || '/2|' || s || '#1D|B/1|' || kind || '/2|' || brand ELSE '1D|A/1|' || name || '/2|' || s || '/3|B/4|' || kind || '/5|' || brand END AS out FROM {P}")
def split_rolls(spark, d):
    even = C("n") % 2 == 0
    rows = F.array(row("1D", "A"), row("1", C("name")), row("2", C("s")), row(if_(even, "1D", "3"), "B"), row(if_(even, "1", "4"), C("kind")), row(if_(even, "2", "5"), C("brand")))
    return part(spark, d).select("k", F.array_join(F.transform(G.split_roll_tables(rows), G.text_of), "#").alias("out"))


@query("G4_grades_drawn", f"SELECT k, CASE WHEN n % 2 = 0 THEN kind || ', Low|+' || n || '|1/' || kind || ', High|+' || (n + 2) || '|2' ELSE kind || '|+' || n || '|1' END AS out FROM {P}")
def grades(spark, d):
    even = C("n") % 2 == 0
    name = if_(even, F.concat("kind", F.lit(", Low "), "kind", F.lit(", High")), C("kind"))
    cells = row(name, if_(even, F.concat(F.lit("+"), "n", F.lit(" +"), C("n") + 2), F.concat(F.lit("+"), "n")), if_(even, "1 2", "1"))
    return part(spark, d).select("k", G.text_of(G.grade_rows(cells, 1, 0)).alias("out"))


@query("G11_pairs_drawn", f"SELECT k, CASE WHEN n % 2 = 0 THEN 'STR=' || n || ';AGL=' || (n + 1) || ';INT=3;Kind=' || kind ELSE '' END AS out FROM {P}")
def pairs(spark, d):
    rows = F.array(row("STR", "AGL"), row(C("s"), (C("n") + 1).cast("string")), row("INT", if_(C("n") % 2 == 0, "Kind", "K9")), row("3", C("kind")))
    found = F.array_join(F.transform(G.wrapped_pairs(rows), lambda p: F.concat(p["label"], F.lit("="), p["value"])), ";")
    return part(spark, d).select("k", F.coalesce(found, F.lit("")).alias("out"))


@query("G13_match_drawn", f"SELECT k, CASE WHEN contains(name, 'ring') OR contains(name, 'small') THEN 1 ELSE -1 END AS at FROM (SELECT k, name, len(list_intersect(list_distinct(string_split(name, ' ')), ['small', 'ring'])) AS hit FROM {P}) WHERE hit <> 1 UNION ALL SELECT k, -1 FROM (SELECT k, len(list_intersect(list_distinct(string_split(name, ' ')), ['small', 'ring'])) AS hit FROM {P}) WHERE hit = 1")
def match_row(spark, d):
    rows = F.array(row("Name", "Cost"), row(C("name"), "5"), row("other thing", "6"))
    return part(spark, d).select("k", F.coalesce(G.match_row(rows, F.lit("small ring")), F.lit(-1)).alias("at"))


@query("G15_transposed_drawn", f"SELECT k, '1' AS rating, '% of Hull' AS label, s || '%' AS value FROM {P} UNION ALL SELECT k, '2', '% of Hull', (n + 1) || '%' FROM {P} UNION ALL SELECT k, '1', 'TL', name FROM {P} UNION ALL SELECT k, '2', 'TL', kind FROM {P}")
def transposed(spark, d):
    rows = F.array(row("Rating", "1", "2"), row("% of Hull", F.concat("s", F.lit("%")), F.concat((C("n") + 1).cast("string"), F.lit("%"))), row("TL", C("name"), C("kind")))
    return part(spark, d).select("k", F.inline(G.named_rows(rows)))


@query("G16_column_drawn", f"SELECT k, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS cost, CASE WHEN n % 3 = 0 AND contains(name, 'red') THEN 0 WHEN n % 3 = 1 THEN -1 ELSE CASE WHEN contains(name, 'red') THEN 0 ELSE -1 END END AS red FROM (SELECT * REPLACE (CASE WHEN n % 3 = 1 THEN replace(name, 'red', 'x') ELSE name END AS name) FROM {P})")
def column_of(spark, d):
    first = if_(C("n") % 3 == 1, F.replace("name", F.lit("red"), F.lit("x")), C("name"))
    header = row(first, if_(C("n") % 3 == 0, "Total Cost", "Bulk"), if_(C("n") % 3 == 1, "COST (cr)", "Note"))
    return part(spark, d).select("k", G.column_of(header, "cost").alias("cost"), G.column_of(header, "red").alias("red"))


@query("V2_render_drawn", f"""SELECT k, rtrim(rpad('Name', CAST(w AS INTEGER), ' ') || ' | ' || rpad('Size', CAST(v AS INTEGER), ' ')) || chr(10) || repeat('-', w) || '-+-' || repeat('-', v) || chr(10) || rtrim(rpad(name, CAST(w AS INTEGER), ' ') || ' | ' || rpad(s, CAST(v AS INTEGER), ' ')) AS text
  FROM (SELECT *, greatest(4, length(name)) AS w, greatest(4, length(s)) AS v FROM {P})""")
def render_drawn(spark, d):
    return part(spark, d).select("k", render(F.array(row("Name", "Size"), row(C("name"), C("s")))).alias("text"))


# ------------------------------------------------------------------ texts
@query("H10_tables_drawn", f"SELECT k, 1 AS table_no, n AS page, 'Costs of ' || kind AS title, 'Name|Cost/' || name || '|' || s || CASE WHEN n % 2 = 0 THEN '/' || brand || '|' ELSE '' END AS grid FROM {P} UNION ALL SELECT k, 2, n, 'More', 'A|B/1|' || kind FROM {P} WHERE n % 3 = 0")
def markdown_tables(spark, d):
    text = F.concat(F.lit("[[page "), "s", F.lit("]]\n### Costs of "), "kind", F.lit("\n|Name|Cost|\n|:--|--:|\n|"), "name", F.lit("|`"), "s", F.lit("`|\n"), if_(C("n") % 2 == 0, F.concat(F.lit("|**"), "brand", F.lit("**||\n"))), F.lit("words\n"), if_(C("n") % 3 == 0, F.concat(F.lit("#### More\n|A|B|\n|---|---|\n|1|"), "kind", F.lit("|\n"))))
    lines = part(spark, d).select(C("k").alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    grid = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return H.markdown_tables(lines).select(C("doc").alias("k"), "table_no", "page", "title", grid.alias("grid"))


@query("H11_boxes_drawn", f"SELECT k, 'GLOW ' || upper(kind) AS name, 'FEAT' AS kind, n AS level, 'Range=' || s || ' feet' || CASE WHEN n % 2 = 0 THEN ';Area=' || lower(brand) || ' and more' ELSE ';Cost=' || name END AS fields, 'Light of ' || s || '.' AS description FROM (SELECT k, kind, name, brand, s, n FROM {P})")
def stat_boxes(spark, d):
    text = F.concat(F.lit("[[page 2]]\n##### **GLOW "), F.upper("kind"), F.lit(" FEAT "), "s", F.lit("**\n**Range** "), "s", F.lit(" feet; "), if_(C("n") % 2 == 0, F.concat(F.lit("**Area** "), F.lower("brand"), F.lit("\nand more")), F.concat(F.lit("**Cost** "), "name")), F.lit("\nLight of "), "s", F.lit(".\n"))
    boxes = H.stat_boxes(part(spark, d).select(C("k").alias("doc"), text.alias("text")))
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["label"], F.lit("="), f["value"])), ";")
    return boxes.select(C("doc").alias("k"), "name", "kind", C("level").cast("int").alias("level"), fields.alias("fields"), "description")


@query("S5_decode_drawn", "SELECT doc_id AS k, coalesce(text, '') || chr(65533) || '.' AS text FROM documents")
def decode(spark, d):
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("E92E")))
    files = table(spark, d, "documents").select(C("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("path"), F.lit("t").alias("modified_time"), content.alias("content"))
    return L.extract(files).select(C("file_id").cast("long").alias("k"), "text")


@query("S13_gold_drawn", "SELECT CAST(item_id AS VARCHAR) AS id, len(string_split(text, ' ')) AS facts FROM benchmark")
def gold_reader(spark, d):
    from folioscope.plans.library import _folder

    path = _folder(spark, "gold")
    entry = F.to_json(F.struct(C("item_id").cast("string").alias("id"), F.split("text", " ").alias("key_facts")))
    # a gold file for each item; a file is one JSON object
    table(spark, d, "benchmark").select("item_id", F.concat(F.lit('{"entries": ['), entry, F.lit("]}")).alias("value")).repartition(8, "item_id").write.partitionBy("item_id").text(path)
    return L.read_gold(spark, f"{path}/item_id=*").select("id", F.size("key_facts").alias("facts"))


@query("X6_recall_drawn", f"SELECT k % 7 AS doc, count(*) AS titles, count(*) FILTER (WHERE n % 4 < 3) AS found FROM {P} GROUP BY k % 7")
def heading_recall(spark, d):
    # a heading on the title's page, one or two before, or (every fourth) one after it
    p = part(spark, d).select((C("k") % 7).alias("doc"), F.concat(F.lit("Section "), "k", F.lit(" of things")).alias("title"), (C("k") * 10).cast("int").alias("page"), C("n"))
    heads = p.select("doc", F.upper("title").alias("title"), (C("page") - F.when(C("n") % 4 < 3, C("n") % 4).otherwise(-1)).cast("int").alias("page"))
    return E.heading_recall(p.select("doc", "title", "page"), heads)


# ------------------------------------------------------------------ rules
@query("Q1_requirements_drawn", """SELECT career, ord, kind, level, need, target FROM (SELECT c_custkey AS career, 0 AS ord, 'reaches' AS kind, ['A','B','C'][c_custkey % 3 + 1] AS level, 0 AS need, '' AS target FROM customer
  UNION ALL SELECT c_custkey, 1, CASE c_custkey % 4 WHEN 0 THEN 'lacks' WHEN 1 THEN 'terms' WHEN 2 THEN 'terms' ELSE 'advisory' END, CASE c_custkey % 4 WHEN 0 THEN 'D' ELSE '' END, CASE c_custkey % 4 WHEN 1 THEN 2 ELSE 0 END, CASE c_custkey % 4 WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'prison' ELSE '' END FROM customer)""")
def requirements(spark, d):
    c = table(spark, d, "customer")
    level = F.element_at(F.array(*map(F.lit, "ABC")), (C("c_custkey") % 3 + 1).cast("int"))
    other = F.element_at(F.array(F.lit("no D attribute"), F.concat(F.lit("Two terms in the "), "c_mktsegment"), F.lit("no terms in prison"), F.lit("a kind heart")), (C("c_custkey") % 4 + 1).cast("int"))
    rows = c.select(C("c_custkey").alias("career"), F.concat(F.lit("STR or AGL "), level, F.lit("+, "), other).alias("requirement"))
    return D.requirement_clauses(rows).select("career", "ord", "kind", "level", "need", "target")


_ELIGIBLE = ["INT B+", "STR and AGL C+", "no D attribute", "two terms in prison", "no terms in prison", "EMP C or D"]


@query("Q2_eligibility_drawn", """WITH a AS (SELECT c_custkey AS draft_id, c_custkey % 4 AS i, c_nationkey % 4 AS g, c_custkey % 3 AS t FROM customer)
  SELECT draft_id, career, CASE career WHEN 'INT B+' THEN i >= 2 WHEN 'STR and AGL C+' THEN g >= 1 WHEN 'no D attribute' THEN i > 0 AND g > 0 WHEN 'two terms in prison' THEN t >= 2 WHEN 'no terms in prison' THEN t = 0 ELSE true END AS eligible FROM a, (SELECT unnest(['INT B+', 'STR and AGL C+', 'no D attribute', 'two terms in prison', 'no terms in prison', 'EMP C or D']) AS career)""")
def eligibility(spark, d):
    level = lambda i: F.element_at(F.array(*map(F.lit, D.LADDER)), (i + 1).cast("int"))
    term = F.struct(F.lit("Prison").alias("name"), F.lit(False).alias("military"))
    attrs = F.create_map(F.lit("INT"), level(C("c_custkey") % 4), F.lit("AGL"), level(C("c_nationkey") % 4))
    drafts = table(spark, d, "customer").select(C("c_custkey").alias("draft_id"), attrs.alias("attrs"), F.array_repeat(term, (C("c_custkey") % 3).cast("int")).alias("history"))
    clauses = D.requirement_clauses(spark.createDataFrame([(x, x) for x in _ELIGIBLE], "career string, requirement string"))
    return D.eligibility(drafts, clauses).select("draft_id", "career", "eligible")


@query("K5_ranks_drawn", "SELECT p_size AS level, CASE WHEN p_size % 2 = 0 THEN 'Local ' || p_size ELSE 'Rank ' || p_size END AS rank FROM (SELECT DISTINCT p_size FROM part)")
def ranks(spark, d):
    levels = table(spark, d, "part").select("p_size").distinct()  # a few dozen levels in one table
    lines = levels.agg(F.array_sort(F.collect_list(F.struct("p_size", F.array(C("p_size").cast("string"), F.concat(F.lit("Rank "), "p_size"), F.lit("x"), if_(C("p_size") % 2 == 0, F.concat(F.lit("Local "), "p_size"))).alias("r")))).alias("lines"))
    header = row("Level", "US", "Soviet", "Local")
    tables = lines.select(F.lit(2).alias("ord"), F.concat(F.array(header), F.transform("lines", lambda x: x["r"])).alias("rows"))
    other = spark.createDataFrame([(1, [["x", "y"]])], "ord int, rows array<array<string>>")
    return rank_names(other.unionByName(tables), "Local")


@query("B1_catalogue_drawn", f"SELECT k, name, CASE n % 3 WHEN 0 THEN round(n / 100.0, 6) WHEN 1 THEN CAST(n AS DOUBLE) ELSE round(n / 1000000.0, 9) END AS value FROM {P}")
def catalogue(spark, d):
    cost = F.when(C("n") % 3 == 0, F.concat(F.lit("+"), "s", F.lit("%"))).when(C("n") % 3 == 1, F.concat(F.lit("MCr"), "s")).otherwise(F.concat(F.lit("Cr"), "s"))
    grid = F.array(row("Note", "Name", "Cost"), row("x", C("name"), cost))
    rows = part(spark, d).select("k", "n", F.get(grid, F.lit(0)).alias("h"), F.get(grid, F.lit(1)).alias("r"))
    cell = F.get("r", G.column_of(C("h"), "cost"))
    value = F.when(C("n") % 3 == 0, F.round(T.percent(cell), 6)).otherwise(F.round(T.money_millions(cell), 9))
    return rows.select("k", F.get("r", G.column_of(C("h"), "name")).alias("name"), value.alias("value"))


@query("B4_armour_drawn", f"SELECT k, kind AS family, suit, protection FROM (SELECT k, kind, kind || ', Light' AS suit, n AS protection FROM {P} UNION ALL SELECT k, kind, kind || ', Heavy', n + 5 FROM {P})")
def armour(spark, d):
    cells = row(F.concat("kind", F.lit(", Light "), "kind", F.lit(", Heavy")), F.concat(F.lit("+"), "s", F.lit(" +"), (C("n") + 5).cast("string")), "6 7")
    rows = part(spark, d).select("k", F.explode(G.grade_rows(cells, 1, 0)).alias("r"))
    first = F.get("r", F.lit(0))
    return rows.select("k", T.base_name(first).alias("family"), first.alias("suit"), T.first_int(F.replace(F.get("r", F.lit(1)), F.lit("+"), F.lit(""))).alias("protection"))


# ------------------------------------------------------------------ pages: one for each part
def word(i):
    """A word of the part's name."""
    return F.get(F.split("name", " "), F.lit(i))


PW = "(SELECT *, string_split(name, ' ')[1] AS w1, string_split(name, ' ')[2] AS w2 FROM " + P + ")"


def placed(spark, d, *items, style=None):
    """Words (x, y, text[, wide]) of a page for each part, with size, weight and colour for spans; null texts are not there."""
    out = []
    for x, y, text, *more in items:
        wide = more[0] if more else 20.0
        fields = [F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + wide)).alias("x1"), F.lit(float(y + 8)).alias("y1"), (F.lit(text) if isinstance(text, str) else text).alias("text")]
        if style:
            fields += [F.lit(float(more[1] if len(more) > 1 else 9.0)).alias("size"), F.lit(bool(more[2] if len(more) > 2 else False)).alias("bold"), F.lit(0).alias("color")]
        out.append(F.struct(*fields))
    rows = part(spark, d).select(F.lit("a").alias("doc"), C("k").cast("int").alias("page"), F.explode(F.array(*out)).alias("w"))
    return rows.select("doc", "page", "w.*").filter("text IS NOT NULL")


def cells(spark, d, xs, ys, wide=50.0, high=12.0):
    boxes = F.array(*(F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + wide)).alias("x1"), F.lit(float(y + high)).alias("y1")) for y in ys for x in xs))
    return part(spark, d).select(F.lit("a").alias("doc"), C("k").cast("int").alias("page"), F.explode(boxes).alias("b")).select("doc", "page", "b.*")


def _ruled(spark, d):
    even = F.when(C("n") % 2 == 0, C("kind"))
    words = placed(spark, d, (14, 102, "Name"), (64, 102, "Cost"), (14, 114, word(0)), (64, 114, C("s")), (14, 128, even), (64, 128, F.when(C("n") % 2 == 0, F.lit("9"))), (300, 102, "outside"))
    return Z.grids(cells(spark, d, (10, 60), (100, 112)), words)


@query("Z1_grids_drawn", f"SELECT 'a' AS doc, k AS page, 1 AS table_no, 'Name|Cost/' || w1 || '|' || s || CASE WHEN n % 2 = 0 THEN '/' || kind || '|9' ELSE '' END AS grid FROM {PW}")
def ruled(spark, d):
    """Ruled cells, and every second page a row that hangs below them (Z2)."""
    return _ruled(spark, d).select("doc", "page", "table_no", G.text_of(C("rows")).alias("grid"))


@query("Z3_titles_drawn", f"SELECT 'a' AS doc, k AS page, 1 AS table_no, 'Prices of ' || kind AS title FROM {PW}")
def titles(spark, d):
    spans = placed(spark, d, (10, 84, F.concat(F.lit("Prices of "), "kind"), 60, 14.0, True), (10, 60, F.concat(F.lit("some flavour "), "name"), 80, 9.0), (10, 400, "body text of the page " * 8, 290, 9.0), style=True)
    return Z.titles(_ruled(spark, d), spans)


@query("Z8_columns_drawn", f"SELECT 'a' AS doc, k AS page, 'Roll|Event/1|' || w1 || ' ' || w2 || '/2|' || kind AS grid FROM {PW}")
def unruled(spark, d):
    words = placed(spark, d, (10, 10, "Roll"), (80, 10, "Event"), (10, 22, "1"), (80, 22, word(0)), (104, 22, word(1)), (10, 34, "2"), (81, 34, C("kind")))
    return Z.unruled_grids(words).select("doc", "page", G.text_of(C("rows")).alias("grid"))


@query("Z4_shaded_drawn", f"SELECT 'a' AS doc, k AS page, 'Roll|Event/1|' || w1 || ' ' || w2 || '/2|' || kind AS grid FROM {PW}")
def shaded(spark, d):
    words = placed(spark, d, (10, 10, "Roll"), (80, 10, "Event"), (10, 22, "1"), (80, 22, word(0)), (104, 22, word(1)), (10, 34, "2"), (81, 34, C("kind")))
    return Z.shaded_grids(cells(spark, d, (5,), (8, 32), 125.0, 11.0), words).select("doc", "page", G.text_of(C("rows")).alias("grid"))


@query("Z5_side_by_side_drawn", f"SELECT 'a' AS doc, k AS page, 'Score|Mod/' || s || '|-5/' || (n + 1) || '|' || kind AS grid FROM {PW}")
def side_by_side(spark, d):
    words = placed(spark, d, (10, 10, "Score"), (60, 10, "Mod"), (110, 10, "Score"), (160, 10, "Mod"), (10, 22, C("s")), (60, 22, "-5"), (110, 22, (C("n") + 1).cast("string")), (160, 22, C("kind")))
    return Z.unruled_grids(words).select("doc", "page", G.text_of(G.unroll_repeats(C("rows"))).alias("grid"))


@query("Z6_anchored_drawn", f"SELECT 'a' AS doc, k AS page, 'CAREER|BAKER|EMT/SKILLS|' || w1 || ' ' || w2 || '|' || kind || '/GEAR|Pan|' AS grid FROM {PW}")
def anchored(spark, d):
    words = placed(spark, d, (10, 10, "CAREER"), (90, 10, "BAKER"), (160, 10, "EMT"), (10, 22, "SKILLS"), (92, 22, word(0)), (120, 22, word(1)), (161, 22, C("kind")), (10, 34, "GEAR"), (90, 34, "Pan"))
    return Z.header_anchored_grids(words).select("doc", "page", G.text_of(C("rows")).alias("grid"))


@query("Z7_cards_drawn", f"SELECT k AS doc, 'KEY Attribute' AS label, kind AS value FROM {PW} WHERE n % 3 > 0 UNION ALL SELECT k, 'Gear', name FROM {PW} WHERE n % 3 > 0")
def cards(spark, d):
    key = F.when(C("n") % 3 > 0, F.concat(F.lit("KEY ATTRIBUTE: "), "kind")).otherwise("no key")
    text = F.concat(F.lit("THE SCOUT\n"), key, F.lit("\nsome prose\nGEAR: "), "name", F.lit(" "))
    return Z.archetype_cards(part(spark, d).select(C("k").alias("doc"), text.alias("text")))


@query("Z12_boxes_drawn", f"SELECT 'a' AS doc, k AS page, 0 AS col, 1 AS box, '##### **GLOW SPELL ' || s || '**' || chr(10) || '**Range**' || chr(10) || 'A ' || name || ' fills it.' AS text FROM {PW}")
def boxes(spark, d):
    spans = placed(spark, d, (20, 50, F.concat(F.lit("GLOW SPELL "), "s"), 70, 10.0, True), (20, 62, "Range", 70, 9.0, True), (20, 74, F.concat(F.lit("A "), "name", F.lit(" fills it.")), 70, 9.0), style=True)
    return Z.spans_to_boxes(spans).select("doc", "page", "col", C("box").cast("int").alias("box"), "text")


@query("Z9_sections_drawn", f"SELECT 'a' AS doc, k AS page, 'Skills' AS label, '1 ' || w1 || ' 2 ' || w2 AS text FROM {PW} UNION ALL SELECT 'a', k, 'Mishaps', '1 ' || kind FROM {PW}")
def spread(spark, d):
    spans = placed(spark, d, (20, 50, "Skills and training", 70, 14.0, True), (20, 70, F.concat(F.lit("1 "), word(0)), 70), (20, 82, F.concat(F.lit("2 "), word(1)), 70), (320, 50, "MISHAPS", 70, 14.0, True), (320, 70, F.concat(F.lit("1 "), "kind"), 70), style=True)
    return Z.spread_sections(spans).select("doc", "page", "label", "text")
