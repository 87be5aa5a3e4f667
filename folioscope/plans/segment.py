"""Queries of segmentation (H) and of the windows it rests on (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import segment as G
from folioscope.plans.base import Rows, query, table

BOOK = """intro that goes
[[page 4]]
# TRICKS
## Loud **Things**
- **LOUD STEP:** You are heard from farther away than other walkers are.
some more words that follow the step entry in the same block
## EXAMPLE: Bo
Bo walks over the bridge and everyone hears the steps of Bo.
[[page 5]]
04 COMBAT & DAMAGE
### Index
one two three four five six seven
### Index
alpha beta gamma delta epsilon zeta"""
TABLES = """[[page 4]]
##### **Speed Steps**
|Rating Rating|1|2|
|---|---|---|
|**% of Frame**|1%|2%|

|not|a table|
[[page 5]]
### Costs
|Name|Cost|
|:--|--:|
|Rope<br>long|5|
|Lamp|`7`|
"""
BOXES = """[[page 2]]
##### **GLOW SPELL 1**
**Range** 10 feet; **Area** 5-foot burst
and more
A soft light fills the area.
##### **ODD THING 3**
ignored kind here
##### **SWIFT FEAT 2**
**Prerequisites** none **Prerequisites** other
You move. ## 5TH LEVEL
"""
DOCS = Rows("doc string, text string", [("book", BOOK), ("tables", TABLES), ("boxes", BOXES), ("plain", "no markers here at all"), ("empty", "")])

#: Pages synthesised from orders: a marker before each order of a customer.
SYNTH_SQL = "(SELECT o_custkey AS doc, string_agg('[[page ' || (o_orderkey % 97) || ']]' || chr(10) || '## ' || o_orderpriority || chr(10) || o_orderstatus || ' body ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey)"


def synth(spark, d):
    one = F.concat(F.lit("[[page "), F.col("o_orderkey") % 97, F.lit("]]\n## "), "o_orderpriority", F.lit("\n"), "o_orderstatus", F.lit(" body "), "o_orderkey")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("t")))).alias("items"))
    return rows.select("doc", F.array_join(F.transform("items", lambda x: x["t"]), "\n").alias("text"))


@query("H1_pages", rf"SELECT doc, CAST(i - 1 AS INTEGER) AS page_ord, regexp_extract_all(text, '\[\[page (\d+)\]\]', 1)[i] AS page_label, string_split_regex(text, '\[\[page \d+\]\]')[i + 1] AS page_text FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '\[\[page \d+\]\]')) + 1)) AS i FROM {SYNTH_SQL})")
def pages(spark, d):
    return G.pages(synth(spark, d))


HEADS = Rows("id int, raw string", list(enumerate(["## Loud **Things**", "04 COMBAT & DAMAGE", "plain line", "#nospace", "###### deep  ", "~~**EXAMPLE**~~", "# Worked example one", "- **SNIPER:** Gives +1 to it.", "**Ballistic Vest**: protects", "7 **NOT A**"])))


@query("H2_heading", rf"""SELECT id, CASE WHEN regexp_matches(raw, '^#{{1,6}}\s+\S') THEN length(regexp_extract(raw, '^(#{{1,6}})', 1)) WHEN regexp_matches(raw, '^\d{{2}}\s+[A-Z][A-Z0-9 &''/.\-]{{2,}}$') THEN 1 ELSE 0 END AS level,
  CASE WHEN regexp_matches(raw, '^#{{1,6}}\s+\S') THEN trim(replace(replace(regexp_extract(raw, '^#{{1,6}}\s+(.+?)\s*$', 1), '~~', ''), '**', '')) WHEN regexp_matches(raw, '^\d{{2}}\s+[A-Z]') THEN 'Combat & Damage' ELSE '' END AS title FROM {HEADS.sql}""")
def heading(spark, d):
    level, title = G.heading(F.col("raw"))
    return HEADS.df(spark).select("id", F.coalesce(level, F.lit(0)).alias("level"), F.coalesce(title, F.lit("")).alias("title"))


@query("H3_example_heading", rf"SELECT id, regexp_matches(regexp_replace(raw, '^#+\s*|[*~]', '', 'g'), '(?i)^(worked\s+)?example\b') OR (contains(raw, '~~') AND len(string_split(raw, ' ')) <= 5) AS example FROM {HEADS.sql}")
def example_heading(spark, d):
    title = F.regexp_replace("raw", r"^#+\s*|[*~]", "")
    return HEADS.df(spark).select("id", G.is_example(F.col("raw"), title).alias("example"))


@query("H4_definition", r"SELECT id, trim(regexp_extract(raw, '^[\s\-•▪◦·]*\d*\s*\*\*([A-Z0-9][^*\n]{0,38}?)(?::\*\*|\*\*:)\s*(\S.*)$', 1)) AS term, regexp_extract(raw, '^[\s\-•▪◦·]*\d*\s*\*\*([A-Z0-9][^*\n]{0,38}?)(?::\*\*|\*\*:)\s*(\S.*)$', 2) AS body FROM " + HEADS.sql)
def definition(spark, d):
    return HEADS.df(spark).select("id", F.regexp_extract("raw", G.DEFINITION, 1).alias("term"), F.regexp_extract("raw", G.DEFINITION, 2).alias("body"))


@query("H5_chunks", "SELECT * FROM (VALUES ('book', 1, 'TRICKS', 'Loud Things', 'LOUD STEP', '4', 'LOUD STEP: You are heard from farther away than other walkers are. some more words that follow the step entry in the same block'), ('book', 2, 'TRICKS', 'Loud Things', 'Example', '4', 'Bo walks over the bridge and everyone hears the steps of Bo.'), ('book', 3, 'Combat & Damage', 'Index', '', '5', 'one two three four five six seven'), ('book', 4, 'Combat & Damage', 'Index', '', '5', 'alpha beta gamma delta epsilon zeta'), ('plain', 1, '', '', '', '', 'no markers here at all')) v(doc, chunk_no, chapter, section, entry, page, text)")
def chunks(spark, d):
    return G.chunk_rows(DOCS.df(spark).filter("doc IN ('book', 'plain', 'empty')"))


@query("H5_chunk_documents")
def chunk_documents(spark, d):
    return G.chunk_rows(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("W1_breadcrumb", """WITH l AS (SELECT o_custkey AS doc, o_orderkey AS line_no, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 END AS level, o_orderstatus || o_orderkey AS title FROM orders),
  s AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN level = 1 THEN line_no END IGNORE NULLS) OVER w AS ca, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN level = 2 THEN line_no END IGNORE NULLS) OVER w AS sa FROM l WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT doc, line_no, coalesce(chapter, '') AS chapter, CASE WHEN coalesce(sa, 0) > coalesce(ca, 0) THEN section ELSE '' END AS section FROM s""")
def breadcrumb(spark, d):
    level = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("line_no"), level.alias("level"), F.concat("o_orderstatus", "o_orderkey").alias("title"), F.lit("").alias("raw"), F.lit(None).cast("string").alias("term"))
    return G.breadcrumbs(rows).select("doc", "line_no", "chapter", "section")


@query("W8_word_budget", r"""WITH RECURSIVE l AS (SELECT doc_id, len(regexp_extract_all(line, '[^\s]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  f AS (SELECT doc_id, i, 0 AS seg, n AS s FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN f.s >= 110 THEN f.seg + 1 ELSE f.seg END, CASE WHEN f.s >= 110 THEN l.n ELSE f.s + l.n END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
  SELECT doc_id, count(DISTINCT seg) AS segments, CAST(sum(seg) AS BIGINT) AS seg_sum FROM f GROUP BY doc_id""")
def word_budget(spark, d):
    counts = F.transform(F.split("text", "\n"), lambda x: F.size(T.words(x)))
    seg = G.greedy_segments(counts)
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(seg)).cast("long").alias("segments"), F.aggregate(seg, F.lit(0).cast("long"), lambda a, x: a + x).alias("seg_sum"))


NOISY = Rows("doc string, line_no int, raw string", [("a", 1, "# Credits"), ("a", 2, "## 83"), ("a", 3, "## Introduction"), ("a", 4, "## NTRODUCTION"), ("a", 5, "### one two three four five six seven eight nine"), ("a", 6, "body"), *[("b", i, "## MAINTENANCE COST") for i in range(1, 43)], ("b", 50, "## Other"), ("b", 51, "# Ther")])
_SHOWN = r"CASE WHEN regexp_matches(raw, '^#{1,6}\s+.*\S\s*$') THEN trim(regexp_replace(regexp_replace(raw, '^#{1,6}\s+', ''), '[*_`#]', '', 'g')) END"


@query("H7_demote_noise", f"SELECT doc, line_no FROM (SELECT *, count(*) OVER (PARTITION BY doc, lower(shown)) AS n FROM (SELECT *, {_SHOWN} AS shown FROM {NOISY.sql}) WHERE shown IS NOT NULL) WHERE NOT regexp_matches(shown, '[A-Za-z]') OR len(string_split(shown, ' ')) > 8 OR length(shown) > 80 OR n > 40 OR lower(shown) IN ({', '.join(repr(x) for x in G.FRONT_MATTER)})")
def demote_noise(spark, d):
    return G.demoted_headings(NOISY.df(spark)).filter("noise").select("doc", "line_no")


@query("H6_drop_caps", f"WITH h AS (SELECT doc, line_no, lower({_SHOWN}) AS t FROM {NOISY.sql}) SELECT doc, line_no FROM h WHERE length(t) >= 4 AND EXISTS (SELECT 1 FROM h o WHERE o.doc = h.doc AND substr(o.t, 2) = h.t)")
def drop_caps(spark, d):
    return G.drop_cap_fragments(NOISY.df(spark)).select("doc", "line_no")


@query("J10_drop_cap_semi_join", f"WITH h AS (SELECT doc, lower({_SHOWN}) AS t FROM {NOISY.sql}) SELECT count(*) AS n FROM h WHERE length(t) >= 4 AND t IN (SELECT substr(o.t, 2) FROM h o WHERE o.doc = h.doc)")
def drop_cap_semi(spark, d):
    return G.drop_cap_fragments(NOISY.df(spark)).agg(F.count("*").alias("n"))


TOC = Rows("doc string, level int, title string, page int", [("book", 1, "Loud Things", 1), ("book", 1, "The Bridge", 1), ("book", 9, "Index", 2), ("book", 2, "Missing page", 9), ("book", 2, " ", 1)])


@query("H8_inject_toc", "SELECT * FROM (VALUES ('book', 0, 1, 'The Bridge')) v(doc, page_ord, level, title)")
def inject_toc(spark, d):
    return G.inject_toc(G.pages(DOCS.df(spark).filter("doc = 'book'")), TOC.df(spark))


@query("H10_markdown_tables", "SELECT * FROM (VALUES ('tables', 1, 4, 'Speed Steps', 'Rating|1|2/% of Frame|1%|2%'), ('tables', 2, 5, 'Costs', 'Name|Cost/Rope long|5/Lamp|7')) v(doc, table_no, page, title, grid)")
def markdown_tables(spark, d):
    numbered = DOCS.df(spark).filter("doc = 'tables'").select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return G.markdown_tables(numbered).select("doc", "table_no", "page", "title", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("grid"))


@query("H11_stat_boxes", "SELECT * FROM (VALUES ('boxes', 1, 'GLOW', 'SPELL', 'spell', 1, 'Range=10 feet;Area=5-foot burst and more', 'A soft light fills the area. ##### **ODD THING 3** ignored kind here'), ('boxes', 2, 'SWIFT', 'FEAT', 'feat', 2, 'Prerequisites=none', 'You move.')) v(doc, box_no, name, kind, category, level, fields, description)".replace(" ##### **ODD THING 3** ignored kind here", ""))
def stat_boxes(spark, d):
    fields = F.array_join(F.transform("fields", lambda p: F.concat(p["label"], F.lit("="), p["value"])), ";")
    return G.stat_boxes(DOCS.df(spark).filter("doc = 'boxes'")).withColumn("fields", fields)


KINDS = Rows("doc int, kind string", [(i % 3, k) for i, k in enumerate(["SPELL", "HAZARD", "RUNE", "HAZARD", "FEAT", "RUNE"] * 4 + ["ODD"])])


@query("H12_accepted_kinds", f"SELECT doc, kind, count(*) AS n FROM {KINDS.sql} GROUP BY doc, kind HAVING count(*) >= 3 OR kind IN ('SPELL', 'CANTRIP', 'FOCUS', 'RITUAL', 'FEAT')")
def accepted_kinds(spark, d):
    return KINDS.df(spark).groupBy("doc", "kind").agg(F.count("*").alias("n")).filter((F.col("n") >= G.KIND_REPEATS) | F.col("kind").isin(G.BOX_KINDS))


#: Class and ancestry traits that mark a recovered heading (fixed values).
TRAITS = "BARBARIAN BARD CHAMPION CLERIC DRUID FIGHTER MONK RANGER ROGUE SORCERER WIZARD ALCHEMIST DWARF ELF GNOME GOBLIN HALFLING HUMAN".split()
FEATS = Rows("doc int, line_no int, raw string", [(1, 1, "**CAVE CLIMBER**"), (1, 2, ""), (1, 3, "**DWARF** text"), (1, 4, "**RAGE**"), (1, 5, "nothing"), (1, 6, "**CAVE CLIMBER**"), (1, 7, "**ELF**"), (2, 1, "**LONE NAME**")])
_TRAIT_SQL = "(" + "|".join(TRAITS) + ")"


@query("H13_recovered_headings", rf"SELECT doc, line_no, name FROM (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY line_no) AS r FROM (SELECT doc, line_no, regexp_extract(raw, '^\*\*([A-Z][A-Z0-9 ,''\-]{{2,44}})\*\*$', 1) AS name, lead(raw) OVER (PARTITION BY doc ORDER BY line_no) AS nxt FROM {FEATS.sql} WHERE raw <> '') WHERE name <> '' AND NOT regexp_matches(name, '^{_TRAIT_SQL}$') AND regexp_matches(nxt, '\*\*{_TRAIT_SQL}\*\*')) WHERE r = 1")
def recovered_headings(spark, d):
    order = Window.partitionBy("doc").orderBy("line_no")
    rows = FEATS.df(spark).filter("raw <> ''").withColumn("nxt", F.lead("raw").over(order)).withColumn("name", F.regexp_extract("raw", r"^\*\*([A-Z][A-Z0-9 ,'’\-]{2,44})\*\*$", 1))
    rows = rows.filter((F.col("name") != "") & ~F.col("name").isin(TRAITS) & F.col("nxt").rlike(r"\*\*(" + "|".join(TRAITS) + r")\*\*"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("doc", "name").orderBy("line_no"))).filter("r = 1").select("doc", "line_no", "name")


@query("H15_page_at", r"SELECT doc, line_no, coalesce(last_value(TRY_CAST(nullif(regexp_extract(raw, '\[\[page (\d+)\]\]', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS page FROM (SELECT doc, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM " + SYNTH_SQL + ")")
def page_at(spark, d):
    rows = synth(spark, d).select("doc", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("doc", (F.col("at") + 1).alias("line_no"), "raw")
    return G.page_of_lines(rows).select("doc", "line_no", F.coalesce("page", F.lit(-1)).alias("page"))


CHILD = Rows("doc int, text string", [(1, "CHILDHOOD 1. Street kid 2. Farm 3. Small town SKILLS a, b; c, d; e, f END"), (2, "no such block")])


@query("H16_childhood", r"SELECT doc, CAST(i AS INTEGER) AS roll, trim(string_split_regex(regexp_extract(text, 'CHILDHOOD (.*) SKILLS', 1), '\d\.')[i + 1]) <> '' AS named, trim(string_split(regexp_extract(text, 'SKILLS (.*) END', 1), ';')[i]) AS skills FROM " + CHILD.sql + ", range(1, 4) t(i) WHERE contains(text, 'CHILDHOOD')")
def childhood(spark, d):
    block = F.regexp_extract("text", r"CHILDHOOD (.*) SKILLS", 1)
    names = F.transform(F.slice(F.split(block, r"\d\."), 2, 6), T.trim_all)
    skills = F.transform(F.split(F.regexp_extract("text", "SKILLS (.*) END", 1), ";"), T.trim_all)
    rows = CHILD.df(spark).filter((F.size(names) == F.size(skills)) & F.col("text").contains("CHILDHOOD"))  # all or nothing
    zipped = F.posexplode(F.arrays_zip(names.alias("n"), skills.alias("s"))).alias("at", "z")
    return rows.select("doc", zipped).select("doc", (F.col("at") + 1).alias("roll"), (F.col("z.n") != "").alias("named"), F.col("z.s").alias("skills"))


AUX = Rows("game string, ord int, childhood string, ranks string", [("T", 1, "a", None), ("T", 2, None, "r1"), ("T", 3, "b", None), ("U", 1, None, None)])


@query("H17_prose_hook", f"SELECT game, coalesce(arg_max(childhood, ord) FILTER (WHERE childhood IS NOT NULL), '') AS childhood, coalesce(arg_max(ranks, ord) FILTER (WHERE ranks IS NOT NULL), '') AS ranks FROM {AUX.sql} GROUP BY game")
def prose_hook(spark, d):
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))), F.lit("")).alias(c)
    return AUX.df(spark).groupBy("game").agg(last("childhood"), last("ranks"))


@query("W2_next_bound", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey + 2) AS upto FROM orders")
def next_bound(spark, d):
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(nxt, F.col("o_orderkey") + 2).alias("upto"))


def anchored_groups(values, tolerance: float):
    """Group number of each value of a sorted array: a new group once a value is beyond the group's first by more than the tolerance."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("g"), F.lit(None).cast("double").alias("a"))

    def step(acc, x):
        new = acc["a"].isNull() | (x - acc["a"] > tolerance)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.concat(acc["ids"], F.array(g)).alias("ids"), g.alias("g"), F.when(new, x).otherwise(acc["a"]).alias("a"))

    return F.aggregate(values, start, step, lambda acc: acc["ids"])


@query("W3_anchor_clusters", """WITH RECURSIVE v AS (SELECT s_nationkey AS k, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS i FROM supplier),
  f AS (SELECT k, i, x AS a, 0 AS g FROM v WHERE i = 1 UNION ALL SELECT v.k, v.i, CASE WHEN v.x - f.a > 900 THEN v.x ELSE f.a END, CASE WHEN v.x - f.a > 900 THEN f.g + 1 ELSE f.g END FROM f JOIN v ON v.k = f.k AND v.i = f.i + 1)
  SELECT k, count(DISTINCT g) AS clusters, count(*) AS n FROM f GROUP BY k""")
def anchor_clusters(spark, d):
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sort_array(F.collect_list("s_acctbal")).alias("x"))
    return rows.select("k", F.size(F.array_distinct(anchored_groups(F.col("x"), 900.0))).cast("long").alias("clusters"), F.size("x").cast("long").alias("n"))


@query("W4_rank_levels", "SELECT p_partkey, CAST(1 + (dr - 1) * 6 // m AS INTEGER) AS level FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_size DESC) AS dr, (SELECT count(DISTINCT p_size) FROM part) AS m FROM part)")
def rank_levels(spark, d):
    p = table(spark, d, "part")
    sizes = p.select("p_size").distinct()  # a few dozen rows
    ranked = sizes.select("p_size", F.dense_rank().over(Window.orderBy(F.desc("p_size"))).alias("dr")).crossJoin(sizes.agg(F.count("*").alias("m")))
    return p.join(ranked, "p_size").select("p_partkey", (1 + F.floor((F.col("dr") - 1) * 6 / F.col("m"))).cast("int").alias("level"))


@query("W5_first_per_key", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_per_key(spark, d):
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r = 1").select("p_name", "p_partkey")


@query("W6_numbering", "SELECT o_orderkey, CASE WHEN r = 1 THEN o_orderstatus ELSE o_orderstatus || ' (' || r || ')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders)")
def numbering(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    label = F.when(F.col("r") == 1, F.col("o_orderstatus")).otherwise(F.concat("o_orderstatus", F.lit(" ("), "r", F.lit(")")))
    return table(spark, d, "orders").withColumn("r", r).select("o_orderkey", label.alias("label"))


@query("W7_family_islands", "SELECT o_custkey, island, min(o_orderstatus) AS family, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> o_orderstatus THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS island FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)) GROUP BY o_custkey, island")
def family_islands(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    new = (~F.lag("o_orderstatus").over(w).eqNullSafe(F.col("o_orderstatus"))).cast("long")
    rows = table(spark, d, "orders").withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("o_custkey", "island").agg(F.min("o_orderstatus").alias("family"), F.count("*").alias("n"))
