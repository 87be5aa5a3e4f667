"""Queries of the joins (J) and careers (K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import careers as K
from folioscope.operators import joins as J
from folioscope.operators import routes as R
from folioscope.plans.base import Rows, query, table

CELLS_SQL = "(SELECT p_partkey AS id, p_brand AS key, p_size % 3 = 0 AS md, [upper(p_name), p_type, CAST(p_size AS VARCHAR)] AS cells FROM part)"


def _cells(spark, d):
    cells = F.array(F.upper("p_name"), "p_type", F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), (F.col("p_size") % 3 == 0).alias("md"), cells.alias("cells"))


@query("J3_anti_overlap", f"SELECT id FROM {CELLS_SQL} a WHERE NOT md AND NOT EXISTS (SELECT 1 FROM {CELLS_SQL} b WHERE b.md AND b.key = a.key AND 2 * len(list_intersect(a.cells, b.cells)) >= len(a.cells))")
def anti_overlap(spark, d):
    rows = _cells(spark, d)
    return J.anti_overlap(rows.filter("NOT md"), rows.filter("md"))


ANCHORS_SQL = "(SELECT o_custkey AS key, o_orderkey AS name, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS page FROM orders)"
TABLES_SQL = "(SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS ord, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS page FROM lineitem)"


def _page(c):
    return F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))


@query("J4_interval_owner", f"""SELECT key, name, ord, CAST(n AS INTEGER) AS n FROM (SELECT t.key, a.name, t.ord, row_number() OVER (PARTITION BY t.key, a.name, a.page ORDER BY t.page, t.ord) AS n
  FROM (SELECT *, coalesce(lead(page) OVER (PARTITION BY key ORDER BY page, name), page + 2) AS upto FROM {ANCHORS_SQL}) a JOIN {TABLES_SQL} t ON t.key = a.key AND t.page >= a.page AND t.page < a.upto) WHERE n <= 8""")
def interval_owner(spark, d):
    anchors = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("name"), _page("o_orderdate").alias("page"))
    tables = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), _page("l_shipdate").alias("page"))
    return K.owned_tables(anchors, tables).select("key", "name", "ord", "n")


@query("J5_graft_siblings", "SELECT p_brand AS key, p_size AS width, p_partkey AS id, coalesce((SELECT min(s.p_partkey) FROM part s WHERE s.p_brand = p.p_brand AND s.p_size = p.p_size AND s.p_type = 'SMALL' AND s.p_partkey <> p.p_partkey), -1) AS sibling FROM part p")
def graft(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("width"), F.col("p_partkey").alias("id"), "p_type")
    return K.graft(rows.drop("p_type").distinct(), rows.filter("p_type = 'SMALL'")).withColumn("sibling", F.coalesce("sibling", F.lit(-1)))


@query("J6_asof", "SELECT e.event_id, coalesce(s.event_id, -1) AS signup FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts")
def asof(spark, d):
    until = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(until)
    return table(spark, d, "events").select("event_id", F.coalesce(last, F.lit(-1)).alias("signup"))


@query("J7_first_heading", "SELECT l.l_orderkey, l.l_linenumber, h.name FROM lineitem l JOIN (SELECT p_size AS page, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_size) h ON h.page = CAST(l.l_quantity AS INTEGER)")
def first_heading(spark, d):
    heads = table(spark, d, "part").select(F.col("p_size").alias("page"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("page"))
    return J.first_on_page(rows, heads).select("l_orderkey", "l_linenumber", "name")


CHILD = Rows("page int, ord int, rows array<array<string>>", [(5, 1, [["", "A", "B"], ["1", "x", "y"]]), (5, 2, [["", "A", "B", "C"], ["1", "p", "q", "r"], ["2", "s", "t", "u"]]), (6, 1, [["", "A", "B", "C"], ["1", "n", "o", "p"]])])


@query("J8_column_alignment", "SELECT * FROM (VALUES (1, 'p'), (1, 's'), (2, 'q'), (2, 't'), (3, 'r'), (3, 'u')) v(col, value)")
def column_alignment(spark, d):
    first = CHILD.df(spark).filter((F.col("page") == 5) & (F.size(F.get("rows", F.lit(0))) == 4)).orderBy("ord").limit(1)
    data = first.select(F.explode(F.slice("rows", 2, 1 << 20)).alias("r")).select(F.posexplode("r").alias("col", "value"))
    return data.filter("col > 0")


@query("J9_replace_on_pages", "SELECT l_orderkey AS k, l_linenumber AS line, 'old' AS side FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'F'")
def replace_on_pages(spark, d):
    new = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"))
    return J.replace_by_key(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line")), new, ["k"])


GOLD = Rows("gold int, cells array<string>, page int", [(1, ["small", "ring"], 3), (2, ["red", "widget"], 40), (3, ["nothing"], 1)])


@query("J11_gold_containment", f"SELECT gold, p_partkey FROM (SELECT gold, p_partkey, row_number() OVER (PARTITION BY gold ORDER BY p_size = page DESC, p_partkey) AS r FROM {GOLD.sql}, part WHERE len(list_filter(cells, lambda c: list_contains(string_split(p_name, ' '), c))) = len(cells)) WHERE r = 1")
def gold_containment(spark, d):
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("cells"), F.col("p_size").alias("page"))
    return J.contained_best(GOLD.df(spark).withColumnRenamed("gold", "wanted"), cells).select(F.col("wanted").alias("gold"), F.col("id").alias("p_partkey"))


LABELS = Rows("label string", [("src1 en",), ("de only",), ("nothing here",)])


@query("J12_label_match", f"SELECT label, coalesce(arg_max(game, n * 1000 - ord) FILTER (WHERE n > 0), 'none') AS game FROM (SELECT label, g.game, g.ord, len(list_intersect(string_split(label, ' '), [g.game])) AS n FROM {LABELS.sql}, (SELECT lang AS game, row_number() OVER (ORDER BY lang) AS ord FROM (SELECT DISTINCT lang FROM documents)) g) GROUP BY label")
def label_match(spark, d):
    games = table(spark, d, "documents").select(F.col("lang").alias("name"))
    return J.best_label(LABELS.df(spark), games, "none").withColumnRenamed("name", "game")


BRACKETS = Rows("upto int, tons int", [(10, 1), (20, 3), (40, 6)])


@query("J13_bracket", f"SELECT p_partkey, coalesce((SELECT arg_min(tons, upto) FROM {BRACKETS.sql} WHERE upto >= p_size), 6) AS tons FROM part")
def bracket(spark, d):
    return J.bracket(table(spark, d, "part"), F.col("p_size"), BRACKETS.rows, "tons").select("p_partkey", "tons")


@query("J14_first_by_name", "SELECT l.l_orderkey, l.l_linenumber, f.p_partkey FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) f ON f.p_name = p.p_name")
def first_by_name(spark, d):
    named = J.first_by_name(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(named, F.col("l_partkey") == F.col("id")).select("l_orderkey", "l_linenumber", F.col("first").alias("p_partkey"))


@query("J15_merge_sections", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey, lower(o_orderpriority) ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def merge_sections(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("game"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"))
    return K.merge_sections(rows).select(F.col("ord").alias("o_orderkey"))


@query("J17_history", "SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS served, coalesce(max(o_orderpriority), '') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def history(spark, d):
    terms = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderstatus") == "F").alias("counts"), F.col("o_orderpriority").alias("rank"))
    return J.with_history(table(spark, d, "customer").select(F.col("c_custkey").alias("person")), terms).withColumnRenamed("person", "c_custkey")


@query("J18_chrome_fonts", "SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE lower(p_name) IN (SELECT DISTINCT lower(p_name) FROM part WHERE p_type = 'PROMO' AND p_size < 3))")
def chrome_fonts(spark, d):
    spans = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("font"), F.col("p_name").alias("text"), "p_type", "p_size")
    return J.without_chrome(spans, spans.filter("p_type = 'PROMO' AND p_size < 3").select("text")).select("p_partkey")


# ------------------------------------------------------------------ K
CARDS = Rows("card int, rows array<array<string>>", [
    (1, [["CAREER", "BAKER", "EMT"], ["SKILLS", "Heat, Lift", "Aid"], ["STARTING GEAR", "Pan", ""], ["", "Apron", "Bag"], ["SPECIALITIES (D6)", "", ""], ["1", "Crust", "Splint"], ["2", "Dough", ""]]),
    (2, [["1", "Roll", "Other"], ["2", "x", "y"]]),
    (3, [["LAST CAREER", "Alpha"], ["X", "y"]]),
])


@query("K1_unpivot_card", "SELECT * FROM (VALUES (1, 'Baker', 'Skills', 'Heat, Lift', ''), (1, 'Baker', 'Starting Gear', 'Pan, Apron', ''), (1, 'Baker', 'Specialities (D6)', '', '1=Crust|2=Dough'), (1, 'EMT', 'Skills', 'Aid', ''), (1, 'EMT', 'Starting Gear', 'Bag', ''), (1, 'EMT', 'Specialities (D6)', '', '1=Splint')) v(card, name, label, text, options)")
def unpivot_card(spark, d):
    return K.card_sections(CARDS.df(spark)).select("card", "name", F.replace("label", F.lit("(d6)"), F.lit("(D6)")).alias("label"), "text", F.array_join("options", "|").alias("options"))


@query("K2_detect_careers", "SELECT * FROM (VALUES ('G', 'Baker', 3), ('G', 'EMT', 3)) v(game, name, sections)")
def detect_careers(spark, d):
    sections = K.card_sections(CARDS.df(spark)).withColumn("game", F.lit("G"))
    twice = sections.withColumn("ord", F.col("ord") + 100).unionByName(sections)
    return K.merge_sections(twice).groupBy("game", "name").agg(F.count("*").cast("int").alias("sections"))


@query("K3_numbered_sections", f"SELECT key, name, ord, CASE WHEN n = 1 THEN 'Skills' ELSE 'Skills (' || n || ')' END AS label FROM (SELECT t.key, a.name, t.ord, row_number() OVER (PARTITION BY t.key, a.name, a.page ORDER BY t.page, t.ord) AS n FROM (SELECT *, coalesce(lead(page) OVER (PARTITION BY key ORDER BY page, name), page + 2) AS upto FROM {ANCHORS_SQL}) a JOIN {TABLES_SQL} t ON t.key = a.key AND t.page >= a.page AND t.page < a.upto) WHERE n <= 8")
def numbered_sections(spark, d):
    owned = interval_owner(spark, d)
    return owned.select("key", "name", "ord", F.when(F.col("n") == 1, "Skills").otherwise(F.concat(F.lit("Skills ("), "n", F.lit(")"))).alias("label"))


@query("K4_typed_columns", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority LIKE '%HIGH%') AS skills, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority LIKE '%LOW%') AS gear FROM orders GROUP BY o_custkey HAVING skills IS NOT NULL AND gear IS NOT NULL")
def typed_columns(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("career"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    found = K.typed_columns(rows, {"skills": ("HIGH", "label"), "gear": ("LOW", "o_orderstatus")})
    return found.withColumnRenamed("career", "o_custkey")


RANK_TABLE = Rows("ord int, rows array<array<string>>", [(1, [["x", "y"]]), (2, [["Level", "US", "Soviet", "Local"], ["1", "Private", "Ryadovoi", ""], ["2", "Corporal", "Yefreitor", "Kapral"]])])


@query("K5_rank_names", "SELECT * FROM (VALUES (1, 'Private'), (2, 'Kapral')) v(level, rank)")
def rank_names(spark, d):
    return K.rank_names(RANK_TABLE.df(spark), "Local")


HITS = Rows("chunk_id int, section string, locator string, text string, score double", [(1, "A › Baker", "p. 1", "baker term  and rank", 2.0), (2, "B", "p. 2", "the baker cooks", 9.0), (3, "A › Baker", "p. 1", "baker again", 5.0), (4, "C", "p. 3", "nothing", 99.0)])


@query("K6_assemble", "SELECT * FROM (VALUES (1, 'Baker · p. 1', 'baker term and rank'), (2, 'B · p. 2', 'the baker cooks')) v(ord, label, text)")
def assemble(spark, d):
    return K.assemble(HITS.df(spark), "Baker")


#: A card a customer: two careers named after its segment and key, some blank cells.
CARD_SQL = "(SELECT c_custkey AS card, 'Segment ' || lower(c_mktsegment) AS one, 'Guild of ' || c_nationkey AS two, 'skill ' || c_custkey % 5 AS s1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'skill ' || c_custkey % 7 END AS s2, 'Pan ' || c_custkey % 4 AS g1, 'Bag' AS g2, CASE WHEN c_custkey % 2 = 0 THEN 'Apron' ELSE '' END AS h1 FROM customer)"


def _cards(spark, d):
    c = table(spark, d, "customer")
    one, two = F.concat(F.lit("Segment "), F.lower("c_mktsegment")), F.concat(F.lit("Guild of "), "c_nationkey")
    s1, s2 = F.concat(F.lit("skill "), F.col("c_custkey") % 5), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("skill "), F.col("c_custkey") % 7))
    rows = F.array(F.array(F.lit("CAREER"), one, two), F.array(F.lit("SKILLS"), s1, s2), F.array(F.lit("STARTING GEAR"), F.concat(F.lit("Pan "), F.col("c_custkey") % 4), F.lit("Bag")), F.array(F.lit(""), F.when(F.col("c_custkey") % 2 == 0, "Apron").otherwise(""), F.lit("")))
    return c.select(F.col("c_custkey").alias("chunk_id"), F.lit("G").alias("game"), F.lit("card").alias("category"), rows.alias("rows"))


_SECTIONS_SQL = f"""(SELECT card, name, ord, label, text FROM (SELECT card, one AS name, 1 AS ord, 'Skills' AS label, s1 AS text FROM {CARD_SQL} UNION ALL SELECT card, one, 2, 'Starting Gear', g1 || CASE WHEN h1 <> '' THEN ', ' || h1 ELSE '' END FROM {CARD_SQL} UNION ALL SELECT card, two, 1, 'Skills', s2 FROM {CARD_SQL} UNION ALL SELECT card, two, 2, 'Starting Gear', g2 FROM {CARD_SQL}) WHERE text <> '')"""


@query("K1_unpivot_drawn", f"SELECT card, name, CAST(ord AS BIGINT) AS ord, label, text FROM {_SECTIONS_SQL}")
def unpivot_drawn(spark, d):
    return K.card_sections(_cards(spark, d).select(F.col("chunk_id").alias("card"), "rows")).select("card", "name", F.col("ord").cast("long").alias("ord"), "label", "text")


@query("K2_careers_of_cards", f"SELECT name, label, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), label ORDER BY card, ord) AS r FROM {_SECTIONS_SQL}) WHERE r = 1")
def careers_of_cards(spark, d):
    return R.structured_careers(_cards(spark, d)).select("name", "label", "text")


@query("R8_find_career", f"SELECT 'structured' AS how, CAST(row_number() OVER (ORDER BY card, ord) AS INTEGER) AS ord, label, text FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY card, ord) AS r FROM {_SECTIONS_SQL} WHERE lower(name) = 'guild of 3') WHERE r = 1")
def find_career(spark, d):
    return R.find_career(_cards(spark, d), {}, "G", "guild OF 3")


@query("R8_assembled_career", """SELECT 'assembled' AS how, CAST(row_number() OVER (ORDER BY signal DESC, score DESC, chunk_id) AS INTEGER) AS ord, label, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 600) AS text FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY signal DESC, score DESC, chunk_id) AS r FROM (
  SELECT chunk_id, score, text, section || ' · ' || 'p. 1' AS label, regexp_matches(section || ' ' || left(text, 400), '(?i)\\b(qualif|surviv|advance|muster|rank|assignment|specialist|service skill|personal development|career|term)\\b') AS signal FROM (SELECT doc_id AS chunk_id, CAST(n_chars AS DOUBLE) AS score, source || ' the' AS section, text FROM documents) WHERE contains(lower(section || ' ' || left(text, 500)), 'the'))) WHERE r = 1 ORDER BY signal DESC, score DESC, chunk_id LIMIT 5""")
def assembled_career(spark, d):
    docs = table(spark, d, "documents")
    hits = docs.select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"), F.concat("source", F.lit(" the")).alias("section"), F.lit("p. 1").alias("locator"), "text")
    return K.assemble(hits, "the").select(F.lit("assembled").alias("how"), "ord", "label", "text")


@query("A10_upper_median", "SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS med FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, d):
    by = Window.partitionBy("l_suppkey")
    place = F.row_number().over(by.orderBy("l_quantity"))
    ranked = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("med"), place.alias("r"), F.count("l_quantity").over(by).alias("n"))
    return ranked.filter(F.col("r") == F.floor(F.col("n") / 2) + 1).select("l_suppkey", "med")


@query("A9_having_gates", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 40")
def having_gates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).filter("n > 40")


@query("A8_style_histogram", "SELECT l_returnflag, arg_min(l_quantity, -n * 1000 + l_quantity) AS body, CAST(max(n) AS BIGINT) AS chars FROM (SELECT l_returnflag, l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_quantity) GROUP BY l_returnflag")
def style_histogram(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.sum("l_linenumber").alias("n"))
    return by.groupBy("l_returnflag").agg(F.min_by("l_quantity", F.struct(-F.col("n"), "l_quantity")).alias("body"), F.max("n").alias("chars"))


@query("A13_budget_sums", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS slots, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY l_orderkey")
def budget_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("slots"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


