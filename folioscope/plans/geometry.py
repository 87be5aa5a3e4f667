"""Queries of page geometry (Z), style headings (H9) and sidebar bleed (H14), on literal pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import geometry as Z
from folioscope.operators import grids as G
from folioscope.plans.base import Rows, query

BOX = "doc string, page int, x0 double, y0 double, x1 double, y1 double"
CELLS = Rows(BOX, [("a", 1, x, y, x + 50, y + 12) for y in (100.0, 112.0, 124.0, 200.0, 212.0) for x in (10.0, 60.0)])
WORDS = Rows(BOX + ", text string", [("a", 1, x + 4, y + 2, x + 20, y + 10, t) for y, row in ((100.0, ("Name", "Cost")), (112.0, ("Rope", "5")), (124.0, ("Lamp", "7")), (200.0, ("Die", "Result")), (212.0, ("1", "Fall"))) for x, t in zip((10.0, 60.0), row)] + [("a", 1, 14.0, 102.0, 30.0, 110.0, "Name"), ("a", 1, 300.0, 102.0, 330.0, 110.0, "outside")])
SPANS = Rows(BOX + ", text string, size double, bold boolean, color int", [
    ("a", 1, 10.0, 84.0, 60.0, 96.0, "Prices", 14.0, True, 0), ("a", 1, 10.0, 180.0, 80.0, 190.0, "some flavour above the table here", 9.0, False, 0),
    ("a", 1, 12.0, 150.0, 70.0, 162.0, "Falling", 12.0, True, 0), ("a", 1, 10.0, 400.0, 300.0, 410.0, "body text of the page " * 8, 9.0, False, 0),
    ("a", 2, 10.0, 70.0, 200.0, 100.0, "COMBAT", 22.0, True, 5), ("a", 2, 10.0, 400.0, 300.0, 410.0, "body text again " * 9, 9.0, False, 0),
    ("a", 5, 10.0, 70.0, 200.0, 100.0, "TRAVEL", 22.0, True, 5), ("a", 5, 10.0, 120.0, 200.0, 130.0, "NOTE", 9.0, True, 0),
])
LINES = Rows("doc string, page int, line_no int, text string", [("a", 0, i, t) for i, t in enumerate(["CONTENTS", "COMBAT", "3", "TRAVEL", "6", "GEAR", "9", "MAGIC", "12", "lower", "77"])])


@query("Z1_ruled_grids", "SELECT * FROM (VALUES ('a', 1, 1, 'Name|Cost/Rope|5/Lamp|7'), ('a', 1, 2, 'Die|Result/1|Fall')) v(doc, page, table_no, grid)")
def ruled_grids(spark, d):
    return Z.grids(CELLS.df(spark), WORDS.df(spark)).select("doc", "page", "table_no", G.text_of(F.col("rows")).alias("grid"))


@query("Z3_titles", "SELECT * FROM (VALUES ('a', 1, 1, 'Prices'), ('a', 1, 2, 'Falling')) v(doc, page, table_no, title)")
def titles(spark, d):
    return Z.titles(Z.grids(CELLS.df(spark), WORDS.df(spark)), SPANS.df(spark))


@query("Z7_archetype_cards", "SELECT * FROM (VALUES (1, 'KEY Attribute', 'STR'), (1, 'Gear', 'rope, lamp')) v(doc, label, value)")
def archetype_cards(spark, d):
    pages = spark.createDataFrame([(1, "THE SCOUT\nKEY ATTRIBUTE: STR\nsome prose\nGEAR: rope, lamp "), (2, "GEAR: none")], "doc int, text string")
    return Z.archetype_cards(pages)


@query("Z10_page_headings", "SELECT * FROM (VALUES ('a', 2, 'COMBAT'), ('a', 5, 'TRAVEL')) v(doc, page, headings)")
def page_headings(spark, d):
    return Z.page_kinds(SPANS.df(spark))


@query("Z11_contents_toc", "SELECT * FROM (VALUES ('a', 'COMBAT', 3), ('a', 'TRAVEL', 6), ('a', 'GEAR', 9), ('a', 'MAGIC', 12)) v(doc, title, page)")
def contents_toc(spark, d):
    return Z.contents_toc(LINES.df(spark), SPANS.df(spark))


@query("H9_style_levels", "SELECT * FROM (VALUES ('a', 22, true, true, 1), ('a', 14, true, false, 2), ('a', 12, true, false, 4), ('a', 9, true, false, 5)) v(doc, size, bold, colored, level)")
def style_levels(spark, d):
    return Z.style_levels(SPANS.df(spark))


BLED = Rows("id int, s string", [(1, "Make many Savage Critical 18 Shatter Defenses 6 attack Sly Step 4 now Zeal 2."), (2, "Add Five 5 feet."), (3, "")])


@query("H14_sidebar_bleed", "SELECT * FROM (VALUES (1, 'Make many attack now.'), (2, 'Add Five 5 feet.'), (3, '')) v(id, out)")
def sidebar_bleed(spark, d):
    return BLED.df(spark).select("id", Z.strip_bleed(F.col("s")).alias("out"))


def _words(rows):
    return [("a", 1, x, y, x + 20, y + 8, t) for y, line in rows for x, t in line]


TRAILING = Rows(BOX + ", text string", [*WORDS.rows, *_words([(138.0, ((14.0, "Wire"), (64.0, "9"))), (300.0, ((14.0, "far"), (64.0, "below")))])])


@query("Z2_trailing_rows", "SELECT * FROM (VALUES ('a', 1, 1, 'Name|Cost/Rope|5/Lamp|7/Wire|9'), ('a', 1, 2, 'Die|Result/1|Fall')) v(doc, page, table_no, grid)")
def trailing_rows(spark, d):
    return Z.grids(CELLS.df(spark), TRAILING.df(spark)).select("doc", "page", "table_no", G.text_of(F.col("rows")).alias("grid"))


LOOSE = Rows(BOX + ", text string", _words([(10.0, ((10.0, "Roll"), (80.0, "Event"))), (22.0, ((10.0, "1"), (80.0, "Rain"), (104.0, "falls"))), (34.0, ((10.0, "2"), (81.0, "Sun")))]))


@query("Z8_column_starts", "SELECT * FROM (VALUES ('a', 1, 'Roll|Event/1|Rain falls/2|Sun')) v(doc, page, grid)")
def column_starts(spark, d):
    return Z.unruled_grids(LOOSE.df(spark)).select("doc", "page", G.text_of(F.col("rows")).alias("grid"))


SHADES = Rows(BOX, [("a", 1, 5.0, y, 130.0, y + 11.0) for y in (8.0, 32.0)])


@query("Z4_shaded_grids", "SELECT * FROM (VALUES ('a', 1, 'Roll|Event/1|Rain falls/2|Sun')) v(doc, page, grid)")
def shaded_grids(spark, d):
    return Z.shaded_grids(SHADES.df(spark), LOOSE.df(spark)).select("doc", "page", G.text_of(F.col("rows")).alias("grid"))


PAIRED = Rows(BOX + ", text string", _words([(10.0, ((10.0, "Score"), (60.0, "Mod"), (110.0, "Score"), (160.0, "Mod"))), (22.0, ((10.0, "1"), (60.0, "-5"), (110.0, "10"), (160.0, "0")))]))


@query("Z5_side_by_side", "SELECT * FROM (VALUES ('a', 1, 'Score|Mod/1|-5/10|0')) v(doc, page, grid)")
def side_by_side(spark, d):
    return Z.unruled_grids(PAIRED.df(spark)).select("doc", "page", G.text_of(G.unroll_repeats(F.col("rows"))).alias("grid"))


BOXED = Rows(BOX + ", text string, size double, bold boolean, color int", [
    ("a", 1, 20.0, 50.0, 90.0, 60.0, "GLOW SPELL 1", 10.0, True, 0), ("a", 1, 20.0, 62.0, 90.0, 70.0, "Range", 9.0, True, 0), ("a", 1, 20.0, 74.0, 90.0, 82.0, "A light fills the area.", 9.0, False, 0),
    ("a", 1, 320.0, 40.0, 390.0, 50.0, "tail of the page before", 9.0, False, 0), ("a", 1, 320.0, 55.0, 390.0, 65.0, "SWIFT FEAT 2", 10.0, True, 0), ("a", 1, 320.0, 70.0, 390.0, 80.0, "You move.", 9.0, False, 0),
])


@query("Z12_boxes_from_spans", "SELECT * FROM (VALUES ('a', 1, 0, 1, '##### **GLOW SPELL 1**' || chr(10) || '**Range**' || chr(10) || 'A light fills the area.'), ('a', 1, 1, 1, '##### **SWIFT FEAT 2**' || chr(10) || 'You move.')) v(doc, page, col, box, text)")
def boxes_from_spans(spark, d):
    return Z.spans_to_boxes(BOXED.df(spark)).withColumn("box", F.col("box").cast("int"))


CARD = Rows(BOX + ", text string", _words([(10.0, ((10.0, "CAREER"), (90.0, "BAKER"), (160.0, "EMT"))), (22.0, ((10.0, "SKILLS"), (92.0, "Heat"), (120.0, "Lift"), (161.0, "Aid"))), (34.0, ((10.0, "GEAR"), (90.0, "Pan")))]))


@query("Z6_header_anchored", "SELECT * FROM (VALUES ('a', 1, 'CAREER|BAKER|EMT/SKILLS|Heat Lift|Aid/GEAR|Pan|')) v(doc, page, grid)")
def header_anchored(spark, d):
    return Z.header_anchored_grids(CARD.df(spark)).select("doc", "page", G.text_of(F.col("rows")).alias("grid"))


SPREAD = Rows(BOX + ", text string, size double, bold boolean, color int", [
    ("a", 1, 20.0, 50.0, 90.0, 60.0, "Skills and training", 14.0, True, 0), ("a", 1, 20.0, 70.0, 90.0, 80.0, "1 Gun", 9.0, False, 0), ("a", 1, 20.0, 82.0, 90.0, 90.0, "2 Pilot", 9.0, False, 0),
    ("a", 1, 320.0, 50.0, 390.0, 60.0, "MISHAPS", 14.0, True, 0), ("a", 1, 320.0, 70.0, 390.0, 80.0, "1 Injured", 9.0, False, 0), ("a", 1, 20.0, 200.0, 90.0, 210.0, "Mustering out", 13.0, True, 0), ("a", 1, 20.0, 220.0, 90.0, 230.0, "1 Cash", 9.0, False, 0),
])


@query("Z9_spread_sections", "SELECT * FROM (VALUES ('a', 1, 'Skills', '1 Gun 2 Pilot'), ('a', 1, 'Mishaps', '1 Injured'), ('a', 1, 'Mustering Out', '1 Cash')) v(doc, page, label, text)")
def spread_sections(spark, d):
    return Z.spread_sections(SPREAD.df(spark))
