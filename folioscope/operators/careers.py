"""Careers from column cards and from pages that an anchor owns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

D6 = r"(?i)\(?\bd6\)?"
SECTIONS_KEPT, LAST_PAGES = 8, 2
SIGNAL = r"(?i)\b(qualif|surviv|advance|muster|rank|assignment|specialist|service skill|personal development|career|term)\b"


def looks_like_name(c: Column) -> Column:
    s = T.trim_all(F.coalesce(c, F.lit("")))
    return (s != "") & ~s.rlike(r"^\d{1,2}$") & ~s.rlike(D6) & s.rlike("[A-Za-z]{2,}")


def card_cells(cards: DataFrame) -> DataFrame:
    """card, col, row, label, value: a card's cells by named column, in row order (an unpivot)."""
    header = F.get("rows", F.lit(0))
    first = T.trim_all(F.coalesce(F.get(header, F.lit(0)), F.lit("")))
    good = (F.size("rows") >= 2) & ~first.rlike(r"^\d{1,2}$") & ~first.rlike(D6) & ~F.upper(first).startswith("LAST CAREER")
    named = cards.filter(good).select("card", "rows", F.posexplode(header).alias("col", "name")).filter((F.col("col") > 0) & looks_like_name(F.col("name")))
    cells = named.select("card", "col", T.acronym_title(F.col("name")).alias("name"), F.posexplode(F.slice(F.col("rows"), F.lit(2), F.size("rows") - 1)).alias("row", "r"))
    return cells.select("card", "col", "name", "row", T.trim_all(F.coalesce(F.get("r", F.lit(0)), F.lit(""))).alias("label"), T.trim_all(F.coalesce(F.get("r", F.col("col")), F.lit(""))).alias("value"))


def card_sections(cards: DataFrame) -> DataFrame:
    """card, name, ord, label, text, options: the sections of every career on the cards (card, rows).

    A blank label continues the field above; numbered rows under a D6 label are
    that career's options; sections without content go.
    """
    column = Window.partitionBy("card", "col").orderBy("row")
    cells = card_cells(cards).withColumn("die", F.col("label").rlike(D6)).withColumn("number", F.col("label").rlike(r"^\d{1,2}$"))
    rolled = F.last(F.when(F.col("label") != "", F.when(F.col("die"), 1).when(F.col("number"), None).otherwise(0)), ignorenulls=True).over(column)
    cells = cells.withColumn("rolled", F.coalesce(rolled, F.lit(0)) == 1).withColumn("option", F.col("rolled") & F.col("number"))
    opens = (F.col("label") != "") & ~F.col("option")
    cells = cells.withColumn("field", F.sum(opens.cast("int")).over(column))
    item = F.struct("row", "value", "label")
    grouped = cells.groupBy("card", "col", "name", F.col("field").alias("ord")).agg(
        F.array_sort(F.collect_list(F.when((F.col("value") != "") & ~F.col("option") & ~F.col("die"), item))).alias("parts"),
        F.array_sort(F.collect_list(F.when((F.col("value") != "") & F.col("option"), item))).alias("rolls"),
        F.max(F.when(opens, F.col("label"))).alias("label"),
    )
    text = F.array_join(F.transform("parts", lambda x: x["value"]), ", ")
    options = F.transform("rolls", lambda x: F.concat(x["label"], F.lit("="), x["value"]))
    out = grouped.select("card", "name", "ord", T.acronym_title(F.coalesce("label", F.lit(""))).alias("label"), text.alias("text"), options.alias("options"))
    return out.filter((F.col("text") != "") | (F.size("options") > 0))


def owned_tables(anchors: DataFrame, tables: DataFrame, keep: int = SECTIONS_KEPT) -> DataFrame:
    """Each anchor (key, name, page) owns the tables (key, page, ord) up to the next anchor's page; the last one its own and the next page.

    One pass in the order of pages carries the last anchor forward, so neither
    ranges nor pages are multiplied; of anchors on one page the last name owns.
    """
    here = F.struct("page", "name")
    marks = anchors.select("key", "page", "name", F.lit(0).alias("_kind"))
    both = marks.unionByName(tables.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    anchor = F.when(F.col("_kind") == 0, here)
    so_far = Window.partitionBy("key").orderBy("page", "_kind", "name").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_owner", F.last(anchor, ignorenulls=True).over(so_far)).withColumn("_final", F.max(anchor).over(Window.partitionBy("key")))
    inside = (F.col("_owner") != F.col("_final")) | (F.col("page") < F.col("_owner.page") + LAST_PAGES)
    owned = both.filter((F.col("_kind") == 1) & F.col("_owner").isNotNull() & inside).withColumn("name", F.col("_owner.name")).withColumn("start", F.col("_owner.page"))
    order = Window.partitionBy("key", "name", "start").orderBy("page", "ord")
    return owned.drop("_kind", "_owner", "_final").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)


def graft(cards: DataFrame, siblings: DataFrame) -> DataFrame:
    """Each card (key, width, id) with the first sibling of its key and width that is not itself: one of the two smallest."""
    place = F.row_number().over(Window.partitionBy("key", "width").orderBy("id"))
    two = siblings.select("key", "width", "id").distinct().withColumn("_r", place).filter("_r <= 2")
    two = two.groupBy("key", "width").agg(F.min("id").alias("_one"), F.max("id").alias("_two"))
    other = F.when(F.col("_one") != F.col("id"), F.col("_one")).when(F.col("_two") != F.col("id"), F.col("_two"))
    return cards.join(two, ["key", "width"], "left").select("key", "width", "id", other.alias("sibling"))


def typed_columns(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Per career the value of the first row (career, ord, label, ...) whose label has a word, for each wanted name: (word, column); careers that lack one go."""
    first = [F.min_by(column, F.when(F.col("label").contains(word), F.col("ord"))).alias(name) for name, (word, column) in wanted.items()]
    there = [F.max(F.col("label").contains(word)).alias(f"_has_{name}") for name, (word, _) in wanted.items()]
    out = rows.groupBy("career").agg(*first, *there)
    for name in wanted:
        out = out.filter(F.col(f"_has_{name}"))
    return out.select("career", *wanted)


#: Header of the table of ranks (fixed values): level, then a column for each side.
RANK_HEADER = ["Level", "US", "Soviet", "Local"]


def rank_names(tables: DataFrame, side: str) -> DataFrame:
    """level, rank of the first table (ord, rows) with the header of ranks; a side's blank cells take the first side's name."""
    header = F.array(*map(F.lit, RANK_HEADER))
    first = tables.filter(F.get("rows", F.lit(0)) == header).orderBy("ord").limit(1)
    rows = first.select(F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("r"))
    own = F.nullif(F.get("r", F.lit(RANK_HEADER.index(side))), F.lit(""))
    return rows.select(F.get("r", F.lit(0)).cast("int").alias("level"), F.coalesce(own, F.get("r", F.lit(1))).alias("rank"))


def merge_sections(sections: DataFrame) -> DataFrame:
    """Sections (game, name, ord, label, ...) with only the first of each label of a career; blank labels stay."""
    key = T.section_key(F.col("label"))
    order = Window.partitionBy("game", F.lower("name"), key).orderBy("ord")
    return sections.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") == 1) | (F.col("label") == "")).drop("_r")


def assemble(hits: DataFrame, name: str, most: int = 5) -> DataFrame:
    """ord, label, text of a career put together from hits (section, locator, text, score) that name it.

    Hits that speak of careers come first, then by score; equal labels once.
    """
    named = hits.filter(F.lower(F.concat_ws(" ", "section", F.left("text", F.lit(500)))).contains(name.lower()))
    signal = F.concat_ws(" ", "section", F.left("text", F.lit(400))).rlike(SIGNAL)
    label = T.provenance(T.crumb_leaf(F.col("section")), F.col("locator"))
    rows = named.withColumn("signal", signal).withColumn("label", label)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(F.lower("label")).orderBy(F.desc("signal"), F.desc("score"), "chunk_id"))).filter("r = 1")
    top = first.orderBy(F.desc("signal"), F.desc("score"), "chunk_id").limit(most)
    order = Window.orderBy(F.desc("signal"), F.desc("score"), "chunk_id")  # over the few rows that are left
    return top.select(F.row_number().over(order).alias("ord"), "label", F.left(T.collapse(F.col("text")), F.lit(600)).alias("text"))
