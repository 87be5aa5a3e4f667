"""Text to rows: pages, lines with their breadcrumbs, chunks, Markdown tables, stat boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

PAGE = r"\[\[page \d+\]\]"
TARGET_WORDS, LEAST_WORDS = 110, 5
HEADING_WORDS, HEADING_CHARS, HEADING_REPEATS, COVERED = 8, 80, 40, 0.6
#: Headings of front matter that head names, not rules (fixed values).
FRONT_MATTER = [
    "credits", "illustrations", "interior illustrations", "additional illustrations", "cover art", "cover artist", "additional art", "art direction",
    "graphic design", "layout", "author", "authors", "editor", "editors", "writer", "writers", "special thanks", "acknowledgements", "acknowledgments",
    "dedication", "playtesters", "playtesting", "proofreading", "proofreaders", "cartography", "contents", "table of contents",
]
DEFINITION = r"^[\s\-•▪◦·]*\d*\s*\*\*([A-Z0-9][^*\n]{0,38}?)(?::\*\*|\*\*:)\s*(\S.*)$"
BOX_HEADING = r"(?m)^#{3,6}\s*\*\*(.+?)\s+([A-Z][A-Z’'\-]{2,})\s+(\d+)\*\*\s*$"
#: Kinds of boxes that always count (fixed values).
BOX_KINDS = ["SPELL", "CANTRIP", "FOCUS", "RITUAL", "FEAT"]
KIND_REPEATS = 3


def split_game(path: Column) -> tuple[Column, Column]:
    """(game, book): the first and last part of a path; without folders the game is General."""
    parts = F.split(path, "/")
    return F.when(path.contains("/"), F.element_at(parts, 1)).otherwise("General"), F.element_at(parts, -1)


def pages(docs: DataFrame) -> DataFrame:
    """doc, page_ord, page_label, page_text; text before the first marker goes, without markers there is one page."""
    parts = F.split("text", PAGE)
    labels = F.regexp_extract_all("text", F.lit(r"\[\[page (\d+)\]\]"), F.lit(1))
    paged = F.transform(labels, lambda label, i: F.struct(label.alias("label"), F.get(parts, i + 1).alias("body")))
    single = F.array(F.struct(F.lit("").alias("label"), F.col("text").alias("body")))
    rows = docs.select("doc", F.posexplode(F.when(F.size(labels) > 0, paged).otherwise(single)).alias("page_ord", "p"))
    return rows.select("doc", "page_ord", F.col("p.label").alias("page_label"), F.col("p.body").alias("page_text"))


def lines(paged: DataFrame) -> DataFrame:
    """doc, line_no, page_label, raw: lines that are not blank, numbered through the document."""
    rows = paged.select("doc", "page_ord", "page_label", F.posexplode(F.split("page_text", "\n")).alias("at", "raw")).filter(T.trim_all(F.col("raw")) != "")
    order = Window.partitionBy("doc").orderBy("page_ord", "at")
    return rows.select("doc", F.row_number().over(order).alias("line_no"), "page_label", "raw")


def heading(line: Column) -> tuple[Column, Column]:
    """(level, title) of a heading line, nulls for others: Markdown marks, or a two-digit number and capitals."""
    s = T.trim_all(line)
    marks = F.regexp_extract(s, r"^(#{1,6})\s+\S", 1)
    md = T.trim_all(T.strip_markdown(F.regexp_extract(s, r"^#{1,6}\s+(.+?)\s*$", 1)))
    chapter = F.regexp_extract(s, r"^\d{2}\s+([A-Z][A-Z0-9 &'/.\-]{2,})$", 1)
    level = F.when(marks != "", F.length(marks)).when(chapter != "", 1)
    return level, F.when(marks != "", md).when(chapter != "", T.trim_all(T.title_case(chapter)))


def is_example(line: Column, title: Column) -> Column:
    return title.rlike(r"(?i)^(worked\s+)?example\b") | (line.contains("~~") & (F.size(T.words(title)) <= 5))


def marked_lines(numbered: DataFrame) -> DataFrame:
    """Lines with level, title, term and body of what they are."""
    level, title = heading(F.col("raw"))
    s = T.trim_all(F.col("raw"))
    return numbered.select(
        "*", level.alias("level"), title.alias("title"),
        F.when(level.isNull(), F.nullif(T.trim_all(F.regexp_extract(s, DEFINITION, 1)), F.lit(""))).alias("term"),
        F.when(level.isNull(), F.nullif(F.regexp_extract(s, DEFINITION, 2), F.lit(""))).alias("body"),
    )


def breadcrumbs(marked: DataFrame) -> DataFrame:
    """Lines with the chapter, section and entry they stand under.

    A chapter ends the section, a section or chapter ends the entry; an example
    heading is an entry and leaves the section as it is.
    """
    until = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    example = F.col("level").isNotNull() & is_example(F.col("raw"), F.col("title"))
    own = F.col("level").isNotNull() & ~example

    def latest(when: Column, value: Column) -> Column:
        return F.last(F.when(when, F.struct(F.col("line_no").alias("at"), value.alias("v"))), ignorenulls=True).over(until)

    chapter = latest(own & (F.col("level") <= 1), F.col("title"))
    section = latest(own & (F.col("level") > 1), F.col("title"))
    entry = latest(example | F.col("term").isNotNull(), F.when(example, F.lit("Example")).otherwise(F.col("term")))
    chapter_at, section_at = F.coalesce(chapter["at"], F.lit(0)), F.coalesce(section["at"], F.lit(0))
    return marked.select(
        "*", F.coalesce(chapter["v"], F.lit("")).alias("chapter"),
        F.when(section_at > chapter_at, section["v"]).otherwise("").alias("section"),
        F.when(F.coalesce(entry["at"], F.lit(0)) > F.greatest(chapter_at, section_at), entry["v"]).otherwise("").alias("entry"),
    )


def greedy_segments(word_counts: Column, target: int = TARGET_WORDS) -> Column:
    """Segment number of each count in an array: a new one once a segment has reached the target."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("seg"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        full = acc["sum"] + n >= target
        return F.struct(
            F.concat(acc["ids"], F.array(acc["seg"])).alias("ids"),
            F.when(full, acc["seg"] + 1).otherwise(acc["seg"]).alias("seg"),
            F.when(full, F.lit(0)).otherwise(acc["sum"] + n).cast("long").alias("sum"),
        )

    return F.aggregate(word_counts, start, step, lambda acc: acc["ids"])


def chunk_rows(docs: DataFrame, target: int = TARGET_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """doc, chunk_no, chapter, section, entry, page, text: the prose chunks of documents (doc, text).

    Headings and definition entries begin a chunk, full buffers end one, and
    chunks of fewer words than ``least`` go. An entry's own line never ends its
    chunk; a later line can.
    """
    rows = breadcrumbs(marked_lines(lines(pages(docs))))
    body = F.when(F.col("term").isNotNull(), F.concat("term", F.lit(": "), T.clean_line(F.col("body")))).otherwise(T.clean_line(F.col("raw")))
    so_far = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("level").isNotNull() | F.col("term").isNotNull()
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(so_far)).filter(F.col("level").isNull()).withColumn("line", body).filter("line <> ''")
    rows = rows.withColumn("n", F.when(F.col("term").isNotNull(), F.lit(-1)).otherwise(F.size(T.words(F.col("line")))))
    item = F.struct("line_no", "line", "n", F.size(T.words(F.col("line"))).alias("words"), "page_label")
    grouped = rows.groupBy("doc", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("chapter", "section", "entry")))
    # an entry's line counts, but can only fill the buffer together with a later line
    first = F.get("items", F.lit(0))
    counts = F.transform("items", lambda x, i: F.when(x["n"] >= 0, F.when(i == 1, x["words"] + F.when(first["n"] < 0, first["words"]).otherwise(0)).otherwise(x["words"])).otherwise(0))
    parts = grouped.select("doc", "block", "chapter", "section", "entry", F.explode(F.arrays_zip(F.col("items").alias("item"), greedy_segments(counts, target).alias("seg"))).alias("z"))
    chunks = parts.groupBy("doc", "block", F.col("z.seg").alias("seg")).agg(
        F.array_sort(F.collect_list("z.item")).alias("items"), *(F.first(c).alias(c) for c in ("chapter", "section", "entry"))
    )
    text = F.array_join(F.transform("items", lambda x: x["line"]), " ")
    chunks = chunks.withColumn("text", text).withColumn("page", F.get("items", F.lit(0))["page_label"]).filter(F.size(T.words(F.col("text"))) >= least)
    order = Window.partitionBy("doc").orderBy("block", "seg")
    return chunks.select("doc", F.row_number().over(order).alias("chunk_no"), "chapter", "section", "entry", "page", "text")


def heading_text(line: Column) -> Column:
    """The visible text of a Markdown heading, null for other lines."""
    return F.when(line.rlike(r"^#{1,6}\s+.*\S\s*$"), T.trim_all(F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), "[*_`#]", "")))


def demoted_headings(numbered: DataFrame) -> DataFrame:
    """Lines with ``noise``: heading lines that are numbers, too long, front matter or repeated all over the document."""
    shown = heading_text(F.col("raw"))
    rows = numbered.withColumn("shown", shown)
    times = F.count("shown").over(Window.partitionBy("doc", F.lower("shown")))
    noise = (
        T.is_pure_number(F.col("shown")) | (F.size(T.words(F.col("shown"))) > HEADING_WORDS) | (F.length("shown") > HEADING_CHARS)
        | (times > HEADING_REPEATS) | F.lower("shown").isin(FRONT_MATTER)
    )
    return rows.withColumn("noise", F.col("shown").isNotNull() & (F.col("shown") != "") & noise)


def drop_cap_fragments(numbered: DataFrame) -> DataFrame:
    """Heading lines equal to another heading of the document without its first letter: one semi-join."""
    heads = numbered.withColumn("shown", F.lower(heading_text(F.col("raw")))).filter("shown IS NOT NULL")
    tails = heads.select(F.col("doc").alias("o_doc"), F.substring("shown", 2, 1 << 20).alias("tail")).distinct()
    return heads.filter(F.length("shown") >= 4).join(tails, (F.col("doc") == F.col("o_doc")) & (F.col("shown") == F.col("tail")), "left_semi")


def covers_title(title: Column, headings: Column) -> Column:
    """Whether one of the headings has most of the title's longer tokens."""
    want = T.long_tokens(title, 2)
    return F.exists(headings, lambda h: F.size(F.array_intersect(want, T.long_tokens(h, 2))) / F.greatest(F.size(want), F.lit(1)) >= COVERED) & (F.size(want) > 0)


def inject_toc(paged: DataFrame, toc: DataFrame) -> DataFrame:
    """doc, page_ord, level, title of contents entries (doc, level, title, page) to put before their page's text."""
    top = F.filter(F.slice(F.split("page_text", "\n"), 1, 6), lambda x: T.trim_all(x).startswith("#"))
    heads = paged.select("doc", "page_ord", F.transform(top, lambda x: F.regexp_replace(x, "[*_`#]", "")).alias("top"))
    rows = toc.select("doc", "level", T.trim_all(F.col("title")).alias("title"), (F.col("page") - 1).alias("page_ord")).filter("title <> ''")
    return rows.join(heads, ["doc", "page_ord"]).filter(~covers_title(F.col("title"), F.col("top"))).select("doc", "page_ord", F.least("level", F.lit(6)).alias("level"), "title")


def markdown_tables(numbered: DataFrame) -> DataFrame:
    """doc, table_no, page, title, rows of well-formed pipe tables: runs of lines that begin with a pipe.

    numbered: doc, line_no (all lines), raw. The title is the nearest heading
    before, across pages.
    """
    s = T.trim_all(F.col("raw"))
    until = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("doc").orderBy("line_no")
    rows = numbered.select(
        "doc", "line_no", s.alias("s"),
        F.coalesce(F.last(F.nullif(F.regexp_extract(s, r"^\[\[page (\d+)\]\]", 1), F.lit("")), ignorenulls=True).over(until).cast("int"), F.lit(0)).alias("page"),
        F.coalesce(F.last(F.when(s.rlike(r"^#{1,6}\s+.*\S$"), T.clean_cell(F.regexp_replace(s, r"^#{1,6}\s+", ""))), ignorenulls=True).over(until), F.lit("")).alias("title"),
        F.row_number().over(order).alias("n"),
    ).filter(F.col("s").startswith("|"))
    cells = F.split(F.regexp_replace(F.regexp_replace("s", r"^\s*\|", ""), r"\|\s*$", ""), r"\|")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(order)).withColumn("cells", F.transform(cells, T.clean_cell))
    blocks = rows.groupBy("doc", "island").agg(F.min("line_no").alias("at"), F.first("page").alias("page"), F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("items"))
    blocks = blocks.withColumn("grid", F.transform("items", lambda x: x["cells"])).filter(F.size("grid") >= 3)
    separator = F.forall(F.filter(F.get("grid", F.lit(1)), lambda c: c != ""), lambda c: c.rlike("^:?-{2,}:?$"))
    data = F.slice(F.col("grid"), F.lit(3), F.size("grid") - 2)
    blocks = blocks.filter(separator & F.exists(data, lambda r: F.exists(r, lambda c: c != "")))
    header = F.transform(F.get("grid", F.lit(0)), lambda c, i: F.when(i == 0, T.dedupe_header(c)).otherwise(c))
    return blocks.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("table_no"), "page", "title", F.concat(F.array(header), data).alias("rows"))


def page_of_lines(numbered: DataFrame) -> DataFrame:
    """Lines with the page of the nearest marker before (as-of by carrying forward)."""
    until = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.nullif(F.regexp_extract("raw", r"\[\[page\s+(\d+)\]\]", 1), F.lit("")).try_cast("int")
    return numbered.withColumn("page", F.last(mark, ignorenulls=True).over(until))


def box_headings(docs: DataFrame) -> DataFrame:
    """doc, box_no, name, kind, level, body: boxes of known kinds, and of kinds that a document repeats.

    The body reaches to the next heading of a box; the last takes 1200 characters.
    """
    names, kinds, levels = (F.regexp_extract_all("text", F.lit(BOX_HEADING), F.lit(i)) for i in (1, 2, 3))
    bodies = F.split("text", BOX_HEADING)
    rows = docs.select("doc", bodies.alias("bodies"), F.posexplode(F.arrays_zip(names.alias("name"), kinds.alias("kind"), levels.alias("level"))).alias("at", "h"))
    rows = rows.select("doc", "at", T.clean_box(F.col("h.name")).alias("name"), F.col("h.kind").alias("kind"), F.col("h.level").cast("int").alias("level"), F.get("bodies", F.col("at") + 1).alias("body"), (F.size("bodies") - 2 == F.col("at")).alias("last"))
    often = F.count(F.lit(1)).over(Window.partitionBy("doc", "kind"))
    rows = rows.withColumn("often", often).filter(F.col("kind").isin(BOX_KINDS) | (F.col("often") >= KIND_REPEATS))
    body = F.when(F.col("last"), F.left("body", F.lit(1200))).otherwise(F.col("body"))
    return rows.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("box_no"), "name", "kind", "level", body.alias("body"))


def box_category(kind: Column) -> Column:
    return F.when(kind == "FEAT", "feat").when(kind.isin(BOX_KINDS[:4]), "spell").otherwise(F.lower(kind))


def stat_boxes(docs: DataFrame) -> DataFrame:
    """doc, box_no, name, kind, category, level, fields (label, value), description."""
    raw = F.filter(F.transform(F.split("body", "\n"), T.trim_all), lambda x: (x != "") & ~x.rlike(r"(?i)\[\[page|^\s*core\s+rulebook\s*$"))
    wraps = lambda acc, x: (F.size(acc) > 0) & ~x.startswith("**") & (x.rlike("^[a-z]") | F.try_element_at(acc, F.lit(-1)).rlike(r"(?i)^\*\*Heightened\b"))
    merged = F.aggregate(
        raw, F.array().cast("array<string>"),
        lambda acc, x: F.when(wraps(acc, x), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x))),
    )
    rows = box_headings(docs).withColumn("lines", merged)
    joined = F.array_join("lines", "\n")
    field = r"\*\*([^*\n]+?)\*\*[ \t]*([^\n*]*)"
    pairs = F.arrays_zip(F.regexp_extract_all(joined, F.lit(field), F.lit(1)).alias("label"), F.regexp_extract_all(joined, F.lit(field), F.lit(2)).alias("value"))
    clean = F.transform(pairs, lambda p: F.struct(T.clean_box(p["label"]).alias("label"), F.regexp_replace(T.clean_box(p["value"]), "[ ;,]+$", "").alias("value")))
    good = F.filter(clean, lambda p: (p["value"] != "") & p["label"].rlike(r"^[A-Z][A-Za-z][A-Za-z0-9 '()+/-]{0,24}$"))
    first = F.aggregate(good, F.array().cast("array<struct<label:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["label"] == p["label"]), acc).otherwise(F.concat(acc, F.array(p))))
    prose = T.cut_markup_tail(T.clean_box(F.array_join(F.filter("lines", lambda x: ~x.contains("**")), " ")))
    return rows.select("doc", "box_no", "name", "kind", box_category(F.col("kind")).alias("category"), "level", first.alias("fields"), prose.alias("description"))
