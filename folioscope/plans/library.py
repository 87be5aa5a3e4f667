"""Queries of sources (S), streaming (T), the index lifecycle (R10), evaluation (X) and plug-ins (Y)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from folioscope import library as books
from folioscope.operators import chargen as C
from folioscope.operators import evals as E
from folioscope.operators import segment as G
from folioscope.plans.base import Rows, query, table
from folioscope.plans.domain import _book as domain_book
from folioscope.plans.search import chunks
from folioscope.plugins import Registry, per_page
from folioscope.sources import library as L
from folioscope.streaming import watch as W

LISTING_SQL = "(SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '.xlsx' END AS path, CAST(doc_id % 7 AS VARCHAR) AS modified_time, text FROM documents)"


def _listing(spark, d):
    ending = F.element_at(F.array(*map(F.lit, [".md", ".PDF", ".txt", ".xlsx"])), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", ending)
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), (F.col("doc_id") % 7).cast("string").alias("modified_time"), "text")


@query("S4_route_formats", f"SELECT CASE WHEN regexp_matches(lower(path), '\\.(txt|md|markdown)$') THEN 'text' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'unsupported' END AS kind, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(lower(path), '\\.(txt|md)$') THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM {LISTING_SQL} GROUP BY kind")
def route_formats(spark, d):
    files = _listing(spark, d).withColumn("content", F.col("text").cast("binary"))
    return L.extract(files).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


CACHE_SQL = f"(SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'old' ELSE modified_time END AS modified_time, CASE WHEN file_id % 3 = 0 THEN '0' ELSE '1' END AS mdv, '1' AS tbv, 'cached ' || file_id AS text FROM {LISTING_SQL} WHERE file_id % 2 = 0)"


def _cache(spark, d):
    changed = F.when(F.col("file_id") % 5 == 0, "old").otherwise(F.col("modified_time"))
    return _listing(spark, d).filter("file_id % 2 = 0").select("file_id", changed.alias("modified_time"), F.when(F.col("file_id") % 3 == 0, "0").otherwise("1").alias("mdv"), F.lit("1").alias("tbv"), F.concat(F.lit("cached "), "file_id").alias("text"))


@query("S8_staleness", f"SELECT l.file_id, NOT (coalesce(l.modified_time = c.modified_time, false) AND coalesce(mdv = '1', false)) AS text_stale, NOT (coalesce(l.modified_time = c.modified_time, false) AND coalesce(tbv = '1', false)) AS tables_stale FROM {LISTING_SQL} l LEFT JOIN {CACHE_SQL} c USING (file_id)")
def staleness(spark, d):
    return L.staleness(_listing(spark, d), _cache(spark, d))


@query("S11_incremental", f"SELECT file_id, CASE WHEN fresh THEN 'cached ' || file_id ELSE text END AS text FROM (SELECT l.*, coalesce(l.modified_time = c.modified_time AND mdv = '1', false) AS fresh FROM {LISTING_SQL} l LEFT JOIN {CACHE_SQL} c USING (file_id)) WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def incremental(spark, d):
    files = _listing(spark, d)
    return L.refreshed(files, _cache(spark, d), files.select("file_id", "text"))


@query("S10_manifest", f"SELECT '3' AS version, count(*) AS documents, CAST(sum(CAST(CAST('0x' || substr(md5(path), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS files FROM {LISTING_SQL}")
def manifest(spark, d):
    return L.manifest(_listing(spark, d), "3")


@query("S14_split_path", f"SELECT file_id, string_split(path, '/')[1] AS game, string_split(path, '/')[-1] AS book FROM {LISTING_SQL}")
def split_path(spark, d):
    game, book = G.split_game(F.col("path"))
    return _listing(spark, d).select("file_id", game.alias("game"), book.alias("book"))


def _folder(spark, name):
    """A new folder beside the checkpoints, which all executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="folioscope-")  # local mode: one machine
    return f"{base.rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"


@query("S1_listing")
def listing(spark, d):
    folder = _folder(spark, "library")
    rows = table(spark, d, "benchmark").select(F.concat_ws("/", F.lit("G"), "item_id").alias("k"), "text")
    rows.select((F.xxhash64("k") % 4).cast("string").alias("part"), "text").write.partitionBy("part").text(folder)
    found = L.extract(L.listing(spark, folder))
    return found.select("kind", F.length("text").alias("chars"))


@query("S5_decode", "SELECT * FROM (VALUES (1, 'plain'), (2, 'caf' || chr(65533))) v(id, text)")
def decode(spark, d):
    raw = spark.createDataFrame([(1, bytearray(b"plain"), "a.txt"), (2, bytearray(b"caf\xe9"), "b.txt")], "id int, content binary, path string")
    files = raw.select("id", F.lit("x").alias("file_id"), "path", F.lit("t").alias("modified_time"), "content")
    return files.join(L.extract(files).select("path", "text"), "path").select("id", "text")


@query("S9_write_cache", "SELECT lang AS game, count(*) AS n FROM documents GROUP BY lang")
def write_cache(spark, d):
    path = _folder(spark, "cache")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("game"))
    L.write_cache(docs, path)
    L.write_cache(docs.filter("game = 'en'"), path)  # replaces one partition only
    return spark.read.parquet(path).groupBy("game").agg(F.count("*").alias("n"))


GOLD = '{"entries": [{"id": "a", "key_facts": ["x", "y"]}, {"id": "b", "key_facts": []}]}'


@query("S13_gold_reader", "SELECT * FROM (VALUES ('a', 2), ('b', 0)) v(id, facts)")
def gold_reader(spark, d):
    path = _folder(spark, "gold")
    spark.createDataFrame([(GOLD,)], "value string").coalesce(1).write.text(path)
    return L.read_gold(spark, path).select("id", F.size("key_facts").alias("facts"))


@query("S15_dump", "SELECT count(*) AS lines FROM part")
def dump(spark, d):
    path = _folder(spark, "dump")
    table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_name")).write.text(path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query("T4_snapshot_swap", "SELECT '2' AS version, lang, count(*) AS n, (SELECT count(*) FROM documents) AS before FROM documents WHERE lang <> 'de' GROUP BY lang")
def snapshot_swap(spark, d):
    shots = L.Snapshots(spark, _folder(spark, "snapshots"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    langs = docs.groupBy("lang").agg(F.count("*").alias("n"))
    first = shots.publish({"docs": docs, "langs": langs}, "1")
    kept = docs.filter("lang <> 'de'")
    second = shots.publish({"docs": kept, "langs": langs.filter("lang <> 'de'")}, "2")
    old = shots.read("docs", first).agg(F.count("*").alias("before"))  # readers of the old version keep it
    now = shots.read("langs").join(shots.read("docs").select("lang").distinct(), "lang")
    return now.crossJoin(old).select(F.lit(shots.label(second)).alias("version"), "lang", "n", "before")


@query("R10_refresh", f"SELECT file_id, CASE WHEN fresh THEN 'cached ' || file_id ELSE text END AS text FROM (SELECT l.*, coalesce(l.modified_time = c.modified_time AND mdv = '1', false) AS fresh FROM {LISTING_SQL} l LEFT JOIN {CACHE_SQL} c USING (file_id)) WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def refresh(spark, d):
    files = _listing(spark, d)
    shots = L.Snapshots(spark, _folder(spark, "index"))
    L.refresh(shots, files, _cache(spark, d), lambda stale: stale.select("file_id", "text"), "1")
    return shots.read().select("file_id", "text")


@query("R10_refresh_forced", f"SELECT file_id, text FROM {LISTING_SQL} WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def refresh_forced(spark, d):
    files = _listing(spark, d)
    shots = L.Snapshots(spark, _folder(spark, "index"))
    L.refresh(shots, files, _cache(spark, d), lambda stale: stale.select("file_id", "text"), "1", force=True)
    return shots.read().select("file_id", "text")


@query("T3_guard", "SELECT 'taken' AS first, 'rejected' AS second, count(*) AS documents FROM documents")
def guard(spark, d):
    """A refresh that starts while another one runs is rejected and changes nothing."""
    shots = L.Snapshots(spark, _folder(spark, "guarded"))
    files, said = _listing(spark, d), []

    def during(stale):
        try:
            L.refresh(shots, files.limit(0), _cache(spark, d), lambda rows: rows.select("file_id", "text"), "2", force=True)
            said.append("taken")
        except L.Busy:
            said.append("rejected")
        return stale.select("file_id", F.coalesce(F.nullif("text", F.lit("")), F.lit("-")).alias("text"))

    L.refresh(shots, files, _cache(spark, d), during, "1", force=True, keep_blank=True)
    return shots.read().agg(F.lit("taken").alias("first"), F.lit(said[0]).alias("second"), F.count("*").alias("documents"))


def _watch(spark, d):
    folder, mark = _folder(spark, "manifests"), _folder(spark, "watch")
    shots, seen = L.Snapshots(spark, _folder(spark, "streamed")), []

    def rebuild(batch, number):
        if not batch.isEmpty():
            seen.append(batch.count())
            shots.publish(table(spark, d, "documents").select("doc_id"), str(number))

    L.manifest(_listing(spark, d), "1").write.json(folder)
    for version in ("2", "3"):
        W.watch(spark, folder, mark, rebuild, once=True).awaitTermination()
        L.manifest(_listing(spark, d), version).write.mode("append").json(folder)
    W.watch(spark, folder, mark, rebuild, once=True).awaitTermination()
    return seen, shots


@query("T1_watch_manifests", "SELECT 3 AS rebuilds, 3 AS manifests")
def watch_manifests(spark, d):
    seen, _ = _watch(spark, d)
    return spark.createDataFrame([(len(seen), sum(seen))], "rebuilds int, manifests int")


@query("T2_startup_batch", "SELECT count(*) AS docs FROM documents")
def startup_batch(spark, d):
    _, shots = _watch(spark, d)
    return shots.read().agg(F.count("*").alias("docs"))


@query("T_extra_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    # a stream of the table's files, drained once; the watermark comes after all rows of the only batch
    name, out, mark = f"events-{d.rsplit('/', 1)[-1]}", _folder(spark, "windows"), _folder(spark, "windows-mark")
    source = _folder(spark, name)
    table(spark, d, "events").select("ts", "event_type", "value").write.parquet(source)
    schema = spark.read.parquet(source).schema
    windows = W.event_windows(spark.readStream.schema(schema).parquet(source))
    flat = windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    whole = lambda batch, number: batch.write.mode("overwrite").parquet(out) if not batch.isEmpty() else None
    flat.writeStream.outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(whole).start().awaitTermination()
    return spark.read.parquet(out)


# ------------------------------------------------------------------ X
FACTS = Rows("query_id int, fact string, text string, want double", [
    (1, "roll two dice", "You roll two dice, then add.", 1.0),
    (1, "adds 8 points to armour", "It may add 8 point of armour plates", 1.0),
    (2, "nine tens make ninety", "ten make", 0.5),
    (2, "the of", "anything", 0.0),
    (3, "costs 12", "cost 13", 0.5),
])


@query("X1_fact_present", f"SELECT query_id, fact, want AS coverage FROM {FACTS.sql}")
def fact_present(spark, d):
    return FACTS.df(spark).select("query_id", "fact", F.round(E.fact_coverage(F.col("fact"), F.col("text")), 6).alias("coverage"))


@query("X2_run_eval", "SELECT * FROM (VALUES (1, 2, 2, 1.0), (2, 2, 0, 0.0), (3, 1, 0, 0.0)) v(query_id, facts, found, recall)")
def run_eval(spark, d):
    rows = FACTS.df(spark)
    text = rows.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return E.recall(rows.select("query_id", "fact"), text)


@query("X3_summary", "SELECT coalesce(lang, 'all') AS system, count(*) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def eval_summary(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("system"), "quality")
    return E.by_system(joined, "quality").withColumn("system", F.coalesce("system", F.lit("all")))


@query("A11_eval_aggregates", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS stable FROM labels")
def eval_aggregates(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("quality"))), 6).alias("stable"))


TABLES = Rows("id int, rows array<array<string>>, headers array<string>, labels array<string>, least int, most int, missing string, correct boolean", [
    (1, [["Title", ""], ["Name", "Cost"], ["Rope", "5"]], ["name", "cost"], ["Rope"], 2, 0, "", True),
    (2, [["Name", "Cost"], ["Rope", "5"]], ["name", "weight"], ["Lamp"], 1, 0, "WEIGHT|LAMP", False),
    (3, [["Name", "Cost"], ["Rope", "5"]], ["name"], [], 1, 1, "", False),
])


@query("X4_score_tables", f"SELECT id, missing, correct FROM {TABLES.sql}")
def score_tables(spark, d):
    c = E.check_table(*(F.col(x) for x in ("rows", "headers", "labels", "least", "most")))
    rows = TABLES.df(spark).select("id", c.alias("c"))
    return rows.select("id", F.array_join(F.concat("c.missing_headers", "c.missing_labels"), "|").alias("missing"), "c.correct")


@query("X5_snapshot_diff", "WITH a AS (SELECT lang, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS fp FROM documents WHERE doc_id % 9 > 0 OR lang <> 'de' GROUP BY lang), b AS (SELECT lang, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS fp FROM documents GROUP BY lang) SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b ON a.lang = b.lang WHERE a.fp IS DISTINCT FROM b.fp")
def snapshot_diff(spark, d):
    docs = table(spark, d, "documents")
    line = F.col("doc_id").cast("string")
    return E.snapshot_diff(E.fingerprints(docs.filter("doc_id % 9 > 0 OR lang <> 'de'"), "lang", line), E.fingerprints(docs, "lang", line), "lang")


TOC = Rows("doc string, title string, page int", [("a", "The Long Road", 7), ("a", "Combat", 12), ("b", "Magic Items", 3)])
HEADS = Rows("doc string, title string, page int", [("a", "LONG ROAD", 5), ("a", "Combat", 13), ("b", "Items of Magic", 3)])


@query("X6_heading_recall", "SELECT * FROM (VALUES ('a', 2, 1), ('b', 1, 1)) v(doc, titles, found)")
def heading_recall(spark, d):
    return E.heading_recall(TOC.df(spark), HEADS.df(spark))


# ------------------------------------------------------------------ Y
LANGUAGES = Registry("page", "career_detect")
LANGUAGES.register("de", page=lambda pdf: pdf.assign(text=pdf["text"].fillna("").str.replace("\n", " / ", regex=False)))
LANGUAGES.register("e", page=lambda pdf: pdf.assign(text=pdf["text"].fillna("").str.len().astype(str)), career_detect=lambda pdf: pdf.assign(found=pdf["text"].fillna("").str.count("the")).loc[:, ["doc", "found"]])
_PAGE_SQL = "(SELECT doc_id AS doc, lang AS game, coalesce(text, '') AS text FROM documents)"


def _pages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("game"), "text")


@query("Y1_page_plugins", f"SELECT doc, CASE WHEN contains(game, 'de') THEN replace(text, chr(10), ' / ') WHEN contains(game, 'e') THEN CAST(length(text) AS VARCHAR) ELSE text END AS text FROM {_PAGE_SQL}")
def page_plugins(spark, d):
    return per_page(_pages(spark, d), ["doc"], LANGUAGES, "page").select("doc", F.coalesce("text", F.lit("")).alias("text"))


@query("Y2_career_hooks", f"SELECT doc, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS found FROM {_PAGE_SQL} WHERE contains(game, 'e') AND NOT contains(game, 'de')")
def career_hooks(spark, d):
    return per_page(_pages(spark, d), ["doc"], LANGUAGES, "career_detect", "doc long, found long")


FLOWS = Registry("build_flow", "build_data")
FLOWS.register("e", build_flow=lambda: C.archetype, build_data=domain_book)
FLOWS.register("", build_flow=lambda: C.life_path, build_data=domain_book)


@query("Y3_chargen_registry", "SELECT lang AS game, contains(lang, 'e') AS quick, count(*) AS sheets FROM (SELECT DISTINCT lang FROM documents), range(1, 11) r(n) GROUP BY lang")
def chargen_registry(spark, d):
    """Ten sheets for each language, by the flow that the registry has for it."""
    games = sorted(r[0] for r in table(spark, d, "documents").select("lang").distinct().collect())  # a few games
    drafts, out = spark.range(1, 11).withColumnRenamed("id", "draft_id"), None
    for game in games:
        entry = FLOWS.of(game)
        sheets = C.characters(drafts, entry.hooks["build_data"](spark), entry.hooks["build_flow"](), game)
        mine = sheets.groupBy(F.lit(game).alias("game"), (F.col("template") != "").alias("quick")).agg(F.count("*").alias("sheets"))
        out = mine if out is None else out.unionByName(mine)
    return out


BUILDS = Registry("build_data", "render")
BUILDS.register("small", build_data=lambda p: p.filter("p_type = 'SMALL'"), render=lambda: F.concat(F.lit("small "), "p_name"))
BUILDS.register("pr", build_data=lambda p: p.filter("p_type = 'PROMO'"), render=lambda: F.upper("p_name"))


@query("Y4_builder_registry", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'small ' || p_name ELSE upper(p_name) END AS sheet FROM part WHERE p_type IN ('SMALL', 'PROMO')")
def builder_registry(spark, d):
    part, out = table(spark, d, "part"), None
    for game in ("Small craft", "promo", "other"):
        if (entry := BUILDS.of(game)) is not None:
            mine = entry.hooks["build_data"](part).select("p_partkey", entry.hooks["render"]().alias("sheet"))
            out = mine if out is None else out.unionByName(mine)
    return out


@query("Y5_rolls_as_columns", f"SELECT c_custkey AS draft_id, CAST(1 + CAST('0x' || left(md5('s' || c_custkey || '|nationality'), 7) AS BIGINT) % 5 AS INTEGER) AS seeded, 1 + c_custkey % 5 AS given FROM customer")
def rolls_as_columns(spark, d):
    """The same flow by a seed, and by rolls that a column gives."""
    drafts = table(spark, d, "customer").select(F.col("c_custkey").alias("draft_id"))
    book, nations = domain_book(spark), F.array(*map(F.lit, C.NATIONS))
    place = F.array_position(nations, F.col("nation"))
    seeded = C.characters(drafts, book, seed="s", fields=["draft_id", "nation"]).select("draft_id", place.cast("int").alias("seeded"))
    rolls = F.create_map(F.lit("nationality"), (F.col("draft_id") % 5 + 1).cast("int"))
    given = C.characters(drafts.withColumn("rolls", rolls), book, fields=["draft_id", "nation"]).select("draft_id", place.alias("given"))
    return seeded.join(given, "draft_id")


#: A stat box for each part: heading, two fields, a wrapped value and prose.
_BOX_KINDS = ["SPELL", "FEAT", "CANTRIP", "RITUAL"]


@query("C3_box_chunks", """SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 1 THEN 'feat' ELSE 'spell' END AS category, CASE p_partkey % 4 WHEN 0 THEN 'Spell' WHEN 1 THEN 'Feat' WHEN 2 THEN 'Cantrip' ELSE 'Ritual' END || ' › Glow' AS section,
  'Level=' || p_size || ';Range=' || p_size || ' feet;Area=' || lower(p_brand) AS grid, 'A soft light of ' || p_size || ' fills it.' AS description FROM part""")
def box_chunks(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _BOX_KINDS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("[[page 2]]\n##### **GLOW "), kind, F.lit(" "), "p_size", F.lit("**\n**Range** "), "p_size", F.lit(" feet; **Area** "), F.lower("p_brand"), F.lit("\nA soft light of "), "p_size", F.lit(" fills it.\n##### **GLOW "), kind, F.lit(" 9**\n**Range** second\nThe same name again.\n"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.lit("G").alias("game"), F.lit("book").alias("source"), text.alias("text"))
    rows = books.box_chunks(docs)
    grid = F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), ";")
    return rows.select("doc", "category", "section", grid.alias("grid"), "description")
