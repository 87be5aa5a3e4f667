"""From a folder of books to published tables, and the commands that answer from them.

    python -m folioscope.library FOLDER OUT [--version V] [--force]

``build`` reads the folder, cuts every book into prose chunks, table chunks and
stat-box chunks, routes them, indexes their terms and publishes all tables as
one version; ``Library`` answers from the current version.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import classify as P
from folioscope.operators import grids as G
from folioscope.operators import routes as R
from folioscope.operators import search as S
from folioscope.operators import segment as H
from folioscope.sources import library as L

CHUNK = ["doc", "family", "ord", "game", "source", "category", "section", "locator", "text", "rows", "description"]


def clean_text(c):
    return T.strip_controls(T.normalize_ligatures(c))


def _crumbs(*parts: str):
    return F.concat_ws(" › ", *(F.nullif(F.col(p), F.lit("")) for p in parts))


def prose_chunks(docs: DataFrame) -> DataFrame:
    """Prose of docs (doc, game, source, text), routed by heading and body, guards last."""
    rows = H.chunk_rows(docs.select("doc", "text")).join(docs.select("doc", "game", "source"), "doc")
    rows = rows.withColumn("section_key", _crumbs("chapter", "section")).withColumn("category", P.category(F.col("source"), F.col("chapter"), F.col("section")))
    section = _crumbs("chapter", "section", "entry")
    rows = P.retag(rows).withColumn("crumb", section)
    locator = F.when(F.col("page") != "", F.concat(F.lit("p. "), "page")).otherwise("")
    return rows.select("doc", F.lit(0).alias("family"), F.col("chunk_no").alias("ord"), "game", "source", P.guard(F.col("category"), F.col("crumb"), F.col("text")).alias("category"), F.col("crumb").alias("section"), locator.alias("locator"), "text", F.lit(None).cast(G.GRID).alias("rows"), F.lit("").alias("description"))


def table_chunks(docs: DataFrame) -> DataFrame:
    """Labelled pipe tables of docs as chunks with their grid."""
    numbered = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = H.markdown_tables(numbered).join(docs.select("doc", "game", "source"), "doc").filter((G.width(F.col("rows")) >= 2) & (F.size("rows") >= 3) & G.is_real(F.col("rows")))
    rows = rows.withColumn("kind", P.table_class(F.lit(""), F.col("rows"))).filter("kind <> 'noise'")
    name = T.table_name(F.col("title"), F.lit(""), F.get("rows", F.lit(0)))
    flat = F.array_join(F.transform("rows", lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), "\n")
    locator = F.when(F.col("page") > 0, F.concat(F.lit("p. "), "page")).otherwise("")
    return rows.withColumn("name", name).select("doc", F.lit(1).alias("family"), F.col("table_no").alias("ord"), "game", "source", F.when(F.col("kind") == "rules", "tables").otherwise(F.col("kind")).alias("category"), F.col("name").alias("section"), locator.alias("locator"), F.concat("name", F.lit("\n"), flat).alias("text"), "rows", F.lit("").alias("description"))


def box_chunks(docs: DataFrame) -> DataFrame:
    """Stat boxes of docs as cards: label and value rows with the prose beside them, the first of each name."""
    rows = H.stat_boxes(docs.select("doc", "text")).join(docs.select("doc", "game", "source"), "doc")
    first = F.row_number().over(Window.partitionBy("doc", "category", F.lower("name")).orderBy("box_no"))
    rows = rows.withColumn("r", first).filter("r = 1").withColumn("title", T.entry_title(F.col("name")))
    grid = F.concat(F.array(F.array(F.lit("Level"), F.col("level").cast("string"))), F.transform("fields", lambda f: F.array(f["label"], f["value"])))
    flat = F.array_join(F.transform("fields", lambda f: f["value"]), " ")
    return rows.select("doc", F.lit(2).alias("family"), F.col("box_no").alias("ord"), "game", "source", "category", F.concat(T.title_case(F.col("kind")), F.lit(" › "), "title").alias("section"), F.lit("").alias("locator"), F.concat_ws(" ", "title", T.title_case(F.col("kind")), flat, "description").alias("text"), grid.alias("rows"), "description")


def all_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of all families; chunk_id follows document, family and place, whatever the partitioning."""
    docs = docs.withColumn("text", clean_text(F.col("text"))).filter(T.trim_all(F.col("text")) != "")
    rows = prose_chunks(docs).select(CHUNK).unionByName(table_chunks(docs).select(CHUNK)).unionByName(box_chunks(docs).select(CHUNK))
    return rows.withColumn("chunk_id", F.xxhash64("doc", "family", "ord"))


def build(spark: SparkSession, folder: str, out: str, version: str | None = None, force: bool = False) -> dict[str, str]:
    """Publish chunks, postings, term_stats and corpus of a folder as one version, under a lock; raises Busy while another build runs.

    Texts of files that have not changed come from the previous version unless
    forced. The manifest is written last.
    """
    version = version or str(int(time.time()))
    shots = L.Snapshots(spark, f"{out}/index")
    with L.exclusive(spark, out):
        found = L.with_attempts(lambda: L.listing(spark, folder))
        before = shots.current()
        files = L.extract(found).filter("kind = 'text'")
        if before and not force:
            cached = shots.read("files", before).withColumn("mdv", F.lit(L.TEXT_VERSION)).withColumn("tbv", F.lit(L.TABLE_VERSION))
            good = L.staleness(files, cached).filter("NOT text_stale").select("file_id")
            stale = L.extract(found.join(good, "file_id", "left_anti")).filter("kind = 'text'")
            kept = cached.join(files.select("file_id"), "file_id", "left_semi").join(good, "file_id", "left_semi")
            files = stale.unionByName(kept.select(*stale.columns))
        stage = f"{out}/stage-{version}-{time.time_ns()}"
        files.write.parquet(f"{stage}/files")
        files = spark.read.parquet(f"{stage}/files")
        docs = files.select(F.col("file_id").alias("doc"), "path", "game", "source", "text")
        all_chunks(docs).write.parquet(f"{stage}/chunks")
        chunks = spark.read.parquet(f"{stage}/chunks")
        path = shots.publish({"files": files, "chunks": chunks, **S.index(chunks)}, version)
        stage_path = spark._jvm.org.apache.hadoop.fs.Path(stage)
        stage_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stage_path, True)
        L.write_manifest(shots.read("files", path), version, f"{out}/manifest")
    return {name: f"{path}/{name}" for name in ("files", "chunks", "postings", "term_stats", "corpus")}


class Library:
    """Answers from the version that was current when it was opened; ``reload`` takes the newest."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self._shots = spark, L.Snapshots(spark, f"{out}/index")
        self.reload()

    def reload(self) -> None:
        path = self._shots.current()
        if path is None:
            raise FileNotFoundError("no version has been published yet")
        read = lambda name: self._shots.read(name, path)
        self.chunks = read("chunks")
        self.index = {name: read(name) for name in ("postings", "term_stats", "corpus")}

    def search(self, query: str, k: int = 5, game: str | None = None, book: str | None = None, categories: list[str] | None = None, min_rel: float | None = None) -> DataFrame:
        """rank, score and the chunk of the best hits."""
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        scope = S.in_scope(self.chunks, game, book, categories)
        hits = S.top_hits(S.bm25(self.index, asked, scope), k, min_rel)
        return hits.join(self.chunks, "chunk_id").drop("query_id").orderBy("rank")

    def lookup(self, query: str, game: str | None = None) -> DataFrame:
        """The unified lookup: twelve hits, without reference clutter, the first eight."""
        hits = self.search(query, 12, game).filter("category <> 'reference'")
        return hits.orderBy("rank").limit(8)

    def table(self, query: str, game: str | None = None) -> DataFrame:
        return self.search(query, 8, game, categories=["tables"], min_rel=0.6)

    def domain(self, query: str, domain: str, game: str | None = None) -> DataFrame:
        """Hits and named entries of a domain (ability, rule, item, transport, table, class), best first."""
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        hits = R.domain_lookup(self.chunks, self.index, asked, domain, game).drop("query_id", "source")
        return hits.join(self.chunks, "chunk_id").orderBy("rank")

    def career(self, name: str, game: str) -> DataFrame:
        """Sections of a career: from its cards, else put together from what is said of it."""
        return R.find_career(self.chunks, self.index, game, name)

    def sources(self) -> DataFrame:
        return self.chunks.groupBy("game", "source").agg(F.count(F.lit(1)).alias("chunks")).orderBy("game", "source")


def main(argv: list[str] | None = None) -> int:
    """0: published; 2: no folder to read or no place to write was named; 3: another build runs."""
    parser = argparse.ArgumentParser(description="Index a folder of books.", exit_on_error=False)
    parser.add_argument("folder", nargs="?", default=os.environ.get("FOLIOSCOPE_FOLDER"))
    parser.add_argument("out", nargs="?", default=os.environ.get("FOLIOSCOPE_OUT"))
    parser.add_argument("--version")
    parser.add_argument("--force", action="store_true", help="extract all files anew")
    args = parser.parse_args(argv)
    if not args.folder or not args.out:
        print("name a folder and an output folder, or set FOLIOSCOPE_FOLDER and FOLIOSCOPE_OUT", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    try:
        for name, path in build(spark, args.folder, args.out, args.version, args.force).items():
            print(name, path)
    except L.Busy as busy:
        print(busy, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
