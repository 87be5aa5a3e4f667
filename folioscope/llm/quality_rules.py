"""Line-first quality rules.

Each line is judged by itself: punctuation (it ends like a sentence and is not
made of runs of marks), navigation (menus and crumbs) and boilerplate (licence,
cookie and account notices). Lines that fail are removed; a document that loses
more than half of its characters this way, or that fails the base counts, is
rejected.

Defined cases: a null text is an empty one; an empty text has no words and
fails the base; blank lines are neither judged nor counted; repeated rows are
judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import IS_SPACE, PolyHash, byte_rows, mix64, slices, word_hashes, word_spans

SPACE = " \t\n\x0b\x0c\r"
END = r"""[.!?:;,…"'”’»)\]]$"""
MARK_RUNS = r"[#*$%&!?<>]{2,}"
CRUMBS = r"[|»›]"
BOILERPLATE = (
    r"(?i)lorem ipsum|all rights reserved|cookie|privacy policy|terms of (?:use|service)|javascript"
    r"|licensed under|copyright|©|subscribe|sign up|log ?in\b|click here"
)
#: A line fails with over one run of marks for so many words, or with so many crumbs.
WORDS_A_MARK, MOST_CRUMBS = 5, 2
MOST_LOST = 0.5
GRAM = 5

_END, _MARKS, _CRUMBS, _BOILER = (re.compile(x) for x in (END, MARK_RUNS, CRUMBS, BOILERPLATE))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(line: str) -> bool:
    """Whether a stripped, non-blank line is removed."""
    if not _END.search(line) or len(_CRUMBS.findall(line)) >= MOST_CRUMBS or _BOILER.search(line):
        return True
    runs = len(_MARKS.findall(line))
    return bool(runs) and runs * WORDS_A_MARK > len(_WORD.findall(line))


def split_lines(text: str) -> tuple[list[str], list[str]]:
    """(kept, removed) lines of a text, stripped, blank ones left out."""
    kept, removed = [], []
    for line in text.split("\n"):
        if line := line.strip(SPACE):
            (removed if line_fails(line) else kept).append(line)
    return kept, removed


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(offsets) - 1
    starts, ends, at = word_spans(data, offsets)
    counts = np.diff(at)

    def row_sums(flags: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=prefix[1:])
        return prefix[offsets[1:]] - prefix[offsets[:-1]]

    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    out = {
        "n_words": counts,
        "word_chars": row_sums(((data & 0xC0) != 0x80) & ~IS_SPACE[data]),
        "n_symbols": row_sums(symbol[data]),
    }
    # lines: pieces between line feeds and row ends that hold a word
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    line_row = np.searchsorted(offsets[1:], line_ends, side="left")
    real = line_ends > line_starts
    line_starts, line_ends, line_row = line_starts[real], line_ends[real], line_row[real]
    real = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_row = line_starts[real], line_ends[real], line_row[real]
    salt = mix64(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = mix64(PolyHash(data.astype(np.uint64) + np.uint64(1)).ranges(line_starts, line_ends)) ^ salt[line_row]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    # five-word windows that occur twice or more in the same row
    n = len(starts)
    covered = np.zeros(n + 1, np.int64)
    if n >= GRAM:
        word_row = np.repeat(np.arange(rows), counts)
        first = np.flatnonzero(word_row[: n - GRAM + 1] == word_row[GRAM - 1 :])
        grams = mix64(PolyHash(word_hashes(data, starts, ends)).ranges(first, first + GRAM)) ^ salt[word_row[first]]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        repeated = np.zeros(len(grams), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        np.add.at(covered, first[repeated], 1)
        np.add.at(covered, first[repeated] + GRAM, -1)
    prefix = np.zeros(n + 1, np.int64)
    np.cumsum(np.cumsum(covered[:n]) > 0, out=prefix[1:])
    out["n_repeat_words"] = prefix[at[1:]] - prefix[at[:-1]]
    return out


def _row_of_lines(text: str | None) -> tuple[int, int, int, int]:
    kept, removed = split_lines(text or "")
    return len(kept), len(removed), sum(map(len, kept)), sum(map(len, removed))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_chars_removed long"
)


def judge(docs: DataFrame) -> DataFrame:
    """The counts and the verdict for every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts = base_counts(*byte_rows(part.column("text")))
                lines = np.array([_row_of_lines(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, 4)
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                lost = lines[:, 3] > MOST_LOST * (lines[:, 2] + lines[:, 3])
                longs = [counts[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                arrays = [pa.array(x, pa.int64()) for x in longs] + [pa.array(failed), pa.array(~failed & ~lost)]
                arrays += [pa.array(x, pa.int64()) for x in (lines[:, 0] + lines[:, 1], lines[:, 1], lines[:, 3])]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame) -> DataFrame:
    """docs with their failing lines removed from the text; rejected documents are left out.

    The columns of docs are kept as they are; a removed line takes its line feed along.
    """
    verdict = judge(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()

    def strip(batches):
        for batch in batches:
            texts = ["\n".join(split_lines(t or "")[0]) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pc.cast(pa.array(texts, pa.string()), batch.schema.field(at).type))

    kept = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.mapInArrow(strip, docs.schema)


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and line-first verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_SQL_RE = {k: v.replace("'", "''") for k, v in {"end": END, "marks": MARK_RUNS, "crumbs": CRUMBS, "boiler": BOILERPLATE}.items()}

OP5_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tok AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), gram AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' ||
         lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g
  FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM gram
), cov AS (
  SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM rep
), repeats AS (
  SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id
), raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), ln AS (
  SELECT doc_id, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM raw
), judged AS (
  SELECT doc_id, line,
    NOT regexp_matches(line, '{_SQL_RE["end"]}')
    OR len(regexp_extract_all(line, '{_SQL_RE["crumbs"]}')) >= {MOST_CRUMBS}
    OR regexp_matches(line, '{_SQL_RE["boiler"]}')
    OR len(regexp_extract_all(line, '{_SQL_RE["marks"]}')) * {WORDS_A_MARK} > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS bad
  FROM ln WHERE line <> ''
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad,
         sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (WHERE bad), 0) AS bad_chars
  FROM judged GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad, coalesce(chars, 0) AS chars, coalesce(bad_chars, 0) AS bad_chars
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (bad_chars > {MOST_LOST} * chars) AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad AS BIGINT) AS n_lines_removed, CAST(bad_chars AS BIGINT) AS n_chars_removed
FROM base
"""
