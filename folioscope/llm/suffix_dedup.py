"""Suffix-array dedup by a run-length index.

Bytes that a 200-byte string covers which also starts elsewhere are removed.
Entries (windows.py) settle what repeats in whole contexts: entries with equal
fingerprint repeat in every window. What is left are contexts that share an
anchor but differ around it, at the ends of repeated passages. They are shipped
to their anchor's key and indexed in blocks: the block's text gets a suffix
array and a Burrows-Wheeler transform that is kept as runs of equal letters,
with suffix-array samples at the two ends of each run. Inside a run the match
with the neighbouring suffix shrinks by one from position to position, so match
lengths are computed at run ends alone and streamed over the text as matching
statistics; windows whose longest match is 200 bytes or more are marked.

Groups of contexts are bounded, so blocks are. An anchor that is very frequent in
one slice (HOT), or whose contexts come to more than GROUP_LETTERS in all slices
together, would put its contexts into one block without bound; its windows are
compared by 128-bit digests instead, which is exact and spreads over all tasks.
Windows whose distance to the anchor is the same in steps of STEPS are a cell; they
have a core in common and lie in one hull. Cells that repeat as a whole are settled
by their hulls, those without a repeat by their cores, and only what is between,
at the ends of a repeat, is cut into finer cells and at last into windows.

Defined cases: a null text is an empty one; bytes are those of UTF-8, matches
never cross documents and what remains may cut a character; rows that share
doc_id and text are documents of their own, so each is elsewhere for the other;
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscope.llm.common import NULL_ID, PolyHash, byte_rows, drop_materialized, materialize, mix64, slices
from folioscope.llm.windows import (
    DIGESTS,
    HOT,
    REMOVED,
    REPEATED,
    _merged,
    covered,
    entry_table,
    keyed,
    list_arrays,
    pos_anchor,
    pos_count,
    pos_first,
    pos_marks,
    removed_rows,
    with_lists,
)

WIDTH, GRAM = 200, 72
#: Letters from which a block is indexed, and the most that the contexts of an anchor have to be one group of a block.
BLOCK_LETTERS, GROUP_LETTERS = 1 << 18, 1 << 17
#: Letters that are packed into the first ranks of suffixes.
PACKED = 5
#: Neighbouring windows of a frequent anchor that are a cell; each divides the one before.
STEPS = (16, 4)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, with suffix-array samples at run ends."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        letters = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
        letters[self.starts + lengths] = np.arange(len(texts))  # ends of texts are letters of their own
        self.letters = letters
        order = suffix_order(letters, len(texts))
        before = letters[order - 1]  # position -1 is the last end, which is a letter of its own
        head = np.concatenate([[True], before[1:] != before[:-1]])
        tail = np.concatenate([head[1:], [True]])
        #: Letters and lengths of the runs.
        self.run_letters = before[head]
        self.run_lengths = np.diff(np.append(np.flatnonzero(head), len(before)))
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
        #: At run ends: the suffix sampled there and its neighbour outside the run.
        self.above = (order[heads[1:]], order[heads[1:] - 1])
        self.below = (order[tails[:-1]], order[tails[:-1] + 1])
        self.outer = (order[heads[0]], order[tails[-1]])
        self._hash = PolyHash(mix64(letters.astype(np.uint64) + np.uint64(0x9E37)))

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the longest common start of two suffixes, by bisection over hashes."""
        n = len(self.letters)
        low = np.zeros(len(left), np.int64)
        high = n - np.maximum(left, right)
        step = 1 << max(0, int(high.max(initial=0)).bit_length())
        while step:
            reach = low + step
            fits = reach <= high
            a, b = left[fits], right[fits]
            equal = self._hash.ranges(a, a + reach[fits]) == self._hash.ranges(b, b + reach[fits])
            low[np.flatnonzero(fits)[equal]] = reach[fits][equal]
            step >>= 1
        return low

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text, the longest match that starts at another one."""
        n = len(self.letters)
        best = np.zeros(n, np.int64)
        for (sampled, neighbour), edge in ((self.above, self.outer[0]), (self.below, self.outer[1])):
            value = np.full(n, -1, np.int64)
            value[sampled] = self.common(sampled, neighbour)
            value[edge] = 0
            known = np.maximum.accumulate(np.where(value >= 0, np.arange(n), -1))
            inside = known >= 0
            streamed = np.zeros(n, np.int64)
            streamed[inside] = value[known[inside]] - (np.arange(n)[inside] - known[inside])
            best = np.maximum(best, streamed)
        return best


def suffix_order(letters: np.ndarray, texts: int) -> np.ndarray:
    """Suffix array by doubling; letters below ``texts`` occur once each, the last letter is one of them."""
    n = len(letters)
    ends = letters < texts
    packed, live, end = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
    for i in range(PACKED):  # up to the suffix's text's end, whose own letter parts what is equal so far
        letter = np.zeros(n, np.int64)
        letter[: n - i] = np.where(ends[i:], 0, letters[i:] - texts + 1)
        letter *= live
        packed = packed << 9 | letter
        here = np.zeros(n, bool)
        here[: n - i] = ends[i:]
        here &= live
        end[here] = letters[np.flatnonzero(here) + i] + 1
        live &= ~here
    keys = packed * (texts + 1) + end if texts < 1 << 17 else _ranks_of(np.lexsort((end, packed)), packed, end)
    order = np.argsort(keys)
    rank, step = _ranks(keys[order], order), PACKED
    while rank.max(initial=0) < n - 1:
        keys = rank * (n + 1)
        keys[: n - step] += rank[step:] + 1
        order = np.argsort(keys)
        rank = _ranks(keys[order], order)
        step *= 2
    return order


def _ranks_of(order: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    a, b, rank = first[order], second[order], np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return rank


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return rank


def long_matches(contexts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per context, runs (first, count) of the starts of ``width`` bytes that also start elsewhere in the contexts."""
    index = RunLengthIndex(contexts)
    edges = np.diff((index.matching_statistics() >= width).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)  # a match ends before its text's end, so no run crosses one
    at = np.searchsorted(begin, np.append(index.starts, len(index.letters)))
    return [(begin[a:b] - s, (end - begin)[a:b]) for a, b, s in zip(at[:-1], at[1:], index.starts, strict=True)]


_CONTEXT = "k long, doc long, tag long, first long, want boolean, context binary"


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """The bytes that each open entry's windows cover."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_rows(part.column("text"))
                raw = data.tobytes()
                item_offsets, (first, count, key, want) = list_arrays(part.column("items"), 4)
                row = np.repeat(np.arange(part.num_rows), np.diff(item_offsets))
                begin = offsets[:-1][row] + first
                texts = [raw[b:e] for b, e in zip(begin.tolist(), (begin + count - 1 + width).tolist(), strict=True)]
                doc, tag = np.asarray(part.column("doc"))[row], np.asarray(part.column("tag"))[row]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(tag), pa.array(first), pa.array(want), pa.array(texts, pa.binary())], ["k", "doc", "tag", "first", "want", "context"])

    return rows.filter("items IS NOT NULL").select("doc", "tag", "text", "items").mapInArrow(run, _CONTEXT)


def _marks(contexts: DataFrame, width: int, partitions: int) -> DataFrame:
    """Repeated windows of contexts that meet at their key, by a run-length index per block."""

    def judged(block: list[tuple]) -> pa.RecordBatch:
        found = long_matches([row[5] for row in block], width)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for (_, doc, tag, first, want, _), (begin, count) in zip(block, found, strict=True):
            if want and len(begin):
                for column, values in zip(out, (np.full(len(begin), doc), np.full(len(begin), tag), begin + first, count), strict=True):
                    column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["doc", "tag", "first", "count"])

    def run(batches):
        block, letters, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if letters >= BLOCK_LETTERS and row[0] != last:
                    yield judged(block)
                    block, letters = [], 0
                block.append(row)
                letters += len(row[5]) + 1
                last = row[0]
        if block:
            yield judged(block)

    return contexts.repartition(partitions, "k").sortWithinPartitions("k").mapInArrow(run, "doc long, tag long, first long, count long")


def removed_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc, tag, first, count: runs of windows that occur more than once."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    met = entry_table(rows, "byte", width, gram, all_occurrences=True).repartition(partitions, "k")
    marks = pos_marks(F.col("pos"))
    same, anchor = Window.partitionBy("k", "f"), Window.partitionBy("k")
    passing = marks.bitwiseAND(F.lit(REMOVED)) != 0
    letters = F.when((F.col("rank") == 1) & ~passing, pos_count(F.col("pos")) + (width - 1)).otherwise(0)
    met = (
        met.withColumn("rank", F.row_number().over(same.orderBy("doc", "tag", "pos")))
        .withColumn("n", F.count(F.lit(1)).over(same))
        .withColumn("known", F.max(marks.bitwiseAND(F.lit(REPEATED))).over(same) > 0)
        .withColumn("shared", (F.min("f").over(anchor) != F.max("f").over(anchor)))
        .withColumn("hot", (F.max(marks.bitwiseAND(F.lit(HOT))).over(anchor) > 0) | (F.sum(letters).over(anchor) > GROUP_LETTERS))
    )
    repeated = (F.col("n") > 1) | F.col("known")
    # a repeated representative was reported by its slice, with the others
    report = passing | (repeated & (marks.bitwiseAND(F.lit(REPEATED)) == 0))
    open_ = ~passing & (F.col("rank") == 1) & (F.col("shared") | F.col("hot"))
    met = met.select("k", "f", "doc", "tag", "pos", "hot", report.alias("report"), open_.alias("open"), (~repeated).alias("want")).filter("report OR open")
    met = materialize(met, "suffix-entries")
    settled = removed_rows(met.filter("report"))
    left = met.filter("open").select(
        "k", "doc", "tag", "hot", "want", pos_first(F.col("pos")).alias("first"), pos_count(F.col("pos")).alias("count"), pos_anchor(F.col("pos")).alias("behind")
    )
    cold = with_lists(rows, left.filter("NOT hot"), ["first", "count", "k", "want"])
    contexts = materialize(_contexts(cold, width), "suffix-contexts")
    marked = materialize(_marks(contexts, width, partitions), "suffix-marks")
    drop_materialized(contexts)
    return settled.unionByName(marked).unionByName(_frequent(rows, left.filter("hot"), width))


def _frequent(rows: DataFrame, open_: DataFrame, width: int) -> DataFrame:
    """doc, tag, first, count: repeated windows of entries (doc, tag, first, count, behind) of frequent anchors.

    Of windows that start ``r`` units before the anchor, those with equal r // step
    are a cell. Its windows all hold the same ``width - step + 1`` units, the core,
    and together cover ``width + step - 1``, the hull, both at fixed places before
    the anchor. Where the hull repeats all windows of the cell do, and one cell of
    each such hull goes on for others to meet; where the core does not repeat none
    of them does. Only cells between the two are cut into finer ones.
    """
    steps = (*(step for step in STEPS if step < width), 1)
    step = steps[0]
    last, first = F.floor(F.col("behind") / step), F.floor((F.col("behind") - F.col("count") + 1) / step)
    cells = open_.withColumn("g", F.explode(F.sequence(first, last))).select("doc", "tag", (F.col("first") + F.col("behind") - F.col("g") * step - (step - 1)).alias("first"))
    found = None
    for step, finer in zip(steps, (*steps[1:], None), strict=True):
        hull = Window.partitionBy("h1", "h2")
        met = (
            _cell_digests(with_lists(rows, cells, ["first"]), width, step)
            .withColumn("rank", F.row_number().over(hull.orderBy("doc", "tag", "first")))
            .withColumn("n", F.count(F.lit(1)).over(hull))
            .withColumn("known", F.max((F.col("kind") == KNOWN).cast("int")).over(hull) > 0)
            .withColumn("repeats", F.col("kind").isin(WHOLE, KNOWN) & ((F.col("n") > 1) | F.col("known")))
        )
        met = materialize(met.drop("h1", "h2", "n", "known"), "suffix-cells")
        done = met.filter(F.col("repeats") | (F.col("kind") == SETTLED)).select("doc", "tag", "first", "count")
        found = done if found is None else found.unionByName(done)
        if finer is not None:
            kept = met.filter((F.col("kind") != SETTLED) & (~F.col("repeats") | (F.col("rank") == 1)))
            many = kept.groupBy(F.col("c1").alias("m1"), F.col("c2").alias("m2")).agg(F.count(F.lit(1)).alias("cores")).filter("cores > 1")
            cut = kept.join(many, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")))
            parts = F.explode(F.sequence(F.lit(0), F.lit(step - finer), F.lit(finer)))
            cells = cut.withColumn("part", parts).select("doc", "tag", (F.col("first") + F.col("part")).alias("first"))
    return found


#: Cells that are known to repeat and go no further; whose hull is the only one so far; whose hull repeats; whose hull the text's ends cut.
SETTLED, WHOLE, KNOWN, CUT = range(4)
_CELL = "h1 long, h2 long, c1 long, c2 long, doc long, tag long, first long, count long, kind int"


def _cell_digests(rows: DataFrame, width: int, step: int) -> DataFrame:
    """128-bit digests of hull and core of cells of ``step`` windows, from rows (doc, tag, text, items: first window).

    Of the cells with equal hulls that are digested at once, one goes on as KNOWN;
    the others are SETTLED and pass through, merged, under keys that spread them.
    A cell none of whose windows fits into its text is left out.
    """
    import xxhash

    digest = xxhash.xxh3_128_digest

    def digests(raw: bytes, begin: np.ndarray, length: int) -> np.ndarray:
        return np.frombuffer(b"".join(digest(raw[b : b + length]) for b in begin.tolist()), "<i8").reshape(-1, 2)

    def spread(doc: np.ndarray, tag: np.ndarray, first: np.ndarray) -> np.ndarray:
        return mix64(mix64(doc.astype(np.uint64) ^ tag.astype(np.uint64)) ^ first.astype(np.uint64)).view(np.int64)

    def digested(raw: bytes, offsets: np.ndarray, doc: np.ndarray, tag: np.ndarray, row: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        begin = offsets[:-1][row] + first
        cut = (first < 0) | (begin + (width + step - 1) > offsets[1:][row])
        hull = np.column_stack([spread(doc[row], tag[row], first), first])
        hull[~cut] = digests(raw, begin[~cut], width + step - 1)
        order = np.lexsort((first, tag[row], doc[row], hull[:, 1], hull[:, 0], cut))
        row, first, begin, cut, hull = row[order], first[order], begin[order], cut[order], hull[order]
        head = np.concatenate([[True], (hull[1:] != hull[:-1]).any(1)]) | cut
        group = np.cumsum(head) - 1
        kind = np.where(cut, CUT, np.where(np.bincount(group)[group] > 1, KNOWN, WHOLE))
        s_row, s_first, s_count = _merged(row[~head], first[~head], np.full(int((~head).sum()), step))
        row, first, begin, hull, kind = row[head], first[head], begin[head], hull[head], kind[head]
        core = digests(raw, begin + (step - 1), width - step + 1) if step > 1 else hull
        none = np.zeros(len(s_row), np.int64)
        columns = (
            *(np.concatenate([x, y]) for x, y in ((hull[:, 0], spread(doc[s_row], tag[s_row], s_first)), (hull[:, 1], s_first), (core[:, 0], none), (core[:, 1], none))),
            *(np.concatenate([x[row], x[s_row]]) for x in (doc, tag)),
            np.concatenate([first, s_first]), np.concatenate([np.full(len(row), step), s_count]),
        )
        kinds = pa.array(np.concatenate([kind, np.full(len(s_row), SETTLED)]), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), kinds], [x.split()[0] for x in _CELL.split(", ")])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = byte_rows(part.column("text"))
                raw = data.tobytes()
                item_offsets, (first,) = list_arrays(part.column("items"), 1)
                row = np.repeat(np.arange(part.num_rows), np.diff(item_offsets))
                fits = (first + (step - 1) >= 0) & (offsets[:-1][row] + first + width <= offsets[1:][row])
                row, first = row[fits], first[fits]
                order = np.lexsort((first, row))
                row, first = row[order], first[order]
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1])]) if len(row) else fits[:0]
                row, first = row[fresh], first[fresh]  # several entries may have a cell
                doc, tag = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
                for low in range(0, len(row), DIGESTS):
                    yield digested(raw, offsets, doc, tag, row[low : low + DIGESTS], first[low : low + DIGESTS])

    return rows.filter("items IS NOT NULL").select("doc", "tag", "text", "items").mapInArrow(run, _CELL)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_windows(docs: DataFrame, removed: DataFrame, width: int = WIDTH, with_bytes: bool = True) -> DataFrame:
    """Per document the bytes that are left and how many, in how many spans, are gone."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_rows(part.column("text"))
                item_offsets, (first, count) = list_arrays(part.column("items"), 2)
                gone = covered(offsets, item_offsets, first, count, width)
                out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                    flags = gone[low:high]
                    left = data[low:high][~flags].tobytes()
                    out["n_bytes"].append(int(high - low))
                    out["n_removed"].append(int(flags.sum()))
                    out["n_spans"].append(int(flags[:1].sum() + np.count_nonzero(flags[1:] & ~flags[:-1])))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    out["kept"].append(left if with_bytes else None)
                ids = [None if x == NULL_ID else x for x in part.column("doc").to_pylist()]
                longs = {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), **longs, "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})

    return with_lists(keyed(docs), removed, ["first", "count"]).mapInArrow(run, SCHEMA)


def cut_documents(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with the removed bytes taken out of the text, and n_chars, if there is one, counted anew.

    A null text stays null; a character that was cut in two goes as a whole.
    """
    others = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")
    rows = with_lists(keyed(docs, others), removed_windows(docs, width, gram), ["first", "count"])
    schema = StructType([rows.schema["row"], StructField("left", StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_rows(part.column("text"))
                item_offsets, (first, count) = list_arrays(part.column("items"), 2)
                keep = ~covered(offsets, item_offsets, first, count, width)
                null = part.column("text").is_null().to_pylist()
                spans = zip(offsets[:-1], offsets[1:], null, strict=True)
                left = [None if n else data[a:b][keep[a:b]].tobytes().decode("utf-8", "ignore") for a, b, n in spans]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(left, pa.string())], ["row", "left"])

    done = rows.mapInArrow(run, schema)
    columns = []
    for field in docs.schema.fields:
        value = F.col("row").getField(field.name)
        if field.name == "text":
            value = F.col("left").cast(field.dataType)
        elif field.name == "n_chars":
            value = F.coalesce(F.char_length("left").cast(field.dataType), value)
        columns.append(value.alias(field.name))
    return done.select(*columns)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated 200-byte string covers, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_windows(docs, removed_windows(docs), with_bytes=False).drop("kept")
