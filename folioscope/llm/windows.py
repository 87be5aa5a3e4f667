"""Entries: every window of a text, named by few fingerprints.

A window is ``width`` consecutive units (words or bytes). Its anchor is the
gram of ``gram`` units inside it with the least hash (the leftmost of equals),
so equal windows have equal anchors at equal offsets. Neighbouring windows with
the same anchor form an entry: ``h`` is the hash of the anchor gram and ``f``
the fingerprint of everything the entry's windows cover and of where the anchor
stands. Entries with equal f hold equal windows throughout; windows of entries
with different h differ; only entries with equal h and different f are left to
compare by window. An entry stands for about half as many windows as fit over
an anchor, which is what keeps shuffles small.

Rows of the entry table: ``k`` where the entry meets its like (h, or a salted
key for an anchor that is very frequent in one slice), ``f``, ``doc`` and
``tag`` (a row's id and 64-bit hash of its text, which tell texts that share a
doc_id or have none) and ``pos``: first window, how far behind it the anchor
stands, number of windows and marks.

Texts of any length are read in pieces of PIECE windows, so memory is bounded by
a slice of rows and a piece. An entry that a piece's end cuts has a fingerprint
of its own and is compared by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, PolyHash, byte_rows, mix64, slices, word_hashes, word_spans

HOT, REPEATED, REMOVED = 1, 2, 4
#: Reps of one anchor in a slice beyond which the anchor counts as hot, and how many of them keep its own key.
HOT_AT, HOT_KEEP = 8, 2
#: Windows that one pass handles; places inside a piece fit into _PLACE_BITS bits.
PIECE, _PLACE_BITS = 1 << 22, 28
_BASE = 0xD1342543DE82EF95
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

ENTRY = "k long, f long, doc long, tag long, pos long"


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """doc (null: the least long), tag (the text's hash) and text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(text).alias("tag"),
        text.alias("text"),
        *others,
    )


def pos_first(pos: Column) -> Column:
    return F.shiftright(pos, 21)


def pos_anchor(pos: Column) -> Column:
    """Units from the first window's start to the anchor."""
    return F.shiftright(pos, 12).bitwiseAND(F.lit(0x1FF))


def pos_count(pos: Column) -> Column:
    return F.shiftright(pos, 3).bitwiseAND(F.lit(0x1FF))


def pos_marks(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(7))


class Units:
    """The units of a slice of rows: their places in the bytes, and hashes of any stretch of them."""

    def __init__(self, column: pa.Array, unit: str):
        self.data, self.byte_offsets = byte_rows(column)
        if unit == "word":
            self.starts, self.ends, self.offsets = word_spans(self.data, self.byte_offsets)
        else:
            self.starts = self.ends = None
            self.offsets = self.byte_offsets

    def poly(self, low: int, high: int) -> PolyHash:
        """Hashes of ranges of the units from low to high; places count from low."""
        if self.starts is None:
            return PolyHash(_BYTE_VALUES[self.data[low:high]], _BASE)
        if low == high:
            return PolyHash(np.zeros(0, np.uint64), _BASE)
        begin, end = int(self.starts[low]), int(self.ends[high - 1])
        return PolyHash(word_hashes(self.data[begin:end], self.starts[low:high] - begin, self.ends[low:high] - begin), _BASE)


def entries(units: Units, width: int, gram: int, piece: int = PIECE):
    """Per piece (row, first window, windows, anchor behind the first window, h, f) of every entry; first windows count from the start of the slice."""
    n = int(units.offsets[-1])
    for low in range(0, max(0, n - width + 1), piece):
        yield _piece_entries(units, width, gram, low, min(n, low + piece + width - 1))


def _piece_entries(units: Units, width: int, gram: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    n, poly = high - low, units.poly(low, high)
    at = np.arange(n - gram + 1)
    hashes = mix64(poly.ranges(at, at + gram))
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_least((hashes & ~place) | at.astype(np.uint64), width - gram + 1)
    begin, end = units.offsets[:-1], units.offsets[1:] - width + 1  # starts whose window fits into their row
    fits = (end > begin) & (end > low) & (begin < high - width + 1)
    whole = np.zeros(n - width + 2, np.int8)
    np.add.at(whole, np.maximum(begin[fits] - low, 0), 1)
    np.add.at(whole, np.minimum(end[fits] - low, n - width + 1), -1)
    start = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8) > 0)
    anchor = (least[start] & place).astype(np.int64)
    row = np.searchsorted(units.offsets, start + low, side="right") - 1
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(start) else start
    first, count = start[fresh], np.diff(np.append(fresh, len(start)))
    anchor, row = anchor[fresh], row[fresh]
    shape = ((anchor - first) << 20 | count).astype(np.uint64)
    f = mix64(poly.ranges(first, first + count - 1 + width) ^ mix64(shape + np.uint64(0x51ED270B)))
    return row, first + low, count, anchor - first, hashes[anchor], f


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _merged(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows without gaps, from entries in any order."""
    if not len(row):
        return row, first, count
    order = np.lexsort((first, row))
    row, first, count = row[order], first[order], count[order]
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + count[:-1])]))
    return row[fresh], first[fresh], np.add.reduceat(count, fresh)


def entry_table(rows: DataFrame, unit: str, width: int, gram: int, all_occurrences: bool, slice_bytes: int = 2 << 20) -> DataFrame:
    """The entries of rows (doc, tag, text), with repeats inside a slice settled at once.

    Of entries with equal f in a slice, one goes on as their representative: the
    earliest; the others are known to be removed and only pass through, merged,
    under keys that spread them. With ``all_occurrences`` the representative is
    removed too and goes on with the mark REPEATED. This keeps a key that a
    third of all rows share down to a row per slice.
    """

    def settled(units: Units, doc: np.ndarray, tag: np.ndarray, row, first, count, behind, h, f) -> pa.RecordBatch:
        own = first - units.offsets[:-1][row]
        order = np.lexsort((tag[row], own, doc[row], f))
        row, first, own, count, behind, h, f = (x[order] for x in (row, first, own, count, behind, h, f))
        head = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        leader = np.flatnonzero(head)
        marks = np.zeros(len(f), np.int64)
        if all_occurrences:
            repeated = np.bincount(group, minlength=len(leader))[group] > 1 if len(f) else head
            gone, stays = repeated, head
            marks[repeated] |= REPEATED
        else:
            lead = leader[group]
            earliest = (doc[row] == doc[row[lead]]) & (own == own[lead])
            gone = ~earliest
            # of the earliest, one of each text goes on
            stays = earliest & np.concatenate([[True], (tag[row][1:] != tag[row][:-1]) | ~earliest[:-1] | head[1:]]) if len(f) else earliest
        g_row, g_first, g_count = _merged(row[gone], own[gone], count[gone])
        g_key = mix64(mix64(doc[g_row].astype(np.uint64) ^ tag[g_row].astype(np.uint64)) ^ g_first.astype(np.uint64))
        row, own, count, behind, h, f, marks = (x[stays] for x in (row, own, count, behind, h, f, marks))
        key = h.copy()
        if len(h):
            by_h = np.argsort(h, kind="stable")
            fresh = np.concatenate([[True], h[by_h][1:] != h[by_h][:-1]])
            begin = np.flatnonzero(fresh)
            which = np.cumsum(fresh) - 1
            hot = np.diff(np.append(begin, len(h)))[which] > HOT_AT
            marks[by_h[hot]] |= HOT
            salted = by_h[hot & (np.arange(len(h)) - begin[which] >= HOT_KEEP)]
            key[salted] = mix64(h[salted] ^ mix64(f[salted]))
        columns = (
            np.concatenate([key, g_key]).view(np.int64),
            np.concatenate([f.view(np.int64), g_count]),
            np.concatenate([doc[row], doc[g_row]]),
            np.concatenate([tag[row], tag[g_row]]),
            np.concatenate([own << 21 | behind << 12 | count << 3 | marks, g_first << 21 | REMOVED]),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "f", "doc", "tag", "pos"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                units = Units(part.column("text"), unit)
                doc, tag = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
                for found in entries(units, width, gram):
                    yield settled(units, doc, tag, *found)

    return rows.mapInArrow(run, ENTRY)


def removed_rows(entries_: DataFrame) -> DataFrame:
    """doc, tag, first, count of runs of removed windows, from rows that pos marks or that stand for one entry."""
    gone = pos_marks(F.col("pos")).bitwiseAND(F.lit(REMOVED)) != 0
    return entries_.select(
        "doc", "tag", pos_first(F.col("pos")).alias("first"),
        F.when(gone, F.col("f")).otherwise(pos_count(F.col("pos"))).alias("count"),
    )


def with_lists(rows: DataFrame, lists: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc, tag, text, ...) with, per document, the list of structs of ``columns`` (null: none)."""
    grouped = lists.groupBy(F.col("doc").alias("l_doc"), F.col("tag").alias("l_tag")).agg(F.collect_list(F.struct(*columns)).alias("items"))
    return rows.join(grouped, (F.col("doc") == F.col("l_doc")) & (F.col("tag") == F.col("l_tag")), "left").drop("l_doc", "l_tag")


def list_arrays(column: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row offsets, flat arrays of the fields) of a list-of-structs column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), [np.asarray(flat.field(i)) for i in range(fields)]


def covered(offsets: np.ndarray, item_offsets: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Flags of the units that the given windows cover; offsets are those of the rows' units."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(item_offsets))
    begin = offsets[:-1][row] + first
    end = begin + count - 1 + width
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else begin
    change = np.zeros(int(offsets[-1]) + 1, np.int8)
    change[begin[fresh]] = 1
    change[end[np.append(fresh[1:], len(end)) - 1] if len(fresh) else end] = -1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


WINDOW = "d1 long, d2 long, doc long, tag long, pos long"
#: Windows that are digested at once.
DIGESTS = 1 << 18


def window_digests(rows: DataFrame, unit: str, width: int, all_occurrences: bool) -> DataFrame:
    """128-bit digests of single windows, from rows (doc, tag, text, items: first, count).

    Windows are digested in a canonical form (words joined by a space, or the
    bytes); of a window that several items have, one is. Repeats among the windows
    digested at once are settled as in entry_table. What goes beyond a text's end
    is left out.
    """
    import xxhash

    def digested(units: Units, doc: np.ndarray, tag: np.ndarray, row: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        at = units.offsets[:-1][row] + own
        low, high = int(at.min()), int(at.max()) + width
        digest = xxhash.xxh3_128_digest
        if unit == "word":
            begin = int(units.starts[low])
            raw = units.data[begin : int(units.ends[high - 1])].tobytes()
            words = [raw[s:e] for s, e in zip((units.starts[low:high] - begin).tolist(), (units.ends[low:high] - begin).tolist(), strict=True)]
            found = b"".join(digest(b" ".join(words[i : i + width])) for i in (at - low).tolist())
        else:
            raw = units.data[low:high].tobytes()
            found = b"".join(digest(raw[i : i + width]) for i in (at - low).tolist())
        d = np.frombuffer(found, "<i8").reshape(-1, 2)
        order = np.lexsort((tag[row], own, doc[row], d[:, 1], d[:, 0]))
        row, own, d = row[order], own[order], d[order]
        head = np.concatenate([[True], (d[1:] != d[:-1]).any(1)])
        group = np.cumsum(head) - 1
        if all_occurrences:
            repeated = np.bincount(group)[group] > 1
            marks = np.where(repeated, REMOVED, 0) | np.where(repeated & head, REPEATED, 0)
        else:
            lead = np.flatnonzero(head)[group]
            marks = np.where((doc[row] == doc[row[lead]]) & (own == own[lead]), 0, REMOVED)
        # what is settled already passes through under keys of its own
        only = (marks & REMOVED) != 0
        if all_occurrences:
            only &= (marks & REPEATED) == 0
        spread = mix64(mix64(doc[row].astype(np.uint64) ^ tag[row].astype(np.uint64)) ^ own.astype(np.uint64)).view(np.int64)
        columns = np.where(only, spread, d[:, 0]), np.where(only, own, d[:, 1]), doc[row], tag[row], own << 21 | 1 << 3 | marks
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d1", "d2", "doc", "tag", "pos"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                units = Units(part.column("text"), unit)
                item_offsets, (first, count) = list_arrays(part.column("items"), 2)
                item_row = np.repeat(np.arange(part.num_rows), np.diff(item_offsets))
                begin = units.offsets[:-1][item_row] + first
                end = np.minimum(begin + count, units.offsets[1:][item_row] - width + 1)
                order = np.argsort(begin, kind="stable")
                order = order[end[order] > begin[order]]
                begin, end = begin[order], np.maximum.accumulate(end[order])
                fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else begin
                item_row, begin = item_row[order][fresh], begin[fresh]
                count = end[np.append(fresh[1:], len(end)) - 1] - begin if len(fresh) else begin
                first = begin - units.offsets[:-1][item_row]
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(count) // DIGESTS)) + 1).tolist(), len(count)]
                doc, tag = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if high > low:
                        many = count[low:high]
                        row = np.repeat(item_row[low:high], many)
                        own = np.repeat(first[low:high] - (np.cumsum(many) - many), many) + np.arange(len(row))
                        yield digested(units, doc, tag, row, own)

    return rows.filter("items IS NOT NULL").select("doc", "tag", "text", "items").mapInArrow(run, WINDOW)
