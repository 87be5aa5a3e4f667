"""Algebra of cell grids (array<array<string>>): no row leaves Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import text as T

GRID = "array<array<string>>"
# Labels of stat blocks (fixed values).
SHIP_PARTS = ["hull", "armour", "armor", "m-drive", "j-drive", "manoeuvre drive", "jump drive", "power plant", "power", "bridge", "computer", "sensors", "staterooms", "stateroom", "cargo", "fuel", "fuel tanks", "weapons", "weapon", "systems", "software", "common areas", "airlock", "drive", "screens", "turret", "hardpoints", "hardpoint", "armoured bulkheads"]
VEHICLE_MARKERS = ["agility", "speed (cruise)", "speed (max)", "tactical speed", "vehicle speed", "range (cruise)", "passengers", "shipping"]
VEHICLE_PARTS = [*VEHICLE_MARKERS, "crew", "cargo", "hull", "cost", "tl", "skill", "locomotion", "secondary locomotion", "armour", "armor", "weapons", "traits", "cargo hull", "crew passengers", "shipping cost"]


def _cell(c: Column) -> Column:
    return T.trim_all(F.coalesce(c, F.lit("")))


def clean(rows: Column) -> Column:
    """Cells trimmed, nulls empty, blank rows gone."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, _cell)), lambda r: F.exists(r, lambda c: c != ""))


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def drop_empty_columns(rows: Column) -> Column:
    """Ragged rows padded, columns without a value gone."""
    good = F.filter(indices(width(rows)), lambda j: F.exists(rows, lambda r: F.coalesce(F.get(r, j), F.lit("")) != ""))
    return F.transform(rows, lambda r: F.transform(good, lambda j: F.coalesce(F.get(r, j), F.lit(""))))


def first_column(rows: Column) -> Column:
    return F.filter(F.transform(rows, lambda r: F.lower(_cell(F.get(r, F.lit(0))))), lambda c: c != "")


def _among(labels: Column, known: list[str]) -> Column:
    return F.size(F.filter(labels, lambda c: c.isin(known)))


def is_ship_block(rows: Column) -> Column:
    labels = first_column(rows)
    n = F.size(labels)
    return (n >= 4) & (_among(labels, SHIP_PARTS) >= F.greatest(F.lit(3), (n / 2).cast("int")))


def is_vehicle_block(rows: Column) -> Column:
    labels = first_column(rows)
    n = F.size(labels)
    return (n >= 4) & (_among(labels, VEHICLE_MARKERS) >= 2) & (_among(labels, VEHICLE_PARTS) >= F.greatest(F.lit(4), (n / 2).cast("int")))


def is_real(rows: Column) -> Column:
    """At least four filled cells, and not both sparse and wordless."""
    cells = F.transform(F.flatten(rows), _cell)
    filled = F.filter(cells, lambda c: c != "")
    wordy = F.size(F.filter(filled, lambda c: F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3))
    sparse = (1 - F.size(filled) / F.greatest(F.size(cells), F.lit(1)) > 0.35) & (wordy / F.greatest(F.size(filled), F.lit(1)) < 0.25)
    return (F.size(filled) >= 4) & ~sparse


def name_column(rows: Column) -> Column:
    """The first column at least half of whose values have letters, else 0."""
    data = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))

    def wordy(j: Column) -> Column:
        values = F.filter(F.transform(data, lambda r: F.coalesce(F.get(r, j), F.lit(""))), lambda v: v != "")
        return (F.size(values) > 0) & (2 * F.size(F.filter(values, lambda v: v.rlike("[A-Za-z]"))) >= F.size(values))

    return F.coalesce(F.get(F.filter(indices(F.size(F.get(rows, F.lit(0)))), wordy), F.lit(0)), F.lit(0))


def select_columns(rows: Column, groups: list[list[int]]) -> Column:
    """Each output column joins some source columns by spaces."""
    return F.transform(rows, lambda r: F.array(*(T.collapse(F.concat_ws(" ", *(F.get(r, F.lit(j)) for j in g))) for g in groups)))


def unroll_repeats(rows: Column) -> Column:
    """A header of equal column groups side by side becomes one group, the rows stacked."""
    # what a lambda is applied to is evaluated once, an expression in it once for each element
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def group(header: Column) -> Column:
        n = F.size(header)

        def repeats(k: Column) -> Column:
            first = F.slice(header, F.lit(1), k)
            same = F.forall(indices((n / k).cast("int")), lambda i: F.slice(header, i * k + 1, k) == first)
            return (n % k == 0) & (n / k >= 2) & F.exists(first, lambda c: c != "") & same

        return F.get(F.filter(F.transform(indices((n / 2).cast("int")), lambda i: i + 1), repeats), F.lit(0))

    def stack(g: Column) -> Column:
        header, k, data = g["header"], g["k"], g["data"]
        n = F.size(header)
        at = indices(n)
        padded = F.transform(data, lambda r: F.transform(at, lambda j: F.coalesce(F.get(r, j), F.lit(""))))
        parts = F.flatten(F.transform(padded, lambda r: F.transform(indices((n / k).cast("int")), lambda i: F.slice(r, i * k + 1, k))))
        return F.concat(F.array(F.slice(header, F.lit(1), k)), F.filter(parts, lambda s: F.exists(s, lambda c: T.trim_all(c) != "")))

    def unrolled(rows: Column) -> Column:
        header = F.transform(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), _cell)
        data = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        found = once(header, lambda h: F.struct(h.alias("header"), group(h).alias("k"), data.alias("data")))
        return once(found, lambda g: F.when((F.size(rows) >= 2) & g["k"].isNotNull(), stack(g)).otherwise(rows))

    return once(rows, unrolled)


def merge_headerless(header: Column, row: Column) -> Column:
    """A row whose cells under blank headers are joined to their left neighbours."""
    start = F.array().cast("array<string>")

    def fold(acc: Column, z: Column) -> Column:
        joined = T.trim_all(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), z["c"]))
        return F.when((z["h"] == "") & (F.size(acc) > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(z["c"])))

    return F.aggregate(F.arrays_zip(header.alias("h"), row.alias("c")), start, fold)


def wrapped_pairs(rows: Column) -> Column:
    """(label, value) pairs of a stat block in alternating label and value rows, else null."""
    n = F.size(rows)
    starts = F.filter(indices(n), lambda i: i % 2 == 0)

    def labels_ok(i: Column) -> Column:
        cells = F.filter(F.transform(F.get(rows, i), _cell), lambda c: c != "")
        return (F.size(cells) >= 2) & F.forall(cells, lambda c: (F.length(c) <= 12) & c.rlike("[A-Za-z]") & ~c.rlike("[0-9]"))

    def pairs(i: Column) -> Column:
        both = F.transform(F.get(rows, i), lambda c, j: F.struct(_cell(c).alias("label"), F.coalesce(_cell(F.get(F.get(rows, i + 1), j)), F.lit("")).alias("value")))
        return F.filter(both, lambda p: p["label"] != "")

    return F.when((n >= 4) & (n % 2 == 0) & F.forall(starts, labels_ok), F.flatten(F.transform(starts, pairs)))


def part_value(row: Column, columns: Column) -> Column:
    """The value of a component row; from four columns on, tonnage and cost in brackets."""
    rest = F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), _cell)
    plain = F.array_join(F.filter(rest, lambda c: c != ""), " ")
    desc = F.array_join(F.filter(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 2, F.lit(0))), lambda c: c != ""), " ")
    tons, cost = F.coalesce(F.try_element_at(rest, F.lit(-2)), F.lit("")), F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit(""))
    extra = F.concat_ws(", ", F.when(~tons.isin("", "—"), F.concat(tons, F.lit(" t"))), F.when(~cost.isin("", "—"), F.concat(F.lit("MCr "), cost)))
    return F.when(columns < 4, plain).when(extra == "", desc).otherwise(T.trim_all(F.concat(desc, F.lit(" ("), extra, F.lit(")"))))


def match_row(rows: Column, query: Column) -> Column:
    """Index of the row whose name has most of the query's tokens (at least 0.6), the first of equals; null if none."""
    grid = clean(rows)
    tokens = lambda c: T.long_tokens(c, 1)
    want, at = tokens(query), name_column(grid)
    scores = F.transform(grid, lambda r, i: F.when(i == 0, 0.0).otherwise(F.size(F.array_intersect(want, tokens(F.coalesce(F.get(r, at), F.lit(""))))) / F.greatest(F.size(want), F.lit(1))))
    best = F.array_max(scores)
    return F.when((F.size(want) > 0) & (F.size(grid) >= 2) & (best >= 0.6), F.array_position(scores, best).cast("int") - 1)


def item_pairs(rows: Column, at: Column) -> Column:
    """(label, value) pairs of a data row under its header, blanks left out."""
    zipped = F.zip_with(F.get(rows, F.lit(0)), F.get(rows, at), lambda h, v: F.struct(_cell(h).alias("label"), _cell(v).alias("value")))
    return F.filter(zipped, lambda p: (p["label"] != "") & (p["value"] != ""))


def column_of(header: Column, *needles: str) -> Column:
    """Index of the first header cell that has all needles; -1 if none."""

    def fits(c: Column) -> Column:
        out = F.lit(True)
        for needle in needles:
            out &= F.lower(c).contains(needle)
        return out

    return F.array_position(F.transform(header, fits), True).cast("int") - 1


def is_roll_row(row: Column) -> Column:
    return F.coalesce(T.trim_all(F.get(row, F.lit(0))).rlike(r"^\d{1,2}([–-]\d{1,2})?$"), F.lit(False))


def is_catalog_header(row: Column) -> Column:
    cells = F.filter(F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), _cell), lambda c: c != "")
    return (F.size(cells) >= 3) & F.forall(cells, lambda c: (F.length(c) <= 25) & c.rlike("[A-Za-z]") & ~c.rlike("[0-9]"))


def header_signature(row: Column) -> Column:
    cells = F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), lambda c: F.lower(_cell(c)))
    return F.array_join(F.filter(cells, lambda c: c != ""), "|")


def is_die_header(row: Column) -> Column:
    """A row that begins a stacked roll table: a die label, then short labels of which one has letters."""
    rest = F.filter(F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), _cell), lambda c: c != "")
    die = F.coalesce(T.trim_all(F.get(row, F.lit(0))).rlike(r"^(\d+[dD]\d*|[dD]\d+)$"), F.lit(False))
    return die & (F.size(rest) > 0) & F.forall(rest, lambda c: F.length(c) <= 25) & F.exists(rest, lambda c: c.rlike("[A-Za-z]"))


def cut_at(rows: Column, starts: Column, keep_last) -> Column:
    """Segments of rows from each start to the next; trailing rows that fail ``keep_last`` go, short segments too."""

    def segment(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(rows))
        part = F.slice(rows, start + 1, end - start)
        good = F.array_max(F.transform(part, lambda r, j: F.when((j == 0) | keep_last(r), j).otherwise(0)))
        return F.slice(part, F.lit(1), good + 1)

    return F.filter(F.transform(starts, segment), lambda s: F.size(s) >= 2)


def split_roll_tables(rows: Column) -> Column:
    """The roll tables that are stacked in one grid, or the grid alone."""
    starts = F.filter(indices(F.size(rows)), lambda i: (i == 0) | is_die_header(F.get(rows, i)))
    first = F.coalesce(T.trim_all(F.get(F.get(rows, F.lit(0)), F.lit(0))).rlike(r"^(\d+[dD]\d*|[dD]\d+)$"), F.lit(False))
    parts = cut_at(rows, starts, is_roll_row)
    return F.when((F.size(rows) >= 4) & first & (F.size(parts) > 1), parts).otherwise(F.array(rows))


def split_catalogs(rows: Column) -> Column:
    """The catalogues that are stacked under a repeated header, or the grid alone."""
    signs = F.transform(rows, lambda r: F.when(is_catalog_header(r), header_signature(r)))
    repeated = F.filter(indices(F.size(rows)), lambda i: F.size(F.filter(signs, lambda s: s == F.get(signs, i))) >= 2)

    def is_data(r: Column) -> Column:
        others = F.filter(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda c: _cell(c) != "")
        return F.coalesce(_cell(F.get(r, F.lit(0))).rlike("[A-Za-z]"), F.lit(False)) & (F.size(others) >= 2)

    parts = cut_at(rows, repeated, is_data)
    return F.when((F.size(rows) >= 6) & (F.size(repeated) >= 2) & (F.size(parts) > 1), parts).otherwise(F.array(rows))


def named_rows(rows: Column) -> Column:
    """(rating, label, value) triples of a transposed table: row 0 has the ratings, column 0 the labels."""
    header = F.get(rows, F.lit(0))
    data = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.flatten(
        F.transform(data, lambda r: F.transform(F.filter(indices(F.size(header)), lambda j: j > 0), lambda j: F.struct(F.get(header, j).alias("rating"), F.get(r, F.lit(0)).alias("label"), F.get(r, j).alias("value"))))
    )


def grade_rows(row: Column, counted: int, name: int) -> Column:
    """A row whose counted cell holds N tokens becomes N rows; cells with N tokens are dealt out, names split at a repeated base."""
    tokens = lambda c: T.words(c)
    n = F.greatest(F.size(tokens(F.get(row, F.lit(counted)))), F.lit(1))
    base = T.trim_all(F.regexp_extract(F.get(row, F.lit(name)), r"^([^,(]+),", 1))
    names = F.transform(F.filter(F.split(F.get(row, F.lit(name)), r"(?=\b[A-Z]\w*,)"), lambda x: T.trim_all(x) != ""), T.trim_all)

    def cell(j: Column, i: Column) -> Column:
        c = F.get(row, j)
        return F.when((j == name) & (base != "") & (F.size(names) == n), F.get(names, i)).when(F.size(tokens(c)) == n, F.get(tokens(c), i)).otherwise(c)

    return F.when(n > 1, F.transform(indices(n), lambda i: F.transform(indices(F.size(row)), lambda j: cell(j, i)))).otherwise(F.array(row))


def text_of(rows: Column) -> Column:
    """Cells by | and rows by / for comparison."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "|")), "/")
