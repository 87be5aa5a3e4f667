"""Scalar text functions as Spark column expressions.

All of them stay inside Catalyst; none calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that suffix folding cannot bridge (fixed values).
EQUIVALENT = {"aging": "age", "ageing": "age", "aged": "age", "armour": "armor", "armoured": "armor", "armored": "armor", "colour": "color", "favour": "favor", "metre": "meter"}
#: Composed glyphs and their letters (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Words that stay small in titles (fixed values).
SMALL_WORDS = ["of", "the", "and", "in", "to", "a", "an", "vs", "from", "with", "on", "at", "by", "for", "or", "into", "your"]
CRUMB = "›"
#: Runs of ASCII letters and digits in lower case.
TOKEN = "[a-z0-9]+"


def trim_all(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def stem(token: Column) -> Column:
    """Known spellings first, then regular plurals; tokens of four letters or fewer stay."""
    known = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    t = F.coalesce(known[token], token)
    n = F.length(t)
    return (
        F.when(n <= 4, t)
        .when(t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when(t.rlike("(ses|xes|zes|ches|shes)$"), t.substr(F.lit(1), n - 2))
        .when(t.endswith("s") & ~t.rlike("(ss|us|is)$"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def tokenize(c: Column) -> Column:
    """Stemmed runs of ASCII letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), stem)


def spellings(term: Column) -> Column:
    """All tokens that may fold to a term, and a few that don't: its plurals and the known spellings."""
    plural = F.concat(term.substr(F.lit(1), F.length(term) - 1), F.lit("ies"))
    forms = F.array(term, F.concat(term, F.lit("s")), F.concat(term, F.lit("es")), plural, *map(F.lit, EQUIVALENT))
    return F.array_distinct(forms)


def name_score(query_tokens: Column, name_tokens: Column) -> Column:
    """1 for equal token lists, 0.7 if the name has all query tokens, else 0.6 times the overlap."""
    q, n = F.array_distinct(query_tokens), F.array_distinct(name_tokens)
    shared, either = F.size(F.array_intersect(q, n)), F.size(F.array_union(q, n))
    return (
        F.when((F.size(q) == 0) | (F.size(n) == 0), 0.0)
        .when(query_tokens == name_tokens, 1.0)
        .when(shared == F.size(q), 0.7)
        .otherwise(0.6 * shared / either)
    )


def normalize_ligatures(c: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    return c


def strip_controls(c: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def acronym_title(c: Column) -> Column:
    """Words all in capitals become titles, unless they are acronyms of three letters at most."""

    def one(w: Column) -> Column:
        upper = (F.upper(w) == w) & w.rlike("[A-Z]")
        return F.when(w.rlike("^[A-Z]{1,3}$"), w).when(upper, title_case(w)).otherwise(w)

    return F.array_join(F.transform(words(c), one), " ")


def entry_title(c: Column) -> Column:
    """Words capitalised but for small ones after the first."""
    small = F.array(*map(F.lit, SMALL_WORDS))

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when((i > 0) & F.array_contains(small, low), low).otherwise(F.concat(F.upper(w.substr(1, 1)), low.substr(F.lit(2), F.length(w))))

    return F.array_join(F.transform(words(c), one), " ")


def strip_markdown(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~~"), F.lit("")), F.lit("**"), F.lit(""))


def clean_line(c: Column) -> Column:
    """A body line without emphasis; empty for picture placeholders and order watermarks."""
    s = trim_all(c)
    drop = s.rlike(r"==>.*omitted.*<==|----- (Start|End) of picture text -----") | s.rlike(r"\(Order #\d+\)")
    return F.when(drop, "").otherwise(trim_all(strip_markdown(F.replace(s, F.lit("<br>"), F.lit(" ")))))


def clean_cell(c: Column) -> Column:
    """A Markdown table cell without emphasis and breaks."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", " "), "[*`]", ""))


def item_name(c: Column) -> Column:
    """A catalogue cell without footnote marks, hyphenation mended."""
    return F.regexp_replace(F.regexp_replace(trim_all(c), "[ *†‡]+$", ""), r"(\w)- (\w)", "$1$2")


def clean_box(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[\x00-\x1f]", " "))


def cut_markup_tail(c: Column) -> Column:
    """Up to the first heading mark or strikethrough."""
    at = F.regexp_instr(c, F.lit(r"\s*(#{2,}|~~)"))
    return F.when(at > 0, F.regexp_replace(c.substr(F.lit(1), at - 1), r"\s+$", "")).otherwise(c)


def dedupe_header(c: Column) -> Column:
    """Adjacent equal words once, then one half of a phrase said twice."""
    once = F.aggregate(
        words(c),
        F.array().cast("array<string>"),
        lambda acc, w: F.when(F.lower(F.try_element_at(acc, F.lit(-1))).eqNullSafe(F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))),
    )
    low = F.transform(once, F.lower)
    half = (F.size(once) / 2).cast("int")
    twice = (F.size(once) > 0) & (F.size(once) % 2 == 0) & (F.slice(low, F.lit(1), half) == F.slice(low, half + 1, half))
    return F.array_join(F.when(twice, F.slice(once, F.lit(1), half)).otherwise(once), " ")


def caps_ratio(c: Column) -> Column:
    """Share of capitals among the (ASCII) letters."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, "[^A-Z]", "")) / letters)


def is_pure_number(c: Column) -> Column:
    return ~c.rlike("[A-Za-z]")


def long_tokens(c: Column, over: int) -> Column:
    """Distinct tokens of more than ``over`` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > over))


def _number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")


def money_millions(c: Column) -> Column:
    """MCr1.2, Cr30000 or bare credits as millions; dashes and blanks are 0."""
    s = F.replace(trim_all(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    return (
        F.when(s.isin("", "—", "-"), 0.0)
        .when(s.rlike("(?i)MCr[0-9.]+"), _number(s, "(?i)MCr([0-9.]+)"))
        .when(s.rlike("(?i)Cr[0-9.]+"), _number(s, "(?i)Cr([0-9.]+)") / 1_000_000)
        .otherwise(F.coalesce(_number(s, "([0-9.]+)") / 1_000_000, F.lit(0.0)))
    )


def percent(c: Column) -> Column:
    return F.coalesce(_number(F.coalesce(c, F.lit("")), r"([0-9.]+)\s*%") / 100, F.lit(0.0))


def first_int(c: Column) -> Column:
    """The first signed integer of a cell, commas ignored; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?\d+)", 1), F.lit("")).try_cast("int")


def base_name(c: Column) -> Column:
    """Up to the first comma or bracket."""
    return trim_all(F.regexp_replace(c, r"(,| \().*$", ""))


def split_list(c: Column) -> Column:
    """Items between commas and semicolons, trimmed."""
    return F.filter(F.transform(F.split(c, "[;,]"), trim_all), lambda x: x != "")


def normal_words(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def singular(t: Column) -> Column:
    return F.when((F.length(t) >= 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)


def section_key(c: Column) -> Column:
    low = F.lower(trim_all(c))
    return F.when(low.startswith("special"), "specialty").otherwise(low)


def career_label(c: Column) -> Column:
    """The card label of a career table's title."""
    t = trim_all(c)
    low = F.lower(t)
    return (
        F.when(low.contains("specialist"), "Specialist Skills")
        .when(low.startswith("skills"), "Skills")
        .when(low.isin("1d", "2d", "3d", "d6", "d66", "d", "") | low.rlike(r"^\d+$"), "Skills")
        .when(low.contains("rank") | low.contains("traveller creation"), "Ranks")
        .when(low.contains("mustering"), "Mustering Out")
        .when(low.contains("career progress") | low.contains("qualif"), "Career Progress")
        .when(low.startswith("mishap"), "Mishaps")
        .when(low.startswith("event"), "Events")
        .when((F.upper(t) == t) & t.rlike("[A-Z]"), title_case(t))
        .otherwise(t)
    )


def crumb_leaf(c: Column) -> Column:
    return trim_all(F.element_at(F.split(c, CRUMB), -1))


def crumb_root(c: Column) -> Column:
    return trim_all(F.element_at(F.split(c, CRUMB), 1))


def table_name(title: Column, section: Column, header: Column) -> Column:
    """The heading unless it reads like prose, else the section's leaf, else the first header cell."""
    t = trim_all(F.coalesce(title, F.lit("")))
    prose = (t == "") | t.rlike("^[a-z]") | t.rlike("[.,;]$") | (F.size(words(t)) > 6)
    leaf = crumb_leaf(F.coalesce(section, F.lit("")))
    first = F.get(F.filter(F.transform(F.coalesce(header, F.array().cast("array<string>")), trim_all), lambda x: x != ""), F.lit(0))
    return F.when(~prose, t).when(leaf != "", leaf).otherwise(F.coalesce(F.left(first, F.lit(40)), F.lit("Table")))


def provenance(source: Column, locator: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(source, F.lit("")), F.nullif(locator, F.lit("")))
