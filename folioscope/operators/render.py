"""Grids as monospaced text, in Arrow batches."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a page (fixed values).
BUDGET, LEAST_COLUMN, NARROW, LONG_TABLE, HEADER_EVERY = 60, 3, 42, 25, 18


def fit_widths(natural: list[int], budget: int) -> list[int]:
    """Widths under the largest common cap with which all columns fit."""
    if sum(natural) <= budget:
        return list(natural)
    fits = [cap for cap in range(LEAST_COLUMN, max(natural) + 1) if sum(min(n, cap) for n in natural) <= budget]
    cap = max(fits, default=LEAST_COLUMN)
    return [min(n, cap) for n in natural]


def fit_width(natural: Column, budget: Column, most: int = 60) -> Column:
    """The largest common cap with which columns of the natural widths (an array) fit the budget; null if not even the least does."""
    fits = F.filter(F.sequence(F.lit(LEAST_COLUMN), F.lit(most)), lambda cap: F.aggregate(natural, F.lit(0), lambda total, x: total + F.least(x, cap)) <= budget)
    return F.array_max(fits)


def render_rows(rows: list[list[str]], budget: int = BUDGET) -> str:
    """Aligned columns with a rule under the header, or one record a row where three or more columns are too wide."""
    count = max(map(len, rows), default=0)
    grid = [[(c or "").strip() for c in r] + [""] * (count - len(r)) for r in rows]
    if not grid or not count:
        return ""
    natural = [max(len(r[j]) for r in grid) for j in range(count)]
    if count >= 3 and sum(natural) > NARROW:
        records = [[f"{h}: {c}" for h, c in zip(grid[0], r, strict=True) if c] for r in grid[1:]]
        return "\n\n".join("\n".join(r) for r in records)
    widths = fit_widths(natural, budget)

    def lines(row: list[str]) -> list[str]:
        cells = [textwrap.wrap(c, w or 1, break_on_hyphens=False) or [""] for c, w in zip(row, widths, strict=True)]
        return [" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip() for i in range(max(map(len, cells)))]

    header = [*lines(grid[0]), "-+-".join("-" * w for w in widths)]
    out = list(header)
    for i, row in enumerate(grid[1:]):
        if i and len(grid) > LONG_TABLE and i % HEADER_EVERY == 0:
            out += header
        out += lines(row)
    return "\n".join(out)


def render(rows: Column, budget: int = BUDGET) -> Column:
    @F.pandas_udf("string")
    def run(grids: pd.Series) -> pd.Series:
        return grids.map(lambda g: render_rows([list(r) for r in g], budget))

    return run(rows)
