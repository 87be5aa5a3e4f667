"""Registries of what differs from game to game: page functions, career hooks, character flows and builders.

A game takes the first entry whose keyword its name has. Entries are plain
functions, so a new game adds them without a change elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


@dataclass
class Entry:
    keyword: str
    hooks: dict[str, Callable] = field(default_factory=dict)


class Registry:
    """Entries in the order of their registration."""

    def __init__(self, *hooks: str):
        self.hooks, self.entries = hooks, []

    def register(self, keyword: str, **hooks: Callable) -> Entry:
        unknown = set(hooks) - set(self.hooks)
        if unknown:
            raise ValueError(f"no such hooks: {sorted(unknown)}")
        self.entries.append(Entry(keyword.lower(), hooks))
        return self.entries[-1]

    def of(self, game: str) -> Entry | None:
        """The first entry whose keyword the game's name has."""
        return next((e for e in self.entries if e.keyword in (game or "").lower()), None)

    def hook(self, game: str, name: str) -> Callable | None:
        entry = self.of(game)
        return entry.hooks.get(name) if entry else None

    def games(self, names: list[str]) -> dict[str, str]:
        """Keyword of the entry of each game that has one."""
        return {n: e.keyword for n in names if (e := self.of(n))}


#: Page functions (one page's rows in, rows out) and career hooks; character flows; builders.
PAGES = Registry("page", "career_detect", "career_sections")
CHARGEN = Registry("build_flow", "build_data", "extract_prose")
BUILDERS = Registry("build_flow", "build_data", "render", "make_draft")


def per_page(rows: DataFrame, keys: list[str], registry: Registry, hook: str, schema: StructType | str | None = None, game: str = "game") -> DataFrame:
    """A hook applied to the rows of every page (``keys``), by the page's game; pages of games without it pass through if the schema is that of rows, else give nothing."""
    schema = schema or rows.schema
    same = schema == rows.schema

    def run(pdf):
        call = registry.hook(str(pdf[game].iloc[0]), hook)
        return call(pdf) if call else (pdf if same else pdf.iloc[:0].reindex(columns=[c.name for c in out]))

    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return rows.groupBy(*keys).applyInPandas(run, schema)
