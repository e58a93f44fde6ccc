"""Configuration: what is indexed, and how the engine is bounded.

Configuration is plain data. Tables and fields are validated when they are
built, so a plan never has to check them again.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from enum import Enum

INDEX_NAME = re.compile(r"[a-z0-9][a-z0-9_.\-]*")


class _Named(Enum):
    @classmethod
    def named(cls, name: str | None, default=None):
        """The member of this name, whatever its case; ``default`` for anything else."""
        return next((m for m in cls if name is not None and m.name == name.strip().upper()), default)


class Role(_Named):
    DISPLAY = "shown with a hit, under its label"
    TITLE = "part of the record's label"
    SUBTITLE = "part of the line below the label"
    BODY = "searchable text"
    KEYWORD = "whole words, outside the snippet"
    EXACT = "the whole value only, outside the snippet"


class Analyzer(_Named):
    PREFIX = "words by their beginnings"
    WORD = "whole words"
    ENGLISH = "stems of English words"
    EXACT = "the whole value"


class DocumentsChoice(_Named):
    KEEP = "documents of a stopped table stay in the index"
    DELETE = "documents of a stopped table are removed"


@dataclass(frozen=True)
class FieldConfig:
    name: str
    label: str | None = None
    weight: int = 1
    role: Role = Role.BODY
    analyzer: Analyzer | None = None
    in_snippet: bool | None = None
    include_label: bool = False

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a field needs a name")
        if not 1 <= self.weight <= 1000:
            raise ValueError(f"weight of {self.name} is {self.weight}, not from 1 to 1000")

    @property
    def shown(self) -> str:
        return self.label or self.name

    @property
    def resolved_analyzer(self) -> Analyzer:
        if self.role is Role.EXACT:
            return Analyzer.EXACT
        return self.analyzer or (Analyzer.WORD if self.role is Role.KEYWORD else Analyzer.PREFIX)

    @property
    def snippet(self) -> bool:
        """Whether the field's text is part of the snippet, the text that all tables are searched by."""
        if self.resolved_analyzer is Analyzer.EXACT:
            return False
        return self.role not in (Role.KEYWORD, Role.EXACT) if self.in_snippet is None else self.in_snippet


@dataclass(frozen=True)
class TableConfig:
    name: str
    key: str
    fields: tuple[FieldConfig, ...]
    timestamp: str | None = None
    label_format: str | None = None
    label_fields: tuple[str, ...] = ()
    protected: frozenset[str] = frozenset()
    interval_minutes: int | None = 5
    enabled: bool = True

    def __post_init__(self):
        if not self.name.strip() or ":" in self.name:
            raise ValueError(f"{self.name!r} can't be a table's name: blank, or with a colon, which separates the parts of a document id")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name} has a field twice")
        if not names:
            raise ValueError(f"{self.name} has no field")

    @property
    def indexed_fields(self) -> tuple[FieldConfig, ...]:
        return tuple(f for f in self.fields if f.name not in self.protected)

    @property
    def searchable(self) -> bool:
        """A table whose key is protected is never searched."""
        return self.key not in self.protected

    @property
    def filtered(self) -> bool:
        """With a protected field, the stored text as a whole may not be searched or shown."""
        return bool(self.protected)

    @property
    def plain(self) -> bool:
        return all(f.snippet and f.resolved_analyzer is Analyzer.PREFIX for f in self.indexed_fields)

    def field(self, name: str) -> FieldConfig:
        return next(f for f in self.fields if f.name == name)

    def fingerprint(self) -> str:
        """What documents of this table depend on, as canonical JSON; default roles, analyzers and snippet values are left out."""
        rows = []
        for f in self.fields:
            row: dict[str, object] = {"name": f.name, "weight": f.weight, "includeLabel": f.include_label}
            if f.role is not Role.BODY:
                row["role"] = f.role.name
            if f.analyzer is not None:
                row["analyzer"] = f.analyzer.name
            if f.in_snippet is not None:
                row["inSnippet"] = f.in_snippet
            rows.append(row)
        return json.dumps(rows, separators=(",", ":"))


@dataclass(frozen=True)
class EngineConfig:
    index_name: str = "lodestar"
    max_field_length: int = 10_000
    max_search_limit: int = 100
    default_limit: int = 25
    min_term: int = 2
    max_term: int = 100
    window: int = 10_000
    overlap_seconds: int = 300
    stale_minutes: int = 30
    retention_days: int = 30
    purge_limit: int = 5000
    max_attempts: int = 10
    tables: tuple[TableConfig, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not INDEX_NAME.fullmatch(self.index_name) or len(self.index_name) > 255:
            raise ValueError(f"{self.index_name!r} can't be an index name")
        for name, value in vars(self).items():
            if isinstance(value, int) and value < 1:
                raise ValueError(f"{name} is {value}; it must be positive")
        names = [t.name for t in self.tables]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"tables configured twice: {', '.join(sorted(twice))}")

    def table(self, name: str) -> TableConfig | None:
        return next((t for t in self.tables if t.name == name), None)

    def with_tables(self, *tables: TableConfig) -> "EngineConfig":
        return replace(self, tables=(*self.tables, *tables))
