"""A parsed program."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Span:
    """A value of a source, and where it stands there (0 and 0 for values that no source holds)."""

    value: str
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class ColumnDecl:
    name: str
    type_name: str
    reference: str = ""  # "", "ref", "foreign child", "explicit foreign child" or "child"
    primary: bool = False
    child_of: str | None = None
    default: str | None = None
    detached: bool = False
    generated: str | None = None


@dataclass(frozen=True)
class TableDecl:
    name: str
    columns: tuple[ColumnDecl, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    view_sql: str | None = None


@dataclass(frozen=True)
class Row:
    cells: tuple[Span, ...]
    nested: tuple[Rows, ...] = ()


@dataclass(frozen=True)
class Rows:
    """DATA: rows of cells."""

    table: str
    columns: tuple[str, ...]
    rows: tuple[Row, ...]
    exclusive: bool = False
    source: int = 0


@dataclass(frozen=True)
class Object:
    cells: tuple[tuple[str, Span], ...]
    nested: tuple[Objects, ...] = ()


@dataclass(frozen=True)
class Objects:
    """DATA STRUCT: rows of named cells."""

    table: str
    objects: tuple[Object, ...]
    exclusive: bool = False
    source: int = 0
    scripted: bool = False  # rows that a script or a module made


@dataclass(frozen=True)
class Proof:
    comment: str
    table: str
    text: str
    language: str = "SQL"


@dataclass(frozen=True)
class DetachedDefault:
    table: str
    column: str
    value: str


@dataclass(frozen=True)
class Script:
    path: str
    text: str
    folder: str | None = None


@dataclass(frozen=True)
class Module:
    path: str
    folder: str | None = None


@dataclass
class Source:
    """A file or a text. origin says where each character without comments stood in the whole text."""

    path: str
    text: str
    plain: str
    origin: list[int]
    folder: str | None = None


@dataclass
class Program:
    tables: list[TableDecl] = field(default_factory=list)
    segments: list[Rows | Objects] = field(default_factory=list)
    proofs: list[Proof] = field(default_factory=list)
    defaults: list[list[DetachedDefault]] = field(default_factory=list)
    scripts: list[Script] = field(default_factory=list)
    modules: list[Module] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    #: for each table: a row's whole key, with its columns' new values
    replacements: dict[str, list[tuple[str, dict[str, str]]]] = field(default_factory=dict)
