"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class SqlError(ValueError):
    """A diagnostic with its place in the text."""

    def __init__(self, message: str, line: int = 1, column: int = 1):
        super().__init__(f"{line}:{column}: {message}")
        self.message, self.line, self.column = message, line, column


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Col:
    name: str
    alias: str | None = None
    at: tuple[int, int] = field(default=(1, 1), compare=False)


@dataclass(frozen=True)
class Un:
    op: str
    arg: object


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Path:
    """``base -> step`` or, as text, ``base ->> step``."""

    base: object
    step: object
    text: bool


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple
    at: tuple[int, int] = field(default=(1, 1), compare=False)


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object | None
    distinct: bool = False
    parameter: float | None = None


@dataclass(frozen=True)
class Cast:
    arg: object
    kind: str


@dataclass(frozen=True)
class If:
    cond: object
    then: object
    other: object


@dataclass
class InQuery:
    arg: object
    query: "Select"
    negated: bool

    def __hash__(self):
        return id(self)


@dataclass
class Exists:
    query: "Select"
    negated: bool

    def __hash__(self):
        return id(self)


@dataclass
class Scalar:
    query: "Select"

    def __hash__(self):
        return id(self)


@dataclass
class Star:
    alias: str | None = None


@dataclass
class Item:
    expr: object
    alias: str | None


@dataclass
class Source:
    alias: str
    name: str | None = None
    query: object | None = None
    at: tuple[int, int] = (1, 1)


@dataclass
class Join:
    kind: str  # inner left right full cross unnest
    source: Source | None
    on: object | None = None
    within: int | None = None
    unnest: object | None = None
    alias: str = ""


@dataclass
class WindowSpec:
    kind: str  # tumbling hopping session
    size: int
    advance: int | None = None


@dataclass
class Select:
    items: list
    source: Source
    joins: list[Join]
    where: object | None = None
    group_by: list | None = None
    group_all: bool = False
    latest_by: list | None = None
    window: WindowSpec | None = None
    emit_changes: bool = False


@dataclass
class Union:
    branches: list
    all: bool
