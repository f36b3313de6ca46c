"""Statements and expressions as the parser gives them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """kind: INT, DOUBLE, STRING or NULL."""

    kind: str
    value: int | float | str | None


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Call:
    """A function or, with an internal name such as ADD, an operator."""

    name: str
    args: tuple
    operator: bool = False


@dataclass(frozen=True)
class RangeSource:
    args: tuple[int, ...]


@dataclass
class Select:
    items: list
    tables: list[str] = field(default_factory=list)
    range: RangeSource | None = None
    subquery: Select | None = None
    where: object | None = None


@dataclass
class CreateDatabase:
    name: str


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    key: str | None


@dataclass
class Drop:
    what: str  # DATABASE or TABLE
    name: str


@dataclass
class Use:
    name: str


@dataclass
class Show:
    what: str  # DATABASES or TABLES


@dataclass
class Insert:
    table: str
    tuples: list[list] | None = None
    select: Select | None = None
    bulk: int | None = None


@dataclass
class Delete:
    table: str
    where: object | None = None


@dataclass
class Flush:
    table: str


@dataclass
class Explain:
    select: Select
