"""What a statement says, once parsed."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A statement that cannot be answered: it is refused before anything runs."""


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: str | int | bool


@dataclass(frozen=True)
class Clauses:
    """The universal clause block; its order in the text does not matter, its order of evaluation is fixed."""

    where: tuple[Predicate, ...] = ()
    having: tuple[Predicate, ...] = ()
    within: str | None = None
    exclude: tuple[str, ...] = ()
    group_by: str | None = None
    order_by: tuple[str, bool] | None = None  # field, ascending
    limit: int | None = None
    offset: int | None = None
    depth: int | None = None
    lines: int | None = None


@dataclass(frozen=True)
class Statement:
    verb: str
    args: dict = field(default_factory=dict)
    clauses: Clauses = Clauses()
