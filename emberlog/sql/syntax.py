"""The parts of a statement.  Every part carries its byte range."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Union

Span = tuple[int, int]

# fixed values: how strongly operators bind; all group to the left
PRECEDENCE = {
    "OR": 10,
    "AND": 20,
    "=": 30,
    "!=": 30,
    "<": 30,
    "<=": 30,
    ">": 30,
    ">=": 30,
    "+": 40,
    "-": 40,
    "*": 50,
    "/": 50,
}
UNARY = 60


@dataclass(frozen=True, slots=True)
class Name:
    text: str
    quoted: bool = False
    span: Span = field(default=(0, 0), compare=False)

    def same(self, other: Name) -> bool:
        """Unquoted names match in any case, quoted ones as they are, and never each other."""
        if self.quoted != other.quoted:
            return False
        return self.text == other.text if self.quoted else self.text.lower() == other.text.lower()


@dataclass(frozen=True, slots=True)
class Column:
    name: Name
    table: Name | None = None
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Literal:
    kind: str  # integer, float, string, boolean, null
    value: int | str | bool | None  # a float stays as it is written
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Star:
    table: Name | None = None
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Unary:
    op: str  # NOT, +, -
    operand: Expression
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Binary:
    op: str
    left: Expression
    right: Expression
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Call:
    name: Name
    args: tuple[Expression, ...]
    distinct: bool = False
    span: Span = field(default=(0, 0), compare=False)


Expression = Union[Column, Literal, Star, Unary, Binary, Call]


@dataclass(frozen=True, slots=True)
class Item:
    expr: Expression
    alias: Name | None = None
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Table:
    name: Name
    alias: Name | None = None
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Derived:
    query: Select
    alias: Name
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Join:
    kind: str  # inner, left
    relation: Table | Derived
    on: Expression | None = None
    using: tuple[Name, ...] = ()
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Source:
    relation: Table | Derived
    joins: tuple[Join, ...] = ()
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Order:
    expr: Expression
    descending: bool = False
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Cte:
    name: Name
    columns: tuple[Name, ...]
    query: Select
    span: Span = field(default=(0, 0), compare=False)


@dataclass(frozen=True, slots=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Source, ...] = ()
    where: Expression | None = None
    group: tuple[Expression, ...] = ()
    having: Expression | None = None
    order: tuple[Order, ...] = ()
    distinct: bool = False
    ctes: tuple[Cte, ...] = ()
    recursive: bool = False
    span: Span = field(default=(0, 0), compare=False)

    @property
    def relational(self) -> bool:
        """Whether more than a filter and a projection of one relation is asked for."""
        more = self.distinct or self.group or self.having or self.order or self.ctes or len(self.sources) > 1
        return bool(more or any(s.joins or isinstance(s.relation, Derived) for s in self.sources))


def spine(expr: Expression) -> tuple[Expression, list[Binary]]:
    """The leftmost operand, and the binary operators above it from the inside out.

    Long chains lean to the left; walking them so needs no recursion.
    """
    above = []
    while isinstance(expr, Binary):
        above.append(expr)
        expr = expr.left
    return expr, above[::-1]


def walk(expr: Expression) -> Iterator[Expression]:
    """The expression's parts in the order in which they are written."""
    first, above = spine(expr)
    if isinstance(first, Unary):
        yield from walk(first.operand)
    elif isinstance(first, Call):
        yield first
        for arg in first.args:
            yield from walk(arg)
    else:
        yield first
    for b in above:
        yield from walk(b.right)
