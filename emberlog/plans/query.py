"""Statements compiled once and applied to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.events import select_events
from ..operators.relational import select_relations
from ..sql import syntax as s
from ..sql.errors import UnsupportedFeature
from ..sql.parse import parse_select
from ..sql.render import format_select
from ..sql.usage import Usage, usage


@dataclass(frozen=True)
class Query:
    """One SELECT: exact value rules over one relation of events, Spark's own over more."""

    statement: s.Select

    @property
    def exact(self) -> bool:
        return not self.statement.relational

    @property
    def text(self) -> str:
        return format_select(self.statement)

    @property
    def usage(self) -> Usage:
        return usage(self.statement)

    def apply(self, events: DataFrame, tables: dict[str, DataFrame] | None = None, carry: bool = False, count_errors: str | None = None) -> DataFrame:
        """The statement over ``events``, which any single table name stands for."""
        if self.exact:
            return select_events(self.statement, events, carry, count_errors)
        return self.over({**{n: events for n in self.table_names()}, **(tables or {})})

    def over(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The statement over named tables."""
        if not self.exact:
            return select_relations(self.statement, tables)
        if not self.statement.sources:
            raise UnsupportedFeature("no relation to read", self.statement.span)
        name = self.statement.sources[0].relation.name
        found = {k.lower(): v for k, v in tables.items()}.get(name.text.lower())
        if found is None:
            raise UnsupportedFeature(f"no table {name.text}", name.span)
        return select_events(self.statement, found)

    def table_names(self) -> list[str]:
        """Tables that the statement reads, in lower case."""
        found: dict[str, None] = {}

        def visit(q: s.Select, hidden: frozenset[str]) -> None:
            own = hidden | {c.name.text.lower() for c in q.ctes}
            for c in q.ctes:
                visit(c.query, own)
            for source in q.sources:
                for relation in (source.relation, *(j.relation for j in source.joins)):
                    if isinstance(relation, s.Derived):
                        visit(relation.query, own)
                    elif relation.name.text.lower() not in own:
                        found[relation.name.text.lower()] = None

        visit(self.statement, frozenset())
        return list(found)


def compile_sql(text: str) -> Query:
    return Query(parse_select(text))
