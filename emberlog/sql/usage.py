"""Which columns and functions a statement uses."""

from __future__ import annotations

from dataclasses import dataclass

from . import syntax as s


@dataclass(frozen=True)
class Usage:
    """Each once, in the order of its first use: (table or None, column), (function, arguments)."""

    columns: tuple[tuple[str | None, str], ...]
    functions: tuple[tuple[str, int], ...]


def usage(q: s.Select) -> Usage:
    """Usages in projection, WHERE, HAVING, GROUP BY, ORDER BY and join conditions.

    Common tables and derived tables are statements of their own and not entered;
    stars name no column.
    """
    exprs = [i.expr for i in q.items]
    exprs += [e for e in (q.where, q.having) if e is not None]
    exprs += [*q.group, *(o.expr for o in q.order)]
    exprs += [j.on for source in q.sources for j in source.joins if j.on is not None]
    columns: dict[tuple, tuple] = {}
    functions: dict[tuple, tuple] = {}
    for part in (p for e in exprs for p in s.walk(e)):
        if isinstance(part, s.Column):
            found = (part.table.text if part.table else None, part.name.text)
            columns.setdefault(tuple((n.text if n.quoted else n.text.lower()) if n else None for n in (part.table, part.name)), found)
        elif isinstance(part, s.Call):
            found = (part.name.text if part.name.quoted else part.name.text.lower(), len(part.args))
            functions.setdefault(found, found)
    for source in q.sources:
        for join in source.joins:
            for n in join.using:
                columns.setdefault((None, n.text if n.quoted else n.text.lower()), (None, n.text))
    return Usage(tuple(columns.values()), tuple(functions.values()))
