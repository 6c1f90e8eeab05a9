"""SELECT over the events of one relation, with exact value rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NULL, Compiler, FieldValue, Value, failed, field_value, kept
from ..sql import syntax as s
from ..sql.errors import UnknownColumn, UnsupportedFeature

#: Columns that travel with events and that no statement sees.
META, BODY = "_meta", "_message"
ERRORS = "emberlog_errors"


@dataclass(frozen=True)
class Events:
    """A DataFrame read as events: a message, metadata, and all other columns as fields."""

    df: DataFrame

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if f.name.lower() not in ("message", META, BODY)]

    def column(self, name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    def message(self) -> Value:
        """The body; a string column of that name, else what the events had before."""
        for f in self.df.schema.fields:
            if f.name.lower() == "message" and isinstance(f.dataType, T.StringType):
                return FieldValue("string", self.column(f.name))
        if BODY in self.df.columns:
            return FieldValue("string", self.column(BODY))
        return Value(NULL, F.lit(None).cast("string"))

    def source_id(self) -> Value:
        meta = next((f for f in self.df.schema.fields if f.name == META), None)
        if meta is None or "source_id" not in meta.dataType.names:
            return Value(NULL, F.lit(None).cast("string"))
        return FieldValue("string", F.col(f"{META}.source_id"))

    def field(self, name: s.Name) -> Value:
        """The first field of that name; null if there is none."""
        for f in self.df.schema.fields:
            if f.name in (META, BODY):
                continue
            if f.name == name.text if name.quoted else f.name.lower() == name.text.lower():
                return field_value(self.column(f.name), f.dataType)
        return Value(NULL, F.lit(None))

    def star(self) -> list[tuple[str, Value]]:
        message = self.message()
        own = FieldValue("string", message.column.cast("string"))
        return [("message", own), *((f.name, field_value(self.column(f.name), f.dataType)) for f in self.fields)]


def _resolver(events: Events, table: s.Table | None):
    names = [n for n in (table.name, table.alias) if n is not None] if table else []

    def check(qualifier: s.Name | None) -> None:
        if qualifier is not None and not any(qualifier.same(n) for n in names):
            raise UnknownColumn(f"no relation {qualifier.text}", qualifier.span)

    def resolve(column: s.Column) -> Value:
        check(column.table)
        if not column.name.quoted and column.name.text.lower() == "message":
            return events.message()
        if not column.name.quoted and column.name.text.lower() == "source_id":
            return events.source_id()
        return events.field(column.name)

    return resolve, check


def select_events(q: s.Select, df: DataFrame, carry: bool = False, count_errors: str | None = None) -> DataFrame:
    """The rows of a statement over the events of ``df``.

    ``carry`` keeps the hidden columns for a statement that follows;
    ``count_errors`` names an observation that counts events and those in error
    (it keeps the filter from the scan, so it is for streams).
    """
    if q.relational:
        raise UnsupportedFeature("more than one relation, or groups or order", q.span)
    table = q.sources[0].relation if q.sources else None
    events = Events(df)
    resolve, check = _resolver(events, table)
    compiler = Compiler(df, resolve)
    where = compiler.value(q.where) if q.where is not None else None
    out: list[tuple[str, Value]] = []
    for item in q.items:
        if isinstance(item.expr, s.Star):
            check(item.expr.table)
            out += events.star()
            continue
        label = item.alias.text if item.alias else item.expr.name.text if isinstance(item.expr, s.Column) else "<expr>"
        out.append((label, compiler.value(item.expr)))
    values = [v for _, v in out]
    if count_errors:
        df = df.observe(count_errors, F.count(F.lit(1)).alias("events"), F.count_if(failed(where, values)).alias("errors"))
    condition = kept(where, values)
    if condition is not None:
        df = df.where(condition)
    columns = [v.column.alias(label) for label, v in out]
    if carry:
        labels = {label for label, _ in out}
        if META in df.columns and META not in labels:
            columns.append(F.col(META))
        body = events.message()
        if body.family != NULL:
            columns.append(body.column.alias(BODY))
    return df.select(*columns)
