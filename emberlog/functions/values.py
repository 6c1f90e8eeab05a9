"""Expressions over events, as columns with errors as data.

A value is null-safe and strictly typed: null equals null, values of different
families are never equal, ordering and arithmetic need fitting types, AND and OR
look at both sides.  Where the rules are broken a row has no result; that is a
second, boolean column beside each value, never a raised exception.

Errors are kept as lists of plain conditions, so that a filter becomes a flat
conjunction such as ``x IS NOT NULL AND x <= 4`` that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql import syntax as s
from ..sql.errors import UnsupportedFeature, UnsupportedFunction

INT, FLOAT, STRING, BOOL, NULL = "integer", "float", "string", "boolean", "null"
NUMBERS = (INT, FLOAT)
EXACT = 1 << 53


@dataclass(frozen=True)
class Value:
    """A column of one family; it is in error where one of ``errors`` holds."""

    family: str
    column: Column
    errors: tuple[Column, ...] = ()
    constant: bool = False
    number: int | float | None = None


class FieldValue(Value):
    """A value as it stands in an event, which may be null."""


SPARK_TYPES = {INT: "bigint", FLOAT: "double", STRING: "string", BOOL: "boolean", NULL: "void"}


def _broken(family: str = BOOL) -> Value:
    """What has no result for any row."""
    return Value(family, F.lit(None).cast(SPARK_TYPES[family]), (F.lit(True),))


def family_of(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return INT
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOL
    return NULL if isinstance(kind, T.NullType) else STRING


def field_value(column: Column, kind: T.DataType) -> Value:
    """A field of an event: numbers are 64 bits wide, what SQL does not know is text."""
    family = family_of(kind)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        column = F.to_json(column)
    elif family != NULL and kind.simpleString() != SPARK_TYPES[family]:
        column = column.cast(SPARK_TYPES[family])
    return FieldValue(family, column)


def literal_value(literal: s.Literal) -> Value:
    if literal.kind == "null":
        return Value(NULL, F.lit(None), constant=True)
    value = float(literal.value) if literal.kind == "float" else literal.value
    return Value(literal.kind, F.lit(value).cast(SPARK_TYPES[literal.kind]), constant=True, number=value if literal.kind in NUMBERS else None)


def _missing(*values: Value) -> tuple[Column, ...]:
    """Null is no operand."""
    return tuple(v.column.isNull() for v in values if not v.constant)


def _errors(*values: Value) -> tuple[Column, ...]:
    return tuple(e for v in values for e in v.errors)


def _double(v: Value) -> Column:
    return v.column if v.family == FLOAT else v.column.cast("double")


def equal(a: Value, b: Value) -> Value:
    errors = _errors(a, b)
    if NULL in (a.family, b.family):
        other = b if a.family == NULL else a
        return Value(BOOL, F.lit(True) if other.family == NULL else other.column.isNull(), errors)
    if a.family in NUMBERS and b.family in NUMBERS:
        if a.family == b.family == INT:
            return Value(BOOL, a.column.eqNullSafe(b.column), errors)
        same = _double(a).eqNullSafe(_double(b))
        # Spark has NaN equal to itself; a literal is never NaN
        return Value(BOOL, same if a.constant or b.constant else same & ~F.coalesce(F.isnan(_double(a)), F.lit(False)), errors)
    if a.family == b.family:
        return Value(BOOL, a.column.eqNullSafe(b.column), errors)
    if a.constant or b.constant:
        return Value(BOOL, F.lit(False), errors)
    return Value(BOOL, a.column.isNull() & b.column.isNull(), errors)


def ordered(op: str, a: Value, b: Value) -> Value:
    if a.family == b.family == STRING:
        x, y = a.column, b.column
    elif a.family in NUMBERS and b.family in NUMBERS:
        # both as doubles, which a small literal beside an integer column need not be
        small = a.family == b.family == INT and any(v.number is not None and abs(v.number) < EXACT for v in (a, b))
        x, y = (a.column, b.column) if small else (_double(a), _double(b))
    else:
        return _broken()
    value = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    errors = (*_errors(a, b), *_missing(a, b))
    if FLOAT in (a.family, b.family):
        # Spark sorts NaN above all numbers; here nothing compares with it
        for v in (a, b):
            if v.family == FLOAT and not v.constant:
                value = value & ~F.isnan(v.column)
    return Value(BOOL, value, errors)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.family not in NUMBERS or b.family not in NUMBERS:
        return _broken(FLOAT)
    if op == "/":
        result = F.try_divide(_double(a), _double(b))
        return Value(FLOAT, result, (*_errors(a, b), result.isNull()))
    if a.family == b.family == INT:
        result = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.column, b.column)
        return Value(INT, result, (*_errors(a, b), result.isNull()))
    x, y = _double(a), _double(b)
    result = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Value(FLOAT, result, (*_errors(a, b), *_missing(a, b)))


def logical(op: str, operands: list[Value]) -> Value:
    """AND or OR of many; every operand is looked at, whatever the others are."""
    if any(v.family != BOOL for v in operands):
        return _broken()
    errors = tuple(e for v in operands for e in (*v.errors, *(_missing(v) if _nullable(v) else ())))
    return Value(BOOL, balanced((lambda x, y: x & y) if op == "AND" else (lambda x, y: x | y), [v.column for v in operands]), errors)


def _nullable(v: Value) -> bool:
    """Whether a boolean may be null: only what is read from a field may."""
    return not v.constant and isinstance(v, FieldValue)


def balanced(join: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """One column of many, as a tree of little depth."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def unary(op: str, v: Value) -> Value:
    if op == "+":
        return v
    if op == "NOT":
        if v.family != BOOL:
            return _broken()
        return Value(BOOL, ~v.column, (*v.errors, *(_missing(v) if _nullable(v) else ())))
    if v.family == INT:
        if v.number is not None:
            return Value(INT, F.lit(-v.number).cast("bigint"), v.errors, True, -v.number)
        result = F.try_subtract(F.lit(0).cast("bigint"), v.column)
        return Value(INT, result, (*v.errors, result.isNull()))
    if v.family == FLOAT:
        return Value(FLOAT, -v.column, (*v.errors, *_missing(v)), v.constant, -v.number if v.number is not None else None)
    return _broken(FLOAT)


class Compiler:
    """Columns of expressions over the events of a DataFrame."""

    def __init__(self, df: DataFrame, resolve: Callable[[s.Column], Value]):
        self.df, self.resolve = df, resolve

    def value(self, expr: s.Expression) -> Value:
        first, above = s.spine(expr)
        out, at = self._leaf(first), 0
        while at < len(above):
            op = above[at].op
            if op in ("AND", "OR"):
                run = [out]
                while at < len(above) and above[at].op == op:
                    run.append(self.value(above[at].right))
                    at += 1
                out = logical(op, run)
                continue
            right = self.value(above[at].right)
            if op == "=":
                out = equal(out, right)
            elif op == "!=":
                same = equal(out, right)
                out = Value(BOOL, ~same.column, same.errors)
            elif op in ("<", "<=", ">", ">="):
                out = ordered(op, out, right)
            else:
                out = arithmetic(op, out, right)
            at += 1
        return out

    def _leaf(self, expr: s.Expression) -> Value:
        match expr:
            case s.Column():
                return self.resolve(expr)
            case s.Literal():
                return literal_value(expr)
            case s.Unary(op, operand):
                return unary(op, self.value(operand))
            case s.Call():
                return self._call(expr)
        raise UnsupportedFeature("a star is no value", getattr(expr, "span", None))

    def _call(self, call: s.Call) -> Value:
        """A function of Spark's, with its own rules for nulls."""
        if call.distinct or any(isinstance(a, s.Star) for a in call.args):
            raise UnsupportedFunction(f"{call.name.text} over whole events", call.span)
        args = [self.value(a) for a in call.args]
        result = F.call_function(call.name.text, *(a.column for a in args))
        try:
            kind = self.df.select(result.alias("v")).schema["v"].dataType
        except Exception as e:
            raise UnsupportedFunction(f"{call.name.text}: {str(e).splitlines()[0][:200]}", call.span) from e
        v = field_value(result, kind)
        return FieldValue(v.family, v.column, _errors(*args))


def kept(where: Value | None, items: list[Value]) -> Column | None:
    """The condition on which an event gives a row: WHERE holds and nothing is in error."""
    parts: list[Column] = []
    if where is not None:
        if where.family != BOOL:
            return F.lit(False)
        parts += [~e for e in (*where.errors, *(_missing(where) if _nullable(where) else ()))]
        parts.append(where.column)
    parts += [~e for v in items for e in v.errors]
    return balanced(lambda x, y: x & y, parts) if parts else None


def failed(where: Value | None, items: list[Value]) -> Column:
    """The condition on which an event is dropped in error."""
    no = F.lit(False)
    any_ = lambda parts: balanced(lambda x, y: x | y, [F.coalesce(p, no) for p in parts]) if parts else no
    of_items = any_([e for v in items for e in v.errors])
    if where is None:
        return of_items
    if where.family != BOOL:
        return F.lit(True)
    of_where = any_([*where.errors, *(_missing(where) if _nullable(where) else ())])
    return of_where | (F.coalesce(where.column, no) & of_items)
