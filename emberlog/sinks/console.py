"""Rows as lines ``{"name": value, ...}``, and sinks that take them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import field_value

# fixed values: escapes of control characters
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_text(column: Column) -> Column:
    """A string in quotes, escaped."""
    escaped = F.regexp_replace(column, r'(["\\])', r"\\$1")
    for code in [*range(0x20), 0x7F]:
        mark = chr(code)
        escaped = F.replace(escaped, F.lit(mark), F.lit(SHORT.get(mark, f"\\u{code:04X}")))
    # most texts have no control character: the replacements run only where one is
    plain = F.regexp_replace(column, r'(["\\])', r"\\$1")
    return F.concat(F.lit('"'), F.when(column.rlike(r"[\x00-\x1f\x7f]"), escaped).otherwise(plain), F.lit('"'))


def scientific(x: float) -> str:
    """The shortest digits that read back, as d.ddde±x."""
    if x != x or x in (float("inf"), float("-inf")):
        return repr(x)
    digits, _, power = repr(x).partition("e")
    sign = "-" if digits.startswith("-") else ""
    whole, _, part = digits.lstrip("-").partition(".")
    exponent = int(power or 0) + len(whole) - 1
    all_digits = (whole + part).rstrip("0") or "0"
    lead = len(all_digits) - len(all_digits.lstrip("0"))
    if all_digits.strip("0"):
        exponent -= min(lead, len(all_digits) - 1)
        all_digits = all_digits.lstrip("0")
    else:
        all_digits, exponent = "0", 0
    return f"{sign}{all_digits[0]}{'.' + all_digits[1:] if len(all_digits) > 1 else ''}e{exponent}"


def json_value(column: Column, kind: T.DataType) -> Column:
    v = field_value(column, kind)
    if v.family == "string":
        text = json_text(v.column)
    elif v.family == "float":

        @F.pandas_udf("string")
        def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                yield pd.Series([None if x is None or pd.isna(x) else scientific(float(x)) for x in xs], dtype=object)

        text = F.when(F.isnan(v.column), "nan").otherwise(written(v.column))
    else:
        text = v.column.cast("string")
    return F.coalesce(text, F.lit("null"))


def console_lines(df: DataFrame) -> DataFrame:
    """``line`` of each row; hidden columns are not shown, names may repeat."""
    renamed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    shown = [(name, json_value(F.col(f"c{i}"), f.dataType)) for i, (name, f) in enumerate(zip(df.columns, df.schema.fields)) if not name.startswith("_m")]
    parts: list[Column] = [F.lit("{")]
    for i, (name, text) in enumerate(shown):
        parts += [F.lit(", " if i else ""), json_text(F.lit(name)), F.lit(": "), text]
    return renamed.select(F.concat(*parts, F.lit("}")).alias("line"))


def write_console(df: DataFrame, target: str = "stdout") -> int:
    """Print the rows as lines; they come one partition at a time.  Gives their number."""
    out = {"stdout": sys.stdout, "stderr": sys.stderr}[target]
    n = 0
    for row in console_lines(df).toLocalIterator():
        out.write(row["line"] + "\n")
        n += 1
    out.flush()
    return n


def write_nothing(df: DataFrame, target: str = "") -> int:
    df.write.format("noop").mode("overwrite").save()
    return 0


#: Sinks by name; more can be added.
SINKS = {"console": write_console, "null": write_nothing}
