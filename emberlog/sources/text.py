"""Decoding of lines: plain text, raw bytes, JSON objects."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syslog import META, transport_meta

SOURCE = "stdin"


def _sourced(df: DataFrame, include: bool) -> dict:
    return {"source": F.lit(SOURCE)} if include else {}


def decode_text(lines: DataFrame, column: str = "value", allow_invalid_utf8: bool = False, include_source: bool = True, source_id: str | None = None) -> DataFrame:
    """A line is the message; invalid UTF-8 is flagged, and marks the payload as damaged."""
    valid = F.is_valid_utf8(F.col(column).cast("string"))
    flag = F.lit(None).cast("boolean") if allow_invalid_utf8 else F.when(~valid, False)
    meta = transport_meta(lines.columns, source_id)
    damaged = meta["payload_truncated"] | (F.lit(False) if allow_invalid_utf8 else ~valid)
    columns = {"message": F.make_valid_utf8(F.col(column).cast("string")), "stdin_msg_utf8_valid": flag, **_sourced(lines, include_source)}
    return lines.select(*(c.alias(n) for n, c in columns.items()), meta.withField("payload_truncated", damaged).cast(META).alias("_meta"))


def decode_raw(lines: DataFrame, column: str = "value", include_source: bool = True, source_id: str | None = None) -> DataFrame:
    """A line's bytes are the message, unchecked."""
    columns = {"message": F.col(column).cast("string"), **_sourced(lines, include_source)}
    return lines.select(*(c.alias(n) for n, c in columns.items()), transport_meta(lines.columns, source_id).cast(META).alias("_meta"))


def decode_ndjson(
    lines: DataFrame, schema: T.StructType | str, column: str = "value", on_error: str = "as_text", message_key: str = "message", include_source: bool = True, source_id: str | None = None
) -> DataFrame:
    """A line is a JSON object whose keys are fields.

    ``schema`` names the fields wanted.  Objects and arrays become JSON text.  The
    message is the ``message_key`` text, or else the whole line.  A line that is no
    object is decoded as text (``as_text``) or left out (``drop``).
    """
    if on_error not in ("as_text", "drop"):
        raise ValueError(f"on_error {on_error}")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    line = F.col(column).cast("string")
    parsed = F.try_parse_json(line)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    rows = lines.withColumns({"__json": parsed, "__object": is_object})
    if on_error == "drop":
        rows = rows.where("__object")

    def path(name: str) -> str:
        return "$[" + json.dumps(name) + "]"

    def field(f: T.StructField):
        kind = f.dataType.simpleString() if isinstance(f.dataType, T.AtomicType) else "string"
        return F.when(F.col("__object"), F.try_variant_get("__json", path(f.name), kind)).alias(f.name)

    spoken = F.when(F.schema_of_variant(F.try_variant_get("__json", path(message_key), "variant")) == "STRING", F.try_variant_get("__json", path(message_key), "string"))
    message = F.coalesce(F.when(F.col("__object"), spoken), line).alias("message")
    fields = [field(f) for f in schema.fields if f.name.lower() not in ("message", "source")]
    extra = [c.alias(n) for n, c in _sourced(lines, include_source).items()]
    return rows.select(message, *fields, *extra, transport_meta(lines.columns, source_id).cast(META).alias("_meta"))


def infer_ndjson_schema(lines: DataFrame, column: str = "value") -> T.StructType:
    """Fields of all objects of the lines, in one aggregate; what is nested becomes text."""
    found = lines.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column).cast("string"))).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType([])
    fields, depth, start, body = [], 0, 0, found[len("OBJECT<") : -1]
    for at, c in enumerate(body + ","):
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            name, _, kind = body[start:at].strip().partition(":")
            kind = kind.strip()
            simple = kind if kind in ("BIGINT", "DOUBLE", "BOOLEAN", "STRING") else "DOUBLE" if kind.startswith("DECIMAL") else "STRING"
            fields.append(T.StructField(name.strip("` "), T.StructType.fromDDL(f"x {simple}")[0].dataType))
            start = at + 1
    return T.StructType(fields)


def read_lines(spark, path: str) -> DataFrame:
    """``file, line_no, value`` of text files of any size, one row per line.

    ``line_no`` orders the lines of a file: the place of the split that has them,
    and their order in it.  Splits are read in parallel.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r$", "")
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), value.alias("value"))
