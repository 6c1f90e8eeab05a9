"""Records of several lines: by a pattern of first lines, by blank lines, or by pauses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: POSIX classes and what Java calls them
CLASSES = {
    "alpha": "Alpha",
    "digit": "Digit",
    "alnum": "Alnum",
    "upper": "Upper",
    "lower": "Lower",
    "punct": "Punct",
    "space": "Space",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "xdigit": "XDigit",
    "print": "Print",
    "graph": "Graph",
}


def java_pattern(posix: str) -> str:
    """An extended POSIX expression for Java, where ^ and $ match at each line."""
    return "(?m)" + re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{CLASSES[m[1]]}}}", posix)


def aggregate_lines(
    lines: DataFrame,
    mode: str = "disabled",
    pattern: str | None = None,
    max_bytes: int = 256 * 1024,
    timeout_ms: int = 0,
    stream: str = "stream",
    order: str = "line_no",
    value: str = "value",
    at: str | None = None,
) -> DataFrame:
    """``stream, line_no, value, truncated``: one row per record, numbered by its first line.

    ``pattern``: a line that matches begins a record.  ``stanza``: a blank line ends
    one and is left out.  With ``timeout_ms`` and an arrival time column ``at``, a
    pause of so long ends a record too.  Lines are joined by a newline and cut at
    ``max_bytes``.  Records are built per ``stream``, so streams run in parallel;
    a null line counts as empty.
    """
    rows = lines.withColumn("__line", F.coalesce(F.col(value).cast("string"), F.lit("")))
    by = Window.partitionBy(stream).orderBy(order)
    if mode == "disabled":
        begins = F.lit(1)
    elif mode == "pattern":
        if not pattern:
            raise ValueError("mode pattern needs a pattern")
        begins = F.col("__line").rlike(java_pattern(pattern)).cast("int")
    elif mode == "stanza":
        begins = F.coalesce((F.lag("__line").over(by) == "").cast("int"), F.lit(1))
    else:
        raise ValueError(f"multiline mode {mode}")
    if timeout_ms and at:
        pause = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(by)
        begins = F.greatest(begins, F.coalesce((pause * 1000 >= timeout_ms).cast("int"), F.lit(0)))
    rows = rows.withColumns({"__begins": begins, "__bytes": F.octet_length("__line") + 1})
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__record": F.sum("__begins").over(running), "__from": F.sum("__bytes").over(running) - F.col("__bytes")})
    # where a line stands in its record: what lies above max_bytes is never gathered
    base = F.coalesce(F.max(F.when(F.col("__begins") == 1, F.col("__from"))).over(running), F.lit(0))
    rows = rows.withColumn("__from", F.col("__from") - base)
    if mode == "stanza":
        rows = rows.where("__line != ''")
    part = F.when(F.col("__from") <= max_bytes, F.struct(F.col(order).alias("o"), F.col("__line").alias("l")))
    size = F.max(F.col("__from") + F.col("__bytes")) - 1
    joined = rows.groupBy(stream, "__record").agg(F.min(order).alias("line_no"), F.array_sort(F.collect_list(part)).alias("parts"), size.alias("size"))
    text = F.array_join(F.transform("parts", lambda p: p["l"]), "\n")
    return joined.select(
        F.col(stream).alias("stream"),
        "line_no",
        F.when(F.col("size") > max_bytes, F.make_valid_utf8(F.substr(F.encode(text, "UTF-8"), F.lit(1), F.lit(max_bytes)).cast("string"))).otherwise(text).alias("value"),
        (F.col("size") > max_bytes).alias("truncated"),
    )
