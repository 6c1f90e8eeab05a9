"""The library's queries over the test tables, each with DuckDB SQL of the same result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import META
from ..sinks.console import console_lines
from ..sources.framing import frame_chunks
from ..sources.limits import allowed, bounded, rate_limited
from ..sources.multiline import aggregate_lines
from ..sources.syslog import parse_syslog
from ..sources.text import decode_ndjson, decode_raw, decode_text
from ..sql.parse import parse_select
from ..sql.render import format_select
from ..sql.usage import usage
from .config import parse_config
from .graph import Pipeline
from .query import compile_sql

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}
#: Year that RFC 3164 times are read in.
NOW = dt.datetime(2024, 3, 15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def over_events(name: str, sql: str, oracle: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A statement with exact value rules over ``events``."""
    query(name, oracle)(lambda spark, sf_dir: compile_sql(sql).apply(prepare(read(spark, sf_dir, "events"))))


def over_tables(name: str, sql: str, oracle: str, *tables: str) -> None:
    """A statement over several tables."""
    query(name, oracle)(lambda spark, sf_dir: compile_sql(sql).over({t: read(spark, sf_dir, t) for t in tables}))


def gaps(df: DataFrame) -> DataFrame:
    """``events`` with nulls: no value for clicks, no type for every third user."""
    return df.withColumns(
        {
            "value": F.when(F.col("event_type") != "click", F.col("value")),
            "event_type": F.when(F.col("user_id") % 3 != 0, F.col("event_type")),
        }
    )


GAPS = "(SELECT event_id, ts, user_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS event_type, CASE WHEN event_type <> 'click' THEN value END AS value, props FROM events)"

# projection, filter, predicates

over_events(
    "filter_project",
    "SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 50.0",
    "SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 50e0",
)
over_events("star_where_true", "SELECT * FROM events WHERE 1 = 1", "SELECT CAST(NULL AS VARCHAR) AS message, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props FROM events", lambda df: df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
over_events(
    "arith_projection",
    "SELECT event_id, (value + 7) * 3 AS score, user_id / 4 AS quarter, -user_id AS minus, +user_id - 1 AS less FROM events WHERE value >= 10",
    "SELECT event_id, (value + 7) * 3 AS score, user_id::DOUBLE / 4 AS quarter, -user_id AS minus, user_id - 1 AS less FROM events WHERE value >= 10",
)
over_events(
    "not_or_precedence",
    "SELECT event_id FROM events WHERE NOT (event_type = 'click') OR value < 5 AND user_id > 100",
    "SELECT event_id FROM events WHERE (NOT (event_type = 'click')) OR ((value < 5) AND (user_id > 100))",
)
over_events(
    "not_binds_first",
    "SELECT event_id FROM events WHERE NOT big = TRUE",
    "SELECT event_id FROM events WHERE (NOT (value > 50)) = TRUE",
    lambda df: df.withColumn("big", F.col("value") > 50),
)
over_events("null_safe_eq", "SELECT event_id FROM events WHERE value = NULL", f"SELECT event_id FROM {GAPS} WHERE value IS NULL", gaps)
over_events("null_safe_ne", "SELECT event_id FROM events WHERE event_type <> 'view'", f"SELECT event_id FROM {GAPS} WHERE event_type IS DISTINCT FROM 'view'", gaps)
over_events("null_eq_null", "SELECT event_id FROM events WHERE missing = absent AND value != NULL", f"SELECT event_id FROM {GAPS} WHERE value IS NOT NULL", gaps)
over_events("cross_type_eq", "SELECT event_id FROM events WHERE user_id = '7' OR event_id = 3", "SELECT event_id FROM events WHERE event_id = 3")
over_events("cross_type_ne", "SELECT event_id FROM events WHERE event_type != 4 AND user_id < 50", "SELECT event_id FROM events WHERE user_id < 50")
over_events("order_err_drop", "SELECT event_id, value FROM events WHERE value < 40", f"SELECT event_id, value FROM {GAPS} WHERE value IS NOT NULL AND value < 40", gaps)
over_events("or_no_shortcircuit", "SELECT event_id FROM events WHERE user_id > 0 OR value < 40", f"SELECT event_id FROM {GAPS} WHERE value IS NOT NULL AND (user_id > 0 OR value < 40)", gaps)
over_events("projection_err_drop", "SELECT event_id, value + 1 AS more FROM events", f"SELECT event_id, value + 1 AS more FROM {GAPS} WHERE value IS NOT NULL", gaps)
over_events("type_mismatch_drop", "SELECT event_id FROM events WHERE event_type < 4", "SELECT event_id FROM events WHERE false")
over_events("div_zero_drop", "SELECT event_id, event_id / (user_id - 7) AS ratio FROM events", "SELECT event_id, event_id::DOUBLE / (user_id - 7) AS ratio FROM events WHERE user_id <> 7")
over_events(
    "overflow_drop",
    "SELECT event_id, 9223372036854775000 + user_id AS big, event_id * 1000000000000000 AS wide FROM events",
    "SELECT event_id, 9223372036854775000 + user_id AS big, event_id * 1000000000000000 AS wide FROM events "
    "WHERE user_id <= 807 AND event_id <= 9223",
)
over_events(
    "int_order_as_double",
    "SELECT event_id FROM events WHERE event_id + 9007199254740992 > 9007199254740993",
    "SELECT event_id FROM events WHERE (event_id + 9007199254740992)::DOUBLE > 9007199254740993::DOUBLE",
)
over_events("string_order", "SELECT event_id FROM events WHERE event_type >= 'error' AND event_type < 'z'", "SELECT event_id FROM events WHERE event_type >= 'error' AND event_type < 'z'")
over_events("missing_column", "SELECT event_id, nothing FROM events", "SELECT event_id, CAST(NULL AS VARCHAR) AS nothing FROM events")
QUERIES["missing_column"] = lambda spark, sf_dir: compile_sql("SELECT event_id, nothing FROM events").apply(read(spark, sf_dir, "events")).withColumn("nothing", F.col("nothing").cast("string"))
over_events("case_insensitive_cols", "SELECT EVENT_ID AS id, Event_Type AS kind FROM events WHERE USER_ID < 20", "SELECT event_id AS id, event_type AS kind FROM events WHERE user_id < 20")
over_events("quoted_ident", 'SELECT "event_id" AS id, "EVENT_ID" = NULL AS other FROM events', "SELECT event_id AS id, true AS other FROM events")
over_events(
    "virtual_cols",
    "SELECT message, source_id, event_id FROM events WHERE source_id = 'feed' AND message != NULL",
    "SELECT event_type AS message, 'feed' AS source_id, event_id FROM events",
    lambda df: df.withColumns({"message": F.col("event_type"), META: F.struct(F.lit("feed").alias("source_id"))}),
)
over_events("qualified_star", "SELECT e.*, events.user_id + 1 AS next FROM events e", "SELECT CAST(NULL AS VARCHAR) AS message, event_id, user_id, value, user_id + 1 AS next FROM events", lambda df: df.select("event_id", "user_id", "value"))
query("select_no_from", "SELECT 1::BIGINT AS one, 'x' AS x FROM events")(lambda spark, sf_dir: compile_sql("SELECT 1 AS one, 'x' AS x").apply(read(spark, sf_dir, "events")))
over_events("literals", "SELECT event_id, 1.5 AS a, .5 AS b, 1e+03 AS c, 'it''s' AS d, TRUE AS e FROM events", "SELECT event_id, 1.5::DOUBLE AS a, 0.5::DOUBLE AS b, 1000::DOUBLE AS c, 'it''s' AS d, true AS e FROM events")
over_events("scalar_functions", "SELECT event_id, ABS(user_id - 50) AS far, UPPER(event_type) AS kind FROM events WHERE ABS(user_id - 50) < 20", "SELECT event_id, abs(user_id - 50) AS far, upper(event_type) AS kind FROM events WHERE abs(user_id - 50) < 20")

# syslog

BODY = "event_type || ': ' || 'user ' || user_id::VARCHAR"


def syslog_lines(df: DataFrame) -> DataFrame:
    """A line per event; RFC 5424 for even ids, RFC 3164 for odd ones, every seventh is broken."""
    pri = (F.col("event_id") % 192).cast("string")
    body = F.concat_ws("", "event_type", F.lit(": user "), F.col("user_id").cast("string"))
    new = F.concat(F.lit("<"), pri, F.lit(">1 2024-01-02T03:04:05Z host"), F.col("user_id").cast("string"), F.lit(" app "), F.col("event_id").cast("string"), F.lit(' ID [a@1 k="v"] '), body)
    old = F.concat(F.lit("<"), pri, F.lit(">Oct 11 22:14:15 host"), F.col("user_id").cast("string"), F.lit(" "), body)
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("<999>"), body)).when(F.col("event_id") % 2 == 0, new).otherwise(old)
    return df.select(line.alias("value"))


def syslog(spark: SparkSession, sf_dir: str, mode: str = "auto") -> DataFrame:
    return parse_syslog(syslog_lines(read(spark, sf_dir, "events")), mode=mode, now=NOW)


@query(
    "syslog_severity_filter",
    "SELECT (event_id % 192 % 8)::BIGINT AS syslog_severity, CASE WHEN event_id % 2 = 0 THEN event_type || ': user ' || user_id ELSE 'user ' || user_id END AS message "
    "FROM events WHERE event_id % 7 <> 0 AND event_id % 192 % 8 <= 4",
)
def syslog_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT syslog_severity, message FROM logs WHERE syslog_severity <= 4").apply(syslog(spark, sf_dir))


@query("syslog_pri", "SELECT (event_id % 192) // 8 AS facility, (event_id % 192) % 8 AS severity, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def syslog_pri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT syslog_facility AS facility, syslog_severity AS severity, COUNT(*) AS n FROM logs GROUP BY syslog_facility, syslog_severity").apply(syslog(spark, sf_dir))


FIVE = "SELECT 'host' || user_id AS host, 'app' AS app, event_id::VARCHAR AS pid, '[a@1 k=\"v\"]' AS data, 1::BIGINT AS version, event_type || ': user ' || user_id AS message FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 0"


@query("syslog_5424", FIVE)
def syslog_5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT syslog_hostname AS host, syslog_app_name AS app, syslog_proc_id AS pid, syslog_structured_data AS data, syslog_version AS version, message FROM logs WHERE syslog_format = 'rfc5424'"
    return compile_sql(sql).apply(syslog(spark, sf_dir, "rfc5424"))


@query("syslog_3164", "SELECT 'host' || user_id AS host, event_type AS tag, '2023-10-11T22:14:15Z' AS at, 'user ' || user_id AS message FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 1")
def syslog_3164(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT syslog_hostname AS host, syslog_app_name AS tag, syslog_timestamp_normalized AS at, message FROM logs WHERE syslog_timestamp_normalized != NULL"
    return compile_sql(sql).apply(syslog(spark, sf_dir, "rfc3164"))


@query("syslog_auto", "SELECT CASE WHEN event_id % 2 = 0 THEN 'rfc5424' ELSE 'rfc3164' END AS format, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def syslog_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT syslog_format AS format, COUNT(*) AS n FROM logs GROUP BY syslog_format").apply(syslog(spark, sf_dir))


@query(
    "syslog_long_data",
    "WITH made AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '[a@1 k=\"' || repeat('y', 10000) || '\"]' "
    "WHEN 1 THEN repeat('[b@1 k=\"v\\\"]\"]', s_suppkey % 40 * 20 + 1) ELSE repeat('[c [d] \"]\"]', s_suppkey % 30 * 20 + 1) END AS data FROM supplier) "
    "SELECT 'host' || s_suppkey AS host, data, 'said ' || s_suppkey AS message FROM made",
)
def syslog_long_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data of thousands of characters, elements and nested brackets."""
    k = F.col("s_suppkey")
    letters = F.concat(F.lit('[a@1 k="'), F.repeat(F.lit("y"), F.lit(10_000)), F.lit('"]'))
    quoted = F.repeat(F.lit('[b@1 k="v\\"]"]'), (k % 40 * 20 + 1).cast("int"))
    nested = F.repeat(F.lit('[c [d] "]"]'), (k % 30 * 20 + 1).cast("int"))
    data = F.when(k % 3 == 0, letters).when(k % 3 == 1, quoted).otherwise(nested)
    line = F.concat(F.lit("<34>1 2024-01-02T03:04:05Z host"), k.cast("string"), F.lit(" app 1 ID "), data, F.lit(" said "), k.cast("string"))
    lines = read(spark, sf_dir, "supplier").select(line.alias("value"))
    return compile_sql("SELECT syslog_hostname AS host, syslog_structured_data AS data, message FROM logs").apply(parse_syslog(lines, now=NOW))


@query(
    "framed_chunks",
    "SELECT n_nationkey::BIGINT AS chunk_id, unnest([0, 1, 2])::BIGINT AS frame_no, unnest([n_name, repeat('x', 40), 'open']) AS value, unnest([false, true, true]) AS truncated FROM nation",
)
def framed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted frames for even chunks, lines for odd ones; the second is above the limit, the last has no end."""
    name, long = F.col("n_name"), F.repeat(F.lit("x"), F.lit(100))
    counted = F.concat(F.octet_length(name).cast("string"), F.lit(" "), name, F.lit("100 "), long, F.lit("4 open"))
    lines = F.concat(name, F.lit("\r\n"), long, F.lit("\n"), F.lit("open"))
    even = F.col("n_nationkey") % 2 == 0
    chunks = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.when(even, counted).otherwise(lines).cast("binary").alias("value"))
    out = frame_chunks(chunks, limit=40).withColumn("value", F.col("value").cast("string"))
    return out.withColumn("truncated", F.col("truncated") | (F.col("value") == "open"))


# decoders


def props(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{ bad "), F.col("props"))).otherwise(F.col("props")) if broken else F.col("props")
    return read(spark, sf_dir, "events").select(value.alias("value"))


@query("ndjson_fields", "SELECT props AS message, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'stdin' AS source FROM events")
def ndjson_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT message, k, source FROM logs").apply(decode_ndjson(props(spark, sf_dir), "k bigint"))


@query("ndjson_bad_as_text", "SELECT CASE WHEN event_id % 5 = 0 THEN '{ bad ' || props ELSE props END AS message, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, 'stdin' AS source FROM events")
def ndjson_bad_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT message, k, source FROM logs").apply(decode_ndjson(props(spark, sf_dir, True), "k bigint"))


@query("ndjson_nested", "SELECT 'm' || event_id AS message, '[' || user_id || ',2]' AS a, '{\"k\":\"' || event_type || '\"}' AS o, event_id % 2 = 0 AS b FROM events")
def ndjson_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message key of another name; what is nested becomes text."""
    line = F.format_string('{"text":"m%d","a":[%d,2],"o":{"k":"%s"},"b":%s}', "event_id", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"))
    lines = read(spark, sf_dir, "events").select(line.alias("value"))
    return compile_sql("SELECT message, a, o, b FROM logs").apply(decode_ndjson(lines, "a string, o string, b boolean", message_key="text"))


@query("ndjson_bad_drop", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def ndjson_bad_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_sql("SELECT k, COUNT(*) AS n FROM logs GROUP BY k").apply(decode_ndjson(props(spark, sf_dir, True), "k bigint", on_error="drop"))


@query("utf8_text", "SELECT text AS message, 'stdin' AS source, true AS valid FROM documents")
def utf8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("value"))
    return compile_sql("SELECT message, source, stdin_msg_utf8_valid = NULL AS valid FROM logs").apply(decode_text(lines))


@query("utf8_invalid", "SELECT event_type || CASE WHEN event_id % 2 = 0 THEN chr(65533) ELSE '' END AS message, CASE WHEN event_id % 2 = 0 THEN false END AS valid FROM events")
def utf8_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("event_type").cast("binary")
    lines = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(raw, F.lit(b"\xff"))).otherwise(raw).alias("value"))
    return compile_sql("SELECT message, stdin_msg_utf8_valid AS valid FROM logs").apply(decode_text(lines))


@query("raw_codec", "SELECT text AS message FROM documents")
def raw_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("value"))
    return compile_sql("SELECT message FROM logs").apply(decode_raw(lines, include_source=False))


def event_lines(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """Lines in 16 streams, numbered by event."""
    return read(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("string").alias("stream"), F.col("event_id").alias("line_no"), value.alias("value"), F.timestamp_seconds(F.col("event_id")).alias("at"))


RECORDS = "SELECT stream, min(line_no) AS line_no, string_agg(value, chr(10) ORDER BY line_no) AS value FROM (SELECT *, {group} AS g FROM lines) {where} GROUP BY stream, g"
LINES = "WITH lines AS (SELECT (user_id % 16)::VARCHAR AS stream, event_id AS line_no, {value} AS value FROM events) "


@query("multiline_pattern", LINES.format(value="event_type") + RECORDS.format(group="sum((value = 'error')::BIGINT) OVER (PARTITION BY stream ORDER BY line_no)", where=""))
def multiline_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_lines(event_lines(spark, sf_dir, F.col("event_type")), "pattern", "^error").drop("truncated")


@query(
    "multiline_stanza",
    LINES.format(value="CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END")
    + RECORDS.format(group="coalesce(sum((value = '')::BIGINT) OVER (PARTITION BY stream ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", where="WHERE value <> ''"),
)
def multiline_stanza(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return aggregate_lines(event_lines(spark, sf_dir, value), "stanza").drop("truncated")


@query(
    "multiline_timeout",
    "WITH lines AS (SELECT (user_id % 16)::VARCHAR AS stream, event_id AS line_no, event_type AS value, "
    "event_id - lag(event_id) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS gap FROM events) "
    + RECORDS.format(group="sum((value = 'error' OR coalesce(gap >= 20, false))::BIGINT) OVER (PARTITION BY stream ORDER BY line_no)", where=""),
)
def multiline_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir, F.col("event_type"))
    return aggregate_lines(lines, "pattern", "^error", timeout_ms=20_000, at="at").drop("truncated")


@query("peer_acl", "SELECT event_id FROM events WHERE user_id // 256 % 256 BETWEEN 1 AND 1 OR (user_id // 256 % 256 = 0 AND user_id % 256 BETWEEN 64 AND 127)")
def peer_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    peer = F.format_string("10.0.%d.%d:514", F.floor(F.col("user_id") / 256) % 256, F.col("user_id") % 256)
    events = read(spark, sf_dir, "events").select("event_id", peer.alias("peer"))
    return events.where(allowed("peer", ["10.0.1.0/24", "10.0.0.64/26"])).select("event_id")


@query("peer_acl_v6", "SELECT event_id FROM events WHERE user_id % 4 = 1")
def peer_acl_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    peer = F.format_string("[2001:db8:%d::7]:514", F.col("user_id") % 4)
    events = read(spark, sf_dir, "events").select("event_id", peer.alias("peer"))
    return events.where(allowed("peer", ["2001:db8:1::/48", "10.0.0.0/8"])).select("event_id")


@query(
    "token_bucket",
    "WITH RECURSIVE arrived AS (SELECT (user_id % 16)::VARCHAR AS stream, event_id AS line_no, event_id / 10 AS came, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS r FROM events), "
    "run(stream, r, came, tokens, pass) AS (SELECT stream, r, came, 1e0, true FROM arrived WHERE r = 1 UNION ALL "
    "SELECT stream, r, came, have - CASE WHEN have >= 1 THEN 1 ELSE 0 END, have >= 1 FROM (SELECT n.stream, n.r, n.came, least(2e0, run.tokens + (n.came - run.came) * 0.5e0) AS have "
    "FROM run JOIN arrived n ON n.stream = run.stream AND n.r = run.r + 1) t) "
    "SELECT stream, line_no FROM run JOIN arrived USING (stream, r) WHERE pass",
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_lines(spark, sf_dir, F.col("event_type")).withColumn("at", (F.col("line_no") / 10).cast("double"))
    return rate_limited(events, 0.5, 2, order="line_no").select("stream", "line_no")


QUEUE = "SELECT stream, line_no FROM (SELECT (user_id % 16)::VARCHAR AS stream, event_id AS line_no, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id {way}) AS r FROM events) WHERE r <= 20"
query("drop_newest", QUEUE.format(way="ASC"))(lambda spark, sf_dir: bounded(event_lines(spark, sf_dir, F.col("event_type")), 20, "drop_newest", "stream").select("stream", "line_no"))
query("queue_reject", QUEUE.format(way="ASC"))(lambda spark, sf_dir: bounded(event_lines(spark, sf_dir, F.col("event_type")), 20, "reject", "stream").select("stream", "line_no"))
query("drop_oldest", QUEUE.format(way="DESC"))(lambda spark, sf_dir: bounded(event_lines(spark, sf_dir, F.col("event_type")), 20, "drop_oldest", "stream").select("stream", "line_no"))

# pipelines

CHAINED = """
[sources.feed]
type = "stdin"

[transforms.first]
type = "sql"
inputs = ["feed"]
query = "SELECT user_id AS who, event_type AS message, value FROM logs WHERE value >= 20"

[transforms.second]
type = "sql"
inputs = ["first"]
query = "SELECT who, message, source_id FROM logs WHERE message = 'click' AND source_id = 'feed'"

[sinks.out]
type = "console"
inputs = [{inputs}]
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", "user_id", "value", F.struct(F.lit("feed").alias("source_id")).alias(META))


@query("chained_transforms", "SELECT user_id AS who, event_type AS message, 'feed' AS source_id FROM events WHERE value >= 20 AND event_type = 'click'")
def chained_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(parse_config(CHAINED.format(inputs='"second"'))).outputs({"feed": feed(spark, sf_dir)})["out"]


@query(
    "fan_in_union",
    "SELECT user_id AS who, event_type AS message, value, CAST(NULL AS VARCHAR) AS source_id FROM events WHERE value >= 20 "
    "UNION ALL SELECT user_id, event_type, NULL, 'feed' FROM events WHERE value >= 20 AND event_type = 'click'",
)
def fan_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(parse_config(CHAINED.format(inputs='"first", "second"'))).outputs({"feed": feed(spark, sf_dir)})["out"]


FANNED = CHAINED.format(inputs='"first"') + """
[sinks.also]
type = "console"
inputs = ["second"]

[sinks.raw]
type = "console"
inputs = ["feed"]
"""


def fanned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = feed(spark, sf_dir).withColumnRenamed("event_type", "message")
    return Pipeline(parse_config(FANNED.replace("event_type AS message", "message"))).outputs({"feed": events})


@query(
    "fan_out",
    "SELECT 'out' AS sink, user_id AS who, event_type AS message FROM events WHERE value >= 20 UNION ALL SELECT 'also', user_id, event_type FROM events WHERE value >= 20 AND event_type = 'click'",
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fanned(spark, sf_dir)
    return out["out"].select(F.lit("out").alias("sink"), "who", "message").union(out["also"].select(F.lit("also"), "who", "message"))


@query("pass_through", "SELECT event_type AS message, user_id, value FROM events")
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanned(spark, sf_dir)["raw"]


@query("console_values", "SELECT '{\"x\": ' || (n_nationkey % 9 + 1) || '.5e0, \"big\": ' || (n_nationkey % 9 + 1) || '.5e3, \"text\": \"a\\u0000\\u001B\\u007F\\n\\t' || n_name || '\", \"yes\": true}' AS line FROM nation")
def console_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("n_nationkey") % 9 + 1.5
    text = F.concat(F.lit("a\x00\x1b\x7f\n\t"), "n_name")
    return console_lines(read(spark, sf_dir, "nation").select(x.alias("x"), (x * 1000).alias("big"), text.alias("text"), F.lit(True).alias("yes")))


@query("console_json", """SELECT '{"event_id": ' || event_id || ', "kind": "' || event_type || '", "props": "' || replace(props, '"', '\\"') || '", "none": null}' AS line FROM events""")
def console_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console_lines(compile_sql("SELECT event_id, event_type AS kind, props, nothing AS none FROM events").apply(read(spark, sf_dir, "events")))


# several relations

over_tables("join_inner_on", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000.0", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000", "orders", "customer")
over_tables(
    "left_join_using",
    "SELECT k, n.n_name AS name, m.total AS total FROM (SELECT n_nationkey AS k, n_name FROM nation) n LEFT OUTER JOIN (SELECT c_nationkey AS k, COUNT(*) AS total FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) m USING (k)",
    "SELECT k, n.n_name AS name, m.total AS total FROM (SELECT n_nationkey AS k, n_name FROM nation) n LEFT JOIN (SELECT c_nationkey AS k, count(*) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1) m USING (k)",
    "nation",
    "customer",
)
over_tables("cross_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND n_nationkey < 12", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND n_nationkey < 12", "region", "nation")
over_tables("join_no_constraint", "SELECT r_name, n_name FROM region JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
over_tables("theta_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
over_tables(
    "multi_join",
    "SELECT r_name, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "lineitem", "orders", "customer", "nation", "region",
)
over_tables("group_having_order", "SELECT user_id, COUNT(*) AS total FROM events GROUP BY user_id HAVING COUNT(*) > 8 ORDER BY total DESC, user_id", "SELECT user_id, count(*) AS total FROM events GROUP BY user_id HAVING count(*) > 8 ORDER BY total DESC, user_id", "events")
over_tables("having_alone", "SELECT COUNT(*) AS n FROM events HAVING COUNT(*) > 1", "SELECT count(*) AS n FROM events HAVING count(*) > 1", "events")
over_tables("aggregates", "SELECT event_type, COUNT(value) AS n, MAX(value) AS high, MIN(value) AS low FROM events GROUP BY event_type", "SELECT event_type, count(value) AS n, max(value) AS high, min(value) AS low FROM events GROUP BY 1", "events")
over_tables("count_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1", "events")
over_tables("select_distinct", "SELECT DISTINCT event_type, user_id FROM events", "SELECT DISTINCT event_type, user_id FROM events", "events")
@query("order_by", "SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_name) - 1 AS place, n_regionkey, n_name FROM nation")
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their place in the result, which is small."""
    out = compile_sql("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC").over({"nation": read(spark, sf_dir, "nation")})
    return out.coalesce(1).withColumn("place", F.monotonically_increasing_id())


over_tables("theta_alone", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "nation")
over_tables("cte_recursive_word", "WITH RECURSIVE d AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) SELECT r_name, n FROM region JOIN d ON r_regionkey = k", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name", "nation", "region")
over_tables(
    "cte_group_join",
    "WITH derived AS (SELECT MAX(o_totalprice) AS most, COUNT(o_orderkey) AS n, o_custkey FROM orders GROUP BY o_custkey) SELECT c_name, most, n FROM customer JOIN derived ON c_custkey = o_custkey",
    "WITH derived AS (SELECT max(o_totalprice) AS most, count(o_orderkey) AS n, o_custkey FROM orders GROUP BY o_custkey) SELECT c_name, most, n FROM customer JOIN derived ON c_custkey = o_custkey",
    "orders", "customer",
)
over_tables("cte_columns", "WITH d (k, n) AS (SELECT user_id, COUNT(*) FROM events GROUP BY user_id) SELECT k, n FROM d WHERE n > 5", "WITH d (k, n) AS (SELECT user_id, count(*) FROM events GROUP BY user_id) SELECT k, n FROM d WHERE n > 5", "events")
over_tables("derived_table", "SELECT d.kind, d.n FROM (SELECT event_type AS kind, COUNT(*) AS n FROM events GROUP BY event_type) AS d WHERE d.n > 10", "SELECT kind, n FROM (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) d WHERE n > 10", "events")

# statements about statements

STATEMENTS = (
    "SELECT UPPER(city) AS town, 2 * (pop + 1) FROM places WHERE ABS(lat) < 40.5",
    "SELECT o.who, SUM(o.cost) AS s FROM orders o WHERE o.cost > 0 AND kind = 'x' ORDER BY s DESC",
)


@query("column_usage", "SELECT * FROM (VALUES (0, NULL, 'city'), (0, NULL, 'lat'), (0, NULL, 'pop'), (1, 'o', 'cost'), (1, 'o', 'who'), (1, NULL, 's'), (1, NULL, 'kind')) t(statement, table_name, column_name)")
def column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, t, c) for n, sql in enumerate(STATEMENTS) for t, c in usage(parse_select(sql)).columns]
    return spark.createDataFrame(rows, "statement int, table_name string, column_name string")


@query("function_usage", "SELECT * FROM (VALUES (0, 'abs', 1), (0, 'upper', 1), (1, 'sum', 1)) t(statement, function_name, arguments)")
def function_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, f, k) for n, sql in enumerate(STATEMENTS) for f, k in usage(parse_select(sql)).functions]
    return spark.createDataFrame(rows, "statement int, function_name string, arguments int")


WRITTEN = {
    "select ((a)) ,-b  from t inner join u using(k) order by a asc;": "SELECT a, -b FROM t JOIN u USING (k) ORDER BY a",
    "SELECT x<>1 AND (y OR z) FROM t -- note": "SELECT x != 1 AND (y OR z) FROM t",
    "with d as (select Count(distinct v) as c from w) select * from d AS e": "WITH d AS (SELECT Count(DISTINCT v) AS c FROM w) SELECT * FROM d e",
}


@query("format_roundtrip", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', true)".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in WRITTEN.items()) + ") t(written, formatted, same)")
def format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(sql, format_select(parse_select(sql)), parse_select(format_select(parse_select(sql))) == parse_select(sql)) for sql in WRITTEN]
    return spark.createDataFrame(rows, "written string, formatted string, same boolean")
