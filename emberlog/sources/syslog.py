"""Syslog lines as events, in column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the columns of a syslog event, in their order
FIELDS = [
    ("syslog_facility", "bigint"),
    ("syslog_severity", "bigint"),
    ("syslog_format", "string"),
    ("syslog_timestamp", "string"),
    ("syslog_timestamp_normalized", "string"),
    ("syslog_hostname", "string"),
    ("syslog_app_name", "string"),
    ("syslog_proc_id", "string"),
    ("syslog_msg_id", "string"),
    ("syslog_structured_data", "string"),
    ("syslog_version", "bigint"),
    ("syslog_msg_utf8_valid", "boolean"),
]
META = "struct<received_at: timestamp, source_id: string, transport: struct<kind: string, peer_address: string, protocol: string>, payload_truncated: boolean>"
#: Elements of structured data without brackets outside quotes; nothing is given back, so a match needs no stack.
DATA = r'^(?:\[(?:[^"\[\]]++|"(?:[^"\\]++|\\.)*+")*+\])++(?= |$)'
DATA_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|\[|\]|[^"\[\]]++|"'
THREE = "^[^ ]+ +[^ ]+ +[^ ]+"
STAMP = r"^[A-Za-z]{3} +[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _present(column: Column) -> Column:
    """A header field; empty and ``-`` are absent."""
    return F.when((column != "") & (column != "-"), column)


def normalised_stamp(stamp: Column, now: dt.datetime) -> Column:
    """``Mon D HH:MM:SS`` as ISO 8601, in the year that brings it nearest to ``now``.

    The day is held against 1..31 only.  Null where it is no such time.
    """

    def written(part: Column) -> Column:
        month = ((F.instr(F.lit(",".join(MONTHS)), F.lower(part[0])) + 3) / 4).cast("int")
        day, *clock = (part[i].cast("int") for i in range(1, 5))
        year = F.lit(now.year) + F.when(month - now.month > 6, -1).when(F.lit(now.month) - month > 6, 1).otherwise(0)
        valid = (month > 0) & day.between(1, 31) & (clock[0] <= 23) & (clock[1] <= 59) & (clock[2] <= 59)
        two = [F.lpad(n.cast("string"), 2, "0") for n in (month, day, *clock)]
        date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *two[:2])
        return F.when(valid, F.concat(date, F.lit("T"), F.concat_ws(":", *two[2:]), F.lit("Z")))

    return F.when(stamp.rlike(STAMP), let(F.split(stamp, "[ :]+"), written))


def parse_syslog(
    lines: DataFrame, column: str = "value", mode: str = "auto", now: dt.datetime | None = None, source_id: str | None = None
) -> DataFrame:
    """Events of the lines in a string or binary column; lines that do not parse are left out.

    ``mode`` is ``auto`` (RFC 5424, else RFC 3164), ``rfc5424`` or ``rfc3164``.
    ``now`` fixes the year of RFC 3164 times.  A ``peer_address`` column goes into
    the metadata, as do ``protocol`` and ``truncated``.
    """
    if mode not in ("auto", "rfc3164", "rfc5424"):
        raise ValueError(f"parser mode {mode}")
    now = now or dt.datetime.now(dt.UTC)
    binary = dict(lines.dtypes)[column] == "binary"
    raw = F.col(column)
    # byte for byte as Latin-1 while parsing; text again where it is valid UTF-8
    text = F.decode(raw, "ISO-8859-1") if binary else raw
    valid = F.is_valid_utf8(raw.cast("string")) if binary else F.lit(True)
    back = (lambda c: F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")), c)) if binary else (lambda c: c)

    def trimmed(t: Column) -> Column:
        ends = t.endswith("\n") | t.endswith("\r") | t.startswith("\n") | t.startswith("\r")
        return F.when(ends, F.trim(t, F.lit(" \r\n"))).otherwise(t)

    def head(line: Column) -> Column:
        close = F.instr(line, ">")
        digits = F.substr(line, F.lit(2), close - 2)
        number = F.when(line.startswith("<") & (close > 1), F.when(close == 2, 0).when(digits.rlike("^[0-9]+$"), digits.try_cast("int")))
        return F.struct(line.alias("__line"), number.alias("__pri"))

    # the priority decides before anything else is cut, behind a generator, so that a line
    # is made once; what filters facility or severity stays between this one and the next
    heads = F.transform(F.transform(F.array(F.trim(text)), trimmed), head)
    kept = [c for c in lines.columns if c not in ("syslog_facility", "syslog_severity")]
    flag = F.when(~valid, False)
    lines = lines.select(*(F.col(f"`{c}`") for c in kept), flag.alias("__flag"), F.inline(F.filter(heads, lambda h: h["__pri"].between(0, 191))))
    lines = lines.withColumns({"syslog_facility": F.shiftright("__pri", 3).cast("bigint"), "syslog_severity": (F.col("__pri") % 8).cast("bigint")})

    def cut(line: Column) -> Column:
        """What follows the priority, and its tokens."""
        rest = F.ltrim(F.substr(line, F.instr(line, ">") + 1))
        return F.struct(rest.alias("rest"), F.split(rest, " +", 7).alias("token"))

    def told(c: Column) -> Column:
        """The format, and where structured data ends."""
        token, after = c["token"], F.coalesce(F.get(c["token"], F.lit(6)), F.lit(""))
        header = F.get(token, F.lit(0)).rlike("^0*1$") & (F.size(token) >= 6) & (F.get(token, F.lit(5)) != "")
        dash = after.startswith("-")
        end = F.when(header & ~dash & (after != ""), data_end(after)).otherwise(F.lit(0))
        new = F.lit(False) if mode == "rfc3164" else header & (end >= 0)
        old = F.lit(False) if mode == "rfc5424" else F.size(token) >= 5
        return F.struct(c["rest"].alias("rest"), token.alias("token"), after.alias("after"), dash.alias("dash"), end.alias("end"), new.alias("new"), old.alias("old"))

    def five(c: Column) -> Column:
        token = [F.get(c["token"], F.lit(i)) for i in range(6)]
        body = F.ltrim(F.when(c["dash"], F.substr(c["after"], F.lit(2))).otherwise(F.substr(c["after"], c["end"] + 1)))
        none = F.lit(None).cast("string")
        return F.struct(
            back(F.regexp_replace(body, "^\u00ef\u00bb\u00bf" if binary else "^\ufeff", "")).alias("message"),
            F.lit("rfc5424").alias("syslog_format"),
            _present(token[1]).alias("syslog_timestamp"),
            none.alias("syslog_timestamp_normalized"),
            *(back(_present(token[i])).alias(n) for i, n in enumerate(("syslog_hostname", "syslog_app_name", "syslog_proc_id", "syslog_msg_id"), 2)),
            back(F.when(c["end"] > 0, F.substr(c["after"], F.lit(1), c["end"]))).alias("syslog_structured_data"),
            F.lit(1).cast("bigint").alias("syslog_version"),
        )

    def three(c: Column) -> Column:
        def shown(parts: Column) -> Column:
            token, stamp = parts["token"], parts["stamp"]
            body, none = F.get(token, F.lit(4)), F.lit(None).cast("string")
            colon = F.instr(body, ":")
            tag = F.when(colon > 0, F.trim(F.substr(body, F.lit(1), colon - 1))).otherwise("")
            return F.struct(
                back(F.when(colon > 0, F.ltrim(F.substr(body, colon + 1))).otherwise(body)).alias("message"),
                F.lit("rfc3164").alias("syslog_format"),
                _present(stamp).alias("syslog_timestamp"),
                normalised_stamp(F.trim(stamp), now).alias("syslog_timestamp_normalized"),
                back(_present(F.get(token, F.lit(3)))).alias("syslog_hostname"),
                back(_present(tag)).alias("syslog_app_name"),
                none.alias("syslog_proc_id"),
                none.alias("syslog_msg_id"),
                none.alias("syslog_structured_data"),
                F.lit(None).cast("bigint").alias("syslog_version"),
            )

        return let(F.struct(F.split(c["rest"], " +", 5).alias("token"), F.regexp_extract(c["rest"], THREE, 0).alias("stamp")), shown)

    read = lines.withColumn("__cut", let(let(cut(F.col("__line")), told), lambda c: F.when(c["new"], five(c)).when(c["old"], three(c))))
    meta = transport_meta(lines.columns, source_id)
    # a generator of one row or none: what filters its columns stays above it, so
    # that a line is parsed once however often a statement refers to its parts
    flag = F.when(F.col("__cut.syslog_format") == "rfc5424", F.col("__flag"))
    read = read.select("syslog_facility", "syslog_severity", flag.alias("__flag"), meta.cast(META).alias("__meta"), F.inline(F.when(F.col("__cut").isNotNull(), F.array("__cut"))))
    values = {n: F.col(n) for n, _ in FIELDS} | {"syslog_msg_utf8_valid": F.col("__flag")}
    return read.select(F.col("message").cast("string").alias("message"), *(values[n].cast(t).alias(n) for n, t in FIELDS), F.col("__meta").alias("_meta"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once.

    Functions of higher order also keep an operator out of whole-stage code, whose
    one method would be too long for the JVM to compile.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def data_end(after: Column) -> Column:
    """Length of the RFC 5424 structured data that ``after`` begins with, or -1.

    The usual form is one match; where brackets are nested outside quotes, tokens
    are counted.
    """
    def walked(state: Column, token: Column) -> Column:
        depth, at, end = state["depth"], state["at"], state["end"]
        # -2 open, -1 no structured data, else its length
        now = (
            F.when(end != -2, end)
            .when(depth > 0, F.when(token == '"', -1).otherwise(-2))
            .when(token == "[", -2)
            .when((at > 0) & token.startswith(" "), at)
            .otherwise(-1)
        )
        deeper = depth + F.when(token == "[", 1).when((token == "]") & (depth > 0), -1).otherwise(0)
        return F.struct(deeper.alias("depth"), (at + F.char_length(token)).alias("at"), now.alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-2).alias("end"))

    def ended(state: Column) -> Column:
        return F.when(state["end"] != -2, state["end"]).when((state["depth"] == 0) & (state["at"] > 0), state["at"]).otherwise(-1)

    nested = F.aggregate(F.regexp_extract_all(after, F.lit(DATA_TOKEN), F.lit(0)), start, walked, ended)
    return let(F.char_length(F.regexp_extract(after, DATA, 0)), lambda n: F.when(n > 0, n).when(after.startswith("["), nested).otherwise(-1))


def transport_meta(columns: list[str], source_id: str | None = None) -> Column:
    peer = F.col("peer_address") if "peer_address" in columns else F.lit(None).cast("string")
    protocol = F.col("protocol") if "protocol" in columns else F.lit(None).cast("string")
    socket = F.when(peer.isNotNull(), F.struct(F.lit("socket").alias("kind"), peer.alias("peer_address"), protocol.alias("protocol")))
    truncated = F.col("truncated") if "truncated" in columns else F.lit(False)
    received = F.col("received_at") if "received_at" in columns else F.lit(None).cast("timestamp")
    return F.struct(received.alias("received_at"), F.lit(source_id).cast("string").alias("source_id"), socket.alias("transport"), truncated.alias("payload_truncated"))
