"""Syslog, framing, decoders, multi-line records, limits, sinks."""

import datetime as dt
import socket

import pytest
from pyspark.sql import functions as F

from emberlog.sinks.console import console_lines, scientific, write_console
from emberlog.sources.framing import Framer, frame_chunks
from emberlog.sources.limits import BoundedBuffer, TokenBucket, allowed, bounded, host_of, rate_limited
from emberlog.sources.multiline import aggregate_lines, java_pattern
from emberlog.sources.sockets import Listener, address_of
from emberlog.sources.syslog import data_end, parse_syslog
from emberlog.sources.text import decode_ndjson, decode_raw, decode_text, infer_ndjson_schema, read_lines

SD = '[exampleSDID@32473 iut="3" eventSource="Application" eventID="1011"]'


def parsed(spark, *lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string").select("value")
    return parse_syslog(df, now=dt.datetime(2024, 1, 15), **options).collect()


def test_rfc5424(spark):
    (r,) = parsed(spark, f"<34>1 2023-10-10T12:30:45Z host app 123 ID47 {SD} Test message")
    assert (r.syslog_facility, r.syslog_severity, r.message, r.syslog_structured_data) == (4, 2, "Test message", SD)
    assert (r.syslog_hostname, r.syslog_app_name, r.syslog_proc_id, r.syslog_msg_id, r.syslog_version) == ("host", "app", "123", "ID47", 1)
    (r,) = parsed(spark, "<34>1 - - - - - -")
    assert (r.syslog_format, r.message, r.syslog_hostname, r.syslog_timestamp) == ("rfc5424", "", None, None)
    (r,) = parsed(spark, '<34>1 t h a p m [a x="]\\"]"][b] hi')
    assert (r.syslog_structured_data, r.message) == ('[a x="]\\"]"][b]', "hi")
    (r,) = parsed(spark, "<34>1 t h a p m -foo")
    assert r.message == "foo"


def test_rfc3164(spark):
    (r,) = parsed(spark, "<13>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8")
    assert (r.syslog_format, r.syslog_hostname, r.syslog_app_name, r.message) == ("rfc3164", "mymachine", "su", "'su root' failed for lonvick on /dev/pts/8")
    assert r.syslog_timestamp_normalized == "2023-10-11T22:14:15Z" and r.syslog_version is None
    (r,) = parsed(spark, "<165>Aug 24 05:34:00 mymachine no colon here")
    assert (r.syslog_facility, r.syslog_severity, r.syslog_app_name, r.message) == (20, 5, None, "no colon here")
    (r,) = parsed(spark, "<13>Feb 31 01:02:03 h a: b")
    assert r.syslog_timestamp_normalized == "2024-02-31T01:02:03Z"
    (r,) = parsed(spark, "<13>Foo 31 01:02:03 h a: b")
    assert r.syslog_timestamp_normalized is None


def test_what_is_no_syslog(spark):
    assert parsed(spark, "<999>notvalid", "<192>Oct 1 1:1:1 h x", "plain", "<34>", "invalid", "") == []
    assert parsed(spark, "<34>2 t h a p m - x", mode="rfc5424") == []
    assert [r.syslog_format for r in parsed(spark, "<34>1 t h a p m [open", "<34>2 t h a p m - x", "<34>1 t h a p m [a]x")] == ["rfc3164"] * 3
    with pytest.raises(ValueError):
        parsed(spark, "x", mode="other")


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(b"<34>1 t h a p m - caf\xc3\xa9",), (b"<34>1 t h a p m - caf\xe9",)], "value binary")
    a, b = parse_syslog(df).collect()
    assert a.message == "café" and a.syslog_msg_utf8_valid is None and b.syslog_msg_utf8_valid is False


def test_transport_goes_to_metadata(spark):
    df = spark.createDataFrame([("<13>Oct 11 22:14:15 m app: cut", "10.0.0.1:5514", "tcp", True)], "value string, peer_address string, protocol string, truncated boolean")
    meta = parse_syslog(df).first()["_meta"]
    assert meta.payload_truncated and meta.transport.peer_address == "10.0.0.1:5514" and meta.transport.kind == "socket"


def test_structured_data_scan(spark):
    cases = {
        '[a x="]"][b] m': 12,
        "[a [b]] m": 7,
        "[a": -1,
        "[a]x": -1,
        "[a]": 3,
        '[a x="\\"]"][b [c [d "]" ]]][e] text [f]': 30,
        '[a "open]': -1,
        "text": -1,
        "[a]]": -1,
        "[a [b] x": -1,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, wanted int")
    assert [(r.text, r.end) for r in df.select("text", "wanted", data_end(F.col("text")).alias("end")).collect() if r.wanted != r.end] == []


def test_structured_data_as_long_as_a_line_may_be(spark):
    values = {
        "letters": f'[a x="{"y" * 65_000}"]',
        "escapes": f'[a x="{chr(92)}{chr(34)}' + (chr(92) + chr(34)) * 20_000 + '"]',
        "elements": '[a k="v"]' * 7_000,
        "nested": "[" * 5_000 + "x" + "]" * 5_000,
        "many nested": "[a [b] c]" * 3_000,
        "parameters": "[a" + ' k="v"' * 9_000 + "]",
    }
    rows = parsed(spark, *(f"<34>1 t h a p m {v} said {k}" for k, v in values.items()))
    assert {r.message: r.syslog_structured_data for r in rows} == {f"said {k}": v for k, v in values.items()}
    rows = parsed(spark, "<34>1 t h a p m " + '[a x="' + "y" * 65_000, "<34>" + "word " * 13_000, "<34>" + "x" * 65_000)
    assert [r.syslog_format for r in rows] == ["rfc3164"] * 2


def test_frames_above_the_limit_are_not_held():
    for mode, data in (("lf", b"x" * 1000 + b"\nnext\n"), ("octet", b"1000 " + b"x" * 1000 + b"4 next")):
        f, out, held = Framer(mode, 10), [], 0
        for at in range(0, len(data), 7):
            out += f.push(data[at : at + 7])
            held = max(held, len(f.buffer))
        assert out == [(b"x" * 10, True), (b"next", False)] and held < 40
    f = Framer(limit=4)
    assert f.push(b"18446744073709551615 abcdefgh") == [] and f.finish() == [(b"abcd", True)]
    f = Framer(limit=4)
    assert f.push(b"abcd\r\nabcde\r\n") == [(b"abcd", False), (b"abcd", True)]
    f = Framer()
    whole = b"3 abc5 de\nfg" + b"2 hi"
    assert [x for i in range(len(whole)) for x in f.push(whole[i : i + 1])] == [(b"abc", False), (b"de\nfg", False), (b"hi", False)]


def test_framing(spark):
    assert Framer().push(b"first\nsecond\n") == [(b"first", False), (b"second", False)]
    assert Framer(limit=4).push(b"5 hello") == [(b"hell", True)]
    for data, why in ((b"5hello", "length"), (b"18446744073709551616 foo\n", "overflow")):
        f = Framer()
        assert f.push(data) == [] and f.dropped[why] == 1
    f = Framer()
    assert f.push(b"par") == [] and f.push(b"t\r\nx") == [(b"part", False)] and f.finish() == [(b"x", True)]
    df = spark.createDataFrame([(1, b"3 abc2 de"), (2, b"x\ny"), (3, None)], "chunk_id long, value binary")
    assert [(r.chunk_id, bytes(r.value), r.truncated) for r in frame_chunks(df).orderBy("chunk_id", "frame_no").collect()] == [(1, b"abc", False), (1, b"de", False), (2, b"x", False), (2, b"y", True)]


NDJSON = '{"message":"m","n":1,"f":1.5,"b":true,"z":null,"a":[1,2],"o":{"k":1}}'


def test_ndjson(spark):
    df = spark.createDataFrame([(NDJSON,), ("not json",), ("[1]",), (None,)], "value string")
    out = decode_ndjson(df, "n bigint, f double, b boolean, z string, a string, o string").collect()
    assert tuple(out[0])[:8] == ("m", 1, 1.5, True, None, "[1,2]", '{"k":1}', "stdin")
    assert [r.message for r in out] == ["m", "not json", "[1]", None]
    assert [r.message for r in decode_ndjson(df, "n bigint", on_error="drop").collect()] == ["m"]
    kinds = {f.name: f.dataType.simpleString() for f in infer_ndjson_schema(df.limit(1)).fields}
    assert kinds["n"] == "bigint" and kinds["f"] == "double" and kinds["a"] == "string" and kinds["o"] == "string"


def test_text_and_raw(spark):
    df = spark.createDataFrame([(b"ok",), (b"\xff",)], "value binary")
    a, b = decode_text(df).collect()
    assert (a.message, a.stdin_msg_utf8_valid, a.source) == ("ok", None, "stdin")
    assert b.stdin_msg_utf8_valid is False and b["_meta"].payload_truncated
    assert decode_text(df, allow_invalid_utf8=True, include_source=False).columns == ["message", "stdin_msg_utf8_valid", "_meta"]
    assert decode_raw(df).count() == 2


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo")
    lines = read_lines(spark, str(tmp_path))
    assert [r.value for r in lines.orderBy("line_no").collect()] == ["one", "", "two"]
    assert [r.value for r in aggregate_lines(lines, "stanza", stream="file").orderBy("line_no").collect()] == ["one", "two"]


def records(spark, lines, **options):
    df = spark.createDataFrame([("s", i, x, float(t)) for i, (x, t) in enumerate(lines)], "stream string, line_no long, value string, at double")
    return [(r.value, r.truncated) for r in aggregate_lines(df, at="at", **options).orderBy("line_no").collect()]


def test_multiline(spark):
    still = lambda *xs: [(x, 0) for x in xs]
    assert records(spark, still("START one", "middle", "START two"), mode="pattern", pattern="START") == [("START one\nmiddle", False), ("START two", False)]
    assert records(spark, still("INFO start", "middle", "WARN next"), mode="pattern", pattern="^(INFO|WARN)") == [("INFO start\nmiddle", False), ("WARN next", False)]
    assert records(spark, still("line one", "line two", "", "", "x"), mode="stanza") == [("line one\nline two", False), ("x", False)]
    assert records(spark, still("a", "b"), mode="disabled") == [("a", False), ("b", False)]
    assert records(spark, [("first", 0), ("near", 0.009), ("far", 0.1)], mode="pattern", pattern="^first", timeout_ms=10) == [("first\nnear", False), ("far", False)]
    assert records(spark, still("first", "abc"), mode="pattern", pattern="^first", max_bytes=7) == [("first\na", True)]
    assert java_pattern("^[[:digit:]]+") == r"(?m)^[\p{Digit}]+"


def test_peers(spark):
    df = spark.createDataFrame([("203.0.113.5:5514",), ("10.0.0.7:1",), ("bad",), (None,), ("10.0.0.300",), ("[::1]:9",)], "p string")
    assert [r.p for r in df.where(allowed("p", ["10.0.0.0/24"])).collect()] == ["10.0.0.7:1"]
    assert [r.p for r in df.where(allowed("p", ["10.0.0.7", "::1"])).collect()] == ["10.0.0.7:1", "[::1]:9"]
    assert df.where(allowed("p", [])).count() == 6
    assert host_of("[fe80::1]:5") == "fe80::1" and host_of("fe80::1") == "fe80::1"


def test_rates_and_queues(spark):
    bucket = TokenBucket(1, 1)
    assert [bucket.take(0), bucket.take(0), bucket.take(1)] == [True, False, True]
    df = spark.createDataFrame([("s", 0.0, 1), ("s", 0.0, 2), ("s", 1.0, 3), ("t", 0.0, 4)], "stream string, at double, line_no int")
    assert sorted(r.line_no for r in rate_limited(df, 1, 1, order="line_no").collect()) == [1, 3, 4]
    assert sorted(r.line_no for r in bounded(df, 2, "drop_oldest").collect()) == [3, 4]
    assert sorted(r.line_no for r in bounded(df, 1, "drop_newest", epoch="stream").collect()) == [1, 4]
    for when, left in (("drop_newest", [1, 2]), ("drop_oldest", [2, 3])):
        b = BoundedBuffer(2, when)
        for i in (1, 2, 3):
            b.push(i)
        assert b.drain() == left and b.dropped == 1
    b = BoundedBuffer(1)
    b.push(1)
    with pytest.raises(OverflowError):
        b.push(2)


def test_console(spark, capsys):
    df = spark.createDataFrame([(4, "hello")], "syslog_severity int, message string")
    assert write_console(df) == 1
    assert capsys.readouterr().out == '{"syslog_severity": 4, "message": "hello"}\n'
    odd = spark.createDataFrame([('\x00\x1b\x7f\n\t"\\', 1.5, None, True)], "m string, f double, n string, b boolean")
    assert console_lines(odd).first().line == '{"m": "\\u0000\\u001B\\u007F\\n\\t\\"\\\\", "f": 1.5e0, "n": null, "b": true}'
    assert [scientific(x) for x in (0.0, 100.0, 0.00123, -12.5, 1e300)] == ["0e0", "1e2", "1.23e-3", "-1.25e1", "1e300"]


def test_addresses():
    assert address_of("udp://127.0.0.1:5514") == ("127.0.0.1", 5514)
    for bad in ("udp://127.0.0.1:0", "udp://127.0.0.1"):
        with pytest.raises((ValueError, OSError)):
            address_of(bad)


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_udp_listener():
    port = free_port(socket.SOCK_DGRAM)
    listener = Listener({"address": f"udp://127.0.0.1:{port}", "transport": "udp", "message_size_limit": 8})
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"one", ("127.0.0.1", port))
        s.sendto(b"much too long", ("127.0.0.1", port))
    rows = listener.poll(1.0) + listener.poll(0.2)
    listener.close()
    assert [(r[0], r[2], r[3]) for r in rows] == [(b"one", "udp", False), (b"much too", "udp", True)]


def test_tcp_listener():
    port = free_port(socket.SOCK_STREAM)
    listener = Listener({"address": f"tcp://127.0.0.1:{port}", "transport": "tcp", "flush_partial_on_close": "true"})
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(b"one\ntw")
    rows = []
    for _ in range(5):
        rows += listener.poll(0.3)
    listener.close()
    assert [(r[0], r[3]) for r in rows] == [(b"one", False), (b"tw", True)]
