"""Configuration, graphs, streams, command line, supervision."""

import io
import json
import sys

import pytest
from pyspark.errors import AnalysisException

from emberlog.cli import main
from emberlog.plans.config import ConfigError, parse_config
from emberlog.plans.graph import Pipeline
from emberlog.streaming.metrics import Metrics
from emberlog.streaming.runner import finish, run_batch, start
from emberlog.streaming.stateful import stream_multiline
from emberlog.streaming.supervisor import RestartPolicy, permanent, supervise

BASIC = """
[sources.syslog_in]
type = "syslog"
address = "udp://127.0.0.1:5514"

[transforms.pick]
type = "sql"
inputs = ["syslog_in"]
query = "SELECT syslog_severity, message FROM logs WHERE syslog_severity < 5 AND message != ''"
parallelism = 2
queue_capacity = 16
queue_strategy = "drop_oldest"

[sinks.console]
type = "console"
inputs = ["pick"]
target = "stdout"
"""
LINES = ["<34>1 - h a - - - bad news", "<39>1 - h a - - - all fine", "no syslog"]


def test_config():
    config = parse_config(BASIC)
    assert [n.id for n in config.order()] == ["syslog_in", "pick", "console"]
    pick = config.of("transform")[0]
    assert (pick.parallelism, pick.queue_capacity, pick.queue_strategy) == (2, 16, "drop_oldest")
    stdin = parse_config(BASIC.replace('type = "syslog"\naddress = "udp://127.0.0.1:5514"', 'type = "stdin"\nmultiline.mode = "pattern"\nmultiline.start_pattern = "^x"')).of("source")[0].source
    assert stdin.multiline_mode == "pattern" and stdin.when_full == "drop_oldest" and stdin.queue_capacity == 1024


@pytest.mark.parametrize(
    ("old", "new", "kind"),
    [
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\ncolour = "x"', "UnknownField"),
        ('address = "udp://127.0.0.1:5514"', "", "MissingField"),
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\ntransport = "sctp"', "InvalidValue"),
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\nmessage_size_limit = 0', "InvalidValue"),
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\ntcp_low_watermark = 9999999', "InvalidValue"),
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\nrate_limit_burst = 2', "InvalidValue"),
        ('address = "udp://127.0.0.1:5514"', 'address = "a"\nallowed_peers = "x"', "InvalidType"),
        ('type = "syslog"', 'type = "kafka"', "UnsupportedSource"),
        ('type = "syslog"\naddress = "udp://127.0.0.1:5514"', 'type = "stdin"\nmultiline.mode = "pattern"', "MissingField"),
        ("parallelism = 2", "parallelism = 0", "InvalidParallelism"),
        ("queue_capacity = 16", "queue_capacity = 0", "InvalidQueueCapacity"),
        ('inputs = ["pick"]', 'inputs = ["other"]', "UnknownComponent"),
        ('inputs = ["pick"]', "inputs = []", "MissingInputs"),
        ('inputs = ["syslog_in"]', 'inputs = ["console"]', "InvalidEdge"),
        ('inputs = ["syslog_in"]', 'inputs = ["pick"]', "CycleDetected"),
        ('type = "console"', 'type = "kafka"', "UnsupportedSinkType"),
        ('target = "stdout"', 'target = "nowhere"', "InvalidValue"),
        ('type = "sql"', 'type = "lua"', "UnsupportedTransformType"),
        ("[sinks.console]", "[sinks]", "InvalidSyntax"),
    ],
)
def test_config_errors(old, new, kind):
    with pytest.raises(ConfigError) as e:
        parse_config(BASIC.replace(old, new))
    assert e.value.kind == kind


def test_no_sink():
    with pytest.raises(ConfigError) as e:
        parse_config(BASIC.partition("[sinks")[0])
    assert e.value.kind == "MissingSinks"


def test_batch_and_fan_out(spark):
    config = parse_config(BASIC + '\n[sinks.raw]\ntype = "null"\ninputs = ["syslog_in"]\n')
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    out = run_batch(spark, config, {"syslog_in": lines})
    assert [tuple(r) for r in out["console"].collect()] == [(2, "bad news")]
    assert out["raw"].columns[0] == "message" and out["raw"].count() == 2


def test_fan_in_is_a_bag_union(spark):
    text = BASIC.replace('inputs = ["pick"]', 'inputs = ["pick", "again"]') + '\n[transforms.again]\ntype = "sql"\ninputs = ["syslog_in"]\nquery = "SELECT message FROM logs"\n'
    out = run_batch(spark, parse_config(text), {"syslog_in": spark.createDataFrame([(x,) for x in LINES], "value string")})["console"]
    assert sorted((r.syslog_severity or 0, r.message) for r in out.collect()) == [(0, "all fine"), (0, "bad news"), (2, "bad news")]


def test_stream_once(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES) + "\n")
    metrics = Metrics()
    query = start(spark, parse_config(BASIC), str(tmp_path / "progress"), {"syslog_in": str(tmp_path / "in")}, once=True, metrics=metrics)
    query.awaitTermination(60)
    assert '{"syslog_severity": 2, "message": "bad news"}' in capsys.readouterr().out
    # what was read is not read again
    start(spark, parse_config(BASIC), str(tmp_path / "progress"), {"syslog_in": str(tmp_path / "in")}, once=True).awaitTermination(60)
    assert "bad news" not in capsys.readouterr().out


def test_stateful_multiline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, part in enumerate((["START one", "middle"], ["more", "START two", "end"])):
        spark.createDataFrame([("s", n * 10 + i, x) for i, x in enumerate(part)], "stream string, line_no long, value string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    lines = spark.readStream.schema("stream string, line_no long, value string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream_multiline(lines, "pattern", "START").writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.value for r in spark.table("records").collect()] == ["START one\nmiddle\nmore"]


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.toml", tmp_path / "bad.toml"
    good.write_text(BASIC)
    bad.write_text(BASIC.replace("SELECT syslog_severity,", "SELECT FROM"))
    assert main(["check", "--config", str(good)]) == 0
    assert "Configuration OK" in capsys.readouterr().out
    assert main(["check", "--config", str(bad)]) == 1
    assert main(["check", "--config", str(tmp_path / "none.toml")]) == 1
    with pytest.raises(SystemExit) as e:
        main(["stop"])
    assert e.value.code == 2


def test_restart_policy():
    policy = RestartPolicy(jitter=lambda: 1.0)
    assert [round(policy.delay(t), 3) for t in (0, 1, 2)] == [0.5, 0.9, 1.62]
    assert [policy.delay(3 + t) for t in range(5)][-1] == 60.0
    policy.succeeded()
    assert policy.delay(1000) == 0.5


def test_supervision():
    left = ["x", "x"]
    slept = []

    def run():
        if left:
            left.pop()
            raise OSError("gone")

    supervise(run, RestartPolicy(jitter=lambda: 1.0), clock=lambda: 0.0, sleep=slept.append)
    assert slept == [0.5, 0.9]
    with pytest.raises(ConfigError):
        supervise(lambda: (_ for _ in ()).throw(ConfigError("MissingField", "x")))
    assert permanent(ConfigError("x", "y")) and not permanent(OSError())


def test_pipeline_compiles_all_statements():
    assert list(Pipeline(parse_config(BASIC)).queries) == ["pick"]
    assert isinstance(sys.stdout, io.TextIOBase)


FILES = """
[sources.feed]
type = "stdin"
{settings}

[sinks.out]
type = "console"
inputs = ["feed"]
"""


def shown(spark, tmp_path, capsys, settings, *files, **options):
    """Messages that reach the console when files are run once."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for n, data in enumerate(files):
        (folder / f"{n}.log").write_bytes(data)
    capsys.readouterr()
    query = start(spark, parse_config(FILES.format(settings=settings)), str(tmp_path / "progress"), {"feed": str(folder)}, once=True, **options)
    finish(query)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_running_multiline(spark, tmp_path, capsys):
    pattern = 'multiline.mode = "pattern"\nmultiline.start_pattern = "^BEGIN"\nmultiline.max_bytes = 20'
    rows = shown(spark, tmp_path, capsys, pattern, b"BEGIN a\nmore\nBEGIN b\n", b"loose\nBEGIN c\n" + b"long line\n" * 50)
    assert [r["message"] for r in rows] == ["BEGIN a\nmore", "BEGIN b", "loose", "BEGIN c\nlong line\nlo"]
    (tmp_path / "s").mkdir()
    rows = shown(spark, tmp_path / "s", capsys, 'multiline.mode = "stanza"', b"one\ntwo\n\n\nthree\n")
    assert [r["message"] for r in rows] == ["one\ntwo", "three"]


def test_running_delimiters_and_sizes(spark, tmp_path, capsys):
    cases = {
        "": ["a", "b", "open"],
        'line_delimiter = "lf"': ["a\r", "b", "open"],
        'line_delimiter = "crlf"': ["a", "b\nopen"],
        "flush_partial_on_close = false": ["a", "b"],
        "message_size_limit = 2": ["a", "b", "op"],
    }
    for n, (settings, wanted) in enumerate(cases.items()):
        (tmp_path / str(n)).mkdir()
        assert [r["message"] for r in shown(spark, tmp_path / str(n), capsys, settings, b"a\r\nb\nopen")] == wanted


def test_running_rates_and_queues(spark, tmp_path, capsys):
    cases = {
        "rate_limit_per_sec = 1\nrate_limit_burst = 2": ["0", "1"],
        'queue_capacity = 2\nwhen_full = "drop_oldest"': ["3", "4"],
        'queue_capacity = 2\nwhen_full = "drop_newest"': ["0", "1"],
        "": ["0", "1", "2", "3", "4"],
    }
    for n, (settings, wanted) in enumerate(cases.items()):
        (tmp_path / str(n)).mkdir()
        assert sorted(r["message"] for r in shown(spark, tmp_path / str(n), capsys, settings, b"0\n1\n2\n3\n4\n")) == wanted


def test_fields_of_json_lines_stay_for_a_stream(spark, tmp_path, capsys):
    rows = shown(spark, tmp_path, capsys, 'codec = "ndjson"', b'{"message": "x", "n": 1}\n', b'{"message": "y", "deep": {"k": [1]}}\n')
    assert sorted(map(str, rows)) == sorted(map(str, [{"message": "x", "deep": None, "n": 1, "source": "stdin"}, {"message": "y", "deep": '{"k":[1]}', "n": None, "source": "stdin"}]))


def test_settings_that_cannot_act_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    config = parse_config(BASIC.replace('address = "udp', 'allowed_peers = ["10.0.0.0/8"]\naddress = "udp'))
    with pytest.raises(ConfigError):
        start(spark, config, str(tmp_path / "p"), {"syslog_in": str(tmp_path / "in")}, once=True)
    assert parse_config(BASIC).without_effect()[:2] == ["pick.parallelism", "pick.queue_capacity"]


def test_errors_of_batches_end_the_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\n")
    query = start(spark, parse_config(FILES.format(settings="")), str(tmp_path / "p"), {"feed": str(tmp_path / "in")}, once=True, on_batch=lambda: spark.table("no_such_table").count())
    with pytest.raises(AnalysisException) as e:
        finish(query)
    assert permanent(e.value) and permanent(e.value.__cause__) and not permanent(OSError("gone"))
