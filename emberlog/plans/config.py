"""Pipelines from TOML: sources, SQL transforms, sinks."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..sinks.console import SINKS

MOST_BYTES = 4 << 20


class ConfigError(ValueError):
    """``kind`` says what is wrong: MissingField, InvalidValue, UnknownField and so on."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class SyslogSource:
    address: str
    transport: str = "udp"
    parser: str = "auto"
    max_batch_size: int = 256
    read_buffer_bytes: int = 64 * 1024
    tcp_max_connections: int = 64
    tcp_keepalive_seconds: int | None = None
    message_size_limit: int = 64 * 1024
    tcp_high_watermark: int = 256 * 1024
    tcp_low_watermark: int = 128 * 1024
    allowed_peers: tuple[str, ...] = ()
    rate_limit_per_sec: int | None = None
    rate_limit_burst: int | None = None
    flush_partial_on_close: bool = False

    CHOICES = {"transport": ("udp", "tcp"), "parser": ("auto", "rfc3164", "rfc5424")}
    MAY_BE_ZERO = ()

    def validate(self) -> None:
        if self.tcp_low_watermark > self.tcp_high_watermark:
            raise ConfigError("InvalidValue", "tcp_low_watermark above tcp_high_watermark")


@dataclass(frozen=True)
class StdinSource:
    codec: str = "text"
    line_delimiter: str = "auto"
    message_size_limit: int = 64 * 1024
    read_buffer_bytes: int = 64 * 1024
    multiline_mode: str = "disabled"
    multiline_start_pattern: str | None = None
    multiline_timeout_ms: int = 1000
    multiline_max_bytes: int = 256 * 1024
    max_batch_size: int = 256
    queue_capacity: int = 1024
    when_full: str = "drop_oldest"
    rate_limit_per_sec: int | None = None
    rate_limit_burst: int | None = None
    flush_partial_on_close: bool = True
    set_received_at: bool = True
    include_source_field: bool = True
    allow_invalid_utf8: bool = False
    on_decode_error: str = "as_text"
    json_message_key: str = "message"
    given: tuple[str, ...] = ()  # names of the settings that the configuration holds

    CHOICES = {
        "codec": ("text", "ndjson", "raw"),
        "line_delimiter": ("auto", "lf", "crlf"),
        "multiline_mode": ("disabled", "pattern", "stanza"),
        "when_full": ("reject", "drop_newest", "drop_oldest"),
        "on_decode_error": ("as_text", "drop"),
    }
    MAY_BE_ZERO = ("multiline_timeout_ms", "rate_limit_per_sec", "rate_limit_burst")

    def validate(self) -> None:
        if self.multiline_mode == "pattern" and not self.multiline_start_pattern:
            raise ConfigError("MissingField", "multiline.start_pattern")


SOURCES = {"syslog": SyslogSource, "stdin": StdinSource}


@dataclass(frozen=True)
class Node:
    """A component: its kind, its settings, and what it reads."""

    id: str
    role: str  # source, transform, sink
    type: str
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    source: SyslogSource | StdinSource | None = None
    query: str | None = None
    target: str = "stdout"
    parallelism: int = 1
    queue_capacity: int = 1024
    queue_strategy: str = "reject"


@dataclass(frozen=True)
class PipelineConfig:
    nodes: tuple[Node, ...] = field(default_factory=tuple)

    def of(self, role: str) -> list[Node]:
        return [n for n in self.nodes if n.role == role]

    def validate(self) -> PipelineConfig:
        """Raise unless the components fit together: some sink, known inputs, no loop."""
        if not self.of("sink"):
            raise ConfigError("MissingSinks", "no sink")
        by_id: dict[str, Node] = {}
        for n in self.nodes:
            if n.id in by_id:
                raise ConfigError("DuplicateComponent", n.id)
            by_id[n.id] = n
        for n in self.nodes:
            for other in (*n.inputs, *n.outputs):
                if other not in by_id:
                    raise ConfigError("UnknownComponent", other)
            if n.role != "source" and not n.inputs:
                raise ConfigError("MissingInputs", n.id)
            if any(by_id[i].role == "sink" for i in n.inputs) or any(by_id[o].role == "source" for o in n.outputs):
                raise ConfigError("InvalidEdge", n.id)
            if n.parallelism < 1:
                raise ConfigError("InvalidParallelism", n.id)
            if n.queue_capacity < 1:
                raise ConfigError("InvalidQueueCapacity", n.id)
        self.order()
        return self

    def without_effect(self) -> list[str]:
        """Settings that are read and checked, but for which Spark has its own ways: tasks, pulls and chunks."""
        out = [f"{n.id}.{k}" for n in self.nodes if n.role != "source" for k, d in (("parallelism", 1), ("queue_capacity", 1024), ("queue_strategy", "reject")) if getattr(n, k) != d]
        return out + [f"{n.id}.{k}" for n in self.of("source") for k in getattr(n.source, "given", ()) if k in ("read_buffer_bytes", "max_batch_size")]

    def order(self) -> list[Node]:
        """Components so that each comes after what it reads."""
        from graphlib import CycleError, TopologicalSorter

        try:
            ids = list(TopologicalSorter({n.id: n.inputs for n in self.nodes}).static_order())
        except CycleError as e:
            raise ConfigError("CycleDetected", str(e.args[1])) from e
        by_id = {n.id: n for n in self.nodes}
        return [by_id[i] for i in ids]


def _flat(table: dict, prefix: str = "") -> dict:
    """Dotted keys with an underscore: ``multiline.mode`` is ``multiline_mode``."""
    out = {}
    for key, value in table.items():
        if isinstance(value, dict):
            out |= _flat(value, f"{prefix}{key}_")
        else:
            out[prefix + key] = value
    return out


def source_settings(table: dict) -> tuple[str, SyslogSource | StdinSource]:
    """Type and settings of a source's table."""
    given = _flat(table)
    kind = given.pop("type", None)
    if kind is None:
        raise ConfigError("MissingField", "type")
    if kind not in SOURCES:
        raise ConfigError("UnsupportedSource", str(kind))
    cls = SOURCES[kind]
    known = {f.name: f for f in fields(cls)}
    named = tuple(given)
    for key, value in given.items():
        if key not in known or key == "given":
            raise ConfigError("UnknownField", key)
        wanted = known[key].type
        if "tuple" in wanted:
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ConfigError("InvalidType", key)
            given[key] = tuple(value)
        elif wanted == "bool" or "str" in wanted:
            if not isinstance(value, bool if wanted == "bool" else str):
                raise ConfigError("InvalidType", key)
        elif not isinstance(value, int) or isinstance(value, bool):
            raise ConfigError("InvalidType", key)
        elif value < 0 or (value == 0 and key not in cls.MAY_BE_ZERO):
            raise ConfigError("InvalidValue", key)
        elif value == 0 and key.startswith("rate_limit"):
            given[key] = None
        if key in cls.CHOICES and value not in cls.CHOICES[key]:
            raise ConfigError("InvalidValue", f"{key} = {value}")
    if cls is SyslogSource and "address" not in given:
        raise ConfigError("MissingField", "address")
    out = cls(**given, **({"given": named} if "given" in known else {}))
    if out.rate_limit_burst is not None and out.rate_limit_per_sec is None:
        raise ConfigError("InvalidValue", "rate_limit_burst without rate_limit_per_sec")
    out.validate()
    return kind, out


# fixed values: keys of transforms and sinks
KEYS = {
    "transforms": ("type", "inputs", "outputs", "query", "parallelism", "queue_capacity", "queue_strategy"),
    "sinks": ("type", "inputs", "target", "parallelism", "queue_capacity", "queue_strategy"),
}


def _node(role: str, name: str, table: dict) -> Node:
    for key in table:
        if key not in KEYS[f"{role}s"]:
            raise ConfigError("UnknownField", f"{name}.{key}")
    kind = table.get("type")
    if kind is None:
        raise ConfigError("MissingField", f"{name}.type")
    if role == "transform" and kind != "sql":
        raise ConfigError("UnsupportedTransformType", str(kind))
    if role == "transform" and not isinstance(table.get("query"), str):
        raise ConfigError("MissingField", f"{name}.query")
    if role == "sink" and kind not in SINKS:
        raise ConfigError("UnsupportedSinkType", str(kind))
    if table.get("target", "stdout") not in ("stdout", "stderr"):
        raise ConfigError("InvalidValue", f"{name}.target")
    if table.get("queue_strategy", "reject") not in ("reject", "drop_newest", "drop_oldest"):
        raise ConfigError("InvalidValue", f"{name}.queue_strategy")
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in table.items()}
    return Node(name, role, **given)


def parse_config(text: str) -> PipelineConfig:
    """The pipeline of a TOML text, validated."""
    if len(text.encode()) > MOST_BYTES:
        raise ConfigError("FileTooLarge", f"over {MOST_BYTES} bytes")
    try:
        tables = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError("InvalidSyntax", str(e)) from e
    nodes = []
    for section, components in tables.items():
        if section not in ("sources", "transforms", "sinks") or not isinstance(components, dict):
            raise ConfigError("UnknownSection", section)
        for name, table in components.items():
            if not isinstance(table, dict):
                raise ConfigError("InvalidSyntax", f"{section}.{name}")
            if section == "sources":
                table = dict(table)
                outputs = tuple(table.pop("outputs", ()))
                kind, settings = source_settings(table)
                nodes.append(Node(name, "source", kind, outputs=outputs, source=settings))
            else:
                nodes.append(_node(section[:-1], name, table))
    return PipelineConfig(tuple(nodes)).validate()


def load_config(path: str) -> PipelineConfig:
    return parse_config(Path(path).read_text(encoding="utf-8"))
