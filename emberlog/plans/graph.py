"""A pipeline's components as lazily built DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import BODY, META
from ..sources.limits import allowed
from ..sources.multiline import aggregate_lines
from ..sources.syslog import parse_syslog
from ..sources.text import decode_ndjson, decode_raw, decode_text, infer_ndjson_schema
from .config import ConfigError, Node, PipelineConfig, StdinSource, SyslogSource
from .query import Query, compile_sql


def decode(settings: SyslogSource | StdinSource, lines: DataFrame, source_id: str | None = None, json_schema=None) -> DataFrame:
    """Events of a source's lines ``value [, peer_address, protocol, truncated, stream, line_no]``."""
    if isinstance(settings, SyslogSource):
        if settings.allowed_peers:
            if "peer_address" not in lines.columns:
                raise ConfigError("InvalidValue", "allowed_peers needs lines with a peer_address, which files have not")
            lines = lines.where(allowed("peer_address", list(settings.allowed_peers)))
        return parse_syslog(lines, mode=settings.parser)
    received = "received_at" in lines.columns
    if settings.multiline_mode != "disabled":
        at = "at" if "at" in lines.columns else None
        lines = aggregate_lines(lines, settings.multiline_mode, settings.multiline_start_pattern, settings.multiline_max_bytes, settings.multiline_timeout_ms if at else 0, at=at)
        if received:
            lines = lines.withColumn("received_at", F.current_timestamp())
    if settings.codec == "raw":
        return decode_raw(lines, include_source=settings.include_source_field, source_id=source_id)
    if settings.codec == "ndjson":
        schema = json_schema or infer_ndjson_schema(lines)
        return decode_ndjson(lines, schema, on_error=settings.on_decode_error, message_key=settings.json_message_key, include_source=settings.include_source_field, source_id=source_id)
    return decode_text(lines, allow_invalid_utf8=settings.allow_invalid_utf8, include_source=settings.include_source_field, source_id=source_id)


class Pipeline:
    """Components compiled; ``outputs`` builds what reaches each sink from the sources' events."""

    def __init__(self, config: PipelineConfig):
        self.config = config
        self.queries: dict[str, Query] = {n.id: compile_sql(n.query) for n in config.of("transform")}

    def outputs(self, events: dict[str, DataFrame], observed: bool = False) -> dict[str, DataFrame]:
        """Rows of each sink.  Several inputs are a bag union; a missing column is null."""
        built: dict[str, DataFrame] = dict(events)
        for node in self.config.order():
            if node.role == "source":
                if node.id not in built:
                    raise KeyError(f"no events for source {node.id}")
                continue
            joined = union([built[i] for i in node.inputs])
            if node.role == "transform":
                built[node.id] = self._transform(node, joined, observed)
            else:
                built[node.id] = joined
        return {n.id: plain(built[n.id], self._kept_columns(n)) for n in self.config.of("sink")}

    def _transform(self, node: Node, events: DataFrame, observed: bool) -> DataFrame:
        # tasks follow from partitions: a node's parallelism asks for no shuffle
        return self.queries[node.id].apply(events, carry=True, count_errors=node.id if observed else None)

    def _kept_columns(self, sink: Node) -> bool:
        return any(n.role == "source" for n in self.config.nodes if n.id in sink.inputs)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def plain(df: DataFrame, from_source: bool = False) -> DataFrame:
    """Without what travels hidden.  Events straight from a source show as ``SELECT *`` would."""
    if from_source and "message" in df.columns:
        others = [c for c in df.columns if c not in (META, BODY, "message")]
        return df.select("message", *(F.col(f"`{c}`") for c in others))
    return df.drop(META, BODY)
