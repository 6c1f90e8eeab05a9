"""Pipelines over Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import ConfigError, Node, PipelineConfig, StdinSource, SyslogSource
from ..plans.graph import Pipeline, decode
from ..sinks.console import SINKS
from ..sources.limits import TokenBucket, bounded
from ..sources.sockets import SyslogSocketSource
from ..sources.text import infer_ndjson_schema
from .metrics import Metrics, ProgressListener


def live_lines(spark: SparkSession, node: Node, path: str | None = None) -> DataFrame:
    """Lines of a source as a stream: of files under ``path``, else of its socket."""
    if path:
        crlf = getattr(node.source, "line_delimiter", "auto") == "crlf"
        place = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_block_start")]
        return spark.readStream.option("lineSep", "\r\n" if crlf else "\n").text(path).select("value", *place)
    if not isinstance(node.source, SyslogSource):
        raise ConfigError("InvalidValue", f"source {node.id} needs a path: executors have no standard input")
    spark.dataSource.register(SyslogSocketSource)
    options = {k: str(v) for k, v in asdict(node.source).items() if v is not None and k != "allowed_peers"}
    return spark.readStream.format("syslog_socket").options(**options).load()


class FileLines:
    """The lines of a micro-batch of files, under the settings of their source.

    Each file is a stream that ends with it: what is open then is flushed.  All
    lines of a micro-batch arrive together.
    """

    def __init__(self, settings: SyslogSource | StdinSource, clock=time.monotonic):
        self.settings, self.clock = settings, clock
        rate = settings.rate_limit_per_sec
        self.bucket = TokenBucket(float(rate), float(settings.rate_limit_burst or rate)) if rate else None

    def of(self, batch: DataFrame) -> DataFrame:
        """``stream, line_no, value, truncated [, received_at]`` that the settings let pass."""
        s = self.settings
        delimiter = getattr(s, "line_delimiter", "auto")
        width = 2 if delimiter == "crlf" else 1
        at = F.struct(F.col("file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
        lines = batch.select(F.col("file_path").alias("stream"), "file_size", at.alias("line_no"), "value")
        # a file whose lines and their ends are longer than itself has no end at its last line
        files = lines.groupBy("stream").agg((F.sum(F.octet_length("value") + width) > F.max("file_size")).alias("open"), F.max("line_no").alias("last"))
        last = files.where("open").select(F.col("stream").alias("__stream"), "last")
        lines = lines.join(last, (F.col("stream") == F.col("__stream")) & (F.col("line_no") == F.col("last")), "left")
        partial = F.col("last").isNotNull()
        if not s.flush_partial_on_close:
            lines = lines.where(~partial)
        value = F.regexp_replace("value", "\r$", "") if delimiter == "auto" else F.col("value")
        cut = F.substr(value.cast("binary"), F.lit(1), F.lit(s.message_size_limit)).cast("string")
        long = F.octet_length(value) > s.message_size_limit
        lines = lines.select("stream", "line_no", F.when(long, cut).otherwise(value).alias("value"), (long | partial).alias("truncated"))
        if "queue_capacity" in getattr(s, "given", ()):
            lines = bounded(lines.withColumn("__order", F.struct("stream", "line_no")), s.queue_capacity, s.when_full, order="__order").drop("__order")
        if self.bucket is not None:
            lines = lines.orderBy("stream", "line_no").limit(self.bucket.take_up_to(lines.count(), self.clock()))
        if getattr(s, "set_received_at", True):
            lines = lines.withColumn("received_at", F.current_timestamp())
        return lines


def start(
    spark: SparkSession,
    config: PipelineConfig,
    checkpoint: str,
    paths: dict[str, str] | None = None,
    once: bool = False,
    max_batches: int | None = None,
    json_schema=None,
    metrics: Metrics | None = None,
    on_batch: Callable[[], None] = lambda: None,
) -> StreamingQuery:
    """Start the pipeline: each micro-batch goes through all components to all sinks.

    A micro-batch is cached once if several sinks read it, and is committed when all
    have it.  ``once`` takes what is there and ends; ``max_batches`` ends after so many.
    The fields of JSON lines are ``json_schema``, or those of the files that are there
    at the start; they stay for the stream's life.  ``on_batch`` is called after each
    batch; ``failures`` of the query holds what made a batch fail.
    """
    pipeline = Pipeline(config)
    sources = config.of("source")
    if len(sources) != 1:
        raise ConfigError("InvalidValue", "a running pipeline reads one source")
    node = sources[0]
    path = (paths or {}).get(node.id)
    lines = live_lines(spark, node, path)
    if path and getattr(node.source, "allowed_peers", ()):
        raise ConfigError("InvalidValue", f"{node.id}: allowed_peers needs lines with a peer_address, which files have not")
    files = FileLines(node.source) if path else None
    if path and json_schema is None and getattr(node.source, "codec", "") == "ndjson":
        json_schema = infer_ndjson_schema(spark.read.text(path))
    if metrics is not None:
        spark.streams.addListener(ProgressListener(metrics))
    done, failures = {"batches": 0}, []

    def batch(df: DataFrame, _: int) -> None:
        try:
            events = decode(node.source, files.of(df) if files else df, node.id, json_schema)
            shared = len(config.of("sink")) > 1
            if shared:
                events = events.persist()
            try:
                for sink_id, rows in pipeline.outputs({node.id: events}, observed=False).items():
                    sink = next(n for n in config.of("sink") if n.id == sink_id)
                    n = SINKS[sink.type](rows, sink.target)
                    if metrics is not None:
                        metrics.add(f"sinks_events_total_{sink_id}", n or 0)
            finally:
                if shared:
                    events.unpersist()
            done["batches"] += 1
            if metrics is not None:
                metrics.add(f"sources_batches_total_{node.id}")
            on_batch()
        except Exception as e:
            failures.append(e)
            if metrics is not None:
                metrics.add("sources_batch_errors_total")
            raise

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()
    query.batches_done = lambda: done["batches"]
    query.failures = failures
    if max_batches and not once:
        while query.isActive and done["batches"] < max_batches:
            query.awaitTermination(0.2)
        query.stop()
    return query


def finish(query: StreamingQuery) -> None:
    """Wait for the stream's end; what made a batch fail is raised as itself."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if query.failures:
            raise query.failures[-1] from e
        raise


def run_batch(spark: SparkSession, config: PipelineConfig, lines: dict[str, DataFrame], json_schema=None) -> dict[str, DataFrame]:
    """Rows of each sink over finite lines of each source."""
    events = {n.id: decode(n.source, lines[n.id], n.id if n.type == "stdin" else None, json_schema) for n in config.of("source")}
    return Pipeline(config).outputs(events)
