"""Counters of running pipelines, fed by observations and query progress."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener


class Metrics:
    """Named numbers; counters add up, gauges are set."""

    def __init__(self):
        self.values: dict[str, float] = defaultdict(float)

    def add(self, name: str, n: float = 1) -> None:
        self.values[name] += n

    def set(self, name: str, n: float) -> None:
        self.values[name] = n

    def __getitem__(self, name: str) -> float:
        return self.values.get(name, 0)


class ProgressListener(StreamingQueryListener):
    """Micro-batches as acknowledgements: a batch that ended is committed."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("collector_streams_started_total")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.add("pipeline_ack_success_total")
        self.metrics.add("pipeline_ack_latency_ns_total", p.batchDuration * 1e6)
        self.metrics.add("pipeline_ack_latency_events_total", p.numInputRows)
        for node, row in p.observedMetrics.items():
            self.metrics.add(f"pipeline_events_total_{node}", row["events"])
            self.metrics.add(f"pipeline_errors_total_{node}", row["errors"])

    def onQueryIdle(self, event) -> None:
        self.metrics.add("collector_idle_total")

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("pipeline_ack_retryable_total" if event.exception else "collector_streams_finished_total")
