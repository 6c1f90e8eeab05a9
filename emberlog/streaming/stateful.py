"""Multi-line records over streams: state per stream, timers for pauses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..sources.multiline import CLASSES

OUT = "stream string, value string, truncated boolean"


class MultilineProcessor(StatefulProcessor):
    """Keeps the open record of each stream; a first line, a blank line or a pause ends it."""

    def __init__(self, mode: str, pattern: str | None, timeout_ms: int, max_bytes: int):
        python = re.sub(r"\[:(\w+):\]", lambda m: {"digit": "0-9", "alpha": "A-Za-z", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "blank": " \t", "xdigit": "0-9A-Fa-f"}[m[1]], pattern or "")
        assert set(re.findall(r"\[:(\w+):\]", pattern or "")) <= set(CLASSES)
        self.mode, self.pattern, self.timeout_ms, self.max_bytes = mode, re.compile(python, re.M), timeout_ms, max_bytes

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "text string")

    def _record(self, key, text: str) -> tuple:
        raw = text.encode()
        return key[0], raw[: self.max_bytes].decode("utf-8", "ignore"), len(raw) > self.max_bytes

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("line_no")
        text = self.open.get()[0] if self.open.exists() else None
        out = []
        for line in found["value"]:
            line = line or ""
            if self.mode == "stanza" and line == "":
                if text is not None:
                    out.append(self._record(key, text))
                text = None
                continue
            if text is not None and self.mode == "pattern" and self.pattern.search(line):
                out.append(self._record(key, text))
                text = None
            text = line if text is None else f"{text}\n{line}"
        if text is None:
            self.open.clear()
        else:
            self.open.update((text,))
            if self.timeout_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(out, columns=["stream", "value", "truncated"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self._record(key, self.open.get()[0])] if self.open.exists() else []
        self.open.clear()
        yield pd.DataFrame(out, columns=["stream", "value", "truncated"])

    def close(self) -> None:
        pass


def stream_multiline(lines: DataFrame, mode: str, pattern: str | None = None, timeout_ms: int = 0, max_bytes: int = 256 * 1024) -> DataFrame:
    """Records of a stream ``stream, line_no, value``; the open one of each stream is state."""
    processor = MultilineProcessor(mode, pattern, timeout_ms, max_bytes)
    return lines.groupBy("stream").transformWithStateInPandas(processor, OUT, "append", "processingTime")
