"""Frames in byte chunks: lines, counted octets, or whichever the first frame is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

DIGITS_AT_MOST = 20


@dataclass
class Framer:
    """Cuts a stream of bytes; ``mode`` auto settles with the first frame.

    Of a frame above the limit only its head is held while the rest goes by, so
    that a sender that never ends a frame takes no more memory than the limit.
    """

    mode: str = "auto"
    limit: int = 64 * 1024
    buffer: bytearray = field(default_factory=bytearray)
    dropped: dict[str, int] = field(default_factory=lambda: {"length": 0, "overflow": 0})
    head: bytes | None = None  # of the frame whose rest is going by
    skip: int | None = None  # octets of it that are still to come; None: up to a newline
    seen: int = 0  # bytes known to hold no newline

    def push(self, data: bytes) -> list[tuple[bytes, bool]]:
        """Complete frames, and whether each was cut at the limit."""
        self.buffer += data
        out: list[tuple[bytes, bool]] = []
        at = 0
        while (step := self._next(at, out)) is not None:
            at = step
        del self.buffer[: min(self.done, len(self.buffer))]
        return out

    def finish(self) -> list[tuple[bytes, bool]]:
        """What is left without an end, as one cut frame."""
        rest = self.head if self.head is not None else bytes(self.buffer).rstrip(b"\r")
        self.buffer, self.head, self.skip, self.seen = bytearray(), None, None, 0
        return [(rest[: self.limit], True)] if rest else []

    def _next(self, at: int, out: list) -> int | None:
        """Where the next frame begins, or None where more bytes are needed; ``done`` is what is used up."""
        self.done = at
        n = len(self.buffer)
        if self.head is not None:
            return self._passed(at, out)
        if at >= n:
            return None
        if self.mode == "octet" or (self.mode == "auto" and 48 <= self.buffer[at] <= 57):
            return self._counted(at, out)
        end = self.buffer.find(b"\n", at + self.seen)
        if end < 0:
            if n - at > self.limit + 1:
                self.head, self.skip, self.done = bytes(self.buffer[at : at + self.limit]), None, n
                self.mode = "lf" if self.mode == "auto" else self.mode
            self.seen = 0 if self.head is not None else n - at
            return None
        self.seen = 0
        self.mode = "lf" if self.mode == "auto" else self.mode
        line = bytes(self.buffer[at:end]).removesuffix(b"\r")
        out.append((line[: self.limit], len(line) > self.limit))
        return end + 1

    def _passed(self, at: int, out: list) -> int | None:
        """Let the rest of a frame go by whose head is held."""
        if self.skip is None:
            end = self.buffer.find(b"\n", at) + 1
        else:
            end = at + self.skip if len(self.buffer) - at >= self.skip else 0
        if not end:
            self.done = len(self.buffer)
            if self.skip is not None:
                self.skip -= len(self.buffer) - at
            return None
        out.append((self.head, True))
        self.head = self.skip = None
        return end

    def _counted(self, at: int, out: list) -> int | None:
        n = at
        while n < len(self.buffer) and n - at <= DIGITS_AT_MOST and 48 <= self.buffer[n] <= 57:
            n += 1
        if n == len(self.buffer) and n - at <= DIGITS_AT_MOST:
            return None
        if n == at or self.buffer[n] != 32:
            return self._dropped(at, "length")
        size = int(self.buffer[at:n])
        if size >= 1 << 64:
            return self._dropped(at, "overflow")
        self.mode = "octet"
        begin, have = n + 1, len(self.buffer) - n - 1
        if have >= size:
            out.append((bytes(self.buffer[begin : begin + min(size, self.limit)]), size > self.limit))
            return begin + size
        if size > self.limit and have >= self.limit:
            self.head, self.skip, self.done = bytes(self.buffer[begin : begin + self.limit]), size - have, len(self.buffer)
        return None

    def _dropped(self, at: int, why: str) -> int | None:
        """A count that cannot be: the line goes, up to its newline."""
        self.dropped[why] += 1
        end = self.buffer.find(b"\n", at)
        if end < 0:
            self.done = len(self.buffer)
            return None
        return end + 1


def frame_chunks(chunks: DataFrame, mode: str = "auto", limit: int = 64 * 1024) -> DataFrame:
    """``chunk_id, frame_no, value, truncated`` of ``chunks(chunk_id, value binary)``, each chunk on its own."""

    def framed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, value in zip(frame["chunk_id"], frame["value"]):
                f = Framer(mode, limit)
                for n, (data, cut) in enumerate([*f.push(bytes(value or b"")), *f.finish()]):
                    rows.append((chunk, n, data, cut))
            yield pd.DataFrame(rows, columns=["chunk_id", "frame_no", "value", "truncated"])

    return chunks.select("chunk_id", "value").mapInPandas(framed, "chunk_id long, frame_no long, value binary, truncated boolean")
