"""Syslog over UDP and TCP as a streaming data source, ``spark.readStream.format("syslog_socket")``.

One driver-side reader listens, as there is one address; each poll hands what has
arrived to executors as rows ``value, peer_address, protocol, truncated``.  A
datagram is a frame set of its own; a connection has a framer of its own.
"""

from __future__ import annotations

import selectors
import socket
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .framing import Framer
from .limits import BoundedBuffer, TokenBucket

SCHEMA = "value binary, peer_address string, protocol string, truncated boolean"


def address_of(text: str) -> tuple[str, int]:
    """Host and port of ``udp://host:port`` and the like; port 0 is no address."""
    rest = text.partition("://")[2] or text
    host, _, port = rest.rpartition(":")
    host = host.strip("[]")
    socket.getaddrinfo(host, None, flags=socket.AI_NUMERICHOST)
    if not port.isdigit() or not 0 < int(port) < 65536:
        raise ValueError(f"address {text}")
    return host, int(port)


class Listener:
    """A socket, its connections, and what they have sent."""

    def __init__(self, options: dict):
        self.transport = options.get("transport", "udp")
        self.limit = int(options.get("message_size_limit", 64 * 1024))
        self.read_bytes = int(options.get("read_buffer_bytes", 64 * 1024))
        self.connections_most = int(options.get("tcp_max_connections", 64))
        self.flush_partial = str(options.get("flush_partial_on_close", "false")).lower() == "true"
        rate = options.get("rate_limit_per_sec")
        self.bucket = TokenBucket(float(rate), float(options.get("rate_limit_burst", rate))) if rate else None
        self.queue = BoundedBuffer(int(options.get("max_batch_size", 256)), options.get("when_full", "drop_newest"))
        host, port = address_of(options["address"])
        kind = socket.SOCK_DGRAM if self.transport == "udp" else socket.SOCK_STREAM
        self.socket = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, kind)
        if kind == socket.SOCK_STREAM:
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.socket.setblocking(False)
        self.selector = selectors.DefaultSelector()
        if kind == socket.SOCK_STREAM:
            self.socket.listen()
        self.selector.register(self.socket, selectors.EVENT_READ)
        self.open: dict[socket.socket, tuple[str, Framer]] = {}
        keepalive = options.get("tcp_keepalive_seconds")
        self.keepalive = int(keepalive) if keepalive else None
        #: Bytes in the queue above which connections are not read, and below which they are again.
        self.high, self.low = int(options.get("tcp_high_watermark", 256 * 1024)), int(options.get("tcp_low_watermark", 128 * 1024))
        self.waiting, self.paused = 0, False

    def poll(self, seconds: float = 0.0) -> list[tuple]:
        """Rows of all that has arrived, up to what the queue holds."""
        until = time.monotonic() + seconds
        while True:
            ready = self.selector.select(max(0.0, until - time.monotonic()) if not self.queue.items else 0)
            for key, _ in ready:
                self._datagrams() if self.transport == "udp" else self._accept() if key.fileobj is self.socket else self._receive(key.fileobj)
            if not ready or self.paused or len(self.queue.items) >= self.queue.capacity:
                return self.drain()

    def drain(self, most: int | None = None) -> list[tuple]:
        rows = self.queue.drain(most)
        self.waiting -= sum(len(r[0]) for r in rows)
        if self.paused and self.waiting <= self.low:
            self.paused = False
            for connection in self.open:
                self.selector.register(connection, selectors.EVENT_READ)
        return rows

    def _keep(self, frames, peer: str) -> None:
        if frames and (self.bucket is None or self.bucket.take(time.monotonic())):
            for data, cut in frames:
                before = sum(len(r[0]) for r in self.queue.items) if len(self.queue.items) >= self.queue.capacity else None
                try:
                    kept = self.queue.push((data, peer, self.transport, cut))
                except OverflowError:
                    continue  # counted by the queue
                if before is not None:  # the oldest went
                    self.waiting = sum(len(r[0]) for r in self.queue.items)
                elif kept:
                    self.waiting += len(data)
        if self.transport == "tcp" and not self.paused and self.waiting >= self.high:
            self.paused = True
            for connection in self.open:
                self.selector.unregister(connection)

    def _datagrams(self) -> None:
        try:
            data, peer = self.socket.recvfrom(self.limit + 1)
        except BlockingIOError:
            return
        framer = Framer("auto", self.limit)
        frames = framer.push(data)
        rest = framer.finish()
        self._keep([*frames, *((d, len(data) > self.limit) for d, _ in rest)], f"{peer[0]}:{peer[1]}")

    def _accept(self) -> None:
        connection, peer = self.socket.accept()
        if len(self.open) >= self.connections_most:
            connection.close()
            return
        connection.setblocking(False)
        if self.keepalive:
            connection.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            connection.setsockopt(socket.IPPROTO_TCP, socket.TCP_KEEPIDLE, self.keepalive)
        self.open[connection] = (f"{peer[0]}:{peer[1]}", Framer("auto", self.limit))
        if not self.paused:
            self.selector.register(connection, selectors.EVENT_READ)

    def _receive(self, connection: socket.socket) -> None:
        peer, framer = self.open[connection]
        try:
            data = connection.recv(self.read_bytes)
        except BlockingIOError:
            return
        except OSError:
            data = b""
        if data:
            self._keep(framer.push(data), peer)
            return
        if self.flush_partial:
            self._keep(framer.finish(), peer)
        if not self.paused:
            self.selector.unregister(connection)
        connection.close()
        del self.open[connection]

    def close(self) -> None:
        for connection in self.open:
            connection.close()
        self.socket.close()


class SyslogSocketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.listener = dict(options), None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self.listener is None:
            self.listener = Listener(self.options)
        rows = self.listener.poll(0.05)
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(())  # datagrams cannot be asked for again

    def commit(self, end: dict) -> None:
        pass


class SyslogSocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "syslog_socket"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        return SyslogSocketReader(self.options)
