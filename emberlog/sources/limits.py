"""What keeps events out: peer lists, rates, and bounded queues."""

from __future__ import annotations

import ipaddress
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(peer: str | None) -> str | None:
    """The address of ``host``, ``host:port`` or ``[host]:port``."""
    if not peer:
        return None
    if peer.startswith("["):
        return peer[1:].partition("]")[0]
    return peer.rpartition(":")[0] if peer.count(":") == 1 else peer


def allowed(peer: str, networks: list[str]) -> Column:
    """Whether a peer address column lies in one of the networks; no networks allow all.

    IPv4 is arithmetic on columns; with an IPv6 network a Python function looks.  An
    address that cannot be read is not allowed.
    """
    if not networks:
        return F.lit(True)
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    if any(n.version == 6 for n in nets):

        @F.pandas_udf("boolean")
        def inside(peers: pd.Series) -> pd.Series:
            def one(p: str | None) -> bool:
                try:
                    ip = ipaddress.ip_address(host_of(p) or "")
                except ValueError:
                    return False
                return any(ip.version == n.version and ip in n for n in nets)

            return peers.map(one).astype(bool)

        return inside(F.col(peer))
    parts = [F.regexp_extract(F.col(peer), r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?::[0-9]+)?$", i).try_cast("bigint") for i in range(1, 5)]
    number = sum((p * (1 << 8 * (3 - i)) for i, p in enumerate(parts)), F.lit(0))
    valid = F.coalesce(F.greatest(*parts) <= 255, F.lit(False))
    found = F.lit(False)
    for n in nets:
        found = found | number.between(int(n.network_address), int(n.broadcast_address))
    return valid & F.coalesce(found, F.lit(False))


@dataclass
class TokenBucket:
    """``rate`` tokens a second, ``burst`` at most; starts full."""

    rate: float
    burst: float | None = None
    tokens: float = field(init=False)
    last: float | None = None

    def __post_init__(self):
        self.burst = float(self.burst if self.burst is not None else self.rate)
        self.tokens = self.burst

    def take(self, now: float) -> bool:
        if self.last is not None and now > self.last:
            self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now if self.last is None else max(self.last, now)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True

    def take_up_to(self, n: int, now: float) -> int:
        """How many of ``n`` events that come at once pass."""
        if n < 1 or not self.take(now):
            return 0
        more = int(min(n - 1, self.tokens))
        self.tokens -= more
        return 1 + more


def rate_limited(events: DataFrame, rate: float, burst: float | None = None, stream: str = "stream", at: str = "at", order: str | None = None) -> DataFrame:
    """The events that a bucket per stream lets pass, replayed in order of arrival.

    Streams are replayed side by side; one stream's events pass through one task as
    a sorted flow of batches, of which only the bucket is kept.
    """
    schema = events.schema
    keys = [stream, at, *([order] if order else [])]
    dealt = events.repartition(stream).sortWithinPartitions(*keys)

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket, begun = None, TokenBucket(rate, burst), False
        for frame in frames:
            keep = []
            for s, t in zip(frame[stream], pd.to_datetime(frame[at]).astype("int64") / 1e9 if frame[at].dtype.kind == "M" else frame[at]):
                if not begun or s != current:
                    current, bucket, begun = s, TokenBucket(rate, burst), True
                keep.append(bucket.take(float(t)))
            yield frame[keep]

    return dealt.mapInPandas(passed, schema)


def bounded(events: DataFrame, capacity: int, when_full: str = "drop_oldest", epoch: str | None = None, order: str = "line_no") -> DataFrame:
    """What a queue of so many holds of each epoch: the first (``reject``, ``drop_newest``) or the last."""
    if when_full not in ("reject", "drop_newest", "drop_oldest"):
        raise ValueError(f"when_full {when_full}")
    way = F.desc(order) if when_full == "drop_oldest" else F.asc(order)
    if epoch is None:
        return events.orderBy(way).limit(capacity)
    ranked = events.withColumn("__rank", F.row_number().over(Window.partitionBy(epoch).orderBy(way)))
    return ranked.where(F.col("__rank") <= capacity).drop("__rank")


class BoundedBuffer:
    """The queue inside a live reader."""

    def __init__(self, capacity: int, when_full: str = "reject"):
        self.capacity, self.when_full, self.items, self.dropped = capacity, when_full, deque(), 0

    def push(self, item) -> bool:
        if len(self.items) < self.capacity:
            self.items.append(item)
            return True
        self.dropped += 1
        if self.when_full == "drop_oldest":
            self.items.popleft()
            self.items.append(item)
            return True
        if self.when_full == "reject":
            raise OverflowError("queue is full")
        return False

    def drain(self, most: int | None = None) -> list:
        n = len(self.items) if most is None else min(most, len(self.items))
        return [self.items.popleft() for _ in range(n)]
