"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints are cut into four blocks of 16 bits.  Two that differ in at most two
bits agree in two blocks at least, so each pair meets in one of the six shards
keyed by two blocks.  In each shard a BK-tree is grown: a child hangs on its
parent by their Hamming distance, and a search follows only those edges whose
distance lies within the radius of its own.  A shard gives each fingerprint's
least linked neighbour class (a spanning forest), never all pairs.

A shard with very many fingerprints is cut again by two of the four remaining
bytes, which again loses no pair: what then shares a shard differs in 16 bits at
most, so no tree ever holds more than 65,536 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

RADIUS = 2
#: A shard of more fingerprints than this is cut again.
SHARD_ROWS = 512
#: So many links or fewer are connected by one task; more by steps over tables.
LINKS_AT_ONCE = 200_000


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle (repeats included) of the text, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[:n].tolist(), ends[-n:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536])
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash fingerprint of a text as a long of the same 64 bits."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint_of(shingle_hashes(t, words)) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return hashed(text)


class BKTree:
    """Fingerprints by Hamming distance to their parents."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            own, children = open_.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                low, high = d - radius, d + radius
                open_ += [child for edge, child in children.items() if low <= edge <= high]
        return found


def spanning_links(prints: list[int], nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """(node, least node of its class) for the classes that links within the radius make."""
    mask = (1 << 64) - 1
    tree, parent, node_of = BKTree(), {}, {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value, node in zip(prints, nodes):
        value &= mask
        if value in node_of:
            continue
        node_of[value] = node
        parent.setdefault(node, node)
        for other in tree.within(value, radius):
            a, b = find(node), find(node_of[other])
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(x, root) for x in parent if (root := find(x)) != x]


def _searched(shards: DataFrame, radius: int) -> DataFrame:
    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links = []
            for members in frame["members"]:
                links += spanning_links([m["fp"] for m in members], [m["node"] for m in members], radius)
            yield pd.DataFrame(links, columns=["node", "other"]).astype("int64")

    return shards.mapInPandas(searched, "node long, other long")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``node, other`` that connect what lies within the radius in ``prints(fp, node)``.

    Each shard gives a spanning forest of its links, so as many rows as it has
    fingerprints at most, however many pairs there are; components are the same.
    """
    if radius > 2:
        raise ValueError("four blocks find differences of up to two bits")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i, j in combinations(range(4), 2)]
    keys = F.array(*(F.struct(F.lit(n).alias("shard"), F.xxhash64(F.lit(n), block[i], block[j]).alias("bucket")) for n, (i, j) in enumerate(pairs)))
    dealt = prints.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.shard", "k.bucket")
    counts = materialize(dealt.groupBy("bucket").count().where("count > 1"), "buckets")
    shared = materialize(dealt.join(counts, "bucket"), "sharded")

    def rest(n: int) -> Column:
        """The keys by two of the four bytes outside the shard's two blocks."""
        free = [b for b in range(4) if b not in pairs[n]]
        byte = [F.shiftrightunsigned("fp", 16 * b + 8 * half).bitwiseAND(0xFF) for b in free for half in (0, 1)]
        return F.array(*(F.xxhash64("bucket", F.lit(m), byte[i], byte[j]) for m, (i, j) in enumerate(combinations(range(4), 2))))

    cut = F.coalesce(*(F.when(F.col("shard") == n, rest(n)) for n in range(len(pairs))))
    final = F.when(F.col("count") <= shard_rows, F.array(F.xxhash64("bucket", F.lit(-1)))).otherwise(cut)
    shards = shared.select("fp", "node", F.explode(final).alias("key")).groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("members"))
    return _searched(shards.where(F.size("members") > 1).select("members"), radius)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    ``fp`` is the SimHash over shingles of ``words`` words, ``component_id`` the
    smallest doc_id reachable over links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint zero, linked like any other; a text of
    fewer words is one shingle; texts of any length are hashed whole.  Rows that
    repeat a doc_id are one document: what either links to is connected.  A row
    without a doc_id links by its fingerprint like any other, is never the
    smallest, and has a null component if all in it are without.
    Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    prints = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), words).alias("fp"))
    prints = materialize(prints, "prints")
    # a fingerprint is its own node; ids come in when components are known
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "firsts")
    # rows that repeat a doc_id connect their fingerprints through it
    owned = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("other"), F.max("fp").alias("most"))
    again = prints.join(owned.where("other != most"), "doc_id").select(F.col("fp").alias("node"), "other")
    roots = components(fingerprint_links(firsts.select("fp", F.col("fp").alias("node"))).union(again), LINKS_AT_ONCE)
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_print = materialize(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
