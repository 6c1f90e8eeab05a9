"""Near-duplicates of a given shingle similarity: wide SimHash fingerprints, then an exact filter.

Fingerprints have 256 bits, and shards are keyed by sets of bits drawn at random, of
as many bits as keep a shard small.  In each shard a BK-tree holds the
representatives found so far; a fingerprint within the radius of one links to the
nearest, any other becomes a representative.  A shard of very many is dealt to
several trees, whose representatives meet in one tree more.  Links are then verified
by the Jaccard similarity of the texts' whole sets of shingles; pairs whose sets
cannot share as many, by the number of shingles that either has in each of some
bins, are left out before, so that few sets move.

The trees join large groups cheaply and need not find every pair: what they miss is
found by an exact filter.  Sets as similar as that share one of the few shingles
that come first in any common order, here from rare to frequent.  Documents that
share one and are in different groups so far are compared, unless the places of the
shingle rule a similar pair out; a shingle of many documents is dealt by pairs of
blocks, and one whose documents are all in one group is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small
from .components import components
from .simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BITS = 256
#: Sets of bits that key shards: more of them leave less to the exact filter, the result is the same.
BANDS = 16
#: Fingerprints that one tree is given, about; a shard of more is dealt to several trees.
TREE_ROWS = 32_768
#: Differing bits among the first 64 up to which fingerprints link in a tree: 3.6 standard deviations.
RADIUS = 20
#: Documents from which the order of shingles is drawn, about, and frequent shingles kept; any
#: order finds the same pairs, a better one compares less.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 200_000
#: Documents of a shingle above which they are dealt by pairs of blocks.
BLOCK = 1024
#: The count that stands for any from it on in a bin.
MOST = 255
#: Pairs that the filter looks at together.
CHUNK_PAIRS = 200_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # so many still count in a byte
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(0, dtype=np.uint8)
    return total


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: the hashes and three mixes of them."""
    parts = [hashes]
    for m in _MIX:
        x = (hashes ^ (hashes >> np.uint64(32))) * m
        parts.append(x ^ (x >> np.uint64(29)))
    return b"".join(np.packbits(bit_counts(p) * 2 > len(hashes), bitorder="little").tobytes() for p in parts)


def tokens_of(hashes: np.ndarray) -> np.ndarray:
    """Shingles as the filter has them: equal ones are equal, and few others."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def least_shared(n: int | np.ndarray, similarity: float) -> int | np.ndarray:
    """Shingles that two sets as similar share at least, ``n`` in all of both."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9).astype(int)


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Tokens of the first shingles by (frequency, hash): any set as similar has one of its own first ones among them."""
    short, (known, counts) = tokens_of(hashes), often
    frequency = np.zeros(len(short), np.int64)
    if len(known) and len(short):
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        frequency = np.where(known[at] == short, counts[at], 0)
    first = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return short[np.lexsort((hashes, frequency))[:first]]


def binned(hashes: np.ndarray) -> bytes:
    """How many of the hashes are in each bin, up to MOST: half as many bins as hashes at least, a power of two."""
    bins = 1 << max(4, (len(hashes) // 2).bit_length())
    return np.minimum(np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins), MOST).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, na: int, b: bytes, nb: int, similarity: float) -> bool:
    """Whether sets of ``na`` and ``nb`` hashes may be as similar, by their bins; never false of a pair that is."""
    few, many = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if few.max() == MOST or many.max() == MOST:
        return True
    # bins are remainders, so that those of the larger number fall together
    return bool(np.minimum(few, many.reshape(-1, len(few)).sum(0)).sum() >= least_shared(na + nb, similarity))


def signature(
    text: str | None, often: tuple[np.ndarray, np.ndarray], words: int = WORDS, similarity: float = SIMILARITY
) -> tuple[bytes, bytes, int, bytes, bytes]:
    """128 bits of hash of the word sequence, wide fingerprint, number of distinct shingles, first tokens, bins."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.unique(shingle_hashes(text, words))
    return xxhash.xxh3_128_digest(b" ".join(found)), wide_fingerprint(hashes), len(hashes), prefix(hashes, often, similarity).tobytes(), binned(hashes)


def jaccard(a: bytes, na: int, b: bytes, nb: int) -> float:
    """Similarity of two sets of ``na`` and ``nb`` hashes, whole and each hash once."""
    x, y = (np.frombuffer(v, f"u{len(v) // n}") if n else np.empty(0, np.uint64) for v, n in ((a, na), (b, nb)))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, na + nb - both)


def bands(rows: int, n: int = BANDS) -> np.ndarray:
    """Sets of bits that key shards, one per row; wider ones for more documents."""
    width = min(40, max(16, math.ceil(math.log2(max(rows, 1))) - 2))
    rng = np.random.default_rng(7)
    return np.stack([np.sort(rng.choice(BITS, width, replace=False)) for _ in range(n)])


class Representatives:
    """BK-tree whose search gives the nearest value within a radius."""

    def __init__(self):
        self.root = None

    def nearest(self, value: int, radius: int) -> tuple[int, int] | None:
        """(distance, node) of the nearest."""
        best, open_ = None, [self.root] if self.root else []
        while open_:
            own, node, children = open_.pop()
            d = (own ^ value).bit_count()
            if d <= radius and (best is None or (d, node) < best):
                best = (d, node)
            if children:
                open_ += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return best

    def add(self, value: int, node: int) -> None:
        if self.root is None:
            self.root = (value, node, {})
            return
        at = self.root
        while (child := at[2].get(d := (at[0] ^ value).bit_count())) is not None:
            at = child
        at[2][d] = (value, node, {})


def _tree_links(dealt: DataFrame, radius: int) -> DataFrame:
    """``key, node, fp, other`` of ``dealt(key, tree, node, fp)``: the nearest representative, of a representative itself."""

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = (1 << 64) - 1
        current, tree = None, Representatives()
        for frame in frames:
            others = []
            for key, part, node, fp in zip(*(frame[c].tolist() for c in ("key", "tree", "node", "fp"))):
                if (key, part) != current:
                    current, tree = (key, part), Representatives()
                near = tree.nearest(fp & mask, radius)
                if near is None:
                    tree.add(fp & mask, node)
                others.append(node if near is None else near[1])
            yield frame[["key", "node", "fp"]].assign(other=np.array(others, np.int64))

    # in another order in each shard, so that representatives differ
    by_tree = dealt.repartition("key", "tree").sortWithinPartitions("key", "tree", F.xxhash64("key", "node"))
    return by_tree.select("key", "tree", "node", "fp").mapInPandas(linked, "key long, node long, fp long, other long")


def shard_links(dealt: DataFrame, radius: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links ``node, other`` of ``dealt(key, node, fp)``; only representatives are held."""
    large = F.broadcast(dealt.groupBy("key").count().where(F.col("count") > tree_rows))  # at most rows / tree_rows keys a band
    dealt = dealt.join(large, "key", "left")
    tree = F.coalesce(F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("count") / tree_rows)), F.lit(0)).cast("long")
    links = materialize(_tree_links(dealt.withColumn("tree", tree), radius), "trees", free=True)
    heads = links.where("node = other").join(large.select("key"), "key", "left_semi").withColumn("tree", F.lit(0).cast("long"))
    return links.union(_tree_links(heads, radius)).where("node != other").select("node", "other")


def frequent_shingles(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that are in more than one document of a sample, and in how many."""
    grain = 1 << 30
    share = min(grain, grain * ORDER_DOCS // max(1, docs.count()))

    @F.pandas_udf("array<long>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(tokens_of(shingle_hashes(t, words))).astype(np.int64) for t in texts], dtype=object)

    sample = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(grain)) < share).distinct()
    counts = sample.select(F.explode(tokens("text")).alias("token")).groupBy("token").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "token").limit(ORDER_SHINGLES).toPandas().sort_values("token")
    return rows["token"].to_numpy().astype(np.uint32), rows["count"].to_numpy().astype(np.int64)


def filtered_pairs(rows: pd.DataFrame, similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs ``node, other`` of ``rows`` sorted by cell that may be similar: whole cells, pairs of different groups only."""
    rows = rows.sort_values(["cell", "group"], kind="stable", ignore_index=True)
    cell, node, group, n, pos, block = (rows[c].to_numpy() for c in ("cell", "node", "group", "n", "pos", "block"))
    mixed = rows["mixed"].to_numpy()
    edge = np.concatenate(([True], (cell[1:] != cell[:-1]) | (group[1:] != group[:-1])))
    begin = np.flatnonzero(edge)
    # a row meets what comes after its group in its cell
    first = np.append(begin[1:], len(rows))[np.cumsum(edge) - 1]
    total = np.cumsum(np.searchsorted(cell, cell, side="right") - first)
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + CHUNK_PAIRS, side="right")))
        sizes = np.diff(total[at:end], prepend=done)
        a = np.repeat(np.arange(at, end), sizes)
        b = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[a]
        # if this is the first shingle that both have, they share no more than the rest of either
        fits = (~mixed[a] | (block[a] != block[b])) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least_shared(n[a] + n[b], similarity))
        x, y = node[a[fits]], node[b[fits]]
        if len(x):
            yield pd.DataFrame(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0), columns=["node", "other"])
        at = end


def prefix_pairs(firsts: DataFrame, similarity: float) -> DataFrame:
    """Distinct ``node, other`` of ``firsts(node, group, n, first)`` that may be similar and have different groups."""

    @F.pandas_udf("array<long>")
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for firsts in batches:
            yield pd.Series([np.frombuffer(f, np.uint32).astype(np.int64) for f in firsts], dtype=object)

    dealt = firsts.where("n > 0").select("node", "group", "n", F.posexplode(unpacked("first")).alias("pos", "token"))
    tokens = dealt.groupBy("token").agg(F.count("*").alias("count"), F.min("group").alias("least"), F.max("group").alias("most"))
    tokens = materialize(tokens.where("least != most").select("token", "count"), "tokens", free=True)
    shared = materialize(dealt.join(tokens, "token").select("token", "count", "node", "group", "n", "pos"), "shared", free=True)
    # every pair of blocks is a cell, so that all of a frequent shingle's documents still meet
    blocks = F.ceil(F.col("count") / BLOCK)
    cut = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "token"), F.col("blocks")))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64("token", F.least("block", "with"), F.greatest("block", "with")).alias("cell")
    cells = cut.select(cell, "node", "group", "n", "pos", "block", (F.col("block") != F.col("with")).alias("mixed"))

    def paired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(rows):
                continue
            last = int(np.searchsorted(rows["cell"].to_numpy(), rows["cell"].iloc[-1]))
            if last:
                yield from filtered_pairs(rows.iloc[:last], similarity)
            rest = rows.iloc[last:]
        if rest is not None:
            yield from filtered_pairs(rest, similarity)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(paired, "node long, other long").where("node != other").distinct()


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` per row of ``docs``: the smallest doc_id of its group.

    Documents are linked if their words are the same, but for case and white space,
    or if the Jaccard similarity of their sets of shingles is at least
    ``similarity``.  A text of fewer words than a
    shingle is one shingle.  Null and empty texts are the same text.  Rows that
    repeat a doc_id are one document.  A row without a doc_id links by its text
    like any other, is never the smallest, and has a null component if all in it
    are without.  Texts are compared whole at any length.  Other columns are not
    read; an empty table gives no rows.
    """
    release(docs.sparkSession)
    often = frequent_shingles(docs, text, words)
    release(docs.sparkSession)

    @F.pandas_udf("same binary, wide binary, n int, first binary, bins binary")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([signature(t, often, words, similarity) for t in texts], columns=["same", "wide", "n", "first", "bins"])

    # rows have a number, once written: a class of equal texts is the number of one of its rows
    signs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = signs.select("doc_id", "text", signed(F.col("text")).alias("s"), F.monotonically_increasing_id().alias("row"))
    signs = materialize(signs.select("doc_id", "text", "row", "s.*"), "signs")
    classes = signs.groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes", free=True)
    firsts = materialize(signs.select(F.col("row").alias("node"), "wide", "n", "first", "bins").join(classes.select("node"), "node", "left_semi"), "firsts", free=True)
    chosen = bands(classes.count())

    @F.pandas_udf("fp long, keys array<long>")
    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        power = np.left_shift(np.int64(1), np.arange(chosen.shape[1], dtype=np.int64))
        for wides in batches:
            raw = np.frombuffer(b"".join(wides), np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
            keys = np.stack([(bits[:, b] @ power) | (n << 48) for n, b in enumerate(chosen)], axis=1)
            yield pd.DataFrame({"fp": np.ascontiguousarray(raw[:, :8]).view(np.int64).reshape(-1), "keys": list(keys)})

    dealt = firsts.where("n > 0").select("node", keyed("wide").alias("k"))
    dealt = materialize(dealt.select("node", F.col("k.fp").alias("fp"), F.explode("k.keys").alias("key")), "dealt")
    links = materialize(shard_links(dealt, RADIUS).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct(), "links")

    @F.pandas_udf("double")
    def compared(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([jaccard(*x) for x in zip(a, na, b, nb)], dtype=float)

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*x, similarity) for x in zip(a, na, b, nb)], dtype=bool)

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts], dtype=object)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of at least the similarity, by the whole sets of the documents in pairs that may be."""
        counts = firsts.select("node", "bins", "n")
        left, right = counts.toDF("node", "a", "na"), counts.toDF("other", "b", "nb")
        pairs = pairs.join(left, "node").join(right, "other").where(possible("a", "na", "b", "nb")).select("node", "other")
        pairs = materialize(pairs, "possible", free=True)
        # written first: a join that knows how few they are moves no texts
        linked = materialize(pairs.select(F.explode(F.array("node", "other")).alias("row")).distinct(), "linked")
        texts = signs.select("row", "text").join(small(linked), "row", "left_semi")
        sets = materialize(texts.select("row", hashed("text").alias("set")).withColumn("n", (F.length("set") / 8).cast("int")), "sets", free=True)
        left = sets.select(F.col("row").alias("node"), F.col("set").alias("a"), F.col("n").alias("na"))
        right = sets.select(F.col("row").alias("other"), F.col("set").alias("b"), F.col("n").alias("nb"))
        found = pairs.join(left, "node").join(right, "other").where(compared("a", "na", "b", "nb") >= similarity)
        return materialize(found.select("node", "other").distinct(), "verified", free=True)

    near = components(verified(links))
    grouped = firsts.join(near, "node", "left").select("node", F.coalesce("root", "node").alias("group"), "n", "first")
    pairs = materialize(prefix_pairs(grouped, similarity), "pairs", free=True)
    # rows that repeat a doc_id connect what they are copies of
    owned = signs.where("doc_id IS NOT NULL").select("doc_id", "same")
    twice = owned.groupBy("doc_id").agg(F.count_distinct("same").alias("n")).where("n > 1").select("doc_id")
    again = owned.join(twice, "doc_id", "left_semi").join(classes, "same").select("doc_id", "node")
    again = again.join(again.groupBy("doc_id").agg(F.min("node").alias("other")), "doc_id").select("node", "other")
    roots = components(near.select("node", F.col("root").alias("other")).union(verified(pairs)).union(again))
    rooted = classes.join(roots, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root"))
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_class = materialize(rooted.join(least, "root").select("same", "component_id"), "components")
    return signs.select("doc_id", "same").join(of_class, "same").select("doc_id", "component_id")
