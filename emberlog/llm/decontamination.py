"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of six words at fixed offsets; words between them may differ.
Every alignment of 13 words with at most two substitutions agrees in all six
words of one of the two masks, somewhere.  Seeds of the benchmark are joined with
those of all documents, and around each hit the words are compared: a document
is contaminated where 13 consecutive aligned words agree in at least 11.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ranges, table

SPAN, AGREE = 13, 11
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Words of the benchmark that go to every executor at once; a larger one goes in blocks.
BLOCK_WORDS = 2_000_000
#: Bits of the filter that tells which texts any block must look at (as its logarithm).
FILTER_BITS = 27
#: Hits, and words around them, that are looked at together.
CHUNK = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = string.punctuation.encode()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, without ASCII punctuation at the ends."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w.strip(_PUNCTUATION) or w) for w in words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each position where the mask fits; seeds of different masks differ."""
    n = len(words) - mask[-1]
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask) * 1009 + sum(at * at for at in mask), np.uint64)
    for at in mask:
        h = (h ^ words[at : at + n]) * ODD
        h ^= h >> np.uint64(32)
    return h


class SeedBlock:
    """Seeds of some benchmark items, sorted, behind a table of their leading bits."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [word_hashes(t) for _, t in items]
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: items of fewer words than the span must occur whole
        self.masks = [*MASKS, *sorted({tuple(range(len(w))) for w in words if 0 < len(w) < SPAN})]
        hashes, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, w in enumerate(words):
            for mask in MASKS if len(w) >= SPAN else [tuple(range(len(w)))] if len(w) else []:
                h = seeds(w, mask)
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        self.hashes = np.concatenate(hashes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owner, self.place = self.hashes[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of the words that the block has, and where they are."""
        hashes, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for mask in self.masks:
            h = seeds(words, mask)
            near = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
            hashes.append(h[near])
            at.append(near)
        h, p = np.concatenate(hashes), np.concatenate(at)
        known = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), bool)
        return h[known], p[known]

    def agreement(self, words: np.ndarray, items: np.ndarray, diagonals: np.ndarray, most: np.ndarray) -> None:
        """Raise ``most`` of the items to the most words that agree in a span along the diagonals."""
        low, high = np.maximum(0, -diagonals), np.minimum(self.sizes[items], len(words) - diagonals)
        spans = np.minimum(SPAN, self.sizes[items])
        some = high - low >= spans
        items, diagonals, low, spans, sizes = items[some], diagonals[some], low[some], spans[some], (high - low)[some]
        total = np.cumsum(sizes)
        at = 0
        while at < len(items):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
            part = slice(at, end)
            own = ranges(self.begins[items[part]] + low[part], sizes[part])
            same = self.words[own] == words[ranges(low[part] + diagonals[part], sizes[part])]
            agreed = np.concatenate(([0], np.cumsum(same)))
            windows = sizes[part] - spans[part] + 1
            first = ranges(np.cumsum(sizes[part]) - sizes[part], windows)
            counts = agreed[first + np.repeat(spans[part], windows)] - agreed[first]
            np.maximum.at(most, items[part], np.maximum.reduceat(counts, np.cumsum(windows) - windows))
            at = end

    def overlaps(self, text: str | None) -> dict[int, int]:
        """Item: the most words that agree in one aligned span, for items that overlap.

        An item that agrees in a whole span is settled: no other diagonal can raise
        it.  So the first place of each seed in the text is tried against all of
        the block before the other places are, with the items still open.
        """
        words = word_hashes(text)
        h, p = self.found(words)
        if not len(h):
            return {}
        most = np.zeros(len(self.sizes), np.int64)
        unique, first, of = np.unique(h, return_index=True, return_inverse=True)
        low = np.searchsorted(self.hashes, unique, "left")
        sizes = np.searchsorted(self.hashes, unique, "right") - low
        entries = ranges(low, sizes)
        self._try(words, self.owner[entries], np.repeat(p[first], sizes) - self.place[entries], most)
        open_ = most[self.owner[entries]] < np.minimum(SPAN, self.sizes[self.owner[entries]])
        more = np.setdiff1d(np.arange(len(p)), first)
        if len(more) and open_.any():
            left = np.add.reduceat(open_.astype(np.int64), np.cumsum(sizes) - sizes)
            entries = entries[open_]
            begin, p, of = np.cumsum(left) - left, p[more], of[more]
            total = np.cumsum(left[of])
            at = 0
            while at < len(p):
                done = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
                which = entries[ranges(begin[of[at:end]], left[of[at:end]])]
                diagonals = np.repeat(p[at:end], left[of[at:end]]) - self.place[which]
                still = most[self.owner[which]] < np.minimum(SPAN, self.sizes[self.owner[which]])
                self._try(words, self.owner[which[still]], diagonals[still], most)
                at = end
        best: dict[int, int] = {}
        for k in np.flatnonzero(most >= np.where(self.sizes >= SPAN, AGREE, np.maximum(1, self.sizes))).tolist():
            best[self.ids[k]] = max(best.get(self.ids[k], 0), int(most[k]))
        return best

    def _try(self, words: np.ndarray, items: np.ndarray, diagonals: np.ndarray, most: np.ndarray) -> None:
        if len(items):
            shift = int(self.sizes.max())  # a diagonal is above minus the longest item
            width = shift + len(words) + 1
            pairs = np.unique(items * width + diagonals + shift)
            self.agreement(words, pairs // width, pairs % width - shift, most)


def seed_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[SeedBlock]:
    """The benchmark in blocks of bounded size, one on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect() if words else []
        yield SeedBlock(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def _judge(shared):
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [shared.value.overlaps(t) for t in texts]
            items = [sorted(i for i in r if i is not None) for r in rows]
            yield pd.DataFrame({"items": items, "n_agree": [max(r.values(), default=0) for r in rows]})

    return F.pandas_udf(judged, "items array<long>, n_agree int")


def _may_overlap(shared):
    """Whether a text has a seed whose bit is set in the filter of all blocks."""

    def looked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits, masks = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = word_hashes(text)
                slots = (seeds(words, m) >> np.uint64(64 - FILTER_BITS) for m in masks)
                rows.append(any((bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).any() for s in slots))
            yield pd.Series(rows, dtype=bool)

    return F.pandas_udf(looked, "boolean")


def with_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``contaminated``, ``items`` (ids that overlap, ascending) and ``n_agree``.

    ``n_agree`` is the most words that agree in a span of 13 with any item (of a
    shorter item: all its words), 0 if none overlaps.

    A benchmark of several blocks is first made one filter of fixed size, and only
    texts that pass it are looked up in the blocks.

    Null and empty texts, on either side, overlap nothing; items of fewer than 13
    words count where they occur whole; an item without an id counts, but is not
    listed.  Items that are repeated or share an id are listed once.  Texts of any
    length are read whole, and repeats in them cost no more than their length times
    the items that have them.  Rows and other columns stay, columns of the three
    names are replaced; an empty benchmark contaminates nothing.
    """
    context = docs.sparkSession.sparkContext
    shared, bits, masks = [], np.zeros(1 << (FILTER_BITS - 3), np.uint8), set()
    for block in seed_blocks(benchmark, block_words=block_words):
        slots = block.hashes >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(bits, slots >> np.uint64(3), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
        masks.update(block.masks)
        shared.append(context.broadcast(block))
    read = F.col(text)
    if len(shared) > 1:
        docs = docs.withColumn("__look", _may_overlap(context.broadcast((bits, sorted(masks))))(read))
        read = F.when(F.col("__look"), read)
    names = [f"__block{n}" for n in range(len(shared))]
    out = docs.withColumns({name: _judge(s)(read) for name, s in zip(names, shared)})
    items = F.array_sort(F.array_distinct(F.concat(*(F.col(f"{n}.items") for n in names))))
    agree = [F.col(f"{n}.n_agree") for n in names]
    most = F.greatest(*agree) if len(agree) > 1 else agree[0]
    return out.withColumns({"contaminated": most > 0, "items": items, "n_agree": most}).drop("__look", *names)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "n_agree")


OP8_SQL = r"""
WITH split AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), spread AS (
  SELECT side, id, len(a) AS n, unnest(a) AS w, generate_subscripts(a, 1) AS p FROM split
), words AS (
  SELECT side, id, n, p, coalesce(nullif(trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'), ''), w) AS w FROM spread
), same AS (
  SELECT d.id AS doc_id, i.id AS item_id, d.p - i.p AS diagonal, d.n AS dn, i.n AS n, i.p AS q,
    count(*) OVER (PARTITION BY d.id, i.id, d.p - i.p) AS m
  FROM words d JOIN words i ON d.side = 'd' AND i.side = 'i' AND d.w = i.w
), few AS (
  SELECT *, least(13, n) AS span, greatest(1, 1 - diagonal) AS low, least(n, dn - diagonal) AS high FROM same WHERE m >= least(11, n)
), starts AS (
  SELECT DISTINCT doc_id, item_id, diagonal, span, n, least(q, high - span + 1) AS s FROM few WHERE least(q, high - span + 1) >= low
), agree AS (
  SELECT doc_id, item_id, count(*) AS k, any_value(span) AS span FROM starts JOIN few USING (doc_id, item_id, diagonal, span, n)
  WHERE q BETWEEN s AND s + span - 1 GROUP BY doc_id, item_id, diagonal, s
), best AS (
  SELECT doc_id, item_id, max(k) AS k FROM agree WHERE k >= CASE WHEN span < 13 THEN span ELSE 11 END GROUP BY doc_id, item_id
), found AS (
  SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(k) AS k FROM best GROUP BY doc_id
)
SELECT doc_id, k IS NOT NULL AS contaminated, coalesce(items, '') AS items, coalesce(k, 0)::INTEGER AS n_agree
FROM documents LEFT JOIN found USING (doc_id)
"""
