"""Substring dedup over a log-structured index of window hashes.

A batch of documents becomes sorted immutable runs: all windows of its texts,
sorted by hash, the least document of each hash, packed in columns (differences
of sorted hashes, then byte planes).  Runs are dealt out by the leading bits of
the hash.  Where the runs of one such bucket meet, they are merge-joined: equal
hashes are verified by a second hash from another mix of the word hashes, and a
window whose least document is smaller answers back to the documents that hold
it.  What a batch can decide by itself (a window in several of its documents) it
answers at once and sends on only for the least of them, so that a passage that
very many documents share weighs one row per batch.

Merged runs can be kept (``compacted``) and given as history to a later batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 13
#: Windows that a batch gathers before it is sorted into runs (about 60 bytes each).
BATCH_WINDOWS = 1_500_000
#: Buckets that runs are dealt to, at least, and bytes of text that one is made for: a bucket is
#: merged in memory, so that there are as many more as there is more text.
LEAST_BUCKETS, BUCKET_BYTES = 64, 16 << 20
NO_DOC = (1 << 63) - 1
RUN = "bucket int, run binary, doc_id long, seq long, at array<int>"
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD2
    return x ^ (x >> np.uint64(29))


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and an independent 16-bit check of each window of consecutive words."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    other = _mixed(own * ODD)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(window):
        a = a * ODD + own[j : j + n]
        b = b * ODD2 + other[j : j + n]
    return _mixed(a), (_mixed(b) >> np.uint64(48)).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, dtype: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(dtype).reshape(n)


def packed(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, seqs: np.ndarray, at: np.ndarray) -> bytes:
    """A run sorted by hash as bytes."""
    known, index = np.unique(np.stack([docs, seqs]), axis=1, return_inverse=True)
    parts = [np.diff(hashes, prepend=np.uint64(0)), checks, index.reshape(-1).astype(np.uint32), at.astype(np.uint32), np.diff(known[0], prepend=0), known[1]]
    head = np.array([len(hashes), known.shape[1]], np.uint32).tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, parts)))


def unpacked(run: bytes) -> tuple[np.ndarray, ...]:
    n, m = map(int, np.frombuffer(run[:8], np.uint32))
    raw, at, out = zstandard.ZstdDecompressor().decompress(run[8:]), 0, []
    for dtype, rows in (("u8", n), ("u2", n), ("u4", n), ("u4", n), ("i8", m), ("i8", m)):
        size = np.dtype(dtype).itemsize * rows
        out.append(_unplaned(raw[at : at + size], dtype, rows))
        at += size
    hashes, checks, index, places, docs, seqs = out
    return np.cumsum(hashes, dtype=np.uint64), checks, np.cumsum(docs)[index], seqs[index], places.astype(np.int64)


def _by_hash(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and where in it a new (hash, check) begins."""
    order = np.argsort(hashes)
    h, c = hashes[order], checks[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return order, np.concatenate(([True], ~same))


def _answers(docs: np.ndarray, seqs: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Rows (doc_id, seq, places)."""
    if not len(docs):
        return []
    order = np.lexsort((at, seqs, docs))
    d, s, p = docs[order], seqs[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]))))
    return [(int(d[i]), int(s[i]), x) for i, x in zip(begin, np.split(p.astype(np.int32), begin[1:]))]


def _frame(runs: list[tuple], answers: list[tuple], buckets: int) -> pd.DataFrame:
    """Rows of both kinds; numbers are never null, as pandas would make them floats and large ids would change."""
    rows = [(b, r, 0, 0, None) for b, r in runs] + [((x[0] ^ x[1]) % buckets, None, *x) for x in answers]
    return pd.DataFrame(rows, columns=["bucket", "run", "doc_id", "seq", "at"]).astype({"bucket": "int32", "doc_id": "int64", "seq": "int64"})


def window_runs(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Runs of ``docs(doc_id, seq, text)`` by bucket, and what batches answer by themselves."""

    def batch(parts: list[tuple]) -> pd.DataFrame:
        hashes, checks = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sizes = [len(p[0]) for p in parts]
        docs_, seqs = np.repeat(np.array([p[2] for p in parts], np.int64), sizes), np.repeat(np.array([p[3] for p in parts], np.int64), sizes)
        at = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])
        order, new = _by_hash(hashes, checks)
        hashes, checks, docs_, seqs, at = hashes[order], checks[order], docs_[order], seqs[order], at[order]
        least = np.minimum.reduceat(docs_, np.flatnonzero(new))[np.cumsum(new) - 1]
        mine = docs_ == least
        answers = _answers(docs_[~mine], seqs[~mine], at[~mine])
        hashes, checks, docs_, seqs, at = hashes[mine], checks[mine], docs_[mine], seqs[mine], at[mine]
        cuts = np.searchsorted(hashes, [np.uint64((b << 64) // buckets) for b in range(1, buckets)])
        runs = []
        for b, part in enumerate(np.split(np.arange(len(hashes)), cuts)):
            if len(part):
                k = slice(part[0], part[-1] + 1)
                runs.append((b, packed(hashes[k], checks[k], docs_[k], seqs[k], at[k])))
        return _frame(runs, answers, buckets)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for frame in frames:
            for doc, seq, text in zip(frame["doc_id"].tolist(), frame["seq"].tolist(), frame["text"]):
                hashes, checks = window_hashes((text or "").encode("utf-8", "surrogatepass").split(), window)
                if len(hashes):
                    parts.append((hashes, checks, doc, seq))
                    held += len(hashes)
                if held >= BATCH_WINDOWS:
                    yield batch(parts)
                    parts, held = [], 0
        if parts:
            yield batch(parts)

    return docs.select("doc_id", "seq", "text").mapInPandas(runs, RUN)


def merge_joined(runs: DataFrame) -> DataFrame:
    """``doc_id, seq, at``: windows that also start in a smaller document.

    Answers that a batch gave by itself travel with the runs and pass through, so
    that the texts are hashed once.
    """

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        ready = frame[frame["run"].isna()]
        rows = list(zip(ready["doc_id"].astype("int64"), ready["seq"].astype("int64"), ready["at"]))
        if len(ready) < len(frame):
            hashes, checks, docs, seqs, at = (np.concatenate(x) for x in zip(*map(unpacked, frame["run"].dropna())))
            order, new = _by_hash(hashes, checks)
            least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            late = order[docs[order] > least]
            rows += _answers(docs[late], seqs[late], at[late])
        return pd.DataFrame(rows, columns=["doc_id", "seq", "at"]).astype({"doc_id": "int64", "seq": "int64"})

    return runs.groupBy("bucket").applyInPandas(merged, "doc_id long, seq long, at array<int>")


def compacted(runs: DataFrame) -> DataFrame:
    """``bucket, run``: one sorted run per bucket, each window once with its least document."""

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        hashes, checks, docs, seqs, at = (np.concatenate(x) for x in zip(*map(unpacked, frame["run"])))
        order, new = _by_hash(hashes, checks)
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[order], begin)
        first = order[begin]
        zero = np.zeros(len(first), np.int64)
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]], "run": [packed(hashes[first], checks[first], least, zero, zero)]})

    return runs.where("run IS NOT NULL").groupBy("bucket").applyInPandas(merged, "bucket int, run binary")


def kept_words(text: str | None, at: np.ndarray | None, window: int) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, and the words that stay."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if at is None or not len(at):
        return len(words), 0, words
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.unique(at)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return len(words), len(words) - len(stay), [words[i] for i in stay.tolist()]


def zipped(text: str) -> Column:
    """A text column as it crosses the shuffle; null stays null."""

    @F.pandas_udf("binary")
    def compressed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for texts in batches:
            yield pd.Series([None if t is None else zip_.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return compressed(F.col(text))


def unzipped(raw: bytes | None) -> str | None:
    return None if raw is None else zstandard.ZstdDecompressor().decompress(raw).decode("utf-8", "surrogatepass")


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, history: DataFrame | None = None, buckets: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, zipped, at`` per row of ``docs``: where windows start that a smaller document has too.

    ``zipped`` is the text, compressed for the way to its answers (``unzipped`` undoes it).

    ``history`` is an index that ``compacted`` made of earlier documents, over as
    many ``buckets``; windows found there count as those of a smaller document if
    their doc_id is smaller.

    Null and empty texts, and those of fewer words than a window, have no windows.
    Rows that repeat a doc_id are one document (they never remove from each
    other) and each keeps its row.  A null doc_id is above all others.  Texts are
    whole at any length; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if history is not None and buckets is None:
        raise ValueError("give the number of buckets of the history")
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.col(text).alias("text"))
    if buckets is None:
        buckets = max(LEAST_BUCKETS, (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET_BYTES)
    # rows that repeat a doc_id are told apart by their texts; equal rows have equal answers.
    # Where none does, a number less travels with the windows
    alone = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("seq", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    made = window_runs(docs, window, buckets)
    if history is not None:
        old = history.select("bucket", "run", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<int>").alias("at"))
        made = made.unionByName(old)
    # one row per document and bucket at most, of places that are no more than its words
    answers = merge_joined(made).groupBy("doc_id", "seq").agg(F.flatten(F.collect_list("at")).alias("at"))
    joined = docs.select("doc_id", "seq", zipped("text").alias("zipped")).join(answers, ["doc_id", "seq"], "left")
    return joined.select(F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), "zipped", "at")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, at in batches:
            rows = []
            for text, places in zip(texts, at):
                n, gone, words = kept_words(unzipped(text), places, WINDOW)
                rows.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", digest("zipped", "at").alias("d")).select("doc_id", "d.*")


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents
), starts AS (
  SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM split WHERE len(a) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k
), again AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + j AS p FROM again, range(13) AS t(j)
), words AS (
  SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS p FROM split
), judged AS (
  SELECT words.*, covered.p IS NOT NULL AS gone FROM words LEFT JOIN covered USING (doc_id, p)
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""
