"""Exact top-k search: BM25 over inverted indexes of shards, pruned by block maxima and pivots.

All documents are tokenised once and written, whatever the number of queries.  The
number of documents, their mean length and each word's document frequency are
counted over all of them.  A shard is what one task reads, up to SHARD_DOCS and
SHARD_POSTINGS: it inverts its documents and keeps, for each word and block of
documents, the largest impact.

The commonest words of a shard are added for many queries at once, by a matrix
product.  A query then adds up its other words' lists, the words with the largest
impacts first, short lists together.  Scores only grow, so the k-th best so far is a threshold.  Once the words that are left
could not bring in a document alone, pivots are looked for as in block-max WAND: only
a document whose score so far, with its block's largest impacts of the words that are
left, reaches the threshold.  If pivots are few, they alone are scored to the end,
from their own words, and the lists that are left are never read.  The best of
all shards are merged; since statistics are global, the result is that of one index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ranges, table

K, K1, B = 10, 1.2, 0.75
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
BLOCK_DOCS = 64
#: Words in at least one of so many documents of a shard are added by a matrix product, for
#: so many queries at once, and no more words than this, nor impacts (8 bytes each).
COMMON, QUERY_ROWS, COMMON_WORDS, COMMON_IMPACTS = 32, 64, 384, 4_000_000
#: Lists shorter than this are added several at once.
SHORT = 256
#: Different words of queries that are searched at once (16 bytes each, on every executor);
#: more queries go in further blocks.
BLOCK_TERMS = 2_000_000
#: Scores have six digits; what rounding could lift is not pruned.
DIGITS, ROUNDING = 6, 1e-6


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the different words of a text, A-Z lower-cased, their numbers, and all words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    terms, counts = np.unique(hashes, return_counts=True)
    return terms, counts.astype(np.uint32), len(words)


class Shard:
    """Inverted index of some documents, with block maxima."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float):
        # documents with the same most frequent word stand together, so that bounds are tight
        lead = np.array([t[c.argmax()] if len(t) else 0 for t, c in zip(terms, counts)], np.int64)
        place = np.lexsort((ids, lead))
        self.ids, lengths = ids[place], lengths[place]
        terms, counts = [terms[i] for i in place], [counts[i] for i in place]
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        term = np.concatenate([np.empty(0, np.uint32), *terms]).astype(np.int64)
        tf = np.concatenate([np.empty(0, np.uint32), *counts]).astype(float)
        norm = K1 * (1 - B + B * lengths / mean)
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        #: Words and impacts of each document.
        self.words, self.own = term, impact
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort(term, kind="stable")
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        #: Where the list of each word begins.
        self.lists = np.searchsorted(term, np.arange(len(idf) + 1))
        self.blocks = -(-len(ids) // BLOCK_DOCS)
        self.block_of = np.arange(len(ids)) // BLOCK_DOCS
        key = term * self.blocks + self.doc // BLOCK_DOCS
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        #: Largest impacts by word and block, where the blocks of each word begin, and the largest of all its blocks.
        self.block = (key[begin] % max(1, self.blocks)).astype(np.int64)
        self.most = np.maximum.reduceat(self.impact, begin) if len(key) else self.impact
        self.runs = np.searchsorted(term[begin], np.arange(len(idf) + 1))
        self.top = np.zeros(len(idf))
        np.maximum.at(self.top, term[begin], self.most)
        self.weight_of = np.zeros(len(idf))
        size = np.diff(self.lists)
        common = np.flatnonzero(size * COMMON >= max(1, len(ids)))
        common = common[np.argsort(-size[common], kind="stable")[: min(COMMON_WORDS, COMMON_IMPACTS // max(1, len(ids)))]]
        #: Row of each common word among the impacts of the common words, by document; -1: not common.
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.impacts = np.zeros((len(common), len(ids)))
        for n, (b, e) in enumerate(zip(self.lists[common].tolist(), self.lists[common + 1].tolist())):
            self.impacts[n, self.doc[b:e]] = self.impact[b:e]
        #: Postings of the words of all queries so far, and those that were read.
        self.postings, self.read = 0, 0

    def begun(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of all documents by the common words of each query ``(terms, weights)``."""
        weights = np.zeros((len(asked), len(self.impacts)))
        for n, (terms, own) in enumerate(asked):
            row = self.row[terms]
            weights[n, row[row >= 0]] = own[row >= 0]
        # queries of one language, say, share few of the others' words
        used = np.flatnonzero(weights.any(0))
        return weights[:, used] @ self.impacts[used]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None, score: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The k best (doc_id, score), by rounded score and then doc_id; documents with no word in common have no score.

        ``score`` is what ``begun`` gives for the query; without it common words are added like others.
        """
        some = self.lists[terms + 1] > self.lists[terms]
        order = np.argsort(-self.top[terms[some]] * weights[some], kind="stable")
        terms, weights = terms[some][order], weights[some][order]
        if not len(terms):
            return []
        every = terms, weights
        if score is None:
            score = np.zeros(len(self.ids))
        else:
            rare = self.row[terms] < 0
            added = int((self.lists[terms + 1] - self.lists[terms])[~rare].sum())
            self.postings += added
            self.read += added
            terms, weights = terms[rare], weights[rare]
        begin, sizes = self.lists[terms], self.lists[terms + 1] - self.lists[terms]
        left = np.cumsum((self.top[terms] * weights)[::-1])[::-1]
        reads = np.cumsum(sizes)
        total = int(sizes.sum())
        self.postings += total
        own = np.flatnonzero(self.ids == skip) if skip is not None else np.empty(0, np.int64)
        read, look, i = 0, total // 4, 0
        found = None
        while i < len(terms):
            if read > look:
                look = read * 2
                found = self._pivots(score, terms[i:], weights[i:], left[i], own, k, total - read)
                if found is not None:
                    score = self._scored(found, *every)
                    break
            # as far as pivots are looked for next
            j = min(int(np.searchsorted(reads, look, "right")) + 1, len(terms))
            self._add(score, begin[i:j], sizes[i:j], weights[i:j])
            read, i = int(reads[j - 1]), j
        self.read += read
        if found is None:
            found = np.flatnonzero(score)
            score = score[found]
        # what is left out comes before what is cut
        if len(own):
            other = ~np.isin(found, own)
            found, score = found[other], score[other]
        if len(found) > k:
            near = score >= np.partition(score, -k)[-k] - ROUNDING
            found, score = found[near], score[near]
        best = sorted((-round(s, DIGITS), d) for s, d in zip(score.tolist(), self.ids[found].tolist()))[:k]
        return [(d, -s) for s, d in best]

    def _add(self, score: np.ndarray, begin: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> None:
        """Add lists to the scores."""
        short = sizes < SHORT
        if short.any():
            at = ranges(begin[short], sizes[short])
            score += np.bincount(self.doc[at], weights=self.impact[at] * np.repeat(weights[short], sizes[short]), minlength=len(score))
        long = ~short
        for b, n, w in zip(begin[long].tolist(), sizes[long].tolist(), weights[long].tolist()):
            # a document is in a list once
            score[self.doc[b : b + n]] += w * self.impact[b : b + n]

    def _pivots(self, score: np.ndarray, terms: np.ndarray, weights: np.ndarray, left: float, own: np.ndarray, k: int, postings: int) -> np.ndarray | None:
        """Documents that the words that are left could lift to the threshold, if they have fewer words than the lists that are left."""
        if len(score) <= k + len(own):
            return None
        others = score
        if len(own):
            others = score.copy()
            others[own] = 0
        least = np.partition(others, -k)[-k] - 2 * ROUNDING
        if left >= least:
            return None
        sizes = self.runs[terms + 1] - self.runs[terms]
        runs = ranges(self.runs[terms], sizes)
        rest = np.bincount(self.block[runs], weights=self.most[runs] * np.repeat(weights, sizes), minlength=self.blocks)
        found = np.flatnonzero(score + rest[self.block_of] >= least)
        return found if 2 * int((self.first[found + 1] - self.first[found]).sum()) <= postings else None

    def _scored(self, found: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from their own words."""
        sizes = self.first[found + 1] - self.first[found]
        at = ranges(self.first[found], sizes)
        self.weight_of[terms] = weights
        score = np.bincount(np.repeat(np.arange(len(found)), sizes), weights=self.own[at] * self.weight_of[self.words[at]], minlength=len(found))
        self.weight_of[terms] = 0
        self.read += len(at)
        return score


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", skip_self: bool = True, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the k best documents of each query ``(query_id, text)``.

    A word that a query repeats counts as often.  Scores are rounded to 6 digits
    and equal ones go by the smaller doc_id.  ``skip_self`` leaves the documents of
    a query's own id out.

    Null and empty texts match nothing, on either side; a query with fewer matching
    documents than k has fewer rows.  Rows with a null id are neither found nor
    asked.  Rows that repeat a doc_id compete each; rows that repeat a query_id are
    one query of all their words.  Texts are whole at any length.  Other columns
    are not read.  An empty table, on either side, gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").where("query_id IS NOT NULL")
    queries = queries.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, *(x.tobytes() for x in term_counts(t)[:2])) for q, t in zip(frame["query_id"], frame["text"])]
            yield pd.DataFrame(rows, columns=["query_id", "terms", "counts"])

    asked_df = materialize(queries.mapInPandas(asked, "query_id long, terms binary, counts binary"), "asked")

    def tokenised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                terms, counts, n = term_counts(text)
                rows.append((doc, n, terms.tobytes(), counts.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])

    forward = materialize(docs.mapInPandas(tokenised, "doc_id long, n long, terms binary, counts binary"), "forward")
    sizes = forward.agg(F.count("*"), F.sum("n")).first()
    size = asked_df.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    blocks = max(1, -(-size // (8 * block_terms)))
    found = []
    for n in range(blocks):
        rows = asked_df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        asked_now = [(r["query_id"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.uint32)) for r in rows]
        found.append(_search_block(forward, sizes, asked_now, k, skip_self))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _known(words: np.ndarray, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms are among the words, and their places there."""
    terms = np.frombuffer(terms, np.uint64)
    if not len(words):
        return np.zeros(len(terms), bool), np.empty(0, np.uint32)
    at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
    same = words[at] == terms
    return same, at[same].astype(np.uint32)


def _search_block(forward: DataFrame, sizes: tuple, asked: list[tuple], k: int, skip_self: bool) -> DataFrame:
    spark = forward.sparkSession
    words = np.unique(np.concatenate([np.empty(0, np.uint64), *(t for _, t, _ in asked)]))
    shared = spark.sparkContext.broadcast(words)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(shared.value), np.int64)
        for frame in frames:
            for terms in frame["terms"]:
                seen[_known(shared.value, terms)[1]] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": at, "df": seen[at]})

    frequency = np.zeros(len(words), np.int64)
    for r in forward.select("terms").mapInPandas(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas().itertuples():
        frequency[r.term] = r.df
    mean = max(1e-9, (sizes[1] or 0) / max(1, sizes[0]))
    idf = np.log(1 + (sizes[0] - frequency + 0.5) / (frequency + 0.5))
    placed = [(q, np.searchsorted(words, t), c.astype(float)) for q, t, c in asked]
    # queries with the same most common word stand together
    placed.sort(key=lambda x: int(x[1][frequency[x[1]].argmax()]) if len(x[1]) else -1)
    model = spark.sparkContext.broadcast((placed, idf, mean))

    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked_, idf_, mean_ = model.value

        def answer(held: list[tuple]) -> pd.DataFrame:
            ids, lengths, terms, counts = zip(*held)
            shard = Shard(np.array(ids, np.int64), np.array(lengths, np.int64), list(terms), list(counts), idf_, mean_)
            rows = []
            for at in range(0, len(asked_), QUERY_ROWS):
                some = asked_[at : at + QUERY_ROWS]
                for (q, t, c), begun in zip(some, shard.begun([x[1:] for x in some])):
                    rows += [(q, d, s) for d, s in shard.search(t, c, k, q if skip_self else None, begun)]
            return pd.DataFrame(rows, columns=["query_id", "doc_id", "score"]).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})

        held, postings = [], 0
        for frame in frames:
            for doc, n, terms, counts in zip(frame["doc_id"], frame["n"], frame["terms"], frame["counts"]):
                same, at = _known(shared.value, terms)
                held.append((doc, n, at, np.frombuffer(counts, np.uint32)[same]))
                postings += len(at)
                if len(held) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield answer(held)
                    held, postings = [], 0
        if held:
            yield answer(held)

    return forward.mapInPandas(searched, "query_id long, doc_id long, score double")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents
), bags AS (
  SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf) AS n FROM bags GROUP BY doc_id
), corpus AS (
  SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM lengths) / (SELECT count(*) FROM documents) AS mean
), idf AS (
  SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM bags, corpus GROUP BY w, docs
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM bags q JOIN bags d ON q.w = d.w JOIN idf ON idf.w = q.w JOIN lengths l ON l.doc_id = d.doc_id, corpus
  WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""
